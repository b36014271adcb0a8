"""Streams: messages, request status, metrics from finished summaries, windowed averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import message_payload, message_text
from tessera.operators.keyed import keep_first


def messages(raw: DataFrame, schema: str = "patient_id string", data: str = "data", time: str = "ts", delay: str = "1 hour", corrupt: str | None = None) -> DataFrame:
    """Payloads of base64 JSON messages, each message id once within the delay.

    In a stream, a message that comes later than `delay` behind the newest one is dropped, whether its id is new or not. A payload that
    is no JSON has null fields; with `corrupt` a column of that name says which have.
    """
    shown = [F.try_parse_json(message_text(F.col(data))).isNull().alias(corrupt)] if corrupt else []
    parsed = raw.withColumn("payload", message_payload(F.col(data), schema)).select("message_id", F.col(time).cast("timestamp").alias(time), "payload.*", *shown)
    if not raw.isStreaming:
        return keep_first(parsed, "message_id", [time])
    return parsed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["message_id"])


def request_status(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """not_started, processing, completed or failed for each key asked for."""
    done = results.select(key, F.col("status").alias("_status"))
    state = F.when(F.col("_status").isNull() & F.col("requested_at").isNull(), "not_started").when(F.col("_status").isNull(), "processing").when(F.col("_status") == "failed", "failed").otherwise("completed")
    return requests.join(done, key, "left").withColumn("state", state).drop("_status")


def window_average(events: DataFrame, time: str, value: str, width: str = "600 seconds", delay: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean value in aligned windows; with a delay, late rows are dropped by watermark, as a stream needs."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", delay) if delay else timed
    return timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.avg(value).alias("average"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "average", "n")


def threshold_alerts(averages: DataFrame, below: float | None = None, above: float | None = None) -> DataFrame:
    test = F.lit(False)
    if below is not None:
        test = test | (F.col("average") < below)
    if above is not None:
        test = test | (F.col("average") > above)
    return averages.where(test)


def summary_metrics(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of finished run summaries: files that end in summary.json."""
    return spark.readStream.schema(schema).option("multiLine", True).option("pathGlobFilter", "*summary.json").json(folder)
