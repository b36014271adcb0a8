"""Registered queries over streams, feeds and paged sources, made from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import numbering
from tessera.session import shared_folder, written
from tessera.sources.paged import PagedStudies
from tessera.sources.tables import table
from tessera.streaming import events as streams
from tessera.streaming import requests, upserts

from .catalogue import query


def _fed(spark: SparkSession, rows: DataFrame, step: str, steps: int, where: str, start: Callable[[DataFrame], StreamingQuery], after: Callable[[int], bool] = lambda n: False) -> None:
    """Write a step's rows into a folder and run the stream over what is new, step by step; every run goes on from its checkpoint.

    after(step) says whether the stream is to run once more.
    """
    schema = rows.drop(step).schema
    for n in range(steps):
        rows.where(F.col(step) == n).drop(step).write.parquet(f"{where}/feed/s{n:04d}")
        for run in range(2):
            start(spark.readStream.schema(schema).parquet(f"{where}/feed/*")).awaitTermination()
            if run or not after(n):
                break


def _forget_last_commit(spark: SparkSession, checkpoint: str) -> bool:
    """Make the last batch look as if its run had ended before it was done, so that the next run does it again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().isdigit()]
    return files.delete(jvm.org.apache.hadoop.fs.Path(where, str(max(done))), False)


def _parted(ts: str, steps: int) -> Column:
    """The step of a time among equal spans of a month."""
    days = F.datediff(F.col(ts).cast("date"), F.lit("2024-01-01").cast("date"))
    return F.least(F.greatest(F.floor(days * steps / 30), F.lit(0)), F.lit(steps - 1)).cast("int")


_STEP_SQL = "least(greatest(CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 5 / 30) AS INT), 0), 4)"


# --- keyed state ------------------------------------------------------------------------------------------------------------
@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user from a feed in four steps, out of order, with one batch done twice."""
    where = shared_folder(spark, "upsert")
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("step"))
    log = upserts.UpsertLog(spark, f"{where}/log", "user_id long, event_id long, event_type string, value double", "user_id", "event_id")

    def after(n: int) -> bool:
        if n == 2:
            log.compact()
        return n == 1 and _forget_last_commit(spark, f"{where}/checkpoint")

    _fed(spark, rows, "step", 4, where, lambda stream: upserts.run_upsert(stream, log, f"{where}/checkpoint"), after)
    return log.read()


# --- messages ---------------------------------------------------------------------------------------------------------------
@query(f"""WITH e AS (SELECT *, {_STEP_SQL} AS step FROM events),
sent AS (SELECT event_id, ts, step FROM e WHERE event_id % 11 <> 0 UNION ALL SELECT event_id, ts, step + 1 FROM e WHERE event_id % 7 = 0 AND event_id % 11 <> 0),
late AS (SELECT event_id, ts, step + 2 AS step FROM e WHERE event_id % 11 = 0),
kept AS (SELECT event_id FROM sent UNION SELECT event_id FROM late WHERE ts > (SELECT max(ts) FROM (SELECT ts, step FROM sent UNION ALL SELECT ts, step FROM late) AS s WHERE s.step < late.step) - INTERVAL 1 HOUR)
SELECT 'm' || event_id AS message_id, CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 13 <> 0 THEN value END AS value, event_id % 13 = 0 AS corrupt FROM events WHERE event_id IN (SELECT event_id FROM kept)""")
def message_feed(spark: SparkSession, d: str) -> DataFrame:
    """Base64 messages, some sent twice at once, some again with the next step, some two steps late, some no JSON."""
    where = shared_folder(spark, "messages")
    k = F.col("event_id")
    body = F.when(k % 13 == 0, F.lit("no json {")).otherwise(F.to_json(F.struct("user_id", "value")))
    sent = table(spark, d, "events").select("event_id", F.concat(F.lit("m"), k.cast("string")).alias("message_id"), F.col("ts").cast("timestamp").alias("ts"), F.base64(F.to_binary(body, F.lit("utf-8"))).alias("data"), _parted("ts", 5).alias("step"))
    steps = F.when(k % 11 == 0, F.array(F.col("step") + 2)).when(k % 7 == 0, F.array("step", F.col("step") + 1)).when(k % 5 == 0, F.array("step", "step")).otherwise(F.array("step"))
    feed = sent.withColumn("step", F.explode(steps)).drop("event_id")

    def start(raw: DataFrame) -> StreamingQuery:
        told = streams.messages(raw, "user_id long, value double", corrupt="corrupt")
        return told.writeStream.outputMode("append").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start(f"{where}/out", "parquet")

    _fed(spark, feed, "step", 7, where, start)
    return spark.read.parquet(f"{where}/out").select("message_id", "user_id", "value", "corrupt")


# --- requests and polls -----------------------------------------------------------------------------------------------------
_POLL_SQL = """WITH k AS (SELECT *, CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS told FROM events),
s AS (SELECT user_id AS key, event_id AS event, ts, event_type, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'not_started') AS state FROM k)
SELECT key, event, ts, state FROM s WHERE event_type = 'click'"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"view": "request", "purchase": "completed", "error": "failed", "click": "poll"}
    kind = F.coalesce(*(F.when(F.col("event_type") == e, F.lit(k)) for e, k in kinds.items()), F.lit("other"))
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), _parted("ts", 3).alias("step"))


@query(_POLL_SQL)
def polls_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """What each poll is answered: the state that the last request or result before it led to."""
    return requests.poll_states(_requests(spark, d).drop("step")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_POLL_SQL)
def polls_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a feed in three steps, by a state machine a user whose rows wait for the watermark."""
    where = shared_folder(spark, "polls")
    rows = _requests(spark, d)
    tick = rows.agg(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("event"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"), F.lit("tick").alias("kind"), F.lit(3).alias("step"))  # moves the watermark past the last row

    def start(raw: DataFrame) -> StreamingQuery:
        told = requests.stream_poll_states(raw, "1 hour").writeStream.outputMode("append").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
        return requests.with_state_store(spark, lambda: told.start(f"{where}/out", "parquet"))

    _fed(spark, rows.unionByName(tick), "step", 4, where, start)
    return spark.read.parquet(f"{where}/out").select("key", "event", F.col("ts").cast("timestamp_ntz").alias("ts"), "state")


# --- alerts -----------------------------------------------------------------------------------------------------------------
_ALERT_SQL = """WITH w AS (SELECT event_type AS key, time_bucket(INTERVAL '1 hour', ts) AS start, avg(value) AS average FROM events GROUP BY 1, 2),
b AS (SELECT *, lead(start) OVER (PARTITION BY key ORDER BY start) AS nxt, start - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY key, average > 55 ORDER BY start) AS island FROM w),
i AS (SELECT key, island, min(start) AS since, max(start) AS latest, count(*) AS windows, arg_max(nxt, start) AS nxt, bool_or(nxt IS NULL) AS open FROM b WHERE average > 55 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT key, since + INTERVAL 3 HOUR AS at, 'firing' AS event, since, CAST(3 AS BIGINT) AS windows FROM i UNION ALL SELECT key, latest + INTERVAL 1 HOUR, 'recovered', since, windows FROM i WHERE NOT open"""


def _plain_times(alerts: DataFrame) -> DataFrame:
    return alerts.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "event", F.col("since").cast("timestamp_ntz").alias("since"), "windows")


@query(_ALERT_SQL)
def alerts_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on three hours in a row above the limit, and their recovery."""
    hours = streams.window_average(table(spark, d, "events"), "ts", "value", "1 hour", keys=("event_type",)).withColumnRenamed("event_type", "key")
    return _plain_times(requests.sustained(hours, width="1 hour", runs=3, above=55.0))


@query(_ALERT_SQL)
def alerts_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a feed in three steps: averages closed by the watermark, then a run of windows as state of each type."""
    where = shared_folder(spark, "alerts")
    rows = table(spark, d, "events").select("event_type", "ts", "value", _parted("ts", 3).alias("step"))
    tick = rows.agg(F.lit("tick").alias("event_type"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(0.0).alias("value"), F.lit(3).alias("step"))

    def start(raw: DataFrame) -> StreamingQuery:
        hours = streams.window_average(raw, "ts", "value", "1 hour", "1 hour", ("event_type",)).withColumnRenamed("event_type", "key")
        told = requests.stream_sustained(hours, width_us=3_600_000_000, runs=3, above=55.0).writeStream.outputMode("append").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
        return requests.with_state_store(spark, lambda: told.start(f"{where}/out", "parquet"))

    _fed(spark, rows.unionByName(tick), "step", 4, where, start)
    return _plain_times(spark.read.parquet(f"{where}/out"))


# --- paged source -----------------------------------------------------------------------------------------------------------
def _write_pages(orders: DataFrame, where: str, broken: Column) -> None:
    """Pages of 200 orders a priority, as an interface answers them; one in a hundred entries is no study."""
    entry = F.when(F.col("o_orderkey") % 100 == 0, F.lit('"no study"')).otherwise(F.to_json(F.struct("o_orderkey", "o_totalprice")))
    pages = orders.groupBy("query", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", entry.alias("entry")))), lambda x: x["entry"]), ",").alias("studies"), F.first("last").alias("last"))
    token = F.when(F.col("page") < F.col("last"), F.concat(F.lit(', "nextPageToken": "t'), (F.col("page") + 1).cast("string"), F.lit('"'))).otherwise("")
    body = F.when(broken, F.lit('{"studies": [')).otherwise(F.concat(F.lit('{"studies": ['), "studies", F.lit("]"), token, F.lit("}")))
    pages.select("query", "page", body.alias("value")).repartition("query", "page").write.partitionBy("query", "page").mode("overwrite").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(where)  # tasks move their files, not the driver all of them


@query("""WITH o AS (SELECT o_orderkey, left(o_orderpriority, 1) AS q, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 200 AS BIGINT) AS page FROM orders),
s AS (SELECT * FROM o WHERE o_orderkey % 100 <> 0)
SELECT 'permissive' AS mode, q AS query, page, o_orderkey FROM s WHERE q <> '2' OR page < 1 UNION ALL SELECT 'failfast', q, page, o_orderkey FROM s WHERE q = '1' UNION ALL SELECT 'failed', '2', -1, -1
UNION ALL SELECT 'stream', q, page, o_orderkey FROM s""")
def paged_orders(spark: SparkSession, d: str) -> DataFrame:
    """Pages of orders with one broken: as batches in both modes, and as a stream that goes on at the page once it is mended."""
    where = shared_folder(spark, "pages")
    numbered = numbering.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.left("o_orderpriority", F.lit(1)).alias("query")), ["o_orderkey"], within="query")
    paged = numbered.withColumn("page", F.floor((F.col("number") - 1) / 200))
    paged = paged.join(F.broadcast(paged.groupBy(F.col("query").alias("q")).agg(F.max("page").alias("last"))), F.col("query") == F.col("q")).drop("q")
    _write_pages(paged, f"{where}/api", (F.col("query") == "2") & (F.col("page") == 1))
    spark.dataSource.register(PagedStudies)
    every = ";".join("12345")

    def read(reader, mode: str, queries: str):
        return reader.format("paged_studies").options(url=f"{where}/api", query=queries, sleep="0", mode=mode, pages_per_batch="8").load()

    def rows(name: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(name).alias("mode"), "query", F.col("page").cast("long").alias("page"), F.get_json_object("study", "$.o_orderkey").cast("long").alias("o_orderkey"))

    found = rows("permissive", read(spark.read, "permissive", every)).unionByName(rows("failfast", read(spark.read, "failfast", "1")))
    try:
        read(spark.read, "failfast", "2").count()
    except Exception:
        found = found.unionByName(spark.createDataFrame([("failed", "2", -1, -1)], "mode string, query string, page long, o_orderkey long"))
    found = written(found, "pages-found")  # before the page is mended
    out = f"{where}/out"

    def run() -> None:
        """All pages that the interface gives now, batch after batch of one stream."""
        stream = read(spark.readStream, "permissive", every).writeStream.option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/data", "parquet")
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    run()
    one = (F.col("query") == "2") & (F.col("page") == 1)
    _write_pages(paged.where(one), f"{where}/mended", F.lit(False))
    _replace(spark, f"{where}/mended/query=2/page=1", f"{where}/api/query=2/page=1")
    run()
    return found.unionByName(rows("stream", spark.read.parquet(f"{out}/data")))


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, source: str, target: str) -> None:
    new, files = _files(spark, source)
    old, _ = _files(spark, target)
    files.delete(old, True)
    files.rename(new, old)
