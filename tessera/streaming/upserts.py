"""Keyed results of a stream: the state store holds each key's newest row, and a log holds what each batch changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class UpsertLog:
    """A keyed table as the changes of its batches, one folder a batch: what a batch writes grows with the batch alone.

    A batch that comes again writes its own folder again, so replays change nothing. Reading takes each key's row of the
    highest version; `compact` puts all batches so far into one base, after which older folders may go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, *version: str):
        self.spark, self.path, self.schema, self.key, self.version = spark, path.rstrip("/"), schema, key, version

    def folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch:012d}"

    def write(self, changes: DataFrame, batch: int) -> None:
        changes.select(*self._empty().columns).write.mode("overwrite").parquet(self.folder(batch))

    def batches(self) -> list[tuple[str, int]]:
        """(kind, number) of the finished folders: "base" or "batch"."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted((n.split("=")[0], int(n.split("=")[1])) for n in names if "=" in n)

    def read(self) -> DataFrame:
        """The newest row of each key."""
        found = self.batches()
        base = max((n for kind, n in found if kind == "base"), default=-1)
        folders = [f"{self.path}/base={base:012d}"] * (base >= 0) + [self.folder(n) for kind, n in found if kind == "batch" and n > base]
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self._empty()
        return newest(rows, self.key, *self.version)

    def compact(self) -> int:
        """Put all batches into one base; gives its number, -1 if there is no batch."""
        last = max((n for _, n in self.batches()), default=-1)
        if last >= 0:
            self.read().select(*self._empty().columns).write.mode("overwrite").parquet(f"{self.path}/base={last:012d}")
        return last

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)


def newest(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """Each key's row of the highest version, ties by the other columns; keys that are null are dropped. Batch or stream."""
    others = [c for c in rows.columns if c not in (key, *version)]
    best = F.max(F.struct(*version, *others)).alias("_row")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(*(key if c == key else F.col(f"_row.`{c}`").alias(c) for c in rows.columns))


def run_upsert(stream: DataFrame, log: UpsertLog, checkpoint: str, handle: Callable[[DataFrame], DataFrame] = lambda df: df, available_now: bool = True) -> StreamingQuery:
    """Handle the rows of a stream and upsert the results by key; ends when the input that is there is done.

    The newest row of each key is kept in the state store, so a late older row changes nothing; a batch writes the keys that it touched.
    """
    kept = newest(handle(stream), log.key, *log.version)
    writer = kept.writeStream.outputMode("update").foreachBatch(lambda df, batch: log.write(df, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
