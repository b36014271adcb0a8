"""What the operators share: reading tables, folds, checkpoints in the shared folder, chat of sizes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Whole texts go to Python in batches of 2,000 rows unless the session says otherwise, which bounds a task's memory."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's default
        spark.conf.set(rows, "2000")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df  # files of few pieces are dealt out to all cores


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, one is made in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tessera-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once no plan needs them any more: a later table holds what they were for."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessera/" in file:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of steps whose rows are written deleted now: Spark deletes them once both collectors on the driver have met the plans, which may take long. The last query's are held until another one runs."""
    gc.collect()  # objects of the JVM are in cycles here
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores put before it while the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def key_bits(keys: DataFrame, bits: int, chunks: int = 64) -> bytes:
    """A bitmap of 2**bits places, set where one of the hashed long keys (first column) falls: a filter of fixed size without misses."""
    size = (1 << bits) // 8 // chunks

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            place = np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(held, (place >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (place & np.uint64(7)).astype(np.uint8))
        packed = held.reshape(chunks, size)
        some = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[c].tobytes() for c in some], pa.binary())], names=["chunk", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = np.frombuffer(x.as_buffer(), np.uint8)
                held[c] = held[c] | row if c in held else row.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    schema = "chunk int, bits binary"
    rows = keys.mapInArrow(mark, schema).repartition(chunks, "chunk").mapInArrow(unite, schema).toArrow()
    found = dict(zip(rows["chunk"].to_pylist(), rows["bits"].to_pylist()))
    return b"".join(found.get(c, bytes(size)) for c in range(chunks))


def in_bits(keys: np.ndarray, bitmap: bytes) -> np.ndarray:
    bits = len(bitmap).bit_length() + 2
    place = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (np.frombuffer(bitmap, np.uint8)[place >> np.uint64(3)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1


def maybe_in(keys: DataFrame, key: Column, most: int = 1 << 24) -> Column | None:
    """A condition on the long column `key` that holds for all of `keys` and for few others; None if there are more than `most` keys."""
    n = keys.count()
    if n > most:
        return None
    bitmap = keys.sparkSession.sparkContext.broadcast(key_bits(keys, min(27, max(16, (16 * n).bit_length()))))

    @F.arrow_udf("boolean")
    def inside(values: pa.Array) -> pa.Array:
        return pa.array(in_bits(np.asarray(values), bitmap.value))

    return inside(key)
