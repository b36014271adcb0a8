"""8. Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets that fit in memory. Pass
two shuffles each bucket by a Fisher-Yates permutation (`shuffle` over the bucket's
places) and writes it. Permutations are stored before they are used, so a task that
runs again puts every record in the same place. A record's place in the whole order
gives its shard and slot: shards are consecutive ranges of the order, at most one record
apart in count (law `rows`).

Defined results: an empty table gives no rows; null texts have size 1 and CRC 0; equal
texts are placed apart like any others; rows equal in all hashed columns meet in one
bucket and get places of their own; extra columns are carried along, and ones that bear
the names of the results are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, shared_dir, table, written

#: The finest buckets; at 16 MB each they hold 268 TB.
CELLS = 1 << 24


def shard(docs: DataFrame, shards: int, path: str, *, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """Write `docs` to `path` in folders shard=0..shards-1, each row with its slot, and read them again."""
    rest = docs.drop("shard", "slot")
    hashed, cell, bucket, row, place, before, order = (free_name(rest, f"_{x}") for x in ("hash", "cell", "bucket", "row", "place", "before", "order"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    sized = rest.withColumn(hashed, F.xxhash64(F.lit(seed), id_col, text_col)).withColumn(cell, F.pmod(hashed, F.lit(CELLS)))
    cells = written(sized.groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")), "shard-cells")
    rows, total = cells.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = min(CELLS, max(1, -(-total // bucket_bytes)))
    number = lambda c: F.floor(F.col(c) * buckets / CELLS)

    counts = cells.groupBy(number("cell").alias(bucket)).agg(F.sum("rows").alias("rows"))
    earlier = F.sum("rows").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))  # one row a bucket
    places = counts.withColumn(before, F.coalesce(earlier, F.lit(0))).repartition(bucket)
    permutations = written(places.select(bucket, before, F.shuffle(F.sequence(F.lit(0), (F.col("rows") - 1).cast("int")), seed).alias(order)), "shard-orders")

    scattered = sized.withColumn(bucket, number(cell))
    placed = scattered.withColumn(row, F.row_number().over(Window.partitionBy(bucket).orderBy(hashed, id_col))).join(permutations, bucket)
    placed = placed.withColumn(place, F.col(before) + F.element_at(order, F.col(row)))
    shard_of = F.expr(f"{place} * {shards} div {max(rows, 1)}").cast("int")
    out = placed.withColumn("shard", shard_of).withColumn("slot", F.col(place) - F.expr(f"(shard * {rows} + {shards - 1}) div {shards}"))
    out = out.select(*rest.columns, "slot", "shard")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard(docs, 16, f"{shared_dir(spark)}/tessera/shards-{uuid.uuid4().hex}")
    body = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
