"""Global row numbers, fixed batches and packing under a budget, without a window over the whole table.

Rows are sorted over range partitions and stored; the partitions' row counts, a number each, become prefix sums. So a
row's number is its place in its partition and its partition's offset, and no task sees more than its own range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written

_PLACE = (1 << 33) - 1
_BITS = 12  # rows of a block of the packing


def numbered(df: DataFrame, order: Sequence[str | Column], number: str = "number", within: str | None = None) -> DataFrame:
    """Add row numbers from 1 in `order`, over the table or within the values of a column (null is one). Ties get numbers in any order, each once.

    The rows are written to the shared folder. Rows that tie are spread too, so one value may hold any share of them.
    """
    keys = [*([F.col(within)] if within else []), *(F.col(o) if isinstance(o, str) else o for o in order)]
    sort = [*keys, F.col("_tie")]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = written(tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie").withColumn("_place", F.monotonically_increasing_id()), "numbered")
    counts = placed.groupBy(F.shiftright("_place", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row a partition
    offsets, total = [], 0
    for c in counts:
        offsets.append((c.p, total))
        total += c.n
    table = F.broadcast(df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _offset long"))
    out = placed.join(table, F.shiftright("_place", 33) == F.col("_p")).withColumn(number, F.col("_place").bitwiseAND(F.lit(_PLACE)) + F.col("_offset") + 1).drop("_place", "_p", "_offset")
    if not within:
        return out
    first = out.groupBy(F.col(within).alias("_w")).agg(F.min(number).alias("_first"))
    return out.join(first, F.col(within).eqNullSafe(F.col("_w"))).withColumn(number, F.col(number) - F.col("_first") + 1).drop("_w", "_first")


def fixed_batches(df: DataFrame, order: str, size: int = 20, within: str | None = None) -> DataFrame:
    """Add batch numbers from 0 of `size` rows in order, over the table or within a column's values."""
    return numbered(df, [order], "_number", within).withColumn("batch", F.floor((F.col("_number") - 1) / size)).drop("_number")


def packed_batches(df: DataFrame, order: Sequence[str | Column], size: Column, *, limit: int, rows: int = 20, within: str | None = None) -> DataFrame:
    """(within, batch, first, rows, size): consecutive rows, flushed before their sizes would exceed `limit` or their number `rows`.

    A row larger than `limit` is a batch alone. Where a batch ends depends on all before it in its order. For every row the start
    of the next batch is known from the `rows` rows behind it; in blocks of 4,096 rows these pointers are doubled until
    they leave the block, so a block is a table from entry to exit of `rows` numbers. The tables are followed block by
    block in one stream a group, and every block then cuts its own rows.
    """
    group = within or "_all"
    base = df if within else df.withColumn(group, F.lit(0))
    placed = numbered(base.select(*dict.fromkeys([group, *_names(order)]), F.coalesce(size, F.lit(0)).cast("long").alias("_size")), order, "_number", group)
    at = placed.select(F.col(group).alias("g"), (F.col("_number") - 1).alias("i"), F.col("_size").alias("size"))
    bits = _BITS
    own = F.shiftright("i", bits)
    ahead = (F.col("i").bitwiseAND(F.lit((1 << bits) - 1)) < rows) & (own > 0)  # the first rows are looked at from the block before, too
    spread = at.withColumn("block", F.explode(F.when(ahead, F.array(own - 1, own)).otherwise(F.array(own))))
    kind = placed.schema[group].dataType.simpleString()
    blocks = written(spread.groupBy("g", "block").agg(F.array_sort(F.collect_list(F.struct("i", "size"))).alias("items")), "packed-blocks")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits, counts = [], []
            for block, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                _, sizes, n = _sizes(block, items, bits)
                jump = _next(sizes, limit, rows)[:n]
                hops = np.ones(n, np.int64)
                while (inside := jump < n).any():  # each pointer is followed by the pointer at its end
                    hops[inside] += hops[jump[inside]]
                    jump[inside] = jump[jump[inside]]
                entry = np.minimum(np.arange(rows), max(n - 1, 0))
                there = np.arange(rows) < n
                exits.append(np.where(there, jump[entry] - n, np.arange(rows) - n).tolist())
                counts.append(np.where(there, hops[entry], 0).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exits, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["g", "block", "exits", "counts"])

    maps = blocks.mapInArrow(tables, f"g {kind}, block long, exits array<long>, counts array<long>")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entry, done = object(), 0, 0
        for batch in batches:
            entries, before = [], []
            for g, exits, counts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if g != held:
                    held, entry, done = g, 0, 0
                entries.append(entry)
                before.append(done)
                done += counts[entry]
                entry = max(0, exits[entry])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64()), pa.array(before, pa.int64())], names=["g", "block", "entry", "before"])

    path = maps.repartition("g").sortWithinPartitions("g", "block").mapInArrow(follow, f"g {kind}, block long, entry long, before long")
    joined = blocks.join(path.withColumnsRenamed({"g": "pg", "block": "pb"}), F.col("g").eqNullSafe(F.col("pg")) & (F.col("block") == F.col("pb"))).select("g", "block", "items", "entry", "before")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, made = [], []
            for k, (block, items, entry, before) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)))):
                first, sizes, n = _sizes(block, items, bits)
                jump, total = _next(sizes, limit, rows), np.append(0, np.cumsum(sizes))
                at = entry
                while at < n:
                    owner.append(k)
                    made.append((before, first + at + 1, int(jump[at] - at), int(total[jump[at]] - total[at])))
                    before, at = before + 1, int(jump[at])
            columns = [pa.array(c, pa.int64()) for c in zip(*made)] if made else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=["g", "batch", "first", "rows", "size"])

    out = joined.mapInArrow(cut, f"g {kind}, batch long, first long, rows long, size long")
    return out.withColumnRenamed("g", within) if within else out.drop("g")


def _names(order: Sequence[str | Column]) -> list[str]:
    if not all(isinstance(o, str) for o in order):
        raise ValueError("the order of a packing is given by column names")
    return list(order)


def _sizes(block: int, items: list[dict], bits: int) -> tuple[int, np.ndarray, int]:
    """The number before the first row of a block, the sizes of its rows and of those looked at behind it, and how many are its own."""
    return block << bits, np.array([x["size"] for x in items], np.int64), sum(x["i"] >> bits == block for x in items)


def _next(sizes: np.ndarray, limit: int, rows: int) -> np.ndarray:
    """Where the batch that starts at each row ends."""
    total = np.append(0, np.cumsum(sizes))
    reach = np.searchsorted(total, total[:-1] + limit, "right") - 1
    at = np.arange(len(sizes))
    return np.minimum(np.maximum(np.minimum(reach, at + rows), at + 1), len(sizes))
