"""Exact quantiles by selection: histograms narrow down the cells that hold the ranks; no buffer grows with the values."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOST = sys.float_info.max


def quantiles(df: DataFrame, value: Column, probabilities: Sequence[float], *, cells: int = 512, held: int = 4096) -> list[float | None]:
    """The quantiles of the non-null numbers, interpolated linearly between ranks; null each when there are none.

    Each round counts the rows of `cells` equal cells between the least and the greatest value that can have a wanted
    rank, and goes on inside the cells that have one, until a cell has one value or `held` rows at most, which are fetched. A
    round is one pass with partial counts and a few thousand rows for the driver. NaN counts as null, infinities as the largest finite numbers.
    """
    x = df.select(F.greatest(F.least(value.cast("double"), F.lit(_MOST)), F.lit(-_MOST)).alias("x"), value.cast("double").alias("raw")).where("raw is not null and not isnan(raw)").select("x")
    one = x.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not one.n:
        return [None] * len(probabilities)
    ranks = {r for p in probabilities for r in (math.floor(p * (one.n - 1)), math.ceil(p * (one.n - 1)))}
    where = dict.fromkeys(ranks, (one.low, one.high, 0, one.n))  # rank: least and greatest value, rows below, rows within
    while open_ := sorted({w for w in where.values() if w[0] < w[1] and w[3] > held}):
        index, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (low, high, _, _) in enumerate(open_):
            inside = F.col("x").between(low, high)
            place = F.floor((F.col("x") / 2 - low / 2) / F.lit(high / 2 - low / 2) * cells)
            index, cell = F.when(inside, i).otherwise(index), F.when(inside, place.cast("int")).otherwise(cell)
        counts = x.select(index.alias("i"), cell.alias("cell"), "x").where("i is not null").groupBy("i", "cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i", "cell").collect()
        for i, interval in enumerate(open_):
            below = interval[2]
            for c in (c for c in counts if c.i == i):
                for rank, held_by in list(where.items()):
                    if held_by == interval and below <= rank < below + c.n:
                        where[rank] = (c.low, c.high, below, c.n)
                below += c.n
    found: dict[int, float] = {rank: w[0] for rank, w in where.items() if w[0] == w[1]}
    for interval in {w for w in where.values() if w[0] < w[1]}:
        below = interval[2]
        for c in x.where(F.col("x").between(interval[0], interval[1])).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect():  # `held` rows at most
            found |= {rank: c.x for rank, w in where.items() if w == interval and below <= rank < below + c.n}
            below += c.n
    out = []
    for p in probabilities:
        place = p * (one.n - 1)
        low, high = found[math.floor(place)], found[math.ceil(place)]
        out.append(low + (high - low) * (place - math.floor(place)))
    return out
