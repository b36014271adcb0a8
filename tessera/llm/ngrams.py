"""A modified Kneser-Ney model of code-point n-grams, counted, fitted and looked up with Spark.

Texts are lower-cased code points, nothing folded, so the counts grow with the corpus. Counts are
combined in each task, then by key. Only n-grams that two different texts or more have are evidence:
no text teaches the model its own oddities, however many copies of it there are. With its counts an n-gram carries the least and the
greatest 32-bit hash of the texts that have it, which differ if two texts do. Levels, discounts and backoffs are joins and
groupings on keys; no language and no level goes through one task. `values` gives the log
probability of any n-grams, seen or not: those of a level that are not in it go on to the next lower one, each once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat as fl
from .common import discard, written

ORDER = 5
#: stands before the first symbol of a text
PAD = "\x02"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _folds() -> np.ndarray:
    """Lower-case code points of alphabets up to U+052F; every white space is a blank."""
    out = np.arange(0x530, dtype=np.uint32)
    for i in range(0x530):
        low = chr(i).lower()
        out[i] = ord(low) if len(low) == 1 else i
    out[[0x20, 0xA0, *range(0x09, 0x0E)]] = 0x20
    return out


FOLDS = _folds()


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all rows and the rows' bounds among them; stray bytes are passed over."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    out = data[at].astype(np.uint32)
    many = np.flatnonzero(out >= 0xC0)
    if len(many):
        first, place = out[many], at[many]
        tail = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32) & 0x3F
        one, two, three = (tail[place + k] for k in (1, 2, 3))
        out[many] = np.select([first < 0xE0, first < 0xF0], [(first & 0x1F) << 6 | one, (first & 0x0F) << 12 | one << 6 | two], (first & 0x07) << 18 | one << 12 | two << 6 | three)
    low = out < len(FOLDS)
    out[low] = FOLDS[out[low]]
    return out, np.append(0, np.cumsum(lead))[bounds]


def grams(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes with padding before each row, and where in them each n-gram ends."""
    sizes = np.diff(bounds)
    ends = np.arange(len(codes)) + (ORDER - 1) * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    padded = np.full(len(codes) + (ORDER - 1) * len(sizes), ord(PAD), np.uint32)
    padded[ends] = codes
    return padded, ends


def hashes(padded: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams; seeds stand for their languages."""
    total = np.zeros(len(ends), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        total = total * _FACTOR + padded[ends - back]
    return fl.mix(total ^ seeds)


def seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def strings(codes: np.ndarray) -> pa.Array:
    """One string a row of code points."""
    width = np.select([codes < 0x80, codes < 0x800, codes < 0x10000], [1, 2, 3], 4).sum(1)
    body = codes.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    offsets = np.append(0, np.cumsum(width)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def count_grams(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    """(lang, g, n, low, high): occurrences of each n-gram, and the least and greatest hash of the texts that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def combined() -> tuple[np.ndarray, ...]:
            h, n, low, high, of, codes = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            first = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
            one = order[first]
            return h[one], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), of[one], codes[one]

        def rows() -> Iterator[pa.RecordBatch]:
            known = np.array(list(names), object)
            _, n, least, most, of, codes = combined()
            for at in range(0, len(n), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(known[of[part]], pa.string()), strings(codes[part]), pa.array(n[part]), pa.array(least[part]), pa.array(most[part])], names=["lang", "g", "n", "low", "high"])

        size = 0
        for batch in batches:
            data, bounds = fl.flat(batch.column(1))
            texts = np.asarray(batch.column(2))
            of = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            seeds = np.array([seed(x) for x in names], np.uint64)
            for low, high in fl.pieces(bounds):
                codes, at = code_points(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                if not len(codes):
                    continue
                padded, ends = grams(codes, at)
                row = np.repeat(np.arange(low, high), np.diff(at))
                h = hashes(padded, ends, seeds[of[row]])
                order = np.argsort(h)
                first = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
                one, row_of = order[first], row[order]
                text_of = texts[row_of]
                symbols = padded[ends[one][:, None] + np.arange(1 - ORDER, 1)]
                held.append((h[one], np.diff(np.append(first, len(h))), np.minimum.reduceat(text_of, first), np.maximum.reduceat(text_of, first), of[row[one]], symbols))
                size += len(one)
                if size > 1_500_000 and len(held) > 1:
                    held[:] = [combined()]
                    if (size := len(held[0][0])) > 1_000_000:  # hand over what is counted so far
                        yield from rows()
                        held.clear()
                        size = 0
        if held:
            yield from rows()

    source = docs.select(F.coalesce(lang.cast("string"), F.lit("")).alias("lang"), text.alias("text"), F.hash(F.xxhash64(text)).alias("of"))
    return source.mapInArrow(count, "lang string, g string, n long, low int, high int").groupBy("lang", "g").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


class Levels:
    """Tables of a fitted model: for each level, probabilities (lang, g, n, p) and backoffs (lang, c, b); for each language, that of an unseen symbol."""

    def __init__(self, p: dict[int, DataFrame], b: dict[int, DataFrame], unseen: DataFrame):
        self.p, self.b, self.unseen = p, b, unseen

    def values(self, wanted: DataFrame) -> DataFrame:
        """`wanted` (lang, g, ...) with nats, the negative log probability of the last symbol after the others."""
        named = {"lang": "_lang", "g": "_g"}
        found = self._level(wanted.select("lang", "g").distinct(), ORDER).withColumnsRenamed(named)
        joined = wanted.join(found, (F.col("lang") == F.col("_lang")) & (F.col("g") == F.col("_g")))
        return joined.select(*wanted.columns, (-F.log("v")).alias("nats"))

    def model(self, counts: DataFrame) -> DataFrame:
        """(lang, g, nats, n) of all counted n-grams: those of the top level as they are, the others backed off."""
        top = self.p[ORDER].select("lang", "g", "p", "n")
        rest = self._backed_off(counts.where("low = high").select("lang", "g", "n"), ORDER).select("lang", "g", F.col("v").alias("p"), "n")
        return top.unionByName(rest).select("lang", "g", (-F.log("p")).alias("nats"), "n")

    def _level(self, rows: DataFrame, k: int) -> DataFrame:
        """(lang, g, v) of distinct k-grams."""
        met = rows.join(self.p[k].select("lang", "g", "p"), ["lang", "g"], "left")
        met = written(met, f"grams-met{k}") if k > 1 else met
        there = met.where("p IS NOT NULL").select("lang", "g", F.col("p").alias("v"))
        return there.unionByName(self._backed_off(met.where("p IS NULL").drop("p"), k).select("lang", "g", "v"))

    def _backed_off(self, rows: DataFrame, k: int) -> DataFrame:
        """`rows` (lang, g, ...) of k-grams that level k has not, with v from the next lower level."""
        rows = rows.withColumns({"c": F.substring("g", 1, k - 1), "low": F.substring("g", 2, k - 1)}).join(self.b[k], ["lang", "c"], "left")
        if k == 1:
            rows = rows.join(self.unseen.withColumnRenamed("unseen", "below"), "lang", "left")
        else:
            below = self._level(rows.select("lang", F.col("low").alias("g")).distinct(), k - 1)
            rows = rows.join(below.select("lang", F.col("g").alias("low"), F.col("v").alias("below")), ["lang", "low"])
        return rows.withColumn("v", F.coalesce("b", F.lit(1.0)) * F.coalesce("below", F.lit(1e-6))).drop("c", "low", "b", "below")

    def discard(self) -> None:
        discard(*self.p.values(), *self.b.values(), self.unseen)


def fit(counts: DataFrame) -> Levels:
    """Modified Kneser-Ney over the n-grams of two texts or more; lower levels count the distinct symbols before a gram."""
    level = written(counts.where("low <> high").select("lang", "g", "n"), "grams-5")
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n"))
        levels[k] = written(levels[k], f"grams-{k}")
    unseen = written(levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("unseen")), "grams-unseen")
    p, b = {}, {}
    for k in range(1, ORDER + 1):
        # discounts from how many grams are seen once, twice, ...; at the top, those of one text count too
        times = (counts if k == ORDER else levels[k]).groupBy("lang").agg(*(F.greatest(F.count_if(F.col("n") == i), F.lit(1)).alias(f"t{i}") for i in range(1, 5)))
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        discounts = [F.greatest(F.lit(0.05), F.least(F.lit(0.95 * i), i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}"))).alias(f"d{i}") for i in range(1, 4)]
        grams_ = levels[k].withColumns({"c": F.substring("g", 1, k - 1), "low": F.substring("g", 2, k - 1)})
        sums = grams_.groupBy("lang", "c").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") > 2).alias("n3"))
        sums = sums.join(times.select("lang", *discounts), "lang")
        sums = sums.withColumn("b", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
        joined = grams_.join(sums, ["lang", "c"])
        if k == 1:
            joined = joined.join(unseen.withColumnRenamed("unseen", "below"), "lang")
        else:
            joined = joined.join(p[k - 1].select("lang", F.col("g").alias("low"), F.col("p").alias("below")), ["lang", "low"])
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        p[k] = written(joined.select("lang", "g", "n", ((F.col("n") - taken) / F.col("total") + F.col("b") * F.col("below")).alias("p")), f"grams-p{k}")
        b[k] = written(sums.select("lang", "c", "b"), f"grams-b{k}")
    discard(*levels.values())
    return Levels(p, b, unseen)


class Arrays:
    """Sorted hashes of n-grams with their nats; the first bits of a hash lead to its place."""

    def __init__(self, keys: bytes, nats: bytes):
        self.keys, self.nats = np.frombuffer(keys, np.uint64), np.frombuffer(nats, np.float32)
        bits = max(1, len(self.keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats of the hashes (0 where unknown) and which are known."""
        out, known = np.zeros(len(h), np.float32), np.zeros(len(h), bool)
        if not len(self.keys):
            return out, known
        left = np.arange(len(h))
        place = self.start[(h >> self.shift).astype(np.int64)]
        while len(left):
            inside = place < len(self.keys)
            left, place = left[inside], place[inside]
            here = self.keys[place]
            hit = here == h[left]
            known[left[hit]], out[left[hit]] = True, self.nats[place[hit]]
            on = here < h[left]
            left, place = left[on], place[on] + 1
        return out, known


def hashed(valued: DataFrame) -> DataFrame:
    """(h, nats, n) of (lang, g, nats, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), np.uint32)
            seeds = np.array([seed(x) for x in batch.column(0).to_pylist()], np.uint64)
            h = hashes(codes, np.arange(ORDER - 1, len(codes), ORDER), seeds)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2), batch.column(3)], names=["h", "nats", "n"])

    return valued.select("lang", "g", F.col("nats").cast("float"), "n").mapInArrow(run, "h long, nats float, n long")
