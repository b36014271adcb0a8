"""10. Quality rules with n-gram perplexity.

Base rules count words, symbols, repeated lines and repeated word windows. A modified
Kneser-Ney model of code-point 5-grams per language is counted by Spark over all documents (see
`ngrams`) and stored as sorted hash arrays. Per-character cross-entropies of the documents that
pass the base rules give each language a lower and an upper band; documents outside are rejected.

The model grows with the corpus. Its commonest n-grams, up to `max_rows`, are broadcast; what
documents have of rarer ones is summed up per document and joined to the rest of the table by hash.

Defined results: null and empty texts have no words and fail the base rules; null
languages share one model; a language of which no document passes the base rules has
open bands; repeated rows count and are judged each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat as fl
from . import ngrams
from .common import discard, table, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LANG = "coalesce(cast(lang AS string), '') AS lang"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def model(docs: DataFrame) -> DataFrame:
    """(h, nats, n) of every n-gram of the documents (lang, text)."""
    counts = written(ngrams.count_grams(docs, F.col("lang"), F.col("text")), "quality-counts")
    levels = ngrams.fit(counts)
    out = written(ngrams.hashed(levels.model(counts)), "quality-model")
    levels.discard()
    discard(counts)
    return out


def _repeated_words(hashes: np.ndarray, at: np.ndarray, k: int = 8) -> np.ndarray:
    """Words of each row in k-word windows that its text has twice or more."""
    found, first = fl.window_hashes(hashes, at, k)
    of = fl.rows_of(first, at)
    found = fl.mix(found ^ of.astype(np.uint64) * fl.PLACES[0])
    order = np.argsort(found)
    same = found[order[1:]] == found[order[:-1]]
    twice = first[order[np.append(False, same) | np.append(same, False)]] if len(order) else first
    covered = np.cumsum(np.bincount(twice, minlength=len(hashes) + 1) - np.bincount(twice + k, minlength=len(hashes) + 1)[: len(hashes) + 1]) > 0
    return np.diff(np.append(0, np.cumsum(covered))[at])


def _repeated_lines(data: np.ndarray, bounds: np.ndarray, worded: np.ndarray) -> np.ndarray:
    """Lines of each row with a word that equal an earlier line; worded: running count of word bytes."""
    if not len(data):
        return np.zeros(len(bounds) - 1, np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(bounds[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where((ends > starts) & (data[ends - 1] == 0x0A), ends - 1, ends)
    some = worded[ends] > worded[starts]
    starts, ends = starts[some], ends[some]
    of = np.searchsorted(bounds, starts, "right") - 1
    order = np.argsort(hashes := fl.mix(fl.span_hashes(data, starts, ends) ^ of.astype(np.uint64) * fl.PLACES[0]))
    again = order[1:][hashes[order[1:]] == hashes[order[:-1]]]
    return np.bincount(of[again], minlength=len(bounds) - 1)


def _base(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, at = fl.words(data, bounds, fl.NOT_SPACE)
    running = lambda mask: np.append(0, np.cumsum(mask, dtype=np.int64))
    inside = fl.NOT_SPACE[data]
    return {
        "n_words": np.diff(at),
        "word_chars": np.diff(running(inside & ((data & 0xC0) != 0x80))[bounds]),
        "n_symbols": np.diff(running(SYMBOLS[data])[bounds]),
        "n_dup_lines": _repeated_lines(data, bounds, running(inside)),
        "n_repeat_words": _repeated_words(fl.span_hashes(data, starts, ends), at),
    }


def score(docs: DataFrame, known: DataFrame, carry: Sequence[str] = ("doc_id",), max_rows: int = 4_000_000) -> DataFrame:
    """Base counts and cross-entropy (nats a character, null without text) of each document; `known` is the model of these documents.

    If the model has more than max_rows n-grams, the commonest of them, down to a power of two of occurrences, are broadcast.
    """
    spark = docs.sparkSession
    sizes = dict(known.groupBy(F.floor(F.log2("n")).cast("int")).count().collect())  # at most 64 rows
    least, filled = 64, 0
    for power in sorted(sizes, reverse=True):
        if filled + sizes[power] > max_rows:
            break
        least, filled = power, filled + sizes[power]
    whole = filled == sum(sizes.values())
    common = known if whole else known.where(F.col("n") >= 2**least)
    rows = common.select("h", "nats").toArrow()  # at most max_rows
    order = np.argsort(h := rows["h"].to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((h[order].tobytes(), rows["nats"].to_numpy()[order].astype(np.float32).tobytes()))
    source = docs.select(*carry, F.expr(LANG), "text")
    kept = len(carry) + 1
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:kept]]
    schema = ", ".join([*own, *(f"{c} long" for c in COUNTS), "chars long, total double, rare array<long>, times array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = ngrams.Arrays(*shared.value)
        for batch in batches:
            data, bounds = fl.flat(batch.column(kept))
            langs = batch.column(kept - 1).to_pylist()
            seeds = {x: ngrams.seed(x) for x in set(langs)}
            for low, high in fl.pieces(bounds):
                part, at = data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
                base = _base(part, at)
                codes, ends = ngrams.code_points(part, at)
                total, rare = _nats(codes, ends, np.array([seeds[x] for x in langs[low:high]], np.uint64), arrays)
                columns = [*(batch.column(i).slice(low, high - low) for i in range(kept)), *(pa.array(base[c].astype(np.int64)) for c in COUNTS), pa.array(np.diff(ends)), pa.array(total), *rare]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:kept], *COUNTS, "chars", "total", "rare", "times"])

    scored = source.mapInArrow(run, schema)
    if not whole:
        scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "quality-parts")
        rare = scored.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
        sums = rare.join(known.where(F.col("n") < 2**least), "h").groupBy("_row").agg(F.sum(F.col("nats") * F.col("times")).alias("more"))
        scored = scored.join(sums, "_row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return scored.select(*carry, "lang", *COUNTS, F.when(F.col("chars") > 0, F.col("total") / F.col("chars")).alias("nats"))


def _nats(codes: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, arrays: ngrams.Arrays) -> tuple[np.ndarray, list[pa.Array]]:
    """Each row's sum over n-grams that the arrays have, and lists of the others with their times."""
    rows = len(bounds) - 1
    padded, ends = ngrams.grams(codes, bounds)
    of = np.repeat(np.arange(rows), np.diff(bounds))
    h = ngrams.hashes(padded, ends, seeds[of])
    nats, known = arrays.find(h)
    h, other = h[~known], of[~known]
    order = np.lexsort((h, other))
    h, other = h[order], other[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (other[1:] != other[:-1]))) if len(h) else np.zeros(0, np.int64)
    offsets = pa.array(np.searchsorted(other[first], np.arange(rows + 1)).astype(np.int32))
    times = np.diff(np.append(first, len(h))).astype(np.int32)
    return np.bincount(of, weights=nats, minlength=rows).astype(float), [pa.ListArray.from_arrays(offsets, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times))]


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def bands(scored: DataFrame, spread: float = 5.0, steps: int = 1000) -> DataFrame:
    """Per language: low and high quartile of cross-entropy, from counts in steps of 1/1000 nat over all documents
    that pass the base rules, and the width of the bands beyond them: `spread` interquartile ranges of 0.02 nat at least."""
    counts = scored.where(~F.expr(BASE_FAILED) & F.col("nats").isNotNull()).groupBy("lang", F.floor(F.col("nats") * steps).alias("step")).agg(F.count("*").alias("n"))
    running = Window.partitionBy("lang").orderBy("step")
    share = F.sum("n").over(running) / F.sum("n").over(Window.partitionBy("lang"))
    quartiles = counts.withColumn("share", share).groupBy("lang").agg(F.min(F.when(F.col("share") >= 0.25, F.col("step"))).alias("q1"), F.min(F.when(F.col("share") >= 0.75, F.col("step"))).alias("q3"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.02 * steps)) * spread / steps
    return quartiles.select("lang", (F.col("q1") / steps).alias("low"), ((F.col("q3") + 1) / steps).alias("high"), width.alias("width"))


def quality_rules(docs: DataFrame, carry: Sequence[str] = ("doc_id",), spread: float = 5.0, max_rows: int = 4_000_000) -> DataFrame:
    """`carry` columns, lang, base counts, base_failed, nats, perplexity, the language's bands and kept, for each document."""
    scored = written(score(docs, model(docs), carry, max_rows), "quality-scores")
    limits = written(bands(scored, spread), "quality-bands")
    judged = scored.join(F.broadcast(limits), "lang", "left") if limits.count() <= 100_000 else scored.join(limits, "lang", "left")
    width = F.col("width") * F.sqrt(1 + 100 / F.greatest("n_words", F.lit(1)))  # means over short texts vary more
    inside = F.coalesce(F.col("nats").between(F.col("low") - width, F.col("high") + width), F.lit(True))
    return judged.withColumn("perplexity", F.exp("nats")).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & inside)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity")
