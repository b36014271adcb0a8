"""6. Language ID by multilingual mixture inference.

Byte trigrams of words are counted per language over all labelled documents that are
not held out. For each document, expectation-maximisation estimates the proportions of
the languages among its words from the words' n-gram likelihoods. The language set is
the one of highest likelihood less a penalty for each language: sets grow by the
languages' proportions, and those that no gain could pay for are not tried. The
prediction is the set's largest language and the score is its proportion.

Defined results: a text that is null or has no letter is `und` with score 0; without
any labelled document everything is `und`; beyond 131,072 languages an error is raised; null languages are never learned; repeated
rows count and are predicted each; ties go to the language first in order; extra
columns are carried along, and ones that bear the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat as fl
from .common import held_out, table

BUCKETS, CELLS = 1 << 16, 1 << 25
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each byte of a word (edges count as spaces), each word's first, and the rows' bounds among words."""
    low = fl.LOWER[data]
    starts, ends, at = fl.words(low, bounds, LETTERS)
    inside = LETTERS[low]
    padded = np.full(len(low) + 2, 0x20, np.uint32)
    padded[1:-1] = np.where(inside, low, 0x20)
    left, right = padded[:-2].copy(), padded[2:].copy()
    left[starts] = 0x20  # words of neighbouring rows can touch
    right[ends - 1] = 0x20
    key = (left << np.uint32(16) | padded[1:-1] << np.uint32(8) | right)[inside]
    lengths = ends - starts
    return (key * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64), np.append(0, np.cumsum(lengths))[:-1], at


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): trigram counts of all whole texts with a language; at most BUCKETS rows a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def combined() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            known, (keys, n) = np.array(list(names), object), combined()
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(known[part // BUCKETS], pa.string()), pa.array((part % BUCKETS).astype(np.int32)), pa.array(n[at : at + 100_000])], names=["lang", "bucket", "n"])

        size = 0
        for batch in batches:
            of = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            data, bounds = fl.flat(batch.column(1))
            for low, high in fl.pieces(bounds):
                part, at = data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
                buckets, first, words = _trigrams(part, at)
                if not len(buckets):
                    continue
                word_row = np.repeat(np.arange(low, high), np.diff(words))
                row = np.repeat(word_row, np.diff(np.append(first, len(buckets))))
                held.append(np.unique(of[row] * BUCKETS + buckets, return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000 and len(held) > 1:
                    held[:] = [combined()]
                    if (size := len(held[0][0])) > 1_000_000:  # many languages: hand over what is counted so far
                        yield from rows()
                        held.clear()
                        size = 0
        if held:
            yield from rows()

    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def buckets_for(languages: int) -> int:
    """Buckets of the model: fewer for very many languages, so that it holds CELLS numbers at most; up to CELLS / 256 languages."""
    buckets = BUCKETS
    while buckets > 256 and buckets * languages > CELLS:
        buckets //= 2
    return buckets


class Mixture:
    """Log likelihoods of trigrams, one column a language."""

    def __init__(self, counts: pa.Table, smoothing: float = 0.5):
        self.langs = sorted(set(counts["lang"].to_pylist()))
        self.buckets = buckets_for(len(self.langs))
        n = np.zeros((self.buckets, len(self.langs)), np.float32)
        column = {lang: i for i, lang in enumerate(self.langs)}
        np.add.at(n, (counts["bucket"].to_numpy() % self.buckets, [column[x] for x in counts["lang"].to_pylist()]), counts["n"].to_numpy())
        self.logp = np.log((n + np.float32(smoothing)) / (n.sum(0, dtype=np.float64) + smoothing * self.buckets)).astype(np.float32)

    def infer(self, data: np.ndarray, bounds: np.ndarray, penalty: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Each row's proportions of the languages (zero outside its chosen set) and its number of words."""
        rows, k = len(bounds) - 1, len(self.langs)
        buckets, first, at = _trigrams(data, bounds)
        buckets %= self.buckets
        n = np.diff(at)
        share = np.zeros((rows, k))
        some = np.flatnonzero(n)
        if not len(some) or not k:
            return share, n
        words = np.add.reduceat(self.logp[buckets], first, axis=0)
        starts, n_some = at[:-1][some], n[some]
        top = words.max(1, keepdims=True)
        likely = np.exp(np.maximum(words - top, -60))
        single = np.add.reduceat(words - top, starts, axis=0, dtype=np.float64)
        everything = np.ones((len(some), k), bool)
        pi, total = _em(likely, starts, n_some, everything, rounds)
        order = np.argsort(-pi, axis=1, kind="stable")
        cost = penalty * np.log(n_some + 1.0)
        best_lang = single.argmax(1)
        best, value = np.zeros((len(some), k)), single.max(1) - cost
        best[np.arange(len(some)), best_lang] = 1
        for size in range(2, k + 1):
            open_ = np.flatnonzero(total - size * cost > value)  # no set is likelier than all languages together
            if not len(open_):
                break
            allowed = np.zeros((len(open_), k), bool)
            np.put_along_axis(allowed, order[open_, :size], True, axis=1)
            words_of = np.concatenate([np.arange(s, s + m) for s, m in zip(starts[open_].tolist(), n_some[open_].tolist())])
            own = np.append(0, np.cumsum(n_some[open_]))[:-1]
            p, reached = _em(likely[words_of], own, n_some[open_], allowed, rounds)
            better = reached - size * cost[open_] > value[open_]
            best[open_[better]], value[open_[better]] = p[better], (reached - size * cost[open_])[better]
        share[some] = best
        return share, n


def _em(likely: np.ndarray, starts: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each row's allowed languages and the row's log likelihood (less that of each word's best language)."""
    pi = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
    for _ in range(rounds):
        part = likely * np.repeat(pi, n, axis=0)
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        pi = np.add.reduceat(part, starts, axis=0) / n[:, None]
    mixed = np.log(np.maximum((likely * np.repeat(pi, n, axis=0)).sum(1), 1e-30))
    return pi, np.add.reduceat(mixed, starts, dtype=np.float64)


def _has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    low = fl.LOWER[data]
    plain = np.diff(np.append(0, np.cumsum((low >= 0x61) & (low < 0x7B)))[bounds]) > 0
    for row in np.flatnonzero(~plain & (np.diff(np.append(0, np.cumsum(low >= 0x80))[bounds]) > 0)):
        plain[row] = any(c.isalpha() for c in data[bounds[row] : bounds[row + 1]].tobytes().decode("utf-8", "replace"))
    return plain


def predict(docs: DataFrame, counts: DataFrame, *, text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """Add lang_pred, score and languages (map of the chosen set's proportions) to the documents.

    The model is broadcast: at most CELLS floats, shared out among the languages.
    """
    n_langs = counts.select("lang").distinct().count()
    if n_langs * 256 > CELLS:
        raise ValueError(f"{n_langs} languages are more than {CELLS // 256}")
    folded = counts.groupBy("lang", (F.col("bucket") % buckets_for(n_langs)).alias("bucket")).agg(F.sum("n").alias("n"))  # at most CELLS rows
    shared = docs.sparkSession.sparkContext.broadcast(Mixture(folded.toArrow()))
    piece = max(1 << 13, (1 << 21) // max(n_langs, 4))  # a task holds a number for each word and language
    source = docs.drop("lang_pred", "score", "languages")
    text_at, width = [c.lower() for c in source.columns].index(text_col.lower()), len(source.columns)
    out = source.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "languages": F.lit(None).cast("map<string,double>")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, bounds = fl.flat(batch.column(text_at))
            langs: list[str] = []
            scores: list[float] = []
            sets: list[list[tuple[str, float]]] = []
            for low, high in fl.pieces(bounds, piece):
                part, rows = data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
                share, _ = model.infer(part, rows, penalty)
                for letter, p in zip(_has_letter(part, rows).tolist(), share):
                    chosen = np.flatnonzero(p > 0)
                    known = letter and len(chosen) > 0
                    langs.append(model.langs[int(p.argmax())] if known else "und")
                    scores.append(min(1.0, float(p.max())) if known else 0.0)
                    sets.append([(model.langs[i], float(p[i])) for i in chosen] if known else [])
            arrays = [*(batch.column(i) for i in range(width)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
