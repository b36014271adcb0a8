"""Models behind an interface. The offline defaults are deterministic stand-ins, not the quality of a real model."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashed_words(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """Bag of hashed words at length one."""
    out = []
    for text in texts:
        v = [0.0] * size
        for word in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def embed(df: DataFrame, text: str, model: Embed = hashed_words, column: str = "embedding", budget: float = 18_000, rows: int = 20) -> DataFrame:
    """Add vectors, calling the model with sub-batches of at most `rows` texts and about `budget` tokens (a longer text goes alone)."""
    source = df.drop(column)
    schema = source.withColumn(column, F.array().cast("array<float>")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for batch in packed(frame[text].fillna("").tolist(), budget, rows):
                vectors += list(model(batch))
            yield frame.assign(**{column: vectors})

    return source.mapInPandas(run, schema)


def packed(texts: Sequence[str], budget: float, rows: int) -> Iterator[list[str]]:
    """Consecutive texts, flushed before the estimate of their tokens would exceed the budget."""
    held: list[str] = []
    used = 0.0
    for text in texts:
        tokens = len(text) / 1.4
        if held and (used + tokens > budget or len(held) >= rows):
            yield held
            held, used = [], 0.0
        held.append(text)
        used += tokens
    if held:
        yield held


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: the offline ranker."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(query), words(text))), F.size(words(query))), F.lit(0.0))


#: One text to its answer, or a batch of texts to theirs when `batch` is set on it.
Judge = Callable[[str], str]


def judged(df: DataFrame, prompt: str, judge: Judge | None, column: str = "judgment", unavailable: str = "(judge unavailable)", failed: str | None = None) -> DataFrame:
    """Add a judge's answer to each prompt; without a judge, or where it fails, a fixed text.

    A judge with an attribute `batch` (texts to answers) is called once for each batch; a batch that fails is asked text by
    text, so that one bad prompt costs only its own answer. With `failed`, a column of that name marks the failures, and the
    answer is then the error.
    """
    if judge is None:
        out = df.withColumn(column, F.lit(unavailable))
        return out.withColumn(failed, F.lit(True)) if failed else out

    def one(text: str) -> tuple[str, bool]:
        try:
            return judge(text), False
        except Exception as e:
            return (str(e) if failed else unavailable), True

    def ask(texts: pd.Series) -> pd.DataFrame:
        whole = getattr(judge, "batch", None)
        if whole:
            try:
                answers = list(whole(texts.tolist()))
                if len(answers) == len(texts):
                    return pd.DataFrame({"answer": answers, "failed": False})
            except Exception:
                pass  # each text of it is asked alone
        return pd.DataFrame([one(t) for t in texts], columns=["answer", "failed"])

    said = df.withColumn("_said", F.pandas_udf(ask, "answer string, failed boolean")(F.col(prompt)))
    out = said.withColumn(column, F.col("_said.answer"))
    return (out.withColumn(failed, F.col("_said.failed")) if failed else out).drop("_said")


def judge_failures(df: DataFrame, failed: str) -> DataFrame:
    """One row: how many prompts were judged and how many failed."""
    return df.agg(F.count("*").alias("asked"), F.count_if(F.col(failed)).alias("failed"))
