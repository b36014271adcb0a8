"""Findings of round 3 on the training-data operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tessera.llm import suffix


def _noise(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_contexts_without_a_shared_core_are_not_read(spark, keep, monkeypatch):
    """A phrase longer than a gram, in other surroundings each time, makes no repeat: before, all its contexts were cut and compared."""
    rng = random.Random(3)
    phrase, passage = _noise(rng, 30), _noise(rng, 90)
    rows = [(i, _noise(rng, 80) + phrase + _noise(rng, 80)) for i in range(40)]
    rows += [(100 + i, _noise(rng, 49) + f"{i}{passage}{i}" + _noise(rng, 49)) for i in range(6)]
    asked = []
    real = suffix.contexts
    monkeypatch.setattr(suffix, "contexts", lambda docs, wanted, *a: asked.append(wanted.select("key").distinct().count()) or real(docs, wanted, *a))
    made = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=64, gram=24, keep=keep)
    removed = {r.doc_id: [(x.start, x.end) for x in r.removed] for r in made.select("doc_id", "removed").collect()}
    first = 100 if keep == "first" else None
    assert removed == {i: [(50, 140)] if i >= 100 and i != first else [] for i, _ in rows}
    assert sum(asked) <= 6


def _repeated(texts: list[str], length: int) -> list[set[int]]:
    """Bytes of each text under a window that starts anywhere else too."""
    places: dict[str, list[tuple[int, int]]] = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            places.setdefault(t[s : s + length], []).append((d, s))
    out: list[set[int]] = [set() for _ in texts]
    for found in places.values():
        for d, s in found if len(found) > 1 else ():
            out[d].update(range(s, s + length))
    return out


@pytest.mark.parametrize("most", [1024, 1])
@pytest.mark.parametrize(("length", "gram"), [(64, 24), (32, 32), (34, 32), (40, 16)])
def test_bins_lose_no_match(spark, length, gram, most, monkeypatch):
    """Windows at every place of a bin, at both ends of a text and in texts that repeat themselves, against brute force."""
    rng = random.Random(length * 7 + gram)
    base = _noise(rng, 3 * length)
    texts = [base, base[: length + 1], base[-length:], base[1:], _noise(rng, length) + base[5 : 5 + length], base[7 : 7 + 2 * length] + "!" + base[9 : 9 + length + 3], "ab" * length]
    for i in range(60):
        a = rng.randrange(2 * length)
        n = rng.randrange(length - 3, length + 5)
        texts.append(_noise(rng, rng.randrange(40)) + base[a : a + n] + str(i) + _noise(rng, rng.randrange(40)))
    real = suffix.repeats
    monkeypatch.setattr(suffix, "repeats", lambda docs, length, gram, keep: real(docs, length, gram, keep, most))
    made = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length, gram=gram)
    got = {r.doc_id: {p for x in r.removed for p in range(x.start, x.end)} for r in made.select("doc_id", F.col("removed")).collect()}
    assert [got[i] for i in range(len(texts))] == _repeated(texts, length)
