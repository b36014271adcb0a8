"""Index, numbers, packing and quantiles against plain Python, on awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import numbering, search, vectors
from tessera.operators.quantiles import quantiles
from tessera.providers import packed


# --- index
def some_vectors(n, width, seed, clusters=0):
    rng = np.random.default_rng(seed)
    if clusters:
        centres = rng.normal(size=(clusters, width))
        return centres[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, width))
    return rng.normal(size=(n, width))


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>").repartition(5)


def nearest(rows, queries, k, limit=None):
    unit = {i: np.asarray(v, np.float32).astype(float) for i, v in rows if v is not None}
    unit = {i: v / (np.linalg.norm(v) or 1.0) for i, v in unit.items()}
    out = {}
    for q in queries:
        found = sorted((round(1 - float(unit[q] @ v), 9), i) for i, v in unit.items())
        out[q] = [x for x in found if limit is None or x[0] < limit][:k]
    return out


def lists_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], round(r.distance, 9), r.id))
    return {q: [x[1:] for x in sorted(found)] for q, found in out.items()}


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_PIECE", 16)  # many pieces and blocks
    rows = [*enumerate(some_vectors(400, 8, 1, clusters=7)), (400, np.zeros(8)), (401, None)]
    rows += [(500 + i, rows[3][1]) for i in range(20)]  # ties
    df = table_of(spark, rows)
    index = vectors.VectorIndex.build(df, leaf=20, sample=50)
    asked = df.where("id % 9 = 0 OR id = 400").withColumnRenamed("id", "query_id")
    queries = [r.query_id for r in asked.where("embedding is not null").collect()]
    found, want = lists_of(index.search(asked, 6, exact=True, share=0.02)), nearest(rows, queries, 6)
    assert {q: [d for d, _ in x] for q, x in found.items()} == {q: pytest.approx([d for d, _ in x], abs=1e-6) for q, x in want.items()}
    near = lists_of(index.search(asked, 6, exact=True, share=0.02, limit=0.05))
    assert {q: len(x) for q, x in near.items()} == {q: len(x) for q, x in nearest(rows, queries, 6, 0.05).items() if x}
    exact = lists_of(search.nearest(asked, df.where("embedding is not null"), 6))
    assert {q: [i for _, i in x] for q, x in found.items() if q != 400} == {q: [i for _, i in x] for q, x in exact.items() if q not in (400, 401)}


@pytest.mark.parametrize(("clusters", "most"), [(40, 0.2), (0, 1.0)])
def test_recall_is_reached_by_the_measured_share(spark, clusters, most):
    rows = list(enumerate(some_vectors(2000, 16, 2, clusters)))
    df = table_of(spark, rows)
    index = vectors.VectorIndex.build(df, leaf=50)
    assert vectors.SHARE <= index.share <= most  # clustered vectors need few lists, vectors without structure nearly all
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    found, want = lists_of(index.search(asked, 10)), nearest(rows, range(0, 2000, 20), 10)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_index_of_nothing_and_plan(spark):
    df = table_of(spark, list(enumerate(some_vectors(30, 4, 3))))
    empty = vectors.VectorIndex.build(df.limit(0))
    asked = df.withColumnRenamed("id", "query_id")
    assert empty.search(asked, 3, exact=True).count() == 0
    index = vectors.VectorIndex.build(df, leaf=10)
    assert index.search(asked.limit(0), 3).count() == 0
    plan = index.search(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matching_by_index_equals_matching_by_scan(spark):
    trials = spark.createDataFrame([(f"NCT{i:08d}", "diabetes", f"Study {i % 7} of insulin", "type 2 diabetes", "diabetes") for i in range(120)], "nct_number string, condition string, study_title string, conditions string, disease string")
    patients = spark.createDataFrame([(i, f"A {40 + i}-year-old female diagnosed with type 2 diabetes, HbA1c {i}%, insulin") for i in range(9)], "patient_id long, summary string")
    flat = search.trial_index(trials)
    found = search.match(patients, trials, vectors.VectorIndex.build(flat, leaf=10))
    shown = lambda df: sorted((r.patient_id, r.status, tuple(r.trials)) for r in df.collect())
    assert shown(found) == shown(search.match(patients, trials, flat))


def test_queries_are_sent_to_pieces_not_to_lists(spark, monkeypatch):
    """What is shuffled and held grows with pieces and blocks, however many lists are probed (a row for each list of each query ran out of memory)."""
    monkeypatch.setattr(vectors, "_CELLS", 2**12)
    df = table_of(spark, list(enumerate(some_vectors(600, 8, 5))))
    index = vectors.VectorIndex.build(df, leaf=2)
    assert len(index.lists.sizes) > 200 and index.lists.sizes.sum() == 600 and index.postings.count() == 600
    asked = df.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"), F.lit(None).cast("double").alias("reach"))
    assert index._probes(asked, "query_id", 1.0).count() == 600


def test_lists_are_laid_into_bounded_pieces(monkeypatch):
    monkeypatch.setattr(vectors, "_PIECE", 10)
    lists = vectors._Lists(np.zeros((6, 1)), np.array([4, 6, 3, 25, 0, 9]), np.zeros(6))
    lists.laid_out()
    assert lists.first.tolist() == [0, 0, 1, 2, 5, 5] and lists.parts.tolist() == [1, 1, 1, 3, 1, 1] and lists.count == 6
    assert lists.pieces(np.array([0, 0, 1]), np.array([0, 1, 3])).tolist() == [0, 6 + 2, 6 + 3, 6 + 4]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_of_a_group_with_copies_and_near_ties(k):
    rng = np.random.default_rng(k)
    rows = vectors._unit(np.concatenate([rng.normal(size=(9000, 6)), np.repeat(rng.normal(size=(3, 6)), 200, 0), np.zeros((2, 6))])[rng.permutation(9602)])
    rows[1::7] = vectors._unit(rows[0] + 1e-6 * rng.normal(size=(len(rows[1::7]), 6)))  # closer to each other than single precision sees
    asked = np.concatenate([rows[:300], rng.normal(size=(5, 6))])
    asked = vectors._unit(asked)
    row, at, distance = vectors._best(rows, asked, np.full(305, 3.0), k)
    for q in range(305):
        d = np.round(1 - (asked[q] * rows).sum(1), 12)
        want = np.lexsort((np.arange(len(rows)), d))[:k]
        assert np.allclose(d[want], distance[row == q], atol=2e-12) and len(set(at[row == q].tolist())) == k
    near = vectors._best(rows, asked, np.full(305, 0.2), k)
    assert (near[2] <= 0.2).all() and set(zip(near[0], near[1])) == {(r, a) for r, a, d in zip(row, at, distance) if d <= 0.2}


def test_equal_questions_are_searched_once(spark, monkeypatch):
    trials = spark.createDataFrame([(f"NCT{i:08d}", "diabetes", f"Study {i} of insulin", "type 2 diabetes", "diabetes") for i in range(12)], "nct_number string, condition string, study_title string, conditions string, disease string")
    patients = spark.createDataFrame([(i, "A 40-year-old female diagnosed with type 2 diabetes, HbA1c 7%, insulin") for i in range(30)], "patient_id long, summary string")
    sizes, scan = [], search.nearest
    monkeypatch.setattr(search, "nearest", lambda queries, *a, **more: sizes.append(queries.count()) or scan(queries, *a, **more))
    found = search.match(patients, trials, search.trial_index(trials)).collect()
    assert sizes == [1] and len(found) == 30 and len({tuple(r.trials) for r in found}) == 1 and len(found[0].trials) == 5


# --- numbers
def test_numbers_are_gapless_whatever_the_order(spark):
    rows = [(random.Random(i).choice([None, 1, 2, 2, 2]), i, "x") for i in range(500)] + [(7, None, "x")] * 40
    df = spark.createDataFrame(rows, "g long, o long, number_ string").repartition(6)
    out = numbering.numbered(df, [F.col("o").desc_nulls_first(), "g"]).collect()
    assert sorted(r.number for r in out) == list(range(1, 541)) and [r.o for r in sorted(out, key=lambda r: r.number)] == [None] * 40 + list(range(499, -1, -1))
    within = numbering.numbered(df, ["o"], within="g").collect()
    for g in (None, 1, 2, 7):
        mine = sorted((r.number, r.o) for r in within if r.g == g) if g != 7 else sorted(r.number for r in within if r.g == 7)
        assert [m[0] if g != 7 else m for m in mine] == list(range(1, len(mine) + 1)) and (g == 7 or [m[1] for m in mine] == sorted(m[1] for m in mine))
    assert numbering.numbered(df.limit(0), ["o"]).count() == 0


def test_equal_keys_do_not_meet_in_one_task(spark):
    same = spark.range(100_000).select(F.lit(1).alias("o"))
    sizes = [r["count"] for r in numbering.numbered(same, ["o"]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100_000 and numbering.fixed_batches(same, "o", 30_000).groupBy("batch").count().where("count = 30000").count() == 3


# --- packing
@pytest.mark.parametrize(("limit", "rows"), [(100, 5), (40, 20), (1, 3), (10_000, 20), (0, 2)])
def test_packing_is_the_greedy_one(spark, monkeypatch, limit, rows):
    monkeypatch.setattr(numbering, "_BITS", 5)  # blocks of 32 rows
    rng = random.Random(limit)
    data = [(g, i, rng.choice([0, 1, 5, 13, 30, 200])) for g, n in (("a", 333), ("b", 32), ("c", 1), (None, 65), ("d", 31)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, i long, size long").repartition(4)
    found = sorted(map(tuple, numbering.packed_batches(df, ["i", "size"], F.col("size"), limit=limit, rows=rows, within="g").collect()), key=str)
    want = []
    for g in ("a", "b", "c", None, "d"):
        held, used, first, batch = 0, 0, 1, 0
        for _, i, size in (x for x in data if x[0] == g):
            if held and (used + size > limit or held >= rows):
                want.append((g, batch, first, held, used))
                held, used, first, batch = 0, 0, i + 1, batch + 1
            held, used = held + 1, used + size
        want.append((g, batch, first, held, used))
    assert found == sorted(want, key=str)
    alone = numbering.packed_batches(df.where("g = 'a'"), ["i", "size"], F.col("size"), limit=limit, rows=rows)
    assert alone.columns == ["batch", "first", "rows", "size"] and alone.count() == sum(w[0] == "a" for w in want)


def test_packing_agrees_with_the_models_batches(spark):
    texts = ["x" * random.Random(i).choice([10, 3000, 9000, 40_000]) for i in range(100)]
    df = spark.createDataFrame([(i, len(t)) for i, t in enumerate(texts)], "i long, n long")
    found = [(r.rows, r.size) for r in numbering.packed_batches(df, ["i", "n"], F.col("n"), limit=25_200).orderBy("batch").collect()]
    assert found == [(len(b), sum(map(len, b))) for b in packed(texts, 18_000, 20)]


# --- quantiles
@pytest.mark.parametrize("held", [1, 50, 100_000])
def test_quantiles_are_those_of_the_sorted_values(spark, held):
    rng = np.random.default_rng(4)
    columns = {"wide": rng.lognormal(0, 6, 3000), "few": rng.integers(0, 5, 3000).astype(float), "one": np.full(3000, 2.5), "huge": np.where(rng.random(3000) < 0.5, -1e308, 1e308) * rng.random(3000), "tail": np.append(np.zeros(2999), 1e12)}
    probabilities = [0, 0.01, 0.25, 0.5, 0.75, 0.999, 1]
    df = spark.createDataFrame([tuple(float(c[i]) for c in columns.values()) for i in range(3000)], ", ".join(f"{c} double" for c in columns)).repartition(4)
    for name, values in columns.items():
        assert quantiles(df, F.col(name), probabilities, cells=16, held=held) == pytest.approx([_quantile(sorted(values.tolist()), p) for p in probabilities], rel=1e-12), name


def _quantile(values, p):
    place = p * (len(values) - 1)
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


def test_quantiles_of_few_or_odd_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (3.0,), (float("inf"),)], "x double")
    assert quantiles(df, F.col("x"), [0, 0.5])[0] == 3.0 and quantiles(df.where("x is null"), F.col("x"), [0.5]) == [None]
