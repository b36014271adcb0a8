"""Stored contracts, tolerant scans, sweeps and ablations on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import FEATURE_MASKS
from tessera.operators import contract, contracts, evaluation, experiments, search, vectors
from tessera.sources import tables


def test_contract_store_keeps_versions(spark, tmp_path):
    store = contracts.ContractStore(spark, f"file://{tmp_path}/c")
    first = spark.createDataFrame([(1, "A"), (2, "B")], "id long, kind string")
    assert contracts.checkpoint(first, store, ["id"], allowed={"kind": ["a", "b"]}, ranges={"id": (0, None)}).count() == 0 and store.versions() == [0]
    assert store.load() == contract.Contract({"id": "number", "kind": "string"}, ["id"], allowed={"kind": ["a", "b"]}, ranges={"id": (0, None)})
    assert {r.column: r.nulls for r in store.profile(0).collect()} == {"id": 0, "kind": 0}
    same = contracts.checkpoint(first, store, ["id"])
    assert same.count() == 0 and store.versions() == [0]  # nothing new, no version
    wider = first.withColumn("more", F.lit(True))
    with pytest.raises(contracts.Violated) as error:
        contracts.checkpoint(wider, store, ["id"], allow_new=False)
    assert [r.violation for r in error.value.report.collect()] == ["New columns appeared (not allowed): ['more']"] and store.versions() == [0]
    assert contracts.checkpoint(wider, store, ["id"]).count() == 0 and store.load(1).columns["more"] == "bool" and store.load(0).columns.keys() == {"id", "kind"}
    bad = spark.createDataFrame([(-1, "z")], "id long, kind string")
    told = contracts.checkpoint(bad, store, ["id"], mode="warn").orderBy("rank").collect()
    assert [(r.version, r["rank"], r.violation) for r in told] == [(1, 0, "Columns missing vs baseline schema: ['more']"), (1, 1, "Invalid category values in 'kind': ['Z']"), (1, 2, "'id' has values < 0")]
    assert store.versions() == [0, 1]


def test_gate_boundaries_by_group(spark):
    rows = []
    for group, n, bad, unknown, empty in (("ten", 10, 1, 5, 8), ("nine", 9, 0, 0, 0), ("over", 10, 2, 6, 9)):
        rows += [(group, "x" if i < bad else f"NCT{i:08d}", "d", "Unknown" if i < unknown else "k", None if i < empty else "c") for i in range(n)]
    df = spark.createDataFrame(rows, "g string, `NCT Number` string, disease string, disease_type string, Conditions string")
    found = {r.g: (r.passed, r.rows, r.errors) for r in contract.validation(df, ["NCT Number"], ["Conditions"], by=["g"]).collect()}
    assert found["ten"] == (True, 10, []) and found["nine"] == (False, 9, ["Too few rows: 9"])
    assert found["over"] == (False, 10, ["2 rows have invalid NCT Number format", "disease_type is Unknown for more than half of the rows", "CRITICAL: Conditions is mostly null"])
    one = contract.validation(df.where("g = 'ten'").drop("g"), ["NCT Number"], ["Conditions"]).first()
    assert one.passed and contract.validation(df.limit(0).drop("g"), ["NCT Number"], ["Conditions"]).first().errors == ["Dataset is empty"]


def test_folders_with_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"p": "1",\n "n": 2}')
    (tmp_path / "b.json").write_text('{"p": "1", ')
    (tmp_path / "summary.json").write_text("{")
    (tmp_path / "c.txt").write_text("{")
    (tmp_path / "d.json").write_text('{"p": "2", "n": "no number"}')
    where, schema = f"file://{tmp_path}", "p string, n long"
    assert [(r.file, r.p, r.n) for r in tables.read_results(spark, where, schema).collect()] == [("a.json", "1", 2)]
    assert sorted((r.file, r.n_fields) for r in tables.skipped_results(spark, where, schema).collect()) == [("b.json", 0), ("d.json", 1)]
    bundle = {"entry": [{"resource": {"resourceType": "Patient", "id": 1}}, {"resource": {}}, "x", {"resource": {"resourceType": "Patient"}}, {"resource": {"resourceType": "Claim"}}]}
    (tmp_path / "b").mkdir()
    for name, text in (("1", json.dumps(bundle)), ("2", "{"), ("3", "[]"), ("4", '{"entry": 5}')):
        (tmp_path / "b" / name).write_text(text)
    found = tables.resources(tables.read_bundles(spark, f"{where}/b"))
    assert sorted((r.file, r.type, r.place) for r in found.select("file", "type", "place").collect()) == [("1", "Claim", 4), ("1", "Patient", 0), ("1", "Patient", 3)]


SUMMARIES = [
    "Patient is a 45-year-old female. Active diagnoses: Type 2 Diabetes. Current medications: Metformin 500mg. Recent observations: HbA1c: 8.2%; BMI: 28. Smoking status: Never smoker.",
    "Patient is a 52-year-old female. Active diagnoses: HER2-positive breast cancer stage II. Smoking status: Never smoker.",
]


def test_settings_share_one_search(spark):
    rows = [(f"t{i}", i, [float(i % 7), float(i % 3) + 1, 1.0]) for i in range(60)]
    index = vectors.VectorIndex.build(spark.createDataFrame(rows, "id string, n long, embedding array<double>").select("id", "embedding"), leaf=10)
    prompts = spark.createDataFrame([(1, "in", [1.0, 2.0, 1.0]), (2, "ood", [6.0, 1.0, 0.5]), (3, "ood", None)], "query_id long, slice string, embedding array<double>")
    settings = experiments.one_at_a_time(experiments.Setting(retrieve=4, keep=2, limit=0.2), (2, 4), (1, 2, 9), (0.05, 0.2))
    hits = experiments.neighbours(prompts, index, settings, F.substring("id", 1, 2))
    found = {(r.param, r.value, r.query_id): (r.candidates, r.matched, r.success) for r in experiments.runs(prompts, hits, settings).collect()}
    near = {q: [(r.parent_id, r.distance) for r in hits.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    for s in settings:
        for q in (1, 2, 3):
            parents = {p for p, d in near[q][: 3 * s.retrieve] if d < s.limit}
            candidates = min(len(parents), s.retrieve)
            assert found[s.param, float(s.value), q] == (candidates, min(candidates, s.keep), q != 3)
    metrics = {(r.param, r.value): r for r in evaluation.sweep_metrics(experiments.runs(prompts, hits, settings)).collect()}
    assert len(metrics) == 7 and all(abs(r.success_rate - 2 / 3) < 1e-9 for r in metrics.values())


def test_masked_prompts_change_what_is_found(spark):
    trials = spark.createDataFrame([("NCT1", "Metformin in type 2 diabetes"), ("NCT2", "HER2 positive breast cancer stage II"), ("NCT3", "never smoker female"), ("NCT4", "HbA1c BMI study"), ("NCT5", "x y z")], "nct_number string, study_title string")
    index = vectors.VectorIndex.build(search.trial_index(trials), leaf=2)
    prompts = spark.createDataFrame(list(enumerate(SUMMARIES)), "query_id long, summary string")
    variants = experiments.masked(prompts)
    texts = {(r.query_id, r.feature): r.summary for r in variants.collect()}
    assert len(texts) == 2 * (1 + len(FEATURE_MASKS)) and texts[0, None] == SUMMARIES[0] and "Diabetes" not in texts[0, "diagnosis"] and "45" not in texts[0, "age"]
    from tessera.providers import embed

    found = experiments.ablations(embed(variants, "summary"), index, 2)
    by = {(r.query_id, r.feature): r for r in found.collect()}
    assert len(by) == 2 * len(FEATURE_MASKS) and by[1, "medications"].importance == 0  # there is none to mask
    assert all(abs(r.overlap_ratio + r.importance - 1) < 1e-9 for r in by.values())
    assert {r.feature for r in evaluation.feature_importance(found).collect()} == set(FEATURE_MASKS)
