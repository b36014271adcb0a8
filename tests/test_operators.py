"""Profiles, contracts, keyed tables, flattening, records, search and evaluation on small tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import classify
from tessera.operators import clinical, contract, evaluation, flatten, keyed, profile, search
from tessera.sources import tables


def trials(spark, n=20, **columns):
    base = {c: ["x"] * n for c in contract.REQUIRED} | {"NCT Number": [f"NCT{i:08d}" for i in range(n)]} | columns
    names = list(base)
    return spark.createDataFrame(list(zip(*base.values())), ", ".join(f"`{c}` string" for c in names))


@pytest.mark.parametrize(
    ("n", "columns", "passed"),
    [
        (5, {}, False), (10, {}, True), (20, {}, True), (20, {"NCT Number": ["bad"] * 4 + [f"NCT{i:08d}" for i in range(16)]}, False), (20, {"NCT Number": ["bad"] + [f"NCT{i:08d}" for i in range(19)]}, True),
        (20, {"disease_type": ["Unknown"] * 11 + ["x"] * 9}, False), (20, {"disease_type": ["Unknown"] * 5 + ["x"] * 15}, True), (20, {"Conditions": [None] * 17 + ["x"] * 3}, False), (20, {"disease": [None] + ["x"] * 19}, False),
    ],
)
def test_validation_gate(spark, n, columns, passed):
    assert contract.validation(trials(spark, n, **columns)).first().passed is passed


def test_validation_of_nothing(spark):
    row = contract.validation(trials(spark, 20).limit(0)).first()
    assert not row.passed and "Dataset is empty" in row.errors


def test_profile_counts_nulls_and_distinct_values(spark):
    df = spark.createDataFrame([("N1", 1), (None, 2), (None, None), (None, 2)], "a string, b int")
    rows = {r.column: r for r in profile.column_profile(df).collect()}
    assert rows["a"].null_pct == 75.0 and rows["a"].n_unique == 1 and rows["b"].type == "number" and rows["b"].n_unique == 2


def test_numeric_summary(spark):
    df = spark.createDataFrame([("10",), (None,), ("30",), ("x",)], "v string")
    assert profile.numeric_summary(df, "v").first()[:6] == (2, 20.0, 20.0, 10, 30, 40.0)
    assert profile.numeric_summary(df.where("v = 'x'"), "v").count() == 0


def test_outliers(spark):
    df = spark.createDataFrame(list(enumerate([100, 110, 105, 95, 100, 98, 102, 99, 101, 100000])), "i int, v int")
    assert [r.value for r in profile.outliers(df, "v", "i").collect()] == [100000.0]
    assert profile.outliers(df.where("i < 1"), "v", "i").count() == 0


def test_exploded_countries(spark):
    df = spark.createDataFrame([("United States; Canada",), ("United States",), ("Canada; Germany",), (None,)], "c string")
    assert [tuple(r) for r in profile.distribution(profile.exploded(df, "c"), "value", 10).collect()] == [("Canada", 2), ("United States", 2), ("Germany", 1)]


def test_contract(spark):
    df = spark.createDataFrame([("a", 100, "ALL"), (None, 200, "other")], "`NCT Number` string, Enrollment int, Sex string")
    base = contract.Contract({"NCT Number": "string", "Enrollment": "string", "gone": "string"}, ["NCT Number", "gone"], max_null_pct=40, allowed={"Sex": ["all"]}, ranges={"Enrollment": (None, 50)})
    found = [r.violation for r in contract.violations(df, base, allow_new=False).orderBy("rank").collect()]
    assert [f.split(":")[0].split(" ")[0] for f in found] == ["Missing", "Columns", "New", "Required", "Type", "Invalid", "'Enrollment'"] or len(found) == 7
    with pytest.raises(ValueError):
        contract.check(df, base, [], "enforce")
    assert contract.check(df, None, ["Sex"])[1] == [] and len(contract.check(df, base, [], "warn")[1]) >= 5


def test_anomalies(spark):
    df = trials(spark, 4, **{"NCT Number": ["NCT00000000", "NCT00000000", "bad", None], "Phase": [None] * 4, "Sex": [None] * 4, "Enrollment": ["1", "2", "3", "4"]}).withColumn("_ord", F.monotonically_increasing_id())
    row = contract.anomalies(df, order="_ord").first()
    assert row.duplicates and row.invalid_ids == 2 and [c.column for c in row.high_missing_columns] == ["Sex"] and row.stops and row.outliers == []


@pytest.mark.parametrize(("male", "female", "warned"), [(10, 1, True), (1, 10, True), (2, 2, False)])
def test_sex_bias(spark, male, female, warned):
    df = spark.createDataFrame([("MALE", "Canada")] * male + [("FEMALE", "Canada")] * female, "Sex string, `Location Countries` string")
    row = contract.bias_report(df).first()
    assert (row.male, row.female) == (male, female) and (row.bias_score == 1) is warned


def test_gestational_trials_do_not_count_for_sex(spark):
    df = spark.createDataFrame([("FEMALE", "Gestational Diabetes", "diabetes")] * 5 + [("MALE", "Gestational Diabetes", "diabetes")], "Sex string, disease_type string, disease string")
    assert contract.bias_report(df).first().bias_level == "LOW"


def test_keep_first_follows_the_order_and_joins_nulls(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1), (None, 3), (None, 4)], "k string, o int")
    assert sorted(tuple(r) for r in keyed.keep_first(df, "k", ["o"]).fillna("-").collect()) == [("-", 3), ("a", 1), ("b", 1)]


def test_enrich(spark):
    df = spark.createDataFrame([("N1", "Breast Cancer", 0), ("N1", "other", 1), ("N2", None, 2)], "`NCT Number` string, Conditions string, _ord int")
    rows = {r["NCT Number"]: r for r in keyed.enrich(df, "breast_cancer", classify.classifier_of("breast_cancer")).collect()}
    assert len(rows) == 2 and rows["N2"].disease_type == "Unknown" and rows["N1"].Conditions == "Breast Cancer"
    with pytest.raises(ValueError):
        classify.classifier_of("flu")


def test_upsert_create_update_delete(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (None, "e", 1)], "k int, v string, t int")
    both = keyed.upsert(old, new, "k", ["t"])
    assert sorted(tuple(r)[:2] for r in both.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    changed = keyed.update(old, spark.createDataFrame([(1, "z", 9)], "k int, v string, t int"), "k", kept=["t"])
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "z", 1), (2, "b", 1)]
    assert keyed.delete(old, new, "k").count() == 1 and keyed.create(old, new.where("k = 3"), "k").count() == 3


def study(**sections):
    base = {
        "identificationModule": {"nctId": "NCT12345678", "briefTitle": "T"}, "designModule": {"phases": ["PHASE2"], "enrollmentInfo": {"count": 100}}, "conditionsModule": {"conditions": ["Diabetes", "Obesity"]},
        "contactsLocationsModule": {"locations": [{"country": "United States", "city": "B"}, {"country": "United States", "city": "A"}]}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "NIH", "class": "FED"}},
        "armsInterventionsModule": {"interventions": [{"name": "Drug A", "type": "DRUG"}, "not_a_dict", None]},
    }
    return json.dumps({"protocolSection": base | sections})


def test_flatten(spark):
    texts = [study(), "{}", study(designModule={"enrollmentInfo": "not_a_dict"}, sponsorCollaboratorsModule={"leadSponsor": "not_a_dict"})]
    df = flatten.flatten(spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("study")))
    a, b, c = df.collect()
    assert len(df.columns) == 33 and a.Phase == "PHASE2" and a.Enrollment == 100 and a["Number of Locations"] == 2 and a["Study URL"].endswith("NCT12345678")
    assert a["Location Countries"] == "United States" and a["Location Cities"] == "A; B" and a.Conditions == "Diabetes; Obesity" and a.Interventions == "Drug A" and a["Intervention Types"] == "DRUG"
    assert b["Number of Locations"] == 0 and b.Sponsor == "" and b.Title == "" and c.Enrollment is None and c.Sponsor == "" and c["Sponsor Class"] == ""


BUNDLE = {
    "entry": [
        {"resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1980-06-15", "gender": "Female", "address": [{"city": "X"}], "extension": [{"url": "http://us-core-race", "extension": [{"url": "text", "valueString": "White"}]}]}},
        {"resource": {"resourceType": "Condition", "code": {"coding": [{"code": "44054006", "display": "Diabetes mellitus type 2"}]}, "onsetDateTime": "2010"}},
        {"resource": {"resourceType": "Condition", "code": {"text": "Flu"}, "clinicalStatus": {"coding": [{"code": "resolved"}]}}},
        {"resource": {"resourceType": "MedicationRequest", "medicationCodeableConcept": {"text": "Metformin"}, "status": "active"}},
        {"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "a1c", "display": "HbA1c"}]}, "valueQuantity": {"value": 7.5, "unit": "%"}, "effectiveDateTime": "2020-01-01"}},
        {"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "72166-2", "display": "Smoking"}]}, "valueCodeableConcept": {"text": "Never smoker"}, "effectiveDateTime": "2015-01-01"}},
        {"resource": {"resourceType": "Procedure", "code": {"text": "Old"}, "performedDateTime": "2001-01-01"}},
        {"resource": {"resourceType": "Procedure", "code": {"text": "New"}, "performedPeriod": {"start": "2019-01-01"}}},
        {"resource": {"resourceType": "AllergyIntolerance", "code": {"text": "Nuts"}, "reaction": [{"manifestation": [{"text": "Hives"}]}]}},
    ]
}


def test_patient_record_and_summary(spark):
    as_of = F.lit("2020-06-14").cast("date")
    df = spark.createDataFrame([("f", json.dumps(BUNDLE)), ("g", '{"entry": []}'), ("h", "[]")], "file string, t string").select("file", F.parse_json("t").alias("bundle"))
    made = clinical.patients(df, ["file"], as_of)
    row = made.first()
    assert made.count() == 1 and row.demographics.age == 39 and row.demographics.race == "White" and [c.status for c in row.conditions] == ["active", "resolved"]
    assert row.conditions[0].onset_date == datetime.date(2010, 1, 1) and row.observations[0].value == 7.5 and row.allergies[0].reaction == ["Hives"]
    assert made.select(clinical.summary(as_of).alias("s")).first().s == (
        "Patient is a 39-year-old female White. Active diagnoses: Diabetes mellitus type 2. Current medications: Metformin. Recent observations: HbA1c: 7.5 %. Recent procedures: New, Old. Known allergies: Nuts. Smoking status: Never smoker."
    )
    assert made.select(classify.record_condition(F.col("conditions")).alias("c")).first().c == "diabetes"


def test_matching(spark):
    t = [("NCT00000001", "diabetes", "Metformin in type 2 diabetes", "type 2 diabetes", "diabetes"), ("NCT00000002", "diabetes", "Insulin for type 1 diabetes", "type 1 diabetes", "diabetes"), ("NCT00000003", "breast_cancer", "Breast cancer trial", "breast cancer", "breast_cancer")]
    df = spark.createDataFrame(t, "nct_number string, condition string, study_title string, conditions string, disease string")
    people = spark.createDataFrame([("a", "Patient is a 50-year-old female diagnosed with type 2 diabetes. HbA1c 8%."), ("b", "What is the weather?"), ("c", None)], "patient_id string, summary string")
    rows = {r.patient_id: r for r in search.match(people, df, search.trial_index(df)).collect()}
    assert rows["a"].status == "passed" and "NCT00000001" in rows["a"].trials and "NCT00000002" not in rows["a"].trials and "NCT00000003" not in rows["a"].trials
    assert rows["b"].stage == "input" and rows["b"].trials == [] and rows["c"].reason == "Input is empty"


def test_index_replaces_changed_documents_only(spark):
    docs = spark.createDataFrame([("a", "x" * 2500), ("b", "short"), ("c", " ")], "k string, t string")
    first = search.update_index(None, docs, "k", F.col("t"))
    assert sorted(r.id for r in first.collect()) == ["a_0", "a_1", "a_2", "b_0"]
    changed = spark.createDataFrame([("a", "now short"), ("b", "short")], "k string, t string")
    assert sorted(r.id for r in search.update_index(first, changed, "k", F.col("t")).collect()) == ["a_0", "b_0"]


def test_breaches(spark):
    df = spark.createDataFrame([(3.0, 2, 4, 10, 2)], "average_score double, eligible int, not_eligible int, verdict_total int, patients int")
    assert [(r.metric, r.value, r.severity) for r in evaluation.breaches(df).collect()] == [("eligible_percentage", 20.0, "MEDIUM"), ("patients_evaluated", 2.0, "MEDIUM")]
    assert evaluation.alert_status(evaluation.breaches(df)).first().status == "ALERT"


def test_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "a", "x"]), ([], ["a"])], "a array<string>, b array<string>")
    rows = [r.o for r in df.select(evaluation.overlap(F.col("a"), F.col("b")).alias("o")).collect()]
    assert tuple(rows[0]) == (0.5, 1.0, 0.5) and tuple(rows[1]) == (0.0, 0.0, 1.0)


def test_csv_round_trip_keeps_line_ends_and_nulls(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b c,n\n"x\ny","say ""hi""",5\nNA,,x\n')
    rows = tables.read_csv(spark, f"file://{path}", "n long").collect()
    assert [tuple(r) for r in rows] == [("x\ny", 'say "hi"', 5), (None, None, None)]


def test_results_folder_skips_summary_and_broken_files(spark, tmp_path):
    for name, body in (("a.json", '{"p": "1"}'), ("summary.json", '{"p": "2"}'), ("b.json", "{broken")):
        (tmp_path / name).write_text(body)
    assert [r.p for r in tables.read_results(spark, f"file://{tmp_path}", "p string").collect()] == ["1"]


def test_paged_source(spark, tmp_path):
    from tessera.sources.paged import PagedStudies

    spark.dataSource.register(PagedStudies)
    for i in range(2):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"studies": [{"i": i}, {"i": i}, "bad"]} | ({"nextPageToken": "t"} if i == 0 else {"nextPageToken": "u"})))
    read = spark.read.format("paged_studies").options(url=f"file://{tmp_path}", query="diabetes", sleep="0")
    assert read.load().count() == 4  # the third page is missing: what was read is kept
    with pytest.raises(Exception):
        read.option("mode", "failfast").load().count()


def test_records_of_other_conditions_stay(spark, tmp_path):
    from tessera.sources.sinks import write_records

    rows = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id long, x double")
    for condition in ("diabetes", "breast_cancer", "diabetes"):
        write_records(rows, str(tmp_path / "records"), condition, "2024-01-01")
    assert {(r.condition, r["count"]) for r in spark.read.json(str(tmp_path / "records")).groupBy("condition").count().collect()} == {("diabetes", 2), ("breast_cancer", 2)}


def test_matching_with_judges_and_without_guards(spark):
    t = [("NCT00000001", "diabetes", "Metformin in type 2 diabetes", "type 2 diabetes", "diabetes")]
    df = spark.createDataFrame(t, "nct_number string, condition string, study_title string, conditions string, disease string")
    people = spark.createDataFrame([("a", "A 50-year-old female diagnosed with type 2 diabetes. HbA1c 8%."), ("b", "What is the weather?")], "patient_id string, summary string")
    index = search.trial_index(df)
    asked = search.match(people, df, index, judge_input=lambda s: F.when(s.contains("HbA1c"), "judge says no"))
    assert {r.patient_id: (r.stage, r.reason) for r in asked.collect()} == {"a": ("input", "judge says no"), "b": ("input", "Input lacks sufficient clinical structure")}
    judged = search.match(people, df, index, judge_output=lambda answer, trials: F.lit("unsafe")).where("patient_id = 'a'").first()
    assert (judged.stage, judged.reason, judged.trials) == ("output", "unsafe", ["NCT00000001"])
    assert {r.status for r in search.match(people, df, index, guarded=False).collect()} == {"passed"}


def test_keyed_tables_keep_columns_with_the_names_of_helpers(spark):
    old = spark.createDataFrame([(1, "n", "w", "h", "d", False), (2, "n", "w", "h", "d", False)], "k int, _nth string, _new string, _hit string, _done string, flag boolean")
    assert keyed.keep_first(old, "k", ["k"]).columns == old.columns
    assert sorted(r._new for r in keyed.upsert(old, old.where("k = 1").withColumn("_new", F.lit("z")), "k", []).collect()) == ["w", "z"]
    assert {r.k: (r.flag, r._done) for r in keyed.set_flag(old, old.where("k = 2"), "k", "flag", F.lit(None)).collect()} == {1: (False, "d"), 2: (True, "d")}
    changed = keyed.update(old, old.where("k = 1").select("k", F.lit("x").alias("_nth"), F.lit("y").alias("_hit")), "k")
    assert changed.columns == old.columns and {r.k: (r._nth, r._hit) for r in changed.collect()} == {1: ("x", "y"), 2: ("n", "h")}


def test_patient_records_are_made_without_a_shuffle(spark):
    """A bundle's entries were dealt out as rows and collected again, and one file of patients was one task."""
    body = '{"entry": [5, {"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "72166-2"}]}, "valueCodeableConcept": {"text": "Never"}}}, {"resource": {"resourceType": "Patient", "id": "a"}}, {"resource": {"resourceType": "Patient", "id": "b"}}, {"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "72166-2"}]}}}]}'
    df = spark.createDataFrame([(1, body), (2, '{"entry": []}'), (3, None), (4, '{"entry": {}}')], "k int, body string").select("k", F.try_parse_json("body").alias("bundle"))
    made = clinical.patients(df, ["k"], F.lit("2020-01-01").cast("date"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    (row,) = made.collect()
    assert (row.k, row.demographics.patient_id, len(row.observations), row.conditions, row.lifestyle) == (1, "a", 2, [], None)
