"""Judges that fail, prompts that are put together, rounding, gates in order."""

import json
import random

from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import contract, evaluation, judging
from tessera.providers import judge_failures, judged


def test_a_batch_that_fails_is_asked_text_by_text(spark):
    calls = spark.sparkContext.accumulator(0)

    def judge(text):
        if "bad" in text:
            raise ValueError(f"cannot {text}")
        return text.upper()

    def batch(texts):
        calls.add(1)
        return [judge(t) for t in texts]

    judge.batch = batch
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(10)], "id long, prompt string").coalesce(1)
    said = {r.id: (r.a, r.f) for r in judged(df, "prompt", judge, "a", failed="f").collect()}
    assert said[3] == ("cannot bad", True) and said[4] == ("T4", False) and calls.value == 1
    assert judge_failures(judged(df, "prompt", judge, "a", failed="f"), "f").first() == (10, 1)
    assert {r.a for r in judged(df, "prompt", judge, "a").where("id = 3").collect()} == {"(judge unavailable)"}
    assert judged(df, "prompt", None, "a", failed="f").where("f AND a = '(judge unavailable)'").count() == 10


def test_judgments_are_read_with_defaults(spark):
    answers = ['{"is_valid": true, "category": "valid_supported_clinical_summary"}', '{"is_valid": true}', "{}", "none", None, "```json\n{\"is_valid\": false, \"reason\": \"r\"}\n```"]
    df = spark.createDataFrame([(i, a, False) for i, a in enumerate(answers)] + [(9, "down", True)], "i long, a string, f boolean")
    found = {r.i: r.s for r in df.select("i", judging.input_stage(F.col("a"), F.col("f")).alias("s")).collect()}
    assert found[0] == (None, None, None) and found[1][:2] == ("input_scope", "No reason provided") and found[2][:2] == ("input_llm_judge", "No reason provided")
    assert found[3][2] == found[4][2] == "input_llm_guardrail_error: no JSON" and found[5][:2] == ("input_llm_judge", "r") and found[9][2] == "input_llm_guardrail_error: down"
    safe = df.select("i", judging.output_stage(F.lit('{"is_safe": true, "is_grounded": true}'), F.lit(False)).alias("s")).first()
    assert safe.s == (None, None, None)


def test_templates_are_filled_once(spark):
    row = spark.range(1).select(judging._filled("{a} {b} {c} {a}", a=F.lit("{b}"), b=F.lit("x")).alias("t")).first()
    assert row.t == "{b} x {c} {b}"


def test_evaluation_without_anything_to_judge(spark):
    trial = "struct<nct_number:string,study_title:string,conditions:string,eligibility_criteria:string,min_age:int,max_age:string,sex:string,recruitment_status:string>"
    df = spark.createDataFrame([("a", "s", "blocked", "why", None), ("b", "s", "passed", "", []), ("c", "s", "passed", "", [("N1", None, None, None, None, None, None, None)])], f"patient_id string, summary string, status string, reason string, trials array<{trial}>")
    found = {r.patient_id: r for r in judging.evaluate(df, lambda t: json.dumps({"overall_score": 4.5, "trials": "odd"}), "T {trials_block}", "O {verdicts_block}").collect()}
    assert found["a"].score_reasoning == "why" and found["b"].calls == 0 and (found["c"].score, found["c"].trial_verdicts, found["c"].num_trials) == (4.5, [], 1)
    assert found["a"].summary.startswith("Evaluation skipped") and found["b"].summary.startswith("No retrieved")


def test_rounding_is_that_of_the_exact_double(spark):
    rng = random.Random(1)
    xs = [2.675, 1.005, 0.125, 0.375, -2.675, 2.5, 3.5, -0.5, 0.0, 1e17, 1e300, 0.285, 1.115, 5e-324] + [round(rng.uniform(-1e4, 1e4), 3) for _ in range(3000)] + [rng.uniform(-1, 1) for _ in range(500)] + [k / 8 for k in range(-400, 400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 1, 2, 3):
        for r in df.select("x", values.python_round(F.col("x"), digits).alias("y")).collect():
            assert r.y == round(r.x, digits), (r.x, digits)


def test_first_failing_gate(spark):
    df = spark.createDataFrame([(True, True), (False, True), (True, None)], "a boolean, b boolean")
    gates = contract.first_failure({"a": F.col("a"), "b": F.col("b")})
    assert [r.g for r in df.select(gates.alias("g")).collect()] == [None, ("a", ["b"]), ("b", [])]


def test_running_and_group_statistics(spark):
    rows = spark.createDataFrame([(1, "x", "ELIGIBLE", 2.0), (2, "x", "BLOCKED", None), (3, "y", "ELIGIBLE", 4.0), (4, "x", "ELIGIBLE", 4.0)], "i long, condition string, verdict string, v double")
    found = {r.i: (r.seen, r.eligible, r.blocked) for r in evaluation.running_stats(rows, "i").collect()}
    assert found == {1: (1, 1, 0), 2: (2, 1, 1), 3: (1, 1, 0), 4: (3, 2, 1)}
    assert sorted(map(tuple, evaluation.group_means(rows, "condition", "v").collect())) == [("x", 3.0, 2), ("y", 4.0, 1)]
