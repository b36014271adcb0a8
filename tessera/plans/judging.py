"""Registered queries over judges, reports, status tables and the streams of finished runs, from the test tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import classify, values
from tessera.operators import contract, evaluation, judging
from tessera.providers import embed
from tessera.session import shared_folder
from tessera.sources import sinks
from tessera.sources.tables import table
from tessera.streaming import events as streams
from tessera.streaming import upserts

from .catalogue import query
from .gates import _LETTERS_SQL, _UNIT_SQL, letters


def _key_of(prompt: str) -> int:
    return int(re.search(r"key (\d+)", prompt)[1])


# --- judges -------------------------------------------------------------------------------------------------------------------
def _input_judge(prompt: str) -> str:
    """Fails, says no JSON, refuses, finds the input out of scope, lets it pass inside a fence, or leaves all fields out."""
    k = _key_of(prompt)
    if k % 6 == 0:
        raise RuntimeError(f"down {k}")
    valid = {"is_valid": True, "category": judging.SUPPORTED_INPUT, "reason": "fits"}
    return ["", "I cannot say", json.dumps(valid | {"is_valid": False, "reason": f"refused {k}"}), json.dumps(valid | {"category": "valid_but_unsupported_condition", "reason": f"asthma {k}"}), f"Sure:\n```json\n{json.dumps(valid)}\n```", "{}"][k % 6]


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'input_llm_judge' WHEN 3 THEN 'input_scope' WHEN 5 THEN 'input_llm_judge' END AS stage,
CASE o_orderkey % 6 WHEN 2 THEN 'refused ' || o_orderkey WHEN 3 THEN 'asthma ' || o_orderkey WHEN 5 THEN 'No reason provided' END AS reason,
CASE o_orderkey % 6 WHEN 0 THEN 'input_llm_guardrail_error: down ' || o_orderkey WHEN 1 THEN 'input_llm_guardrail_error: no JSON' END AS flag FROM orders""")
def judged_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Where a judge stops an input, and how one that fails only flags it."""
    asked = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Input: key "), F.col("o_orderkey").cast("string")).alias("prompt"))
    return judging.judge_rows(asked, "prompt", _input_judge, judging.input_stage).select("o_orderkey", "judgment.*")


def _output_judge(prompt: str) -> str:
    return _output_judge.batch([prompt])[0]


def _output_batch(prompts: list[str]) -> list[str]:
    """Answers for a whole batch; one bad prompt spoils it, and is then asked alone."""
    keys = [_key_of(p) for p in prompts]
    if bad := next((k for k in keys if k % 5 == 4), None):
        raise ValueError(f"bad {bad}")
    return [json.dumps({"is_safe": k % 5 != 1, "is_grounded": k % 5 != 2, "reason": f"seen {k}"}) for k in keys]


_output_judge.batch = _output_batch


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'output_llm_judge' END AS stage, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'seen ' || o_orderkey END AS reason, CASE WHEN o_orderkey % 5 = 4 THEN 'output_llm_guardrail_error: bad ' || o_orderkey END AS flag FROM orders""")
def judged_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The same of recommendations, asked in batches of which some fail for one prompt."""
    asked = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Output: key "), F.col("o_orderkey").cast("string")).alias("prompt"))
    return judging.judge_rows(asked, "prompt", _output_judge, judging.output_stage).select("o_orderkey", "judgment.*")


def _trial(key: Column, n: int) -> Column:
    """The n-th trial of a customer."""
    return F.struct(
        F.concat(F.lit(f"N{n}_"), key.cast("string")).alias("nct_number"), F.concat(F.lit('Say "t'), F.lit(f"{n}"), F.lit('"\n')).alias("study_title"), F.when(key % 2 == 0, "c").alias("conditions"), F.lit(None).cast("string").alias("eligibility_criteria"),
        F.lit(18 + n).alias("min_age"), F.when(key % 4 == 1, "80").alias("max_age"), F.lit("ALL").alias("sex"), F.lit("OPEN").alias("recruitment_status"),
    )


def _trials(key: Column) -> Column:
    return F.slice(F.array(*(_trial(key, n) for n in (1, 2, 3))), 1, (key % 4).cast("int"))


_TRIAL_SQL = """'TRIAL ' || n || ': N' || n || '_' || c_custkey || chr(10) || 'Title: Say ''t' || n || '''' || chr(10) || 'Condition: ' || CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE '' END || chr(10) || 'Age: ' || (18 + n) || ' - ' || CASE WHEN c_custkey % 4 = 1 THEN '80' ELSE 'N/A' END
|| '  |  Sex: ALL  |  Status: OPEN' || chr(10) || 'Eligibility Criteria: '"""


@query(f"SELECT c_custkey, coalesce(string_agg({_TRIAL_SQL}, chr(10) || chr(10) ORDER BY n) FILTER (n <= c_custkey % 4), '') AS block FROM customer, (SELECT unnest([1, 2, 3]) AS n) GROUP BY c_custkey")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The numbered block of none to three trials that a judge is shown."""
    return table(spark, d, "customer").select("c_custkey", judging.trials_block(_trials(F.col("c_custkey"))).alias("block"))


def _evaluation_judge(prompt: str) -> str:
    """Verdicts by the number in each trial's id; the score is the number of eligible ones. Every seventh patient's calls fail, some answers are no JSON."""
    k = _key_of(prompt)
    if prompt.startswith("TRIALS"):
        if k % 7 == 0:
            raise RuntimeError("no trials")
        ids = re.findall(r"^TRIAL \d+: (\S+)", prompt, re.M)
        return json.dumps({"trials": [{"nct_id": i, "verdict": "ELIGIBLE" if (k + n) % 2 else "NOT_ELIGIBLE", "fitness_score": n + 1} for n, i in enumerate(ids)]})
    if k % 5 == 1:
        return "no idea"
    if k % 11 == 0:
        raise RuntimeError(f"down {k}")
    lines = [line for line in prompt.split("\n") if line.startswith("- ")]
    return json.dumps({"overall_score": sum("[ELIGIBLE" in line for line in lines), "summary": lines[0] if lines else "none", "score_reasoning": "counted"})


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS n, c_custkey % 9 = 4 AS blocked FROM customer),
t AS (SELECT *, NOT blocked AND n > 0 AS sent, CASE WHEN NOT blocked AND n > 0 AND k % 7 <> 0 THEN n ELSE 0 END AS verdicts FROM c),
e AS (SELECT *, CASE WHEN verdicts = 0 THEN 0 ELSE len(list_filter(range(0, verdicts), lambda i: (k + i) % 2 = 1)) END AS eligible, CASE WHEN sent AND k % 5 = 1 THEN 'no JSON' WHEN sent AND k % 11 = 0 THEN 'down ' || k END AS error FROM t)
SELECT k AS patient_id, CASE WHEN sent THEN n ELSE 0 END AS num_trials, verdicts, eligible, CASE WHEN sent AND error IS NULL THEN CAST(eligible AS DOUBLE) END AS score,
CASE WHEN blocked THEN 'Evaluation skipped because the case was blocked by guardrails.' WHEN n = 0 THEN 'No retrieved trials available for evaluation.' WHEN error IS NOT NULL THEN '' WHEN verdicts = 0 THEN 'none'
 ELSE '- N1_' || k || '  [' || CASE WHEN k % 2 = 1 THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END || '  1/5]  no disqualifier' END AS summary, error, CASE WHEN sent THEN 2 ELSE 0 END AS calls FROM e""")
def judged_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of a judge over all results that may be judged."""
    k = F.col("c_custkey")
    results = table(spark, d, "customer").select(k.alias("patient_id"), F.concat(F.lit("key "), k.cast("string")).alias("summary"), F.when(k % 9 == 4, "blocked").otherwise("passed").alias("status"), F.lit("").alias("reason"), _trials(k).alias("trials"))
    found = judging.evaluate(results, _evaluation_judge, "TRIALS for {patient_summary}\n{trials_block}", "OVERALL for {patient_summary}\n{verdicts_block}")
    eligible = F.size(F.filter("trial_verdicts", lambda v: v["verdict"] == "ELIGIBLE"))
    return found.select("patient_id", "num_trials", F.size("trial_verdicts").alias("verdicts"), eligible.alias("eligible"), "score", "summary", "error", "calls")


@query(f"""WITH l AS (SELECT item_id, {_LETTERS_SQL.format('text')} AS l FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)), v AS (SELECT item_id, {_UNIT_SQL.format('l')} AS v FROM l WHERE list_sum(l) > 0)
SELECT item_id, CAST(26 AS BIGINT) AS dimensions, round(list_sum(list_transform(range(1, 27), lambda i: v[i] * i)), 2) AS weighted FROM v""")
def embedded_items(spark: SparkSession, d: str) -> DataFrame:
    """Vectors beside their texts, whatever the sub-batches that the model is called with."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda t, x: t + x)
    found = embed(items, "text", letters, budget=200, rows=3).select("item_id", F.size("embedding").cast("long").alias("dimensions"), F.round(weighted, 2).alias("weighted"))
    return found.where("weighted > 0")


# --- reports --------------------------------------------------------------------------------------------------------------------
@query("SELECT c_mktsegment, round(avg(c_acctbal) FILTER (c_custkey % 3 <> 0), 6) AS average, count(*) FILTER (c_custkey % 3 <> 0) AS n FROM customer GROUP BY 1")
def group_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("x"))
    return evaluation.group_means(rows, "c_mktsegment", "x").withColumn("average", F.round("average", 6))


_VERDICT_NAMES = {"F": "ELIGIBLE", "O": "BORDERLINE", "P": "INELIGIBLE"}


@query("""WITH v AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS condition, CASE WHEN o_orderkey % 13 = 0 THEN 'BLOCKED' WHEN o_orderstatus = 'F' THEN 'ELIGIBLE' WHEN o_orderstatus = 'O' THEN 'BORDERLINE' WHEN o_orderstatus = 'P' THEN 'INELIGIBLE' END AS verdict FROM orders)
SELECT o_orderkey, condition, verdict, count(*) OVER w AS seen, count(*) FILTER (verdict = 'ELIGIBLE') OVER w AS eligible, count(*) FILTER (verdict = 'BORDERLINE') OVER w AS borderline, count(*) FILTER (verdict = 'INELIGIBLE') OVER w AS ineligible, count(*) FILTER (verdict = 'BLOCKED') OVER w AS blocked
FROM v WINDOW w AS (PARTITION BY condition ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of verdicts so far after each result of a condition."""
    verdict = values.mapped(F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")), _VERDICT_NAMES, "BLOCKED")
    return evaluation.running_stats(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("condition"), verdict.alias("verdict")), "o_orderkey")


@query("""WITH v AS (SELECT left('patient_' || o_orderkey, 8 + 3) AS patient_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ELIGIBLE' WHEN 'O' THEN 'BORDERLINE' ELSE 'Other' END AS verdict FROM orders WHERE o_custkey % 10 = 0)
SELECT patient_id, o_orderkey, verdict, CASE verdict WHEN 'Other' THEN 0 WHEN 'ELIGIBLE' THEN 1 ELSE 2 END AS place FROM v""")
def ordered_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts named by a map with a default and put in their fixed order; ids cut short."""
    verdict = values.mapped(F.col("o_orderstatus"), {"F": "ELIGIBLE", "O": "BORDERLINE"})
    rows = table(spark, d, "orders").where("o_custkey % 10 = 0").select(F.left(F.concat(F.lit("patient_"), F.col("o_orderkey").cast("string")), F.lit(11)).alias("patient_id"), "o_orderkey", verdict.alias("verdict"))
    place = F.array_position(F.array(*(F.lit(v) for v in evaluation.ORDER)), F.col("verdict")).cast("int")
    return evaluation.by_verdict_order(rows).withColumn("place", place)


@query("""WITH t AS (SELECT o_orderkey % 5 = 0 AS gestational, CASE WHEN o_orderkey % 3 = 0 THEN 'MALE' ELSE 'Female' END AS sex FROM orders),
s AS (SELECT count(*) AS total, count(*) FILTER (sex = 'MALE' AND NOT gestational) AS male, count(*) FILTER (sex = 'Female' AND NOT gestational) AS female, count(*) FILTER (sex = 'MALE') AS m2, count(*) FILTER (sex = 'Female') AS f2 FROM t)
SELECT 'diabetes' AS disease, total, male, female FROM s UNION ALL SELECT 'other', total, m2, f2 FROM s""")
def gestational_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Gestational trials do not count for sex, in a table about diabetes only."""
    k = F.col("o_orderkey")
    trials = table(spark, d, "orders").select(F.when(k % 3 == 0, "MALE").otherwise("Female").alias("Sex"), F.when(k % 5 == 0, "Gestational Diabetes").alias("disease_type"))
    rows = [contract.bias_report(trials.withColumn("disease", F.lit(name))).select(F.lit(name).alias("disease"), "total", "male", "female") for name in ("diabetes", "other")]
    return rows[0].unionByName(rows[1])


@query("""WITH t AS (SELECT o_custkey, count(*) >= 8 AS a, avg(o_totalprice) < 260000 AS b, count(*) FILTER (o_orderstatus = 'F') > 2 AS c FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN NOT a THEN 'validate' WHEN NOT b THEN 'anomalies' WHEN NOT c THEN 'bias' END AS failed, CASE WHEN NOT a THEN 'anomalies,bias' WHEN NOT b THEN 'bias' WHEN NOT c THEN '' END AS skipped FROM t""")
def short_circuit(spark: SparkSession, d: str) -> DataFrame:
    """The first gate that fails, and those behind it that do not run."""
    groups = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    gate = contract.first_failure({"validate": F.col("n") >= 8, "anomalies": F.col("price") < 260_000, "bias": F.col("done") > 2})
    return groups.select("o_custkey", gate["failed"].alias("failed"), F.array_join(gate["skipped"], ",").alias("skipped"))


# --- status and finished runs -----------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'completed' END WHEN o_orderkey % 5 <> 0 THEN 'processing' ELSE 'not_started' END AS state FROM orders")
def status_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Requests are told to be processed before their results come; a poll reads the newest."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(k)
    log = upserts.UpsertLog(spark, f"{shared_folder(spark, 'status')}/log", "o_orderkey long, version int, status string", "o_orderkey", "version")
    log.write(orders.where((k % 5 != 0) | (k % 3 == 0)).select("o_orderkey", F.lit(0).alias("version"), F.lit("processing").alias("status")), 0)
    log.write(orders.where(k % 3 == 0).select("o_orderkey", F.lit(1).alias("version"), F.when(k % 2 == 0, "failed").otherwise("passed").alias("status")), 1)
    log.write(orders.where(k % 3 == 0).select("o_orderkey", F.lit(0).alias("version"), F.lit("processing").alias("status")), 2)  # told late
    told = log.read()
    results = told.where("status <> 'processing'").select("o_orderkey", "status")
    asked = orders.join(told.select("o_orderkey", F.lit("t").alias("requested_at")), "o_orderkey", "left")
    return streams.request_status(asked, results, "o_orderkey").select("o_orderkey", "state")


@query("""WITH n AS (SELECT c_nationkey AS run, avg(c_acctbal) / 2000 AS score, count(*) FILTER (c_custkey % 4 = 0) AS yes, count(*) FILTER (c_custkey % 4 <> 0) AS no, count(*) AS whole FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1)
SELECT run, 'average_overall_score' AS metric, round(score, 6) AS value, CASE WHEN score < 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM n WHERE score < 3 UNION ALL SELECT run, 'eligible_percentage', round(100 * yes / whole, 6), 'MEDIUM' FROM n WHERE yes / whole < 0.3
UNION ALL SELECT run, 'not_eligible_percentage', round(100 * no / whole, 6), 'HIGH' FROM n WHERE no / whole > 0.7 UNION ALL SELECT run, 'patients_evaluated', whole, 'MEDIUM' FROM n WHERE whole < 3""")
def finished_runs(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of runs that a stream finds among other files, and the alerts that they raise."""
    from .gates import _files

    where = shared_folder(spark, "runs")
    n = F.col("c_nationkey")
    yes = F.col("c_custkey") % 4 == 0
    rows = table(spark, d, "customer").groupBy(n.alias("run")).agg((F.avg("c_acctbal") / 2000).alias("average_score"), F.count_if(yes).alias("eligible"), F.count_if(~yes).alias("not_eligible"), F.count("*").alias("verdict_total"), F.count("*").alias("patients"))
    name = F.concat(F.lit("run"), F.col("run").cast("string"), F.when(F.col("run") % 3 == 0, ".json").otherwise("_summary.json"))
    schema = rows.schema
    folder = _files(spark, rows.select(name.alias("name"), F.to_json(F.struct("*")).alias("value")), where)
    found = streams.summary_metrics(spark, folder, schema).writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start(f"{where}/out", "parquet")
    found.awaitTermination()
    told = evaluation.breaches(spark.read.schema(schema).parquet(f"{where}/out"), "run")
    alerts = sinks.alerts(told, F.col("run"))
    return alerts.select(F.col("run_id").alias("run"), "metric", F.round(F.split_part("message", F.lit(" "), F.lit(3)).cast("double"), 6).alias("value"), "severity")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'blue') THEN 'cold' WHEN contains(lower(p_name), 'red') THEN 'warm' ELSE 'grey' END AS kind FROM part")
def registered_condition(spark: SparkSession, d: str) -> DataFrame:
    """A condition added to the registry with a classifier of its own."""
    registry = classify.REGISTRY | {"colour": ("colour", lambda c: classify.classify(c, [("cold", ["blue"]), ("warm", ["red"])], "grey"))}
    return table(spark, d, "part").select("p_partkey", classify.classifier_of("colour", registry)(F.col("p_name")).alias("kind"))
