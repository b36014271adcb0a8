"""Evaluation analytics: verdict tables, summaries, slices, thresholds, regressions, ablations and sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import verdicts as V

#: Limits of the alerts and gates.
MIN_SCORE, LOW_SCORE, MIN_ELIGIBLE, MAX_NOT_ELIGIBLE, MIN_PATIENTS = 3.0, 2.0, 0.30, 0.70, 3
MIN_SUCCESS, MIN_MATCHED, SLICE_ERROR, SLICE_WARNING, TOLERANCE = 0.7, 3.0, 2.0, 1.0, 0.2
ORDER = ["ELIGIBLE", "BORDERLINE", "INELIGIBLE", "BLOCKED"]


def result_rows(results: DataFrame) -> DataFrame:
    """One row a result (patient_id, condition, recommendation, judgment, status, flag_reasons, trials) with its verdicts counted."""
    found, second = V.verdicts(F.col("recommendation")), V.verdicts(F.col("judgment"))
    judged = (F.coalesce("judgment", F.lit("")) != "") & ~F.col("judgment").startswith("(")
    flags = F.coalesce("flag_reasons", F.array().cast("array<string>"))
    same = F.when(judged, V.agreement(found, second))
    count = lambda name: F.size(F.filter(found, lambda v: v == name))
    has = lambda word: F.exists(flags, lambda f: F.lower(f).contains(word.lower()))
    return results.select(
        F.substring("patient_id", 1, 8).alias("patient_id"), F.lower(F.coalesce("condition", F.lit("unknown"))).alias("condition"), F.coalesce("status", F.lit("unknown")).alias("guardrail_status"), V.report_verdict(found, F.col("status")).alias("verdict"),
        F.size(F.coalesce("trials", F.array().cast("array<string>"))).alias("n_retrieved"), *(count(v).alias(f"n_{v.lower()}") for v in ORDER[:3]), F.size(found).alias("n_verdicts"), F.size(flags).alias("flag_count"),
        F.array_join(F.slice(flags, 1, 2), "; ").alias("flag_reasons"), judged.alias("judged"), F.coalesce(same["same"], F.lit(0)).alias("consensus"), F.coalesce(same["different"], F.lit(0)).alias("disagreement"),
        has("input_llm_guardrail_error").alias("input_error"), has("output_llm_guardrail_error").alias("output_error"), has("Dosage").alias("policy_flagged"), has("grounding").alias("grounding_flagged"),
    )


def kpis(rows: DataFrame) -> DataFrame:
    """One row of counts and rates; no row for no results."""
    n = F.count("*")
    share = lambda test: 100.0 * F.count_if(test) / n
    verdict, status = F.col("verdict"), F.col("guardrail_status")
    agreed, all_ = F.sum(F.when(F.col("judged"), F.col("consensus"))), F.sum(F.when(F.col("judged"), F.col("consensus") + F.col("disagreement")))
    return rows.agg(
        n.alias("total"), *(F.count_if(verdict == v).alias(f"{v.lower()}_count") for v in ORDER), F.count_if(status == "flagged").alias("flagged_count"), F.count_if(status == "passed").alias("passed_count"), share(verdict == "ELIGIBLE").alias("eligible_rate"),
        share(verdict == "BORDERLINE").alias("borderline_rate"), share(verdict == "BLOCKED").alias("block_rate"), share(status == "flagged").alias("flag_rate"), F.avg("n_retrieved").alias("avg_retrieved"),
        (100.0 * F.coalesce(agreed, F.lit(0)) / F.greatest(F.coalesce(all_, F.lit(0)), F.lit(1))).alias("consensus_rate"), F.count_if("judged").alias("judged_count"), F.count_if("input_error").alias("input_errors"), F.count_if("output_error").alias("output_errors"),
        F.count_if("policy_flagged").alias("policy_flags"),
    ).where("total > 0")


def condition_breakdown(rows: DataFrame, conditions: Sequence[str] = ("breast_cancer", "diabetes", "other")) -> DataFrame:
    """Counts a condition in a fixed order; conditions without rows are left out."""
    rank = F.array_position(F.array(*(F.lit(c) for c in conditions)), F.col("condition"))
    out = rows.where(F.col("condition").isin(list(conditions))).groupBy("condition").agg(F.count("*").alias("patients"), *(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ORDER), F.avg("n_retrieved").alias("avg_retrieved"))
    return out.withColumn("eligible_rate", F.format_string("%.0f%%", 100.0 * F.col("eligible") / F.col("patients"))).orderBy(rank)


def verdict_pivot(rows: DataFrame) -> DataFrame:
    return rows.groupBy("condition").pivot("verdict", ORDER).agg(F.count(F.lit(1)))


def group_means(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, average, n) of a numeric column."""
    return rows.groupBy(key).agg(F.avg(value).alias("average"), F.count(value).alias("n"))


def running_stats(rows: DataFrame, order: str) -> DataFrame:
    """After each result of a condition, in order: how many of each verdict so far."""
    w = Window.partitionBy("condition").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(order, "condition", "verdict", F.count("*").over(w).alias("seen"), *(F.count_if(F.col("verdict") == v).over(w).alias(v.lower()) for v in ORDER))


def by_verdict_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.array_position(F.array(*(F.lit(v) for v in ORDER)), F.col("verdict")))


def run_summary(evaluations: DataFrame) -> DataFrame:
    """One row from (patient_id, score, calls, guardrail_status, trial_verdicts): mean score, verdict and status distributions, calls, patients."""
    nested = evaluations.select(F.explode("trial_verdicts").alias("v")).groupBy(F.coalesce("v", F.lit("UNKNOWN")).alias("v")).count()
    status = evaluations.groupBy(F.coalesce("guardrail_status", F.lit("unknown")).alias("s")).count()
    as_map = lambda df, key: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "count")))).alias(f"{key}_map"))
    one = evaluations.agg(F.count("*").alias("patients"), F.avg(F.col("score").try_cast("double")).alias("average_score"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))
    return one.join(F.broadcast(as_map(nested, "v"))).join(F.broadcast(as_map(status, "s"))).withColumnsRenamed({"v_map": "verdicts", "s_map": "statuses"})  # one row each


def breaches(summary: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, value, threshold, severity) of breached limits, from (average_score, eligible, not_eligible, verdict_total, patients) a row a run."""
    whole = F.greatest(F.col("verdict_total"), F.lit(1))
    yes, no = F.col("eligible") / whole, F.col("not_eligible") / whole
    row = lambda metric, value, threshold, severity, test: F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), severity.alias("severity"), F.coalesce(test, F.lit(False)).alias("breached"))
    rules = F.array(
        row("average_overall_score", F.col("average_score"), MIN_SCORE, F.when(F.col("average_score") < LOW_SCORE, "HIGH").otherwise("MEDIUM"), F.col("average_score") < MIN_SCORE),
        row("eligible_percentage", 100 * yes, 100 * MIN_ELIGIBLE, F.lit("MEDIUM"), yes < MIN_ELIGIBLE),
        row("not_eligible_percentage", 100 * no, 100 * MAX_NOT_ELIGIBLE, F.lit("HIGH"), no > MAX_NOT_ELIGIBLE),
        row("patients_evaluated", F.col("patients"), MIN_PATIENTS, F.lit("MEDIUM"), F.col("patients") < MIN_PATIENTS),
    )
    return summary.select(*keys, F.inline(rules)).where("breached").drop("breached")


def alert_status(found: DataFrame) -> DataFrame:
    return found.agg(F.when(F.count("*") > 0, "ALERT").otherwise("OK").alias("status"), F.count("*").alias("breaches"))


def slice_metrics(results: DataFrame, slices: Sequence[str], value: str, success: Column) -> DataFrame:
    """(metric, average) of successful rows for each value of each slice column, in one pass."""
    long = results.where(success).select(F.col(value).alias("v"), F.explode(F.array(*(F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices))).alias("s")).select("v", "s.*")
    return long.groupBy("slice", "value").agg(F.avg("v").alias("average"), F.count("*").alias("n")).select(F.concat_ws("_", F.lit("avg"), F.lit(value), "slice", "value").alias("metric"), "average", "n")


def slice_gaps(metrics: DataFrame, overall: float) -> DataFrame:
    gap = F.lit(overall) - F.col("average")
    return metrics.withColumn("gap", gap).withColumn("level", F.when(gap > SLICE_ERROR, "error").when(gap > SLICE_WARNING, "warning").otherwise("ok"))


def passes(success_rate: Column, matched: Column) -> Column:
    return (success_rate >= MIN_SUCCESS) & (matched >= MIN_MATCHED)


def regressions(runs: DataFrame, order: str, metrics: dict[str, float], tolerance: float = TOLERANCE, within: Sequence[str] = ()) -> DataFrame:
    """Each run beside the one before it (or a base value), and whether a metric fell by more than the tolerance."""
    w = Window.partitionBy(*(within or [F.lit(1)])).orderBy(order)
    for m, base in metrics.items():
        runs = runs.withColumn(f"previous_{m}", F.coalesce(F.lag(m).over(w), F.lit(base)))
    test = F.lit(False)
    for m in metrics:
        test = test | (F.col(m) < F.col(f"previous_{m}") * (1 - tolerance))
    return runs.withColumn("regressed", test)


def overlap(baseline: Column, other: Column) -> Column:
    """(overlap_ratio, avg_rank_shift, importance) of two id lists; an empty baseline gives (0, 0, 1)."""
    common = F.array_intersect(baseline, other)
    shift = F.aggregate(F.transform(common, lambda x: F.abs(F.array_position(baseline, x) - F.array_position(other, x)).cast("double")), F.lit(0.0), lambda total, x: total + x)
    part = F.size(common) / F.greatest(F.size(F.array_distinct(baseline)), F.lit(1))
    return F.struct(part.alias("overlap_ratio"), (shift / F.greatest(F.size(common), F.lit(1))).alias("avg_rank_shift"), (1 - part).alias("importance"))


def feature_importance(ablations: DataFrame) -> DataFrame:
    """Features by mean importance: (rank, feature, average)."""
    means = ablations.groupBy("feature").agg(F.avg("importance").alias("average"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("average"), "feature")))


def sweep_metrics(runs: DataFrame) -> DataFrame:
    """Means and success of (param, value, slice, candidates, matched, success) for each setting."""
    ok = F.col("success")
    return runs.groupBy("param", "value").agg(
        F.coalesce(F.avg(F.when(ok, F.col("candidates"))), F.lit(0.0)).alias("avg_candidates"), F.coalesce(F.avg(F.when(ok, F.col("matched"))), F.lit(0.0)).alias("avg_matched"),
        F.coalesce(F.avg(F.when(ok & (F.col("slice") == "ood"), F.col("matched"))), F.lit(0.0)).alias("avg_ood_matched"), (F.count_if(ok) / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"),
    )


def skipped(status: Column, reason: Column, trials: Column) -> Column:
    """Why a result is not sent to a judge, as (summary, score_reasoning); null when it is."""
    row = lambda summary, why: F.struct(F.lit(summary).alias("summary"), why.alias("score_reasoning"))
    blocked = row("Evaluation skipped because the case was blocked by guardrails.", F.coalesce(F.nullif(reason, F.lit("")), F.lit("Blocked before evaluation.")))
    empty = row("No retrieved trials available for evaluation.", F.lit("RAG produced zero reranked trials."))
    return F.when(status == "blocked", blocked).when(trials.isNull() | (F.size(trials) == 0), empty)


def latest_run(df: DataFrame, run: str) -> DataFrame:
    """The rows of the last run by name."""
    last = df.agg(F.max(run).alias("_last_run"))
    return df.join(F.broadcast(last), F.col(run) == F.col("_last_run")).drop("_last_run")  # one row


def by_trial_number(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two judges' (patient_id, trial, verdict) side by side."""
    other = second.select("patient_id", "trial", F.col("verdict").alias("second_verdict"))
    return first.join(other, ["patient_id", "trial"], "left").withColumn("agree", F.col("verdict") == F.col("second_verdict"))
