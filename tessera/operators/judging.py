"""Model judges around the matching: what they are asked, how their JSON is read, and what a failing judge changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import prompt_safe, verdict_block
from tessera.functions.values import json_block, json_field
from tessera.providers import Judge, judged

from .evaluation import skipped

#: The one category of inputs that goes on, and what a judgment says where the model left a field out.
SUPPORTED_INPUT = "valid_supported_clinical_summary"
INPUT_DEFAULTS = {"is_valid": ("boolean", False), "category": ("string", "unsafe_or_prompt_injection"), "supported_condition": ("string", "unknown"), "reason": ("string", "No reason provided")}
OUTPUT_DEFAULTS = {"is_safe": ("boolean", False), "is_grounded": ("boolean", False), "category": ("string", "unsupported_claims"), "reason": ("string", "No reason provided")}
_VERDICT = "array<struct<nct_id:string,verdict:string,fitness_score:int,disqualifying_criterion:string>>"


def _judgment(answer: Column, defaults: dict) -> Column:
    """The fields of a judge's JSON as a struct; null where there is no JSON."""
    block = json_block(answer)
    fields = F.struct(*(json_field(block, name, kind, default).alias(name) for name, (kind, default) in defaults.items()))
    return F.when(block.isNotNull(), fields)


def input_stage(answer: Column, failed: Column) -> Column:
    """(stage, reason, flag) of a judged input: where it is blocked and why, or the flag of a judge that failed; else nulls.

    A judge that fails, or says no JSON, flags the request and lets it go on.
    """
    said = _judgment(F.when(~failed, answer), INPUT_DEFAULTS)
    stage = F.when(said.isNull(), None).when(~said["is_valid"], "input_llm_judge").when(said["category"] != SUPPORTED_INPUT, "input_scope")
    return F.struct(stage.alias("stage"), F.when(stage.isNotNull(), said["reason"]).alias("reason"), F.when(said.isNull(), F.concat(F.lit("input_llm_guardrail_error: "), F.when(failed, answer).otherwise("no JSON"))).alias("flag"))


def output_stage(answer: Column, failed: Column) -> Column:
    """The same of a judged recommendation, which must be safe and grounded."""
    said = _judgment(F.when(~failed, answer), OUTPUT_DEFAULTS)
    stage = F.when(said.isNotNull() & ~(said["is_safe"] & said["is_grounded"]), "output_llm_judge")
    return F.struct(stage.alias("stage"), F.when(stage.isNotNull(), said["reason"]).alias("reason"), F.when(said.isNull(), F.concat(F.lit("output_llm_guardrail_error: "), F.when(failed, answer).otherwise("no JSON"))).alias("flag"))


def judge_rows(df: DataFrame, prompt: str, judge: Judge | None, stage, column: str = "judgment") -> DataFrame:
    """`df` with (stage, reason, flag) in `column`, from a judge over the texts of `prompt`; without a judge every row is flagged."""
    asked = judged(df, prompt, judge, "_answer", failed="_failed")
    return asked.withColumn(column, stage(F.col("_answer"), F.col("_failed"))).drop("_answer", "_failed")


def trials_block(trials: Column) -> Column:
    """The numbered block of trials in a judge's prompt, from structs with the fields named here; what is missing is N/A."""

    def one(t: Column, i: Column) -> Column:
        shown = lambda name: F.coalesce(t[name].cast("string"), F.lit("N/A"))
        safe = lambda name, n: F.coalesce(prompt_safe(t[name], n), F.lit(""))
        parts = [
            "TRIAL ", (i + 1).cast("string"), ": ", F.coalesce(F.nullif(t["nct_number"], F.lit("")), F.lit("UNKNOWN")), "\nTitle: ", safe("study_title", 120), "\nCondition: ", safe("conditions", 200),
            "\nAge: ", shown("min_age"), " - ", shown("max_age"), "  |  Sex: ", shown("sex"), "  |  Status: ", shown("recruitment_status"), "\nEligibility Criteria: ", safe("eligibility_criteria", 800),
        ]
        return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    return F.array_join(F.transform(trials, one), "\n\n")


def _filled(template: str, **values: Column) -> Column:
    """A template with its {names} replaced; a value's own braces stay."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = {rest.find("{" + n + "}"): n for n in values if "{" + n + "}" in rest}
        if not at:
            parts.append(F.lit(rest))
            break
        first = min(at)
        parts += [F.lit(rest[:first]), values[at[first]]]
        rest = rest[first + len(at[first]) + 2 :]
    return F.concat(*parts)


def evaluate(results: DataFrame, judge: Judge, per_trial: str, overall: str) -> DataFrame:
    """The judge's evaluation of results (patient_id, summary, status, reason, trials), in two rounds of calls.

    The first asks for a verdict on each trial, the second, with these, for a score. Blocked results and those without trials are
    not sent. A call that fails, or whose answer is no JSON, leaves no verdicts and an error with the score. `per_trial` has
    {patient_summary} and {trials_block}, `overall` {patient_summary} and {verdicts_block}.
    """
    why = skipped(F.col("status"), F.col("reason"), F.col("trials"))
    rows = results.withColumn("why", why)
    sent = rows.where("why IS NULL")
    first = judged(sent.withColumn("_prompt", _filled(per_trial, patient_summary=F.col("summary"), trials_block=trials_block(F.col("trials")))), "_prompt", judge, "_answer", failed="_failed")
    found = F.try_variant_get(json_block(F.when(~F.col("_failed"), F.col("_answer"))), "$.trials", _VERDICT)
    verdicts = first.withColumn("trial_verdicts", F.coalesce(found, F.array().cast(_VERDICT)))
    block = F.when(F.size("trial_verdicts") > 0, verdict_block(F.col("trial_verdicts"))).otherwise("No trial verdicts available.")
    second = judged(verdicts.withColumn("_prompt", _filled(overall, patient_summary=F.col("summary"), verdicts_block=block)), "_prompt", judge, "_answer", failed="_failed")
    said = json_block(F.when(~F.col("_failed"), F.col("_answer")))
    error = F.when(F.col("_failed"), F.col("_answer")).when(said.isNull(), "no JSON")
    done = second.select(
        "patient_id", F.size("trials").alias("num_trials"), "trial_verdicts", F.try_variant_get(said, "$.overall_score", "double").alias("score"), json_field(said, "top_trial", "string", "").alias("top_trial"), json_field(said, "summary", "string", "").alias("summary"),
        json_field(said, "score_reasoning", "string", "").alias("score_reasoning"), error.alias("error"), F.lit(2).alias("calls"),
    )
    none = F.lit(None)
    left = rows.where("why IS NOT NULL").select("patient_id", F.lit(0).alias("num_trials"), F.array().cast(_VERDICT).alias("trial_verdicts"), none.cast("double").alias("score"), F.lit("").alias("top_trial"), "why.summary", "why.score_reasoning", none.cast("string").alias("error"), F.lit(0).alias("calls"))
    return done.unionByName(left)
