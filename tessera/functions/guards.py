"""Privacy, input, output and grounding checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Personal data, in the order of replacement.
PII = [
    ("email", r"\b[\w\.-]+@[\w\.-]+\.\w+\b"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("ssn", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"),
    ("dob", r"\b(?:dob|date of birth)\s*[:\-]?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
]
#: Limits and patterns of the checks.
MAX_INPUT, MAX_OUTPUT = 12_000, 40_000
INJECTION = ["ignore previous instructions", "ignore all instructions", "reveal system prompt", "show hidden prompt", "bypass safety", "developer message", "system prompt"]
BANNED = [r"\btake\s+\d+", r"\bprescribe\b", r"\bstart medication\b", r"\bincrease medication\b", r"\breduce medication\b", r"\byou should take\b", r"\bi recommend starting\b"]
SIGNALS = [
    r"\b(age|years old|yo|min age|max age)\b",
    r"\b(male|female|sex)\b",
    r"\b(diagnosis|diagnosed|condition|disease|history of)\b",
    r"\b(medication|allergy|stage|a1c|hba1c|glucose|insulin|metformin|tumor|bp|blood pressure|bmi|eligibility|trial)\b",
]
SUPPORTED = ["diabetes", "breast cancer", "breast_cancer"]
DISCLAIMER = (
    "Disclaimer: This AI-generated output is for informational purposes only and must not be used as medical advice, diagnosis, prescribing guidance, or treatment recommendation. "
    "Please consult your doctor or healthcare provider before making any clinical decisions or enrolling in a clinical trial."
)


#: What a text must hold for the pattern of that name to occur: a cheap look before the search.
_HINTS = {"email": "@", "phone": r"\d{4}", "ssn": r"\d{4}", "dob": "(?i)dob|date of birth"}


def pii_hits(text: Column) -> Column:
    """A map of counts on the original text."""
    return F.create_map(*(x for name, pattern in PII for x in (F.lit(name), F.when(text.isNull() | text.rlike(_HINTS[name]), F.regexp_count(text, F.lit(f"(?i){pattern}"))).otherwise(0))))


def redact_pii(text: Column) -> Column:
    def without(name: str, pattern: str):
        return lambda t: F.when(t.rlike(_HINTS[name]), F.regexp_replace(t, f"(?i){pattern}", f"[REDACTED_{name.upper()}]")).otherwise(t)

    for name, pattern in PII:
        text = bound(text, without(name, pattern))
    return text


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def input_problem(text: Column) -> Column:
    """The first reason to refuse an input, or null."""
    low = F.lower(text)
    score = sum((low.rlike(pattern).cast("int") for pattern in SIGNALS), F.lit(0))
    return (
        F.when(_blank(text), "Input is empty")
        .when(F.length(text) > MAX_INPUT, f"Input exceeds max length of {MAX_INPUT} characters")
        .when(low.rlike("|".join(INJECTION)), "Prompt injection or instruction override pattern detected")
        .when(score < 2, "Input lacks sufficient clinical structure")
    )


def output_problem(text: Column) -> Column:
    """The first reason to refuse an output, or null."""
    low = F.lower(text)
    return (
        F.when(_blank(text), "Recommendation is empty")
        .when(F.length(text) > MAX_OUTPUT, f"Recommendation exceeds max length of {MAX_OUTPUT} characters")
        .when(low.rlike("|".join(BANNED)), "Dosage or prescribing style advice detected")
        .when(~low.contains("consult your doctor") & ~low.contains("healthcare provider"), "Missing required medical disclaimer")
    )


def with_disclaimer(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("consult your doctor") | low.contains("healthcare provider"), text).otherwise(F.concat(F.trim(text), F.lit("\n\n" + DISCLAIMER)))


def grounding_problem(text: Column, ids: Column, titles: Column) -> Column:
    """Cited ids must have been retrieved; without cited ids, trial headings must name a retrieved title."""
    cited = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bNCT\d{8}\b"), F.lit(0)))
    known = F.transform(F.filter(ids, lambda x: x.isNotNull() & (x != "")), lambda x: F.trim(x))
    names = F.transform(F.filter(titles, lambda x: x.isNotNull() & (x != "")), lambda x: F.lower(F.trim(x)))
    heads = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.lower(F.trim(x))), lambda x: x.startswith("**trial"))
    loose = F.exists(heads, lambda line: ~F.exists(names, lambda t: line.contains(t)))
    return F.when(F.size(F.array_except(cited, known)) > 0, "Recommendation references trials outside retrieved context").when(loose & (F.size(cited) == 0), "Recommendation may contain ungrounded trial references")


def retrieval_problem(ids: Column) -> Column:
    return F.when(ids.isNull() | (F.size(ids) == 0), "No trials retrieved").when(F.exists(ids, lambda x: x.isNull() | (x == "")), "Retrieved trial missing identifier")


def scope_problem(texts: Column) -> Column:
    """texts: conditions and disease of each trial."""
    outside = F.exists(texts, lambda t: ~F.lower(F.coalesce(t, F.lit(""))).rlike("|".join(SUPPORTED)))
    return F.when(texts.isNull() | (F.size(texts) == 0), "No reranked trials available").when(outside, "Retrieved trial outside supported disease scope")


def guard_status(status: Column, recommendation: Column) -> Column:
    text = F.coalesce(recommendation, F.lit(""))
    return (
        F.when(F.coalesce(status, F.lit("")) == "blocked", "blocked").when(text.startswith("Guardrail triggered at"), "blocked").when(F.lower(text).contains("did not pass"), "flagged").when(status == "passed", "passed").otherwise("unknown")
    )


def guard_reason(reason: Column, stage: Column) -> Column:
    return F.coalesce(F.nullif(reason, F.lit("")), stage, F.lit(""))


def blocked_response(reason: Column, summary: Column, stage: str) -> Column:
    """The constant-shape answer of a blocked request."""
    message = F.concat(F.lit(f"Guardrail triggered at {stage}: "), reason, F.lit(". This service supports informational clinical trial matching only for diabetes and breast cancer use cases.\n\n" + DISCLAIMER))
    none = F.array().cast("array<string>")
    guard = F.struct(F.lit("blocked").alias("status"), F.lit(stage).alias("stage"), reason.alias("reason"), pii_hits(summary).alias("pii_hits"), none.alias("flag_reasons"))
    return F.struct(summary.alias("patient_summary"), none.alias("candidates_before_rerank"), none.alias("retrieved_trials"), message.alias("recommendation"), guard.alias("guardrail"))
