"""Verdicts read from model texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The verdict format.
VERDICT = r"(?i)VERDICT\s*:\s*(ELIGIBLE|INELIGIBLE|BORDERLINE)"


def verdicts(text: Column) -> Column:
    """All verdicts, upper-cased, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(VERDICT), F.lit(1)), F.upper)


def overall_verdict(found: Column, status: Column) -> Column:
    """A blocked guardrail first, then the best verdict."""
    return F.when(F.coalesce(status, F.lit("")) == "blocked", "BLOCKED").when(F.array_contains(found, "ELIGIBLE"), "ELIGIBLE").when(F.array_contains(found, "BORDERLINE"), "BORDERLINE").when(F.size(found) > 0, "INELIGIBLE").otherwise("BLOCKED")


def report_verdict(found: Column, status: Column) -> Column:
    """The report's precedence: a good verdict counts even if the guardrail blocked."""
    return F.when(F.array_contains(found, "ELIGIBLE"), "ELIGIBLE").when(F.array_contains(found, "BORDERLINE"), "BORDERLINE").when((F.coalesce(status, F.lit("")) == "blocked") | (F.size(found) == 0), "BLOCKED").otherwise("INELIGIBLE")


def agreement(first: Column, second: Column) -> Column:
    """(same, different) of two verdict lists by position, up to the shorter one's length."""
    n = F.least(F.size(first), F.size(second))
    pairs = F.arrays_zip(F.slice(first, 1, n).alias("a"), F.slice(second, 1, n).alias("b"))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.struct(same.alias("same"), (n - same).alias("different"))


def judge_lines(text: Column) -> Column:
    """(trial, verdict, reason) of lines such as "Trial 2: AGREE — because"."""
    lines = F.regexp_extract_all(text, F.lit(r"(?im)^\W*trial\s+\d+\s*:\s*[A-Z ]+?\s*[—–-].*$"), F.lit(0))
    pick = lambda x, g: F.trim(F.regexp_extract(x, r"(?i)trial\s+(\d+)\s*:\s*([A-Z ]+?)\s*[—–-]\s*(.*)$", g))
    return F.transform(lines, lambda x: F.struct(pick(x, 1).cast("int").alias("trial"), F.upper(pick(x, 2)).alias("verdict"), pick(x, 3).alias("reason")))
