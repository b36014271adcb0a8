"""Schema contracts, validation gates, anomaly and bias reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import number

from .profile import column_profile, family, has_duplicates, outliers

#: The columns that a validated trial table needs, and those that must not be mostly null.
REQUIRED = ["NCT Number", "Study Title", "Recruitment Status", "Conditions", "Interventions", "Sponsor", "Enrollment", "Sex", "Location Countries", "Location Cities", "disease", "disease_type"]
CRITICAL = ["NCT Number", "Study Title", "Conditions"]
ANOMALY_REQUIRED = ["NCT Number", "Study Title", "Conditions", "disease", "disease_type"]
IGNORED_MISSING = ["Phase"]
NCT = r"^NCT\d{8}$"
AGE_GROUPS = {"pediatric": "Child|Pediatric", "adult": "Adult", "elderly": "Older Adult|65|Elder"}


@dataclass
class Contract:
    """What a table must look like: column families, required columns, domains and ranges."""

    columns: dict[str, str]
    required: list[str]
    max_null_pct: float = 80.0
    allowed: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, required: Sequence[str], **rules) -> Contract:
        return cls({f.name: family(f.dataType) for f in df.schema.fields}, list(required), **rules)


def invalid_id(column: Column, pattern: str = NCT) -> Column:
    """True also for null."""
    return ~F.coalesce(column.cast("string"), F.lit("nan")).rlike(pattern)


def violations(df: DataFrame, contract: Contract, allow_new: bool = True) -> DataFrame:
    """(rank, violation) in the order of the rules. Columns are compared from metadata; values in one pass."""
    names, found = df.columns, []
    add = lambda text: found.append(F.lit(text))
    if missing := [c for c in contract.required if c not in names]:
        add(f"Missing required columns: {missing}")
    if removed := sorted(set(contract.columns) - set(names)):
        add(f"Columns missing vs baseline schema: {removed}")
    if not allow_new and (new := sorted(set(names) - set(contract.columns))):
        add(f"New columns appeared (not allowed): {new}")
    for c, expected in contract.columns.items():
        if c in names:
            if (actual := family(df.schema[c].dataType)) != expected:
                add(f"Type drift for '{c}': expected {expected}, got {actual}")
            if c in contract.required:
                pct = 100 * F.avg(F.col(f"`{c}`").isNull().cast("int"))
                found.append(F.when(pct > contract.max_null_pct, F.format_string(f"Required '{c}' null_pct too high: %.1f%% > {contract.max_null_pct:.1f}%%", pct)))
    for c, allowed in contract.allowed.items():
        if c in names and allowed:
            value = F.upper(F.col(f"`{c}`").cast("string"))
            bad = F.array_sort(F.collect_set(F.when(~value.isin([str(a).upper() for a in allowed]), value)))
            found.append(F.when(F.size(bad) > 0, F.concat(F.lit(f"Invalid category values in '{c}': ['"), F.array_join(bad, "', '"), F.lit("']"))))
    for c, (low, high) in contract.ranges.items():
        if c in names:
            x = number(F.col(f"`{c}`"))
            if low is not None:
                found.append(F.when(F.min(x) < low, F.lit(f"'{c}' has values < {low}")))
            if high is not None:
                found.append(F.when(F.max(x) > high, F.lit(f"'{c}' has values > {high}")))
    if not found:
        found = [F.lit(None).cast("string")]
    one = df.agg(F.count("*").alias("rows"), *(f.alias(f"v{i}") for i, f in enumerate(found)))
    return one.select(F.posexplode(F.array_compact(F.array(*(f"v{i}" for i in range(len(found)))))).alias("rank", "violation"))


def check(df: DataFrame, contract: Contract | None, required: Sequence[str], mode: str = "enforce", allow_new: bool = True) -> tuple[Contract, list[str]]:
    """The contract (made from `df` if there is none) and what violates it; raises in mode "enforce"."""
    if contract is None:
        return Contract.of(df, required), []
    found = [r.violation for r in violations(df, contract, allow_new).orderBy("rank").collect()]
    if found and mode == "enforce":
        raise ValueError(f"schema contract violated: {found}")
    return contract, found


def validation(df: DataFrame, required: Sequence[str] = REQUIRED, critical: Sequence[str] = CRITICAL, id_col: str = "NCT Number", min_rows: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """One row: passed, rows and the errors of the gate; with `by` a row for each group of rows, as a table of its own."""
    has, n = set(df.columns), F.col("rows")
    sums = [F.count("*").alias("rows")]
    if id_col in has:
        sums.append(F.count_if(invalid_id(F.col(f"`{id_col}`"))).alias("invalid"))
    if "disease" in has:
        sums.append(F.count_if(F.col("disease").isNull()).alias("no_disease"))
    if "disease_type" in has:
        sums.append(F.count_if(F.col("disease_type") == "Unknown").alias("unknown"))
    sums += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(critical) if c in has]
    missing = [c for c in required if c not in has]
    errors = [F.when(n == 0, "Dataset is empty").when(n < min_rows, F.format_string("Too few rows: %d", n))]
    if missing:
        errors.append(F.lit(f"Missing columns: {missing}"))
    if id_col in has:
        errors.append(F.when(F.try_divide("invalid", "rows") > 0.10, F.format_string(f"%d rows have invalid {id_col} format", "invalid")))
    if "disease" in has:
        errors.append(F.when(F.col("no_disease") > 0, "disease column has nulls"))
    if "disease_type" in has:
        errors.append(F.when(F.col("unknown") > n * 0.5, F.lit("disease_type is Unknown for more than half of the rows")))
    errors += [F.when(F.try_divide(f"null_{i}", "rows") > 0.8, f"CRITICAL: {c} is mostly null") for i, c in enumerate(critical) if c in has]
    return df.groupBy(*by).agg(*sums).withColumn("errors", F.array_compact(F.array(*errors))).select(*by, (F.size("errors") == 0).alias("passed"), "rows", "errors")


def anomalies(df: DataFrame, required: Sequence[str] = ANOMALY_REQUIRED, id_col: str = "NCT Number", value: str = "Enrollment", order: str | None = None, ignored: Sequence[str] = IGNORED_MISSING) -> DataFrame:
    """One row: missing columns, duplicate ids, mostly missing columns, first outliers, invalid ids, and whether the gate stops."""
    missing = [c for c in required if c not in df.columns]
    high = column_profile(df.drop(order) if order else df, distinct=False).where(~F.col("column").isin(list(ignored)) & (F.col("null_pct") >= 70)).agg(F.array_sort(F.collect_list(F.struct("column", "null_pct"))).alias("high_missing_columns"))
    ids = df.agg((F.count_if(invalid_id(F.col(f"`{id_col}`"))) if id_col in df.columns else F.lit(0)).alias("invalid_ids"))
    repeated = has_duplicates(df, f"`{id_col}`") if id_col in df.columns else df.sparkSession.range(1).select(F.lit(False).alias("duplicates"))
    if value in df.columns and order:
        far = outliers(df, value, order).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]).alias("outliers"))
    else:
        far = df.sparkSession.range(1).select(F.array().cast("array<double>").alias("outliers"))
    columns = F.array(*(F.lit(c) for c in missing)).cast("array<string>")
    out = high.join(F.broadcast(ids)).join(F.broadcast(repeated)).join(F.broadcast(far)).withColumn("missing_columns", columns)  # one row each
    return out.withColumn("stops", (F.size("missing_columns") > 0) | F.col("duplicates") | (F.size("high_missing_columns") > 0))


def bias_report(df: DataFrame) -> DataFrame:
    """One row: sex counts and ratio, US share, age groups where there is an age column, warnings, score and level.

    Gestational trials do not count for sex when the table is about diabetes.
    """
    has = set(df.columns)
    sums, warnings = [F.count("*").alias("total")], []
    if age := next((c for c in ("Age", "stdAges") if c in has), None):
        text = F.coalesce(F.col(age).cast("string"), F.lit("nan"))
        sums += [F.count_if(text.rlike(f"(?i){pattern}")).alias(name) for name, pattern in AGE_GROUPS.items()]
        warnings.append(F.when(F.col("pediatric") < F.col("total") * 0.05, F.format_string("LOW pediatric representation: %d", "pediatric")))
    if "Sex" in has:
        sex = F.lower(F.coalesce(F.col("Sex").cast("string"), F.lit("MISSING")))
        counted = ~((F.col("disease") == "diabetes") & (F.coalesce(F.col("disease_type"), F.lit("")) == "Gestational Diabetes")) if {"disease", "disease_type"} <= has else F.lit(True)
        sums += [F.count_if(counted & sex.contains("male") & ~sex.contains("fe")).alias("male"), F.count_if(counted & sex.contains("female")).alias("female")]
        share = F.try_divide(F.col("male"), F.col("female"))
        warnings.append(F.when((F.col("male") > 0) & (F.col("female") > 0) & ((share > 2) | (share < 0.5)), F.format_string("SEX IMBALANCE: Male=%d, Female=%d", "male", "female")))
    if "Location Countries" in has:
        sums.append(F.count_if(F.lower(F.coalesce("Location Countries", F.lit(""))).contains("united states")).alias("us_trials"))
        warnings.append(F.when(F.try_divide(100.0 * F.col("us_trials"), F.col("total")) > 80, F.lit("GEOGRAPHIC BIAS: mostly US trials")))
    found = F.array_compact(F.array(*warnings)) if warnings else F.array().cast("array<string>")
    out = df.agg(*sums).withColumn("warnings", found).withColumn("bias_score", F.size("warnings"))
    return out.withColumn("bias_level", F.when(F.col("bias_score") >= 2, "HIGH").when(F.col("bias_score") == 1, "MEDIUM").otherwise("LOW"))


def first_failure(gates: dict[str, Column]) -> Column:
    """Gates in order, true when passed: (failed, skipped) names the first that fails and those behind it, which then do not run."""
    names = list(gates)
    cases = F.lit(None).cast("struct<failed:string,skipped:array<string>>")
    for i in reversed(range(len(names))):
        skipped = F.array(*(F.lit(n) for n in names[i + 1 :])).cast("array<string>")
        cases = F.when(~F.coalesce(gates[names[i]], F.lit(False)), F.struct(F.lit(names[i]).alias("failed"), skipped.alias("skipped"))).otherwise(cases)
    return cases
