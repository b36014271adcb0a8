"""Keyed tables: first-wins dedupe, upserts, flags, resume, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free(name: str, *tables: DataFrame) -> str:
    """`name`, with underscores put before it while a table has a column of that name."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_first(df: DataFrame, key: str | Column, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in order; nulls are one key."""
    w, nth = Window.partitionBy(key).orderBy(*order), free("_nth", df)
    return df.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)


def enrich(df: DataFrame, disease: str, classifier, conditions: str = "Conditions", key: str = "NCT Number", order: str = "_ord") -> DataFrame:
    """First row of each id, with the disease and the type that `classifier` (Column to Column) gives."""
    return keep_first(df, f"`{key}`", [order]).withColumns({"disease": F.lit(disease), "disease_type": classifier(F.col(f"`{conditions}`"))})


def upsert(old: DataFrame, new: DataFrame, key: str, version: Sequence[str | Column]) -> DataFrame:
    """The latest row of each key of both tables; new rows win ties and rows without a key are skipped."""
    late, nth = free("_new", old, new), free("_nth", old, new)
    both = old.withColumn(late, F.lit(0)).unionByName(new.withColumn(late, F.lit(1)), allowMissingColumns=True).where(F.col(key).isNotNull())
    order = [(F.col(v) if isinstance(v, str) else v).desc_nulls_last() for v in version]
    w = Window.partitionBy(key).orderBy(*order, F.desc(late))
    return both.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth, late)


def set_flag(df: DataFrame, done: DataFrame, key: str, flag: str, as_of: Column, stamp: str | None = None) -> DataFrame:
    """`flag` set for the keys in `done`."""
    mark = free("_done", df)
    marks = done.select(key).where(F.col(key).isNotNull()).distinct().withColumn(mark, F.lit(True))
    out = df.join(marks, key, "left").withColumn(flag, F.coalesce(mark, F.col(flag), F.lit(False)))
    return (out.withColumn(stamp, F.when(F.col(mark), as_of).otherwise(F.col(stamp) if stamp in df.columns else F.lit(None))) if stamp else out).drop(mark)


def not_done(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is not true: false, null or missing."""
    return df.where(~F.col(flag).eqNullSafe(F.lit(True))) if flag in df.columns else df


def resume(todo: DataFrame, results: DataFrame, key: str, failed: str | None = None) -> DataFrame:
    """What has no result yet; failed results do not count."""
    done = results.where(~F.col(failed)) if failed else results
    return todo.join(done.select(key), key, "left_anti")


def create(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return df.unionByName(rows.join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def update(df: DataFrame, changes: DataFrame, key: str, kept: Sequence[str] = ()) -> DataFrame:
    """Changed rows replace those of their key, but for the columns in `kept`; unknown keys are ignored."""
    names = {c: free(f"_new_{c}", df, changes) for c in changes.columns if c != key}
    hit = free("_hit", df, changes)
    other = changes.select(key, *(F.col(c).alias(n) for c, n in names.items()), F.lit(True).alias(hit))
    changed = {c for c in changes.columns if c != key} - set(kept)
    joined = df.join(other, key, "left")
    return joined.select(*(F.when(F.col(hit), F.col(names[c])).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns))


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def visible(df: DataFrame, owner: str, user: str | None, admin: bool) -> DataFrame:
    """All rows for an admin, a user's own rows else."""
    return df if admin else df.where(F.col(owner) == F.lit(user))


def lookup_first(wanted: DataFrame, docs: DataFrame, key: str, partition: str, ranking: Sequence[str]) -> DataFrame:
    """The wanted keys' rows, from the first partition in the ranking that has them."""
    rank = F.array_position(F.array(*(F.lit(r) for r in ranking)), F.col(partition))
    found = docs.where(F.col(partition).isin(list(ranking))).join(wanted.select(key).distinct(), key)
    w, nth = Window.partitionBy(key).orderBy(rank), free("_nth", found)
    return found.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)


def in_scope(df: DataFrame, disease: str, targets: Sequence[str]) -> DataFrame:
    """Rows whose disease is a target or empty."""
    value = F.lower(F.trim(F.coalesce(F.col(disease), F.lit(""))))
    return df.where((value == "") | value.isin([t.lower() for t in targets]))
