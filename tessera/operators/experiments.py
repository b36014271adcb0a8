"""Runs of the matching under many settings and masks, as one plan that shares the index and the neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import FEATURE_MASKS, without_feature

from .evaluation import overlap, sweep_metrics
from .vectors import VectorIndex


@dataclass(frozen=True)
class Setting:
    """One run: which parameter it varies and to what, and all parameters. Defaults are those of the matching's own sweep."""

    param: str = ""
    value: float = 0.0
    retrieve: int = 20
    keep: int = 5
    limit: float = 0.7

    def column(self) -> Column:
        return F.struct(F.lit(self.param).alias("param"), F.lit(float(self.value)).alias("value"), F.lit(self.retrieve).alias("retrieve"), F.lit(self.keep).alias("keep"), F.lit(float(self.limit)).alias("limit"))


def one_at_a_time(base: Setting, retrieve: Sequence[int] = (10, 20, 50), keep: Sequence[int] = (3, 5, 10), limit: Sequence[float] = (0.5, 0.7, 0.9)) -> list[Setting]:
    """Each parameter's values with the others at their base."""
    return [replace(base, param=name, value=float(v), **{name: v}) for name, values in (("retrieve", retrieve), ("keep", keep), ("limit", limit)) for v in values]


def neighbours(prompts: DataFrame, index: VectorIndex, settings: Sequence[Setting], parent: Column, *, query: str = "query_id") -> DataFrame:
    """(query, parent_id, distance, rank): what the most demanding setting fetches, three times its candidates."""
    hits = index.search(prompts, 3 * max(s.retrieve for s in settings), query=query, exact=True)
    return hits.select(query, parent.alias("parent_id"), "distance", "rank")


def runs(prompts: DataFrame, hits: DataFrame, settings: Sequence[Setting], *, query: str = "query_id") -> DataFrame:
    """(param, value, query, slice, candidates, matched, success) of every prompt (query, slice, embedding) under every setting.

    Candidates are the distinct parents among the first 3 * retrieve neighbours nearer than the limit, `retrieve` of them at
    most; `keep` of those are matched. A prompt without a vector fails.
    """
    each = F.explode(F.array(*(s.column() for s in settings))).alias("s")
    asked = prompts.select(query, "slice", F.col("embedding").isNotNull().alias("success"), each).select(query, "slice", "success", "s.*")
    near = hits.select("*", each).where((F.col("rank") <= 3 * F.col("s.retrieve")) & (F.col("distance") < F.col("s.limit")))
    found = near.groupBy(query, "s.param", "s.value").agg(F.count_distinct("parent_id").alias("parents"))
    out = asked.join(found, [query, "param", "value"], "left").withColumn("candidates", F.least(F.coalesce("parents", F.lit(0).cast("long")), F.col("retrieve")))
    return out.select("param", "value", query, "slice", "candidates", F.least("candidates", "keep").alias("matched"), "success")


def sweep(prompts: DataFrame, index: VectorIndex, settings: Sequence[Setting], parent: Column, *, query: str = "query_id") -> DataFrame:
    """The metrics of each setting."""
    return sweep_metrics(runs(prompts, neighbours(prompts, index, settings, parent, query=query), settings, query=query))


def masked(prompts: DataFrame, features: Sequence[str] = tuple(FEATURE_MASKS), text: str = "summary") -> DataFrame:
    """Each prompt as it is (feature null) and without each feature."""
    kinds = [F.struct(F.lit(f).cast("string").alias("feature"), (F.col(text) if f is None else without_feature(F.col(text), f)).alias("t")) for f in (None, *features)]
    return prompts.withColumn("_m", F.explode(F.array(*kinds))).withColumns({"feature": F.col("_m.feature"), text: F.col("_m.t")}).drop("_m")


def ablations(variants: DataFrame, index: VectorIndex, k: int = 5, *, query: str = "query_id") -> DataFrame:
    """(query, feature, overlap_ratio, avg_rank_shift, importance) of variants (query, feature, embedding) against the one without a feature."""
    asked = variants.select(F.struct(query, "feature").alias("variant"), "embedding")
    hits = index.search(asked, k, query="variant", exact=True)
    lists = hits.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("rank", index.item))).alias("l"))
    lists = asked.select("variant").join(lists, "variant", "left").select(F.col(f"variant.{query}").alias(query), F.col("variant.feature").alias("feature"), F.coalesce(F.transform("l", lambda x: x[index.item].cast("string")), F.array().cast("array<string>")).alias("ids"))
    base = lists.where("feature IS NULL").select(query, F.col("ids").alias("base"))
    return lists.where("feature IS NOT NULL").join(base, query).select(query, "feature", F.inline(F.array(overlap(F.col("base"), F.col("ids")))))
