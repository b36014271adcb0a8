"""Chunks, vector search, reranking and the matching pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import classify, guards
from tessera.functions.text import document_text, parent_id
from tessera.functions.values import chunks
from tessera.providers import Embed, embed, hashed_words, lexical_score
from tessera.session import written

from .keyed import keep_first, upsert
from .numbering import fixed_batches
from .vectors import VectorIndex, asked_rows, in_blocks, ranked, scored, with_vectors


def chunk_rows(docs: DataFrame, key: str, text: Column, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(id, parent_id, chunk_no, chunk, is_last): overlapping pieces of each non-empty text."""
    pieces = docs.select(F.col(key).cast("string").alias("parent_id"), text.alias("text")).where("parent_id IS NOT NULL AND trim(coalesce(text, '')) <> ''")
    out = pieces.withColumn("n", F.size(chunks(F.col("text"), size, overlap))).select("parent_id", "n", F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk_no", "chunk"))
    return out.select(F.concat_ws("_", "parent_id", F.col("chunk_no").cast("string")).alias("id"), "parent_id", "chunk_no", "chunk", (F.col("chunk_no") == F.col("n") - 1).alias("is_last"))


def update_index(index: DataFrame | None, docs: DataFrame, key: str, text: Column, model: Embed = hashed_words) -> DataFrame:
    """The index after embedding new and changed documents, by content hash; chunks of changed documents are replaced."""
    current = docs.select(F.col(key).cast("string").alias("parent_id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content"), text.alias("text")).where("parent_id is not null")
    current = keep_first(current, "parent_id", [F.desc("content")])
    todo = current if index is None else current.join(index.select("parent_id", "content").distinct(), ["parent_id", "content"], "left_anti")
    rows = chunk_rows(todo, "parent_id", F.col("text")).join(todo.select("parent_id", "content"), "parent_id")
    made = embed(rows, "chunk", model)
    return made if index is None else index.join(todo.select("parent_id"), "parent_id", "left_anti").unionByName(made)


def nearest(queries: DataFrame, index: DataFrame, k: int, *, query: str = "query_id", vector: str = "embedding", item: str = "id", limit: float | None = None) -> DataFrame:
    """(query, item, distance, rank): the k nearest items of each query, exactly; ties go by item.

    The full scan: every query is sent to every piece of the items, and each group of a piece and a block of queries keeps its own k best.
    """
    rows = written(with_vectors(index, item, vector, "v"), "nearest-items")
    asked = asked_rows(queries, query, vector)
    parts = in_blocks(rows.count())
    pieces = rows.select(F.pmod(F.xxhash64(item), F.lit(parts)).cast("int").alias("piece"), item, "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("piece"), query, "q", F.lit(limit).cast("double").alias("reach"))
    return ranked(scored(pieces, sent, query, item, k, in_blocks(asked.count()), limit), query, item, k)


def best_parents(hits: DataFrame, k: int, query: str = "query_id", item: str = "id", parent: Column | None = None) -> DataFrame:
    """The k parents with the nearest chunks: (query, parent_id, distance, rank)."""
    best = hits.groupBy(query, (parent if parent is not None else parent_id(F.col(item))).alias("parent_id")).agg(F.min("distance").alias("distance")).where("cast(parent_id AS string) <> ''")
    w = Window.partitionBy(query).orderBy("distance", "parent_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, n: int, query: str, score: Column | None, *order: str) -> DataFrame:
    """The n best candidates of each query by score, then by incoming order; without a score, the first n."""
    keys = ([F.desc("_score")] if score is not None else []) + list(order)
    scored = candidates.withColumn("_score", score) if score is not None else candidates
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*keys))).where(F.col("rank") <= n).drop("_score")


def match(patients: DataFrame, trials: DataFrame, index: DataFrame | VectorIndex, *, retrieve: int = 15, keep: int = 5, model: Embed = hashed_words, recommend: Callable[[Column, Column], Column] | None = None, judge_input: Callable[[Column], Column] | None = None, judge_output: Callable[[Column, Column], Column] | None = None, guarded: bool = True) -> DataFrame:
    """The guarded matching of (patient_id, summary): input guard, redaction, retrieval, filters, rerank, output guards.

    A `VectorIndex` is searched by lists, a plain table of vectors whole; both give the same trials.
    trials: (nct_number, condition, study_title, conditions, disease, ...). Every patient gets one row (patient_id, status,
    stage, reason, trial ids, recommendation); a failed output guard replaces the recommendation and keeps the trials.
    judge_input(summary) and judge_output(answer, trials) give a reason to refuse or null, after the rules have passed;
    guarded=False leaves out all guards but the redaction.
    """
    checked = lambda *rules: F.coalesce(*rules) if guarded else F.lit(None).cast("string")
    asks = [judge_input(F.col("summary"))] if judge_input else []
    asked = patients.select("patient_id", F.col("summary").alias("original"), guards.redact_pii(F.col("summary")).alias("summary"), guards.pii_hits(F.col("summary")).alias("pii_hits"), checked(guards.input_problem(F.col("summary")), *asks).alias("input_problem"))
    open_ = asked.where("input_problem is null").withColumn("targets", classify.detect_conditions(F.col("summary")))
    open_ = open_.withColumn("query", classify.retrieval_query(F.col("summary"), F.col("targets")))
    texts = embed(open_.select("query").distinct(), "query", model)  # patients who ask the same are answered by one search
    hits = index.search(texts, 3 * retrieve, query="query", exact=True) if isinstance(index, VectorIndex) else nearest(texts, index, 3 * retrieve, query="query")
    found = best_parents(hits, retrieve, "query").withColumnRenamed("distance", "best").withColumnRenamed("rank", "retrieved_rank")
    docs = keep_first(trials, "nct_number", [F.array_position(F.array(*(F.lit(c) for c in classify.REGISTRY)), F.col("condition"))])
    disease = F.lower(F.trim(F.coalesce("disease", F.lit(""))))
    pairs = found.join(docs, F.col("parent_id") == F.col("nct_number")).join(open_.select("patient_id", "query", "summary", "targets"), "query")
    pairs = pairs.where((disease == "") | F.array_contains("targets", disease) | F.array_contains("targets", F.replace(disease, F.lit(" "), F.lit("_"))))
    pairs = pairs.where(~classify.wrong_subtype(F.col("summary"), F.concat_ws(" ", "conditions", "study_title")))
    top = rerank(pairs, keep, "patient_id", lexical_score(F.col("summary"), F.concat_ws(" ", "study_title", "conditions")), "retrieved_rank")
    trial = F.struct("rank", "nct_number", "study_title", F.concat_ws(" ", F.lower("conditions"), F.lower("disease")).alias("scope"))
    lists = top.groupBy("patient_id").agg(F.array_sort(F.collect_list(trial)).alias("trials"))
    listed = F.transform("trials", lambda t: F.concat(F.lit("**Trial "), t["rank"].cast("string"), F.lit("** "), t["nct_number"], F.lit(" - "), F.coalesce(t["study_title"], F.lit(""))))
    out = asked.join(lists, "patient_id", "left").withColumns({
        "ids": F.transform("trials", lambda t: t["nct_number"]), "titles": F.transform("trials", lambda t: t["study_title"]), "scopes": F.transform("trials", lambda t: t["scope"]),
        "answer": guards.with_disclaimer(recommend(F.col("summary"), F.col("trials")) if recommend else F.array_join(listed, "\n")),
    })
    out = out.withColumns({
        "retrieval": checked(guards.retrieval_problem(F.col("ids"))), "scope": checked(guards.scope_problem(F.col("scopes"))),
        "output": checked(guards.output_problem(F.col("answer")), guards.grounding_problem(F.col("answer"), F.col("ids"), F.col("titles")), *([judge_output(F.col("answer"), F.col("trials"))] if judge_output else [])),
    })
    steps = [("input", "input_problem"), ("retrieval", "retrieval"), ("scope", "scope"), ("output", "output")]
    stage = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in steps), F.lit("none"))
    reason = F.coalesce(*(c for _, c in steps))
    text = F.when(reason.isNotNull(), F.concat(F.lit("Guardrail triggered at "), stage, F.lit(": "), reason, F.lit(". " + guards.DISCLAIMER))).otherwise(F.col("answer"))
    shown = F.when(F.coalesce("input_problem", "retrieval", "scope").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("ids"))
    return out.select("patient_id", "summary", "pii_hits", F.when(reason.isNotNull(), "blocked").otherwise("passed").alias("status"), stage.alias("stage"), reason.alias("reason"), shown.alias("matched"), text.alias("recommendation")).withColumnRenamed("matched", "trials")


def trial_index(trials: DataFrame, model: Embed = hashed_words) -> DataFrame:
    return update_index(None, trials, "nct_number", document_text({c: F.col(c) for c in trials.columns}), model)


__all__ = ["best_parents", "chunk_rows", "fixed_batches", "match", "nearest", "rerank", "trial_index", "update_index", "upsert"]
