"""Registered queries whose work must spread: vector index, global numbers, exact quantiles, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import experiments, numbering, profile, vectors
from tessera.operators.quantiles import quantiles
from tessera.sources.tables import table

from .catalogue import _KNN_SQL, query


# --- vector index -----------------------------------------------------------------------------------------------------------
def _index(spark: SparkSession, d: str) -> tuple[DataFrame, vectors.VectorIndex]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return queries, vectors.VectorIndex.build(e, leaf=25)


@query(_KNN_SQL + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10")
def knn_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest by the partitioned index: its share of the vectors, then the lists that its bounds leave open."""
    queries, index = _index(spark, d)
    return index.search(queries, 10, exact=True).select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, 10 * count(*) FILTER (vec_id % 100 = 0) AS neighbours, true AS recalled, count(*) AS indexed FROM embeddings")
def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index without its second round against all vectors: are nine of ten true neighbours found?"""
    queries, index = _index(spark, d)
    true = index.search(queries, 10, share=1.0).select("query_id", "id")
    found = true.join(index.search(queries, 10).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    indexed = F.lit(index.postings.count()).alias("indexed")
    return found.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled")).select("*", indexed)


# --- global numbers ---------------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS number, (row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) - 1) // 1000 AS batch FROM lineitem")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """All lines numbered through, with a batch of a thousand each, and no column that parts them."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    out = numbering.numbered(rows, [F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("l_orderkey", "l_linenumber", "number", F.floor((F.col("number") - 1) / 1000).alias("batch"))


# --- quantiles --------------------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS place, l_extendedprice * CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN 40 ELSE 1 END AS value FROM lineitem),
p AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s)
SELECT place, value FROM s, p WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY place LIMIT 5""")
def first_outliers(spark: SparkSession, d: str) -> DataFrame:
    """The first five values beyond one and a half interquartile ranges, in row order."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), (F.col("l_extendedprice") * F.when(k % 97 == 0, 40).otherwise(1)).alias("value"))
    return profile.outliers(lines, "value", "place")


_PROBABILITIES = (0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0)


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS \"column\", {p} AS p, round(quantile_cont({c}, {p}), 6) AS q FROM {t}" for t, c in (("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("events", "value")) for p in _PROBABILITIES))
def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of a wide column, of one with fifty values, and of one with a long tail."""
    rows = [(f"{t}.{c}", p, q) for t, c in (("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("events", "value")) for p, q in zip(_PROBABILITIES, quantiles(table(spark, d, t), F.col(c), _PROBABILITIES, held=64))]
    return spark.createDataFrame(rows, "column string, p double, q double").select("column", "p", F.round("q", 6).alias("q"))


# --- packing ----------------------------------------------------------------------------------------------------------------
@query("""WITH RECURSIVE t AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT source, i, 0 AS batch, n AS used, 1 AS texts FROM t WHERE i = 1
UNION ALL SELECT t.source, t.i, CASE WHEN w.used + t.n > 25200 OR w.texts >= 20 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used + t.n > 25200 OR w.texts >= 20 THEN t.n ELSE w.used + t.n END, CASE WHEN w.used + t.n > 25200 OR w.texts >= 20 THEN 1 ELSE w.texts + 1 END
 FROM w JOIN t ON t.source = w.source AND t.i = w.i + 1)
SELECT source, CAST(batch AS BIGINT) AS batch, max(texts) AS texts, CAST(max(used) AS BIGINT) AS chars FROM w GROUP BY source, batch""")
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    """Each source's texts in order, in batches of 18,000 estimated tokens and 20 texts at most: (source, batch, texts, chars)."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("chars"))
    out = numbering.packed_batches(docs, ["doc_id", "chars"], F.col("chars"), limit=int(18_000 * 1.4), within="source")
    return out.select("source", "batch", F.col("rows").alias("texts"), F.col("size").alias("chars"))


# --- sweeps and ablations -----------------------------------------------------------------------------------------------------
_SETTINGS = experiments.one_at_a_time(experiments.Setting(retrieve=8, keep=5, limit=0.7), (4, 8, 16), (3, 5, 10), (0.55, 0.7, 0.9))
_SETTING_SQL = ", ".join(f"('{s.param}', {s.value}, {s.retrieve}, {s.keep}, {s.limit})" for s in _SETTINGS)


@query(_KNN_SQL.replace("vec_id % 100 = 0", "vec_id % 20 = 0") + f"""r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d),
s AS (SELECT * FROM (VALUES {_SETTING_SQL}) AS v(param, value, retrieve, keep, lim)),
q AS (SELECT vec_id AS query_id, vec_id % 3 = 0 AS ood FROM embeddings WHERE vec_id % 20 = 0),
n AS (SELECT q.query_id, q.ood, s.*, least((SELECT count(DISTINCT id // 3) FROM r WHERE r.query_id = q.query_id AND r.rank <= 3 * s.retrieve AND r.distance < s.lim), s.retrieve) AS candidates FROM q, s)
SELECT param, CAST(value AS DOUBLE) AS value, round(avg(candidates), 6) AS avg_candidates, round(avg(least(candidates, keep)), 6) AS avg_matched, round(coalesce(avg(least(candidates, keep)) FILTER (ood), 0), 6) AS avg_ood_matched, 1.0 AS success_rate FROM n GROUP BY param, value""")
def sweep_settings(spark: SparkSession, d: str) -> DataFrame:
    """Three parameters at three values each, from one search of the index."""
    e, index = _index(spark, d)
    prompts = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 3 == 0, "ood").otherwise("in").alias("slice"))
    out = experiments.sweep(prompts, index, _SETTINGS, F.expr("id div 3"))
    return out.select("param", "value", *(F.round(c, 6).alias(c) for c in ("avg_candidates", "avg_matched", "avg_ood_matched")), "success_rate")


@query("""WITH m AS (SELECT vec_id, f, list_transform(range(1, 65), lambda i: CASE WHEN f >= 0 AND i BETWEEN f * 12 + 1 AND f * 12 + 12 THEN 0.0 ELSE CAST(embedding[i] AS DOUBLE) END) AS v FROM embeddings, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f) WHERE vec_id % 20 = 0),
i AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
iu AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM i),
mu AS (SELECT vec_id, f, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM m),
d AS (SELECT vec_id, f, id, 1 - list_sum(list_transform(range(1, 65), lambda k: mu.v[k] * iu.v[k])) AS distance FROM mu, iu),
l AS (SELECT vec_id, f, list(id ORDER BY distance, id)[1:5] AS ids FROM d GROUP BY 1, 2),
p AS (SELECT b.vec_id, a.f, b.ids AS base, a.ids AS ids, list_filter(b.ids, lambda x: list_contains(a.ids, x)) AS c FROM l AS b JOIN l AS a ON a.vec_id = b.vec_id AND a.f >= 0 WHERE b.f = -1)
SELECT vec_id AS query_id, 'part' || f AS feature, len(c) / 5 AS overlap_ratio, coalesce(list_sum(list_transform(c, lambda x: abs(list_position(base, x) - list_position(ids, x)))), 0) / greatest(len(c), 1) AS avg_rank_shift, 1 - len(c) / 5 AS importance FROM p""")
def ablation_masks(spark: SparkSession, d: str) -> DataFrame:
    """Prompts without each of five parts of their vectors, searched together, against the prompts as they are."""
    _, index = _index(spark, d)
    prompts = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.array(*(F.lit(f) for f in range(-1, 5)))).alias("f"), "embedding")
    without = F.transform("embedding", lambda x, i: F.when(F.floor(i / 12) == F.col("f"), 0.0).otherwise(x.cast("double")))
    variants = prompts.select("query_id", F.when(F.col("f") >= 0, F.concat(F.lit("part"), F.col("f").cast("string"))).alias("feature"), without.alias("embedding"))
    return experiments.ablations(variants, index)
