"""The registered queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import classify, guards, text, values, verdicts
from tessera.operators import contract, evaluation, keyed, profile, search
from tessera.sources.sinks import to_metrics
from tessera.sources.tables import spread, table
from tessera.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- SQL that several oracles share -------------------------------------------------------------------------------------
def _sql_squeeze(x: str) -> str:
    return rf"nullif(trim(regexp_replace({x}, '[ \t\n\v\f\r]+', ' ', 'g'), ' '), '')"


def _sql_entities(x: str) -> str:
    for entity, character in text.ENTITIES:
        x = f"replace({x}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return x


def _sql_terms(x: str) -> str:
    for pattern, term in text.TERMS:
        x = rf"regexp_replace({x}, '\b{pattern}\b', '{term}', 'gi')"
    return x


def _sql_unrepeated(source: str) -> str:
    """Two steps that read (doc_id, t) from `source` and give it without repeated words as `unrepeated`."""
    return rf"""split AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t\n\v\f\r]+'), lambda w: w <> '') AS ws FROM {source}),
unrepeated AS (SELECT doc_id, CASE WHEN len(ws) <= 1 THEN t ELSE array_to_string(list_transform(list_filter(list_zip(ws, list_prepend(NULL, ws[1:len(ws) - 1])), lambda p: p[2] IS NULL OR lower(p[1]) <> lower(p[2])), lambda p: p[1]), ' ') END AS t FROM split)"""


def _sql_classify(x: str, rules, otherwise: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({x}), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in rules)
    return f"CASE WHEN {x} IS NULL THEN 'Unknown' {cases} ELSE '{otherwise}' END"


#: Rules with the shape of the disease classifiers for the invented prose of the documents.
PROSE = [("licensed", ["licensed", "copyright"]), ("marked", ["###", "$$$", "%%%"]), ("insulting", ["idiot", "moron", "stupid"]), ("umlaut", ["ä", "ö", "ü"]), ("accented", ["é", "è", "ê"]), ("tilde", ["ñ"])]


# --- text -----------------------------------------------------------------------------------------------------------------
@query(f"""
WITH a AS (SELECT doc_id, {_sql_squeeze('text')} AS t FROM documents),
b AS (SELECT doc_id, {_sql_entities('t')} AS t FROM a),
c AS (SELECT doc_id, {_sql_terms(r"regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]', '', 'g')")} AS t FROM b),
{_sql_unrepeated('c')},
e AS (SELECT doc_id, {_sql_squeeze('t')} AS t FROM unrepeated),
k AS (SELECT {_sql_classify('t', PROSE, 'plain')} AS condition FROM e)
SELECT condition, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct FROM k GROUP BY condition
""")
def condition_distribution(spark: SparkSession, d: str) -> DataFrame:
    labelled = spread(table(spark, d, "documents")).select(classify.classify(text.clean(F.col("text")), PROSE, "plain").alias("condition"))
    return profile.distribution_with_pct(labelled, "condition").orderBy(F.desc("n"), "condition")


@query(f"""
WITH a AS (SELECT doc_id, {_sql_squeeze('text')} AS t FROM documents),
c AS (SELECT doc_id, {_sql_terms(r"regexp_replace(" + _sql_entities('t') + r", '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]', '', 'g')")} AS t FROM a),
{_sql_unrepeated('c')}
SELECT doc_id, {_sql_squeeze('t')} AS cleaned FROM unrepeated
""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, {_sql_entities('html')} AS decoded FROM pages")
def html_entities(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages")).select("page_id", text.decode_entities(F.col("html")).alias("decoded"))


@query(rf"WITH t AS (SELECT doc_id, ['T1D: ', 't1dm, ', 'IDDM ', '(t2d) ', 'T2DM ', 'niddm ', 'GDM. ', 'xT1D '][CAST(doc_id % 8 AS INT) + 1] || text AS t FROM documents) SELECT doc_id, {_sql_terms('t')} AS normalised FROM t")
def terminology(spark: SparkSession, d: str) -> DataFrame:
    term = F.element_at(F.array(*(F.lit(x) for x in ("T1D: ", "t1dm, ", "IDDM ", "(t2d) ", "T2DM ", "niddm ", "GDM. ", "xT1D "))), (F.col("doc_id") % 8 + 1).cast("int"))
    return spread(table(spark, d, "documents")).select("doc_id", text.expand_terms(F.concat(term, "text")).alias("normalised"))


#: Conditions of invented trials, one for each key in turn, so that every rule fires somewhere.
TRIAL_TEXTS = [word.title() for _, words in classify.DIABETES + classify.BREAST_CANCER for word in words] + ["Diabetes", "Breast cancer", ""]
_TRIAL_TEXT_SQL = f"[{', '.join(repr(t) for t in TRIAL_TEXTS)}][CAST(p_partkey % {len(TRIAL_TEXTS)} AS INT) + 1]"


def _trial_text(key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(t) for t in TRIAL_TEXTS)), (key % len(TRIAL_TEXTS) + 1).cast("int"))


@query(f"WITH t AS (SELECT p_partkey, {_TRIAL_TEXT_SQL} AS t FROM part) SELECT p_partkey, {_sql_classify('t', classify.DIABETES, 'Diabetes (General)')} AS diabetes, {_sql_classify('t', classify.BREAST_CANCER, 'Breast Cancer (General)')} AS cancer, {_sql_classify('nullif(t, chr(32))', [('carcinoma', ['ductal', 'lobular']), ('type', ['type'])], 'other')} AS kind FROM t")
def classify_ordered(spark: SparkSession, d: str) -> DataFrame:
    t = _trial_text(F.col("p_partkey"))
    kinds = classify.classify(t, [("carcinoma", ["ductal", "lobular"]), ("type", ["type"])], "other")
    return table(spark, d, "part").select("p_partkey", classify.diabetes_type(t).alias("diabetes"), classify.breast_cancer_type(t).alias("cancer"), kinds.alias("kind"))


@query("""SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE CASE WHEN trim(text) IN ('', 'nan', 'None') THEN 'N/A' ELSE text END END AS short,
trim(left(translate(text, chr(34) || chr(10) || chr(13), chr(39) || '  '), 800)) AS safe FROM documents""")
def shortened_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", text.shortened(F.col("text"), 300).alias("short"), text.prompt_safe(F.col("text")).alias("safe"))


@query(r"""
WITH s AS (SELECT c_custkey, 'Patient is a ' || (20 + c_custkey % 60) || '-year-old. Active diagnoses: ' || c_mktsegment || '. Current medications: none. BMI: ' || (c_custkey % 40) || '; Smoking status: never.' AS t FROM customer)
SELECT c_custkey, trim(regexp_replace(regexp_replace(t, '\d+-year-old', '', 'gi'), '\s{2,}', ' ', 'g')) AS no_age,
 trim(regexp_replace(regexp_replace(t, 'Active diagnoses:\s*[^.]+\.', '', 'gi'), '\s{2,}', ' ', 'g')) AS no_diagnosis,
 trim(regexp_replace(regexp_replace(t, 'Smoking status:\s*[^.]+\.', '', 'gi'), '\s{2,}', ' ', 'g')) AS no_smoking FROM s""")
def mask_feature(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("Patient is a "), (20 + F.col("c_custkey") % 60).cast("string"), F.lit("-year-old. Active diagnoses: "), "c_mktsegment", F.lit(". Current medications: none. BMI: "), (F.col("c_custkey") % 40).cast("string"), F.lit("; Smoking status: never."))
    return table(spark, d, "customer").select("c_custkey", text.without_feature(s, "age").alias("no_age"), text.without_feature(s, "diagnosis").alias("no_diagnosis"), text.without_feature(s, "smoking").alias("no_smoking"))


# --- profiles and statistics ----------------------------------------------------------------------------------------------
@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT coalesce(event_type, 'MISSING') AS event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS pct FROM events GROUP BY 1")
def distribution_pct(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution_with_pct(table(spark, d, "events"), "event_type")


@query("SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY n DESC, s_name LIMIT 10")
def top_k_groups(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return counts.groupBy("s_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s_name").limit(10)


@query("SELECT trim(w) AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE trim(w) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def exploded_top_k(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(profile.exploded(table(spark, d, "part"), "p_name", " "), "value", 10)


_ORDER_TYPES = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number", "o_orderdate": "datetime", "o_orderpriority": "string"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, 100 * (count(*) - count({c})) / count(*) AS null_pct, count(DISTINCT {c}) AS n_unique FROM orders" for c, kind in _ORDER_TYPES.items()))
def schema_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(table(spark, d, "orders"))


@query("""WITH e AS (SELECT nullif(event_type, 'click') AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, props FROM events)
SELECT 'event_type' AS "column", count(*) - count(event_type) AS nulls FROM e HAVING nulls > 0 UNION ALL SELECT 'value', count(*) - count(value) AS nulls FROM e HAVING nulls > 0 UNION ALL SELECT 'props', count(*) - count(props) AS nulls FROM e HAVING nulls > 0""")
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return profile.null_counts(events.select(F.nullif("event_type", F.lit("click")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "props"))


@query("SELECT count(x) AS n, avg(x) AS mean, median(x) AS median, CAST(trunc(min(x)) AS BIGINT) AS min, CAST(trunc(max(x)) AS BIGINT) AS max, round(sum(x), 2) AS total FROM (SELECT o_totalprice AS x FROM orders)")
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    cents = profile.numeric_summary(table(spark, d, "orders"), "o_totalprice")
    return cents.withColumn("total", F.round("total", 2))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT o_orderkey, o_totalprice AS value FROM orders, q WHERE o_totalprice < q1 - 0.5 * (q3 - q1) OR o_totalprice > q3 + 0.5 * (q3 - q1)""")
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return profile.outliers(table(spark, d, "orders"), "o_totalprice", "o_orderkey", None, 0.5)


@query("SELECT count(*) FILTER (contains(lower(n_name), 'united')) AS with_word, count(*) FILTER (NOT contains(lower(n_name), 'united')) AS without, 100.0 * count(*) FILTER (contains(lower(n_name), 'united')) / count(*) AS pct FROM customer JOIN nation ON c_nationkey = n_nationkey")
def geo_share(spark: SparkSession, d: str) -> DataFrame:
    return profile.substring_share(table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "n_name", "united")


@query("SELECT count(*) FILTER (regexp_matches(lower(p_type), 'small|economy')) AS soft, count(*) FILTER (regexp_matches(lower(p_type), 'standard')) AS hard, count(*) FILTER (regexp_matches(lower(p_type), 'a')) AS any_a FROM part")
def keyword_groups(spark: SparkSession, d: str) -> DataFrame:
    return profile.keyword_groups(table(spark, d, "part"), "p_type", {"soft": "Small|Economy", "hard": "Standard", "any_a": "A"})


@query("SELECT max(n) > 1 AS duplicates FROM (SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1)")
def duplicate_key_flag(spark: SparkSession, d: str) -> DataFrame:
    return profile.has_duplicates(table(spark, d, "documents").select(F.md5("text").alias("k")), "k")


# --- contracts and gates ----------------------------------------------------------------------------------------------------
@query("""SELECT 'Invalid category values in ''o_orderstatus'': [''' || string_agg(DISTINCT upper(o_orderstatus), ''', ''' ORDER BY upper(o_orderstatus)) || ''']' AS violation FROM orders WHERE upper(o_orderstatus) NOT IN ('F')
UNION ALL SELECT '''o_totalprice'' has values > 1000.0' FROM orders HAVING max(o_totalprice) > 1000""")
def category_domain(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    base = contract.Contract.of(orders, [], allowed={"o_orderstatus": ["f"]}, ranges={"o_totalprice": (None, 1000.0)})
    return contract.violations(orders, base).select("violation")


@query(r"SELECT count(*) AS rows, count(*) FILTER (NOT regexp_matches(coalesce(c_name, 'nan'), '^Customer#\d{9}$')) AS invalid, count(*) FILTER (NOT regexp_matches(coalesce(c_name, 'nan'), '^NCT\d{8}$')) AS not_nct FROM customer")
def id_format_invalid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.count("*").alias("rows"), F.count_if(contract.invalid_id(F.col("c_name"), r"^Customer#\d{9}$")).alias("invalid"), F.count_if(contract.invalid_id(F.col("c_name"))).alias("not_nct"))


@query("SELECT false AS passed, count(*) AS rows, 'Missing columns: [''Sex'']|' || CAST(count(*) AS VARCHAR) || ' rows have invalid NCT Number format|disease_type is Unknown for more than half of the rows' AS errors FROM orders")
def validation_gate(spark: SparkSession, d: str) -> DataFrame:
    trials = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("NCT Number"), F.col("o_orderpriority").alias("Study Title"), F.col("o_orderstatus").alias("Conditions"), F.lit("x").alias("disease"), F.lit("Unknown").alias("disease_type"))
    found = contract.validation(trials, required=["NCT Number", "Study Title", "Conditions", "Sex"])
    return found.select("passed", "rows", F.array_join("errors", "|").alias("errors"))


@query("""WITH t AS (SELECT count(*) AS total, count(*) FILTER (c_mktsegment = 'BUILDING') AS male, count(*) FILTER (c_mktsegment <> 'BUILDING') AS female, count(*) FILTER (contains(lower(n_name), 'united states')) AS us
FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT *, CASE WHEN male > 0 AND female > 0 AND (male / female > 2 OR male / female < 0.5) THEN 1 ELSE 0 END + CASE WHEN 100.0 * us / total > 80 THEN 1 ELSE 0 END AS score FROM t)
SELECT total, male, female, us AS us_trials, CAST(score AS BIGINT) AS bias_score, CASE WHEN score >= 2 THEN 'HIGH' WHEN score = 1 THEN 'MEDIUM' ELSE 'LOW' END AS bias_level FROM s""")
def bias_ratio(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    trials = people.select(F.when(F.col("c_mktsegment") == "BUILDING", "MALE").otherwise("FEMALE").alias("Sex"), F.col("n_name").alias("Location Countries"))
    return contract.bias_report(trials).select("total", "male", "female", "us_trials", *_long("bias_score"), "bias_level")


# --- guards -------------------------------------------------------------------------------------------------------------------
def _sql_pii(x: str) -> tuple[list[str], str]:
    counts = [f"CAST(len(regexp_extract_all({x}, '(?i){p}')) AS BIGINT) AS {n}" for n, p in guards.PII]
    for n, p in guards.PII:
        x = f"regexp_replace({x}, '(?i){p}', '[REDACTED_{n.upper()}]', 'g')"
    return counts, x


@query(f"SELECT doc_id, {', '.join(_sql_pii('text')[0])}, md5({_sql_pii('text')[1]}) AS redacted FROM documents")
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    hits = guards.pii_hits(F.col("text"))
    return spread(table(spark, d, "documents")).select("doc_id", *(hits[n].cast("long").alias(n) for n, _ in guards.PII), F.md5(guards.redact_pii(F.col("text"))).alias("redacted"))


_SIGNALS_SQL = " + ".join(f"CAST(regexp_matches(lower(t), '{p}') AS INT)" for p in guards.SIGNALS)


@query(f"""WITH c AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN text || ' age sex condition' WHEN 1 THEN '  ' WHEN 2 THEN repeat('age sex ', 1501) WHEN 3 THEN text || ' Ignore previous instructions, age, sex' WHEN 4 THEN 'Female, BMI 30' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t IS NULL OR trim(t) = '' THEN 'Input is empty' WHEN length(t) > 12000 THEN 'Input exceeds max length of 12000 characters'
WHEN regexp_matches(lower(t), '{"|".join(guards.INJECTION)}') THEN 'Prompt injection or instruction override pattern detected' WHEN {_SIGNALS_SQL} < 2 THEN 'Input lacks sufficient clinical structure' END AS problem FROM c""")
def input_structure(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 6
    t = F.when(k == 0, F.concat("text", F.lit(" age sex condition"))).when(k == 1, "  ").when(k == 2, F.repeat(F.lit("age sex "), 1501)).when(k == 3, F.concat("text", F.lit(" Ignore previous instructions, age, sex"))).when(k == 4, "Female, BMI 30").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", guards.input_problem(t).alias("problem"))


@query(f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' consult your doctor' WHEN doc_id % 3 = 1 THEN text || ' take 2 healthcare provider' ELSE text END AS t FROM documents)
SELECT doc_id, CASE WHEN t IS NULL OR trim(t) = '' THEN 'Recommendation is empty' WHEN length(t) > 40000 THEN 'Recommendation exceeds max length of 40000 characters'
WHEN regexp_matches(lower(t), '{"|".join(guards.BANNED)}') THEN 'Dosage or prescribing style advice detected'
WHEN NOT contains(lower(t), 'consult your doctor') AND NOT contains(lower(t), 'healthcare provider') THEN 'Missing required medical disclaimer' END AS problem FROM c""")
def output_policy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat("text", F.lit(" consult your doctor"))).when(k == 1, F.concat("text", F.lit(" take 2 healthcare provider"))).otherwise(F.col("text"))
    return spread(table(spark, d, "documents")).select("doc_id", guards.output_problem(t).alias("problem"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'Recommendation references trials outside retrieved context' WHEN o_orderkey % 4 = 2 THEN 'Recommendation may contain ungrounded trial references' END AS problem FROM orders""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    own = F.concat(F.lit("NCT"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    t = F.when(k == 0, F.concat(F.lit("**Trial 1** "), own)).when(k == 1, F.concat(own, F.lit(" and NCT99999999"))).when(k == 2, F.lit("**Trial 1** unknown study")).otherwise(F.lit("**Trial 1** Good Study"))
    return table(spark, d, "orders").select("o_orderkey", guards.grounding_problem(t, F.array(own), F.array(F.lit("Good study"))).alias("problem"))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'passed' END AS s, CASE turn % 3 WHEN 1 THEN 'It did NOT pass.' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN s = 'blocked' THEN 'blocked' WHEN contains(lower(t), 'did not pass') THEN 'flagged' WHEN s = 'passed' THEN 'passed' ELSE 'unknown' END AS status FROM c""")
def guard_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("turn") % 4 == 0, "blocked").when(F.col("turn") % 4 == 1, "passed")
    return table(spark, d, "conversations").select("conv_id", "turn", guards.guard_status(s, F.when(F.col("turn") % 3 == 1, "It did NOT pass.").otherwise(F.col("text"))).alias("status"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS fenced FROM events")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(values.json_block(F.col("props")), "$.k", "long").alias("k"), values.json_field(values.json_block(fenced), "k", "long", -1).alias("fenced"))


# --- keyed tables -----------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return keyed.keep_first(table(spark, d, "documents"), F.md5("text"), ["doc_id"]).select("doc_id", "lang", "source")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM orders""")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    new = table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("version"))
    return keyed.upsert(old, new, "o_orderkey", ["version"])


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS embedded FROM orders")
def flag_update(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return keyed.set_flag(table(spark, d, "orders").select("o_orderkey", F.lit(False).alias("embedded")), done, "o_orderkey", "embedded", F.lit(None))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("failed"))
    return keyed.resume(table(spark, d, "documents").select("doc_id"), results, "doc_id", "failed")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderkey) AS nth
FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2) JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey) WHERE nth = 1""")
def lookup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return keyed.lookup_first(wanted, docs, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_custkey", "o_orderpriority", "o_orderkey")


# --- chunks and search --------------------------------------------------------------------------------------------------------------
@query("""SELECT CAST(doc_id AS VARCHAR) || '_' || i AS id, CAST(doc_id AS VARCHAR) AS parent_id, CAST(i AS BIGINT) AS chunk_no, substring(text, i * 1000 + 1, 1200) AS chunk, i = n - 1 AS is_last
FROM (SELECT doc_id, text, CAST(greatest(ceil((length(text) - 200) / 1000), 1) AS BIGINT) AS n FROM documents WHERE trim(coalesce(text, '')) <> ''), unnest(range(n)) AS t(i)""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return search.chunk_rows(spread(table(spark, d, "documents")), "doc_id", F.col("text")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


_KNN_SQL = """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, u.vec_id AS id, 1 - list_sum(list_transform(range(1, len(u.v) + 1), lambda i: q.v[i] * u.v[i])) AS distance FROM u AS q, u WHERE q.vec_id % 100 = 0),
"""


@query(_KNN_SQL + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, round(distance, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = search.nearest(queries, e.select(F.col("vec_id").alias("id"), "embedding"), 10)
    return hits.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), *_long("rank"))


@query(_KNN_SQL + """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d), h AS (SELECT query_id, id // 5 AS parent_id, min(distance) AS distance FROM r WHERE rank <= 15 GROUP BY 1, 2),
p AS (SELECT query_id, parent_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, parent_id) AS rank FROM h) SELECT query_id, parent_id, round(distance, 6) + 0.0 AS distance, rank FROM p WHERE rank <= 5""")
def knn_parent_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = search.nearest(queries, e.select(F.col("vec_id").alias("id"), "embedding"), 15)
    best = search.best_parents(hits, 5, parent=F.expr("id div 5"))
    return best.select("query_id", "parent_id", (F.round("distance", 6) + 0.0).alias("distance"), *_long("rank"))


@query(f"""WITH t AS (SELECT p_partkey, lower({_TRIAL_TEXT_SQL}) || CASE WHEN p_partkey % 2 = 0 THEN ' for type 2' ELSE '' END AS t FROM part)
SELECT p_partkey FROM t WHERE NOT (contains(t, 'juvenile') AND NOT contains(t, 'type 2')) AND NOT (contains(t, 'type 1') AND NOT contains(t, 'type 2')) AND NOT (contains(t, 'prediabetes') AND NOT contains(t, 'type 2'))""")
def subtype_filter(spark: SparkSession, d: str) -> DataFrame:
    trial = F.concat(_trial_text(F.col("p_partkey")), F.when(F.col("p_partkey") % 2 == 0, " for type 2").otherwise(""))
    rules = [(["type 2"], ["juvenile", "type 1"], ["type 2"]), (["t2d"], ["prediabetes"], ["type 2"]), (["her2 low"], ["diabetes"], ["x"])]
    return table(spark, d, "part").where(~classify.wrong_subtype(F.lit("Has T2DM, type 2"), trial, rules)).select("p_partkey")


# --- evaluation -----------------------------------------------------------------------------------------------------------------------
def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as evaluation results with made-up verdict tags."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    tag = lambda k: F.element_at(F.array(*(F.lit(f"VERDICT: {v}\n") for v in ("ELIGIBLE", "Ineligible", "BORDERLINE", "INELIGIBLE"))), ((F.col("chars") + k) % 4 + 1).cast("int"))
    first = F.when(F.col("turns") % 3 == 0, F.lit("none")).otherwise(F.concat(tag(0), tag(1)))
    return c.select(
        F.col("conv_id").cast("string").alias("patient_id"), F.element_at(F.array(*(F.lit(x) for x in ("diabetes", "breast_cancer", "other"))), F.col("conv_id").cast("int") % 3 + 1).alias("condition"), first.alias("recommendation"), tag(0).alias("judgment"),
        F.when(F.col("conv_id") % 5 == 0, "blocked").when(F.col("conv_id") % 5 == 1, "flagged").otherwise("passed").alias("status"), F.array().cast("array<string>").alias("flag_reasons"), F.array_repeat(F.lit("t"), F.col("turns").cast("int")).alias("trials"), "turns",
    )


_TAGGED_SQL = """WITH c AS (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY 1),
v AS (SELECT conv_id, turns, ['diabetes', 'breast_cancer', 'other'][conv_id % 3 + 1] AS condition, CASE WHEN conv_id % 5 = 0 THEN 'blocked' WHEN conv_id % 5 = 1 THEN 'flagged' ELSE 'passed' END AS status,
 ['ELIGIBLE', 'INELIGIBLE', 'BORDERLINE', 'INELIGIBLE'][CAST(chars % 4 AS INT) + 1] AS a, ['ELIGIBLE', 'INELIGIBLE', 'BORDERLINE', 'INELIGIBLE'][CAST((chars + 1) % 4 AS INT) + 1] AS b, turns % 3 = 0 AS none FROM c),
r AS (SELECT *, CASE WHEN none THEN 'BLOCKED' WHEN a = 'ELIGIBLE' OR b = 'ELIGIBLE' THEN 'ELIGIBLE' WHEN a = 'BORDERLINE' OR b = 'BORDERLINE' THEN 'BORDERLINE' WHEN status = 'blocked' THEN 'BLOCKED' ELSE 'INELIGIBLE' END AS verdict FROM v)
"""


@query(_TAGGED_SQL + "SELECT verdict, count(*) AS n FROM (SELECT a AS verdict FROM r WHERE NOT none UNION ALL SELECT b FROM r WHERE NOT none) GROUP BY 1")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    found = _tagged(spark, d).select(F.explode(verdicts.verdicts(F.col("recommendation"))).alias("verdict"))
    return found.groupBy("verdict").agg(F.count("*").alias("n"))


@query(_TAGGED_SQL + "SELECT CAST(conv_id AS VARCHAR) AS patient_id, CASE WHEN status = 'blocked' THEN 'BLOCKED' ELSE verdict END AS verdict, verdict AS reported FROM r")
def overall_verdict(spark: SparkSession, d: str) -> DataFrame:
    found, status = verdicts.verdicts(F.col("recommendation")), F.col("status")
    return _tagged(spark, d).select("patient_id", verdicts.overall_verdict(found, status).alias("verdict"), verdicts.report_verdict(found, status).alias("reported"))


@query(_TAGGED_SQL + """SELECT count(*) AS total, count(*) FILTER (verdict = 'ELIGIBLE') AS eligible_count, count(*) FILTER (verdict = 'BORDERLINE') AS borderline_count, count(*) FILTER (verdict = 'INELIGIBLE') AS ineligible_count, count(*) FILTER (verdict = 'BLOCKED') AS blocked_count,
count(*) FILTER (status = 'flagged') AS flagged_count, count(*) FILTER (status = 'passed') AS passed_count, 100.0 * count(*) FILTER (verdict = 'ELIGIBLE') / count(*) AS eligible_rate, avg(turns) AS avg_retrieved, 100.0 * count(*) FILTER (NOT none) / greatest(count(*) FILTER (NOT none), 1) AS consensus_rate FROM r""")
def kpi_block(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.kpis(evaluation.result_rows(_tagged(spark, d))).select("total", "eligible_count", "borderline_count", "ineligible_count", "blocked_count", "flagged_count", "passed_count", "eligible_rate", "avg_retrieved", "consensus_rate")


@query(_TAGGED_SQL + "SELECT condition, count(*) AS patients, count(*) FILTER (verdict = 'ELIGIBLE') AS eligible, count(*) FILTER (verdict = 'BORDERLINE') AS borderline, count(*) FILTER (verdict = 'INELIGIBLE') AS ineligible, count(*) FILTER (verdict = 'BLOCKED') AS blocked, avg(turns) AS avg_retrieved FROM r GROUP BY 1")
def condition_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.condition_breakdown(evaluation.result_rows(_tagged(spark, d))).drop("eligible_rate")


@query(_TAGGED_SQL + """SELECT condition, nullif(count(*) FILTER (verdict = 'ELIGIBLE'), 0) AS "ELIGIBLE", nullif(count(*) FILTER (verdict = 'BORDERLINE'), 0) AS "BORDERLINE", nullif(count(*) FILTER (verdict = 'INELIGIBLE'), 0) AS "INELIGIBLE", nullif(count(*) FILTER (verdict = 'BLOCKED'), 0) AS "BLOCKED" FROM r GROUP BY 1""")
def verdict_pivot(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.verdict_pivot(evaluation.result_rows(_tagged(spark, d)))


@query(_TAGGED_SQL + "SELECT CAST(conv_id AS VARCHAR) AS patient_id, CAST(CASE WHEN none THEN 0 ELSE 1 END AS BIGINT) AS same, CAST(0 AS BIGINT) AS different FROM r")
def zip_consensus(spark: SparkSession, d: str) -> DataFrame:
    pair = verdicts.agreement(verdicts.verdicts(F.col("recommendation")), verdicts.verdicts(F.col("judgment")))
    return _tagged(spark, d).select("patient_id", pair["same"].cast("long").alias("same"), pair["different"].cast("long").alias("different"))


@query("""WITH s AS (SELECT o_totalprice AS v, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
l AS (SELECT 'c_mktsegment' AS s, c_mktsegment AS x, v FROM s UNION ALL SELECT 'o_orderpriority', o_orderpriority, v FROM s)
SELECT 'avg_o_totalprice_' || s || '_' || x AS metric, round(avg(v), 4) AS average, count(*) AS n FROM l GROUP BY s, x""")
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return evaluation.slice_metrics(joined, ["c_mktsegment", "o_orderpriority"], "o_totalprice", F.col("o_orderstatus") == "F").withColumn("average", F.round("average", 4))


@query("""WITH s AS (SELECT avg(quality) AS average_score, count(*) FILTER (toxic = 1) AS eligible, count(*) FILTER (toxic = 0) AS not_eligible, count(*) AS verdict_total, count(*) AS patients FROM labels)
SELECT * FROM (SELECT 'average_overall_score' AS metric, average_score AS value, 3.0 AS threshold, CASE WHEN average_score < 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM s WHERE average_score < 3
UNION ALL SELECT 'eligible_percentage', 100 * (eligible / verdict_total), 30.0, 'MEDIUM' FROM s WHERE eligible / verdict_total < 0.3
UNION ALL SELECT 'not_eligible_percentage', 100 * (not_eligible / verdict_total), 70.0, 'HIGH' FROM s WHERE not_eligible / verdict_total > 0.7
UNION ALL SELECT 'patients_evaluated', patients, 3.0, 'MEDIUM' FROM s WHERE patients < 3)""")
def breach_table(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "labels").agg(F.avg("quality").alias("average_score"), F.count_if(F.col("toxic") == 1).alias("eligible"), F.count_if(F.col("toxic") == 0).alias("not_eligible"), F.count("*").alias("verdict_total"), F.count("*").alias("patients"))
    return evaluation.breaches(one)


@query("""WITH r AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (value > 10) / count(*) AS success, avg(value) AS matched FROM events GROUP BY 1, 2),
p AS (SELECT *, coalesce(lag(success) OVER (PARTITION BY event_type ORDER BY day), 0.7) AS ps, coalesce(lag(matched) OVER (PARTITION BY event_type ORDER BY day), 3.0) AS pm FROM r)
SELECT event_type, day, round(success, 6) AS success, round(matched, 6) AS matched, round(ps, 6) AS previous_success, round(pm, 6) AS previous_matched, success < ps * (1 - 0.2) OR matched < pm * (1 - 0.2) AS regressed FROM p""")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg((F.count_if(F.col("value") > 10) / F.count("*")).alias("success"), F.avg("value").alias("matched"))
    out = evaluation.regressions(runs, "day", {"success": 0.7, "matched": 3.0}, within=["event_type"])
    return out.select("event_type", "day", *(F.round(c, 6).alias(c) for c in ("success", "matched", "previous_success", "previous_matched")), "regressed")


@query("""WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderkey ORDER BY o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1),
t AS (SELECT o_custkey, a[1:5] AS a, b[1:5] AS b FROM l), c AS (SELECT *, list_filter(a, lambda x: list_contains(b, x)) AS m FROM t)
SELECT o_custkey, len(m) / len(a) AS overlap_ratio, coalesce(list_sum(list_transform(m, lambda x: abs(list_position(a, x) - list_position(b, x)))), 0) / greatest(len(m), 1) AS avg_rank_shift, 1 - len(m) / len(a) AS importance FROM c""")
def overlap_rank_shift(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"), F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("b"))
    both = lists.select("o_custkey", F.slice("a", 1, 5).alias("a"), F.transform(F.slice("b", 1, 5), lambda x: x["o_orderkey"]).alias("b"))
    return both.select("o_custkey", F.inline(F.array(evaluation.overlap(F.col("a"), F.col("b")))))


@query("""WITH i AS (SELECT c_mktsegment AS feature, avg(c_acctbal) AS average FROM customer GROUP BY 1) SELECT feature, round(average, 4) AS average, row_number() OVER (ORDER BY average DESC, feature) AS rank FROM i""")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.feature_importance(table(spark, d, "customer").select(F.col("c_mktsegment").alias("feature"), F.col("c_acctbal").alias("importance")))
    return found.select("feature", F.round("average", 4).alias("average"), *_long("rank"))


@query("""SELECT l_returnflag AS param, l_linenumber AS value, avg(l_quantity) FILTER (l_linestatus = 'O') AS avg_candidates, round(avg(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS avg_matched, count(*) FILTER (l_linestatus = 'O') / greatest(count(*), 1) AS success_rate FROM lineitem GROUP BY 1, 2""")
def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("param"), F.col("l_linenumber").alias("value"), F.lit("x").alias("slice"), F.col("l_quantity").alias("candidates"), F.col("l_extendedprice").alias("matched"), (F.col("l_linestatus") == "O").alias("success"))
    return evaluation.sweep_metrics(runs).select("param", "value", F.nullif("avg_candidates", F.lit(0.0)).alias("avg_candidates"), F.nullif(F.round("avg_matched", 4), F.lit(0.0)).alias("avg_matched"), "success_rate")


@query("""WITH r AS (SELECT doc_id % 7 AS run, avg(quality) AS score, 100.0 * avg(toxic) AS toxic_pct FROM labels GROUP BY 1) SELECT run, 'score' AS metric, score AS value FROM r UNION ALL SELECT run, 'toxic_pct', toxic_pct FROM r""")
def metric_long(spark: SparkSession, d: str) -> DataFrame:
    report = table(spark, d, "labels").groupBy((F.col("doc_id") % 7).alias("run")).agg(F.avg("quality").alias("score"), (100.0 * F.avg("toxic")).alias("toxic_pct"))
    return to_metrics(report, ["score", "toxic_pct"], ["run"])


# --- values -----------------------------------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def partial_date(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    shown = F.when(k == 0, F.substring(s, 1, 4)).when(k == 1, F.substring(s, 1, 7)).when(k == 2, s).when(k == 3, F.concat(s, F.lit("T10:00:00Z"))).otherwise(F.lit("2020-13-45"))
    return table(spark, d, "orders").select("o_orderkey", values.partial_date(shown).alias("parsed"))


@query("SELECT o_orderkey, date_diff('year', CAST(o_orderdate AS DATE), DATE '2020-06-15') - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) > 615 THEN 1 ELSE 0 END AS age, date_diff('day', CAST(o_orderdate AS DATE), DATE '2020-06-15') AS days FROM orders")
def age_at(spark: SparkSession, d: str) -> DataFrame:
    born, as_of = F.col("o_orderdate").cast("date"), F.lit("2020-06-15").cast("date")
    return table(spark, d, "orders").select("o_orderkey", values.age_at(born, as_of).cast("long").alias("age"), values.duration_days(born, F.lit(None).cast("date"), as_of).cast("long").alias("days"))


@query("SELECT c_custkey, CASE WHEN c_acctbal <> 0 AND c_nationkey <> 0 THEN c_acctbal < c_nationkey * 100 OR c_acctbal > c_nationkey * 300 END AS abnormal FROM customer")
def out_of_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", values.out_of_range(F.col("c_acctbal"), F.col("c_nationkey") * 100, F.col("c_nationkey") * 300).alias("abnormal"))


# --- streams ------------------------------------------------------------------------------------------------------------------------------
@query("SELECT time_bucket(INTERVAL '600 seconds', ts) AS start, round(avg(value), 6) AS average, count(*) AS n FROM events GROUP BY 1")
def window_avg_600s(spark: SparkSession, d: str) -> DataFrame:
    return streams.window_average(table(spark, d, "events"), "ts", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("average", 6).alias("average"), "n")
