"""Registered queries over studies, patient records, guards, indexes, files and run summaries, made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import classify, guards, text, values, verdicts
from tessera.operators import clinical, contract, evaluation, flatten, keyed, search
from tessera.session import shared_folder, written
from tessera.sources import sinks, tables
from tessera.sources.tables import spread, table

from .catalogue import _TAGGED_SQL, _tagged, query

AS_OF = "2020-06-15"


def _pick(key: str, *texts: str | None) -> Column:
    """One of the texts for each value of a key column, in turn."""
    return F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col(key) % len(texts) + 1).cast("int"))


def _sql_pick(key: str, *texts: str | None) -> str:
    shown = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts)
    return f"[{shown}][CAST({key} % {len(texts)} AS INT) + 1]"


# --- studies ----------------------------------------------------------------------------------------------------------------
_STUDY_TEXTS = {"nct_number": "id", "study_title": "c_name", "study_url": f"'{flatten.STUDY_URL}' || id", "phase": "CASE WHEN k = 0 THEN '' ELSE 'PHASE1; PHASE2' END", "conditions": "c_mktsegment || '; Obesity'", "interventions": "'Drug A; '", "intervention_types": "'DRUG; '", "location_countries": "CASE WHEN k = 1 THEN '' ELSE 'Canada; United States' END", "location_cities": "CASE WHEN k = 1 THEN '' ELSE 'A; B' END", "sponsor": "CASE WHEN k = 2 THEN '' ELSE 'NIH' END"}


@query(f"""WITH s AS (SELECT c_custkey % 3 AS k, 'NCT' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, * FROM customer)
SELECT {', '.join(f'''{_STUDY_TEXTS.get(text.column_name(c), "''")} AS {text.column_name(c)}''' for c in flatten.COLUMNS if c not in ("Enrollment", "Number of Locations"))}, CASE WHEN k <> 0 THEN CAST(c_nationkey AS BIGINT) END AS enrollment, CASE WHEN k = 1 THEN 0 ELSE 4 END AS number_of_locations FROM s""")
def flatten_study(spark: SparkSession, d: str) -> DataFrame:
    """Nested studies, some with sections missing or of a wrong kind, flattened and renamed."""
    k, json = F.col("c_custkey") % 3, F.to_json
    identification = F.struct(F.concat(F.lit("NCT"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("nctId"), F.col("c_name").alias("briefTitle"))
    design = F.when(k == 0, F.lit('{"enrollmentInfo": "not_a_dict", "phases": "PHASE1"}')).otherwise(F.format_string('{"enrollmentInfo": {"count": %d}, "phases": ["PHASE1", "PHASE2", 3]}', F.col("c_nationkey").cast("long")))
    places = F.when(k == 1, F.lit("{}")).otherwise(F.lit('{"locations": [{"country": "United States", "city": "B"}, {"country": "Canada", "city": "A"}, {"country": "Canada", "city": ""}, "bad"]}'))
    sponsor = F.when(k == 2, F.lit('{"leadSponsor": "not_a_dict"}')).otherwise(F.lit('{"leadSponsor": {"name": "NIH"}}'))
    conditions = json(F.struct(F.array("c_mktsegment", F.lit("Obesity")).alias("conditions")))
    body = F.format_string(
        '{"protocolSection": {"identificationModule": %s, "designModule": %s, "contactsLocationsModule": %s, "sponsorCollaboratorsModule": %s, "conditionsModule": %s, "armsInterventionsModule": {"interventions": [{"name": "Drug A", "type": "DRUG"}, "x", {"name": null}]}}}',
        json(identification), design, places, sponsor, conditions,
    )
    return flatten.snake_case(flatten.flatten(table(spark, d, "customer").select(F.parse_json(body).alias("study")))).withColumn("number_of_locations", F.col("number_of_locations").cast("int"))


@query("""SELECT 'NCT' || c_custkey AS nct, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'N/A' END AS title, 'N/A' AS phase FROM customer""")
def trial_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Columns renamed, with a default where a value or a whole column is missing."""
    rows = table(spark, d, "customer").select(F.concat(F.lit("NCT"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    return flatten.with_defaults(rows, {"nct": "id", "title": "name", "phase": "phase"})


# --- patient records --------------------------------------------------------------------------------------------------------
_DIAGNOSES = ("Diabetes mellitus type 2", "HER2 disease", "Flu", "Prediabetes")


def _patients(spark: SparkSession, d: str) -> DataFrame:
    """Health-record bundles of customers as patient records."""
    year = (1940 + F.col("c_custkey") % 60).cast("string")
    body = F.format_string(
        """{"entry": [{"resource": {"resourceType": "Patient", "id": "%s", "birthDate": "%s-06-15", "gender": "%s", "address": [{"city": "X"}], "maritalStatus": {"coding": [{"display": "M"}]}, "extension": [{"url": "http://us-core-race", "extension": [{"url": "text", "valueString": "White"}]}]}},
{"resource": {"resourceType": "Condition", "code": {"coding": [{"code": "c%s", "display": "%s"}]}, "onsetDateTime": "2010", "clinicalStatus": {"coding": [{"code": "active"}]}}},
{"resource": {"resourceType": "Condition", "code": {"text": "Old"}, "clinicalStatus": {"coding": [{"code": "resolved"}]}, "abatementDateTime": "2011-02"}},
{"resource": {"resourceType": "MedicationRequest", "medicationCodeableConcept": {"text": "Metformin"}, "status": "active", "authoredOn": "2012-03-04T05:06:07Z", "dosageInstruction": [{"text": "daily", "route": {"text": "oral"}}]}},
{"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "a", "display": "HbA1c"}]}, "valueQuantity": {"value": %s.5, "unit": "%%"}, "effectiveDateTime": "2020-01-01"}},
{"resource": {"resourceType": "Observation", "code": {"text": "Old one"}, "valueString": "low", "effectiveDateTime": "2012-01-01"}},
{"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "72166-2", "display": "Smoking"}]}, "valueCodeableConcept": {"text": "Never"}, "effectiveDateTime": "2012-01-01"}},
{"resource": {"resourceType": "Observation", "code": {"text": "B"}, "valueString": "b", "effectiveDateTime": "2020-02"}}, {"resource": {"resourceType": "Observation", "code": {"text": "C"}, "valueString": "c"}},
{"resource": {"resourceType": "Observation", "code": {"text": "D"}, "valueString": "d"}}, {"resource": {"resourceType": "Observation", "code": {"text": "E"}, "valueString": "e"}}, {"resource": {"resourceType": "Observation", "code": {"text": "F"}, "valueString": "f"}},
{"resource": {"resourceType": "Procedure", "code": {"text": "P1"}, "performedDateTime": "2001"}}, {"resource": {"resourceType": "Procedure", "code": {"text": "P2"}, "performedPeriod": {"start": "2019-01-01"}}},
{"resource": {"resourceType": "Procedure", "code": {"text": "P3"}, "performedDateTime": "2003-01"}}, {"resource": {"resourceType": "Procedure", "code": {"text": "P4"}, "performedDateTime": "2002"}},
{"resource": {"resourceType": "AllergyIntolerance", "code": {"text": "Nuts"}, "criticality": "high", "reaction": [{"manifestation": [{"text": "Hives"}, {"text": "Itch"}]}]}}]}""",
        F.col("c_custkey").cast("string"), year, _pick("c_custkey", "Female", "male", "x"), F.col("c_custkey").cast("string"), _pick("c_custkey", *_DIAGNOSES), (F.col("c_custkey") % 9 + 1).cast("string"),
    )
    keys = written(spread(table(spark, d, "customer").select("c_custkey")), "patients")  # before the filters, which are pushed below a plain repartition
    bundles = keys.select("c_custkey", F.parse_json(F.when(F.col("c_custkey") % 11 == 0, F.lit('{"entry": []}')).otherwise(body)).alias("bundle"))
    return clinical.patients(bundles, ["c_custkey"], F.lit(AS_OF).cast("date"))


_PATIENT_SQL = f"""WITH p AS (SELECT c_custkey, CAST(80 - c_custkey % 60 AS BIGINT) AS age, {_sql_pick("c_custkey", "female", "male", "unknown")} AS gender, {_sql_pick("c_custkey", *_DIAGNOSES)} AS diagnosis, CAST(c_custkey % 9 + 1 AS VARCHAR) || '.5' AS a1c FROM customer WHERE c_custkey % 11 <> 0) """


@query(_PATIENT_SQL + f"""SELECT c_custkey, age, gender, 'White' AS race, 'X' AS city, 'M' AS marital, {_sql_pick("c_custkey", "diabetes", "breast_cancer", "other", "diabetes")} AS condition,
'Patient is a ' || age || '-year-old ' || gender || ' White. Active diagnoses: ' || diagnosis || '. Current medications: Metformin. Recent observations: HbA1c: ' || a1c || ' %; B: b; C: c; D: d; E: e. Recent procedures: P2, P3, P4. Known allergies: Nuts. Smoking status: Never.' AS summary FROM p""")
def patient_summaries(spark: SparkSession, d: str) -> DataFrame:
    who = F.col("demographics")
    return _patients(spark, d).select(
        "c_custkey", who["age"].cast("long").alias("age"), who["gender"].alias("gender"), who["race"].alias("race"), who["city"].alias("city"), who["marital_status"].alias("marital"), classify.record_condition(F.col("conditions")).alias("condition"),
        clinical.summary(F.lit(AS_OF).cast("date")).alias("summary"),
    )


@query(_PATIENT_SQL + """SELECT c_custkey, 'c' || c_custkey || ' ' || diagnosis || ' 2010-01-01 active|unknown Old 2011-02-01 resolved' AS conditions, 'Metformin daily oral 2012-03-04 active' AS medications,
'HbA1c ' || a1c || ' % 2020-01-01|Old one low 2012-01-01|Smoking Never 2012-01-01|B b 2020-02-01|C c 2020-06-15|D d 2020-06-15|E e 2020-06-15|F f 2020-06-15' AS observations,
'P1 2001-01-01|P2 2019-01-01|P3 2003-01-01|P4 2002-01-01' AS procedures, 'Nuts high Hives,Itch allergy' AS allergies, 'Never' AS smoking, diagnosis AS active, CAST(6 AS BIGINT) AS recent FROM p""")
def patient_parts(spark: SparkSession, d: str) -> DataFrame:
    """The record's lists, each as one text."""

    def shown(items: str, *names: str) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(" ", *(F.array_join(x[n], ",") if n == "reaction" else x[n].cast("string") for n in names))), "|").alias(items)

    return _patients(spark, d).select(
        "c_custkey", shown("conditions", "code", "display_name", "onset_date", "abatement_date", "status"), shown("medications", "display_name", "dosage", "route", "start_date", "status"), shown("observations", "display_name", "value", "value_string", "unit", "date"),
        shown("procedures", "display_name", "performed_date"), shown("allergies", "substance", "criticality", "reaction", "type"), F.col("lifestyle.smoking_status").alias("smoking"),
        F.array_join(F.transform(clinical.active_conditions(F.col("conditions")), lambda c: c["display_name"]), ",").alias("active"), F.size(clinical.recent(F.col("observations"), F.lit(AS_OF).cast("date"), 365)).cast("long").alias("recent"),
    )


_SUMMARIES = ("A 50-year-old female, HbA1c: 8.1%, BMI: 31", "glucose and insulin", "Breast lump after a mammogram, obesity", "HER2 and T2DM, hypertension", "breast only", "nothing")


@query(f"""WITH c AS (SELECT c_custkey, {_sql_pick("c_custkey", "diabetes", "diabetes", "breast_cancer", "breast_cancer,diabetes", "diabetes,breast_cancer", "diabetes,breast_cancer")} AS conditions, c_custkey % 6 AS k FROM customer)
SELECT c_custkey, string_split(conditions, ',')[1] AS first, len(string_split(conditions, ',')) AS n, replace(replace(replace(conditions, 'breast_cancer', 'breast cancer clinical trial oncology'), 'diabetes', 'diabetes clinical trial glycemic control glucose'), ',', ' ')
|| CASE k WHEN 0 THEN ' HbA1c 8.1% BMI 31 adult age 50 female women' WHEN 2 THEN ' obesity overweight BMI' WHEN 3 THEN ' hypertension blood pressure HER2 breast cancer' ELSE '' END AS query,
 'a b' || CASE WHEN k = 0 THEN '' ELSE ' HbA1c 8' END || ' cancer stage II' AS extracted FROM c""")
def retrieval_queries(spark: SparkSession, d: str) -> DataFrame:
    summary = _pick("c_custkey", *_SUMMARIES)
    found = table(spark, d, "customer").select("c_custkey", summary.alias("s")).withColumn("c", classify.detect_conditions(F.col("s")))
    extracted = classify.context_query(F.array(F.lit("a"), F.lit("b")), F.when(F.col("c_custkey") % 6 != 0, "8"), F.lit(""), F.lit("II"), F.lit(""))
    return found.select("c_custkey", F.col("c")[0].alias("first"), F.size("c").cast("long").alias("n"), classify.retrieval_query(F.col("s"), F.col("c")).alias("query"), extracted.alias("extracted"))


# --- guards and scopes --------------------------------------------------------------------------------------------------------
@query(f"""SELECT o_orderkey, {_sql_pick("o_orderkey", None, "No trials retrieved", "Retrieved trial missing identifier", "No trials retrieved")} AS retrieval, {_sql_pick("o_orderkey", None, "Retrieved trial outside supported disease scope", "No reranked trials available")} AS scope,
{_sql_pick("o_orderkey", "r", "s", "s", "")} AS reason, CASE WHEN o_orderkey % 2 = 0 THEN 'Ask. Consult your doctor' ELSE 'Ask.' || chr(10) || chr(10) || '{guards.DISCLAIMER}' END AS answer, 'blocked' AS status, 'Guardrail triggered at input: ' || o_orderpriority AS message FROM orders""")
def guard_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval and scope validation, reasons, disclaimers and blocked answers."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("array<string>")
    ids = F.when(k % 4 == 0, F.array(F.lit("NCT1"))).when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("NCT1"), F.lit(""))).otherwise(none)
    scopes = F.when(k % 3 == 0, F.array(F.lit("Type 2 Diabetes"), F.lit("BREAST CANCER"))).when(k % 3 == 1, F.array(F.lit("diabetes"), F.lit("asthma"))).otherwise(none)
    reason = guards.guard_reason(F.when(k % 4 == 0, "r").when(k % 4 == 1, ""), F.when(k % 4 != 3, "s"))
    answer = guards.with_disclaimer(F.when(k % 2 == 0, "Ask. Consult your doctor").otherwise(" Ask. "))
    blocked = guards.blocked_response(F.col("o_orderpriority"), F.lit("x"), "input")
    return table(spark, d, "orders").select(
        "o_orderkey", guards.retrieval_problem(ids).alias("retrieval"), guards.scope_problem(scopes).alias("scope"), reason.alias("reason"), answer.alias("answer"), blocked["guardrail"]["status"].alias("status"), F.split_part(blocked["recommendation"], F.lit(". This"), F.lit(1)).alias("message"),
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def not_yet_done(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    return keyed.not_done(table(spark, d, "orders").select("o_orderkey", flag.alias("embedded")), "embedded").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') OR c_custkey % 5 = 0")
def condition_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("disease"))
    return keyed.in_scope(rows, "disease", ["Building", "Machinery"]).select("c_custkey")


@query("SELECT 'admin' AS reader, count(*) AS n FROM orders UNION ALL SELECT 'owner', count(*) FILTER (o_orderpriority = '2-HIGH') FROM orders")
def row_access(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    views = [keyed.visible(orders, "o_orderpriority", "2-HIGH", admin).agg(F.count("*").alias("n")).select(F.lit(name).alias("reader"), "n") for name, admin in (("admin", True), ("owner", False))]
    return tables.union_of(views)


# --- keyed tables and index ---------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN 'U' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS owner FROM orders WHERE o_orderkey % 7 <> 0""")
def record_crud(spark: SparkSession, d: str) -> DataFrame:
    """Records created unless there, updated but for their owner, then deleted."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    old = rows.where("o_orderkey % 2 <> 0").withColumn("owner", F.lit(1))
    made = keyed.create(old, rows.withColumn("owner", F.lit(2)), "o_orderkey")
    changed = keyed.update(made, rows.where("o_orderkey % 2 <> 0 AND o_orderkey % 5 = 0").select("o_orderkey", F.lit("U").alias("status"), F.lit(9).alias("owner")), "o_orderkey", kept=["owner"])
    return keyed.delete(changed, rows.where("o_orderkey % 7 = 0"), "o_orderkey")


@query("""WITH b AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text || ' changed' ELSE text END AS text FROM benchmark WHERE trim(coalesce(text, '')) <> ''), n AS (SELECT *, CAST(greatest(ceil((length(text) - 200) / 1000), 1) AS BIGINT) AS n FROM b)
SELECT CAST(item_id AS VARCHAR) || '_' || i AS id, md5(substring(text, i * 1000 + 1, 1200)) AS chunk, sha256(text) AS content, CAST(64 AS BIGINT) AS dimensions FROM n, unnest(range(n)) AS t(i)""")
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """An index of half of the items, brought up to date with all of them, some changed."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    before = search.update_index(None, items.where("item_id % 2 = 0"), "item_id", F.col("text"))
    now = items.withColumn("text", F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return search.update_index(before, now, "item_id", F.col("text")).select("id", F.md5("chunk").alias("chunk"), "content", F.size("embedding").cast("long").alias("dimensions"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, u.vec_id AS id, 1 - list_sum(list_transform(range(1, len(u.v) + 1), lambda i: q.v[i] * u.v[i])) AS distance FROM u AS q, u WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d WHERE distance < 0.75) SELECT query_id, id, rank FROM r WHERE rank <= 20""")
def knn_within(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors within a distance."""
    e = table(spark, d, "embeddings")
    hits = search.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 20, limit=0.75)
    return hits.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) - 1) // 20 AS batch FROM lineitem")
def row_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return search.fixed_batches(rows, "place", 20, "l_returnflag").select("l_orderkey", "l_linenumber", "batch")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Reranking without a score: the first candidates in their order, numbered."""
    return search.rerank(table(spark, d, "orders").select("o_custkey", "o_orderkey"), 3, "o_custkey", None, "o_orderkey").withColumn("rank", F.col("rank").cast("long"))


# --- files ----------------------------------------------------------------------------------------------------------------------
@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'say "hi",' || chr(10) || ' ' || c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS number FROM customer""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes, commas, line ends and NA tokens, written in batches and read again."""
    path = shared_folder(spark, "csv")
    name = F.when(F.col("c_custkey") % 4 == 0, "N/A").otherwise(F.concat(F.lit('say "hi",\n '), "c_name"))
    rows = table(spark, d, "customer").select("c_custkey", name.alias("name"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_nationkey").cast("string")).alias("number"))
    sinks.write_csv(rows, path, rows_per_file=500)
    return tables.read_csv(spark, path, "c_custkey long, number long")


@query("""SELECT c_mktsegment AS condition, count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS numbers FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def records_by_condition(spark: SparkSession, d: str) -> DataFrame:
    """JSON records by condition and date; a second run of one condition replaces its own alone, and NaN is null."""
    path = shared_folder(spark, "records")
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, 0.5).otherwise(F.lit(float("nan"))).alias("x"))
    for name in ("BUILDING", "MACHINERY", "BUILDING"):
        sinks.write_records(rows.where(F.col("c_mktsegment") == name), path, name, "2024-01-01")
    return spark.read.json(path).groupBy("condition").agg(F.count("*").alias("n"), F.count("x").alias("numbers"))


@query("SELECT count(*) AS n, max(c_custkey) AS last, count(*) FILTER (c_custkey % 2 = 0) AS even FROM customer")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "report")
    sinks.write_report(table(spark, d, "customer").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"), F.count_if(F.col("c_custkey") % 2 == 0).alias("even")), path)
    return tables.read_report(spark, path)


@query("SELECT c_custkey, c_name, c_custkey % 2 AS run_id FROM customer")
def results_by_run(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "results")
    for run in (0, 1):
        sinks.write_results(table(spark, d, "customer").where(F.col("c_custkey") % 2 == run).select("c_custkey", "c_name", F.lit(run).cast("long").alias("run_id")), path)
    return spark.read.schema("c_custkey long, c_name string, run_id long").json(path)


@query("SELECT * FROM (SELECT 'point' AS scan, c_custkey, c_name FROM customer WHERE c_custkey = 7 UNION ALL (SELECT 'first', c_custkey, NULL FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 5))")
def lookup_scans(spark: SparkSession, d: str) -> DataFrame:
    """A point lookup and a filtered, limited scan, appended."""
    customer = table(spark, d, "customer")
    first = tables.first_where(customer, "c_nationkey = 3", ["c_custkey"], 5).select(F.lit("first").alias("scan"), "c_custkey")
    return tables.union_of([tables.point_lookup(customer, "c_custkey", 7).select(F.lit("point").alias("scan"), "c_custkey", "c_name"), first])


# --- run summaries ----------------------------------------------------------------------------------------------------------------
@query(_TAGGED_SQL + """SELECT count(*) AS patients, round(avg(turns) FILTER (conv_id % 4 <> 0), 6) AS average, CAST(sum(turns) AS BIGINT) AS calls,
(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT v, count(*) AS n FROM (SELECT a AS v FROM r WHERE NOT none UNION ALL SELECT b FROM r WHERE NOT none) GROUP BY 1)) AS verdicts,
(SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT coalesce(nullif(status, 'flagged'), 'unknown') AS s, count(*) AS n FROM r GROUP BY 1)) AS statuses FROM r""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the scores that are numbers, calls, verdict and status counts."""
    rows = _tagged(spark, d).select("patient_id", F.when(F.col("patient_id").cast("long") % 4 == 0, "n/a").otherwise(F.col("turns").cast("string")).alias("score"), F.col("turns").alias("calls"), F.nullif("status", F.lit("flagged")).alias("guardrail_status"), verdicts.verdicts(F.col("recommendation")).alias("trial_verdicts"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(m)
    return evaluation.run_summary(rows).select("patients", F.round("average_score", 6).alias("average"), F.col("calls").cast("long").alias("calls"), shown("verdicts"), shown("statuses"))


@query("""WITH m AS (SELECT o_orderpriority AS s, avg(o_orderkey % 5 + ascii(o_orderpriority) - 49) AS average FROM orders GROUP BY 1)
SELECT 'avg_score_slice_' || s AS metric, round(average, 6) AS average, CASE WHEN 5 - average > 2 THEN 'error' WHEN 5 - average > 1 THEN 'warning' ELSE 'ok' END AS level FROM m""")
def slice_disparity(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "orders").select(F.col("o_orderpriority").alias("slice"), (F.col("o_orderkey") % 5 + F.ascii("o_orderpriority") - 49).alias("score"))
    return evaluation.slice_gaps(evaluation.slice_metrics(scores, ["slice"], "score", F.lit(True)), 5.0).select("metric", F.round("average", 6).alias("average"), "level")


@query("""WITH r AS (SELECT o_orderpriority, count(*) FILTER (o_orderkey % 4 <> 0) / count(*) AS success, avg(o_orderkey % 7) + ascii(o_orderpriority) - 50 AS matched FROM orders GROUP BY 1)
SELECT o_orderpriority, success >= 0.7 AND matched >= 3 AS passed FROM r""")
def run_passes(spark: SparkSession, d: str) -> DataFrame:
    """The validation threshold of each run."""
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").groupBy("o_orderpriority").agg((F.count_if(k % 4 != 0) / F.count("*")).alias("success"), (F.avg(k % 7) + F.ascii("o_orderpriority") - 50).alias("matched"))
    return runs.select("o_orderpriority", evaluation.passes(F.col("success"), F.col("matched")).alias("passed"))


@query("SELECT 'ALERT' AS status, CAST(1 + CASE WHEN avg(toxic) < 0.3 THEN 1 ELSE 0 END + CASE WHEN avg(toxic) < 0.3 THEN 1 ELSE 0 END AS BIGINT) AS breaches FROM labels")
def alert_state(spark: SparkSession, d: str) -> DataFrame:
    toxic = F.col("toxic")
    one = table(spark, d, "labels").agg(F.lit(1.0).alias("average_score"), F.count_if(toxic == 1).alias("eligible"), F.count_if(toxic == 0).alias("not_eligible"), F.count("*").alias("verdict_total"), F.count("*").alias("patients"))
    return evaluation.alert_status(evaluation.breaches(one))


@query("""SELECT l_orderkey AS patient_id, l_linenumber AS trial, l_returnflag AS verdict, CASE WHEN l_linenumber <= 3 THEN 'R' END AS second_verdict, CASE WHEN l_linenumber <= 3 THEN l_returnflag = 'R' END AS agree FROM lineitem""")
def judges_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("patient_id"), F.col("l_linenumber").alias("trial"), F.col("l_returnflag").alias("verdict"))
    second = first.where("trial <= 3").select("patient_id", "trial").distinct().withColumn("verdict", F.lit("R"))
    return evaluation.by_trial_number(first, second)


@query(f"""SELECT o_orderkey, {_sql_pick("o_orderkey", "Evaluation skipped because the case was blocked by guardrails.", None, "No retrieved trials available for evaluation.", "Evaluation skipped because the case was blocked by guardrails.")} AS summary,
{_sql_pick("o_orderkey", "Blocked before evaluation.", None, "RAG produced zero reranked trials.", "why")} AS reasoning, '- N' || o_orderkey || '  [ELIGIBLE  4/5]  no disqualifier' || chr(10) || '- N2  [INELIGIBLE  1/5]  age' AS block,
'intro ' || chr(10) || 'VERDICT: ELIGIBLE ' || chr(10) || 'Concerns: ' || o_orderkey || ' ' || chr(10) || '**Trial 12** end' AS sections FROM orders""")
def judge_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What is judged and what is skipped, the verdict block of a prompt, and answers put into sections."""
    k, one = F.col("o_orderkey"), F.array(F.lit("t"))
    why = evaluation.skipped(F.when((k % 4 == 0) | (k % 4 == 3), "blocked").otherwise("passed"), F.when(k % 4 == 3, "why").otherwise(""), F.when(k % 4 == 2, F.array().cast("array<string>")).otherwise(one))
    trial = lambda nct, verdict, score, reason: F.struct(nct.alias("nct_id"), F.lit(verdict).alias("verdict"), F.lit(score).alias("fitness_score"), F.lit(reason).cast("string").alias("disqualifying_criterion"))
    block = text.verdict_block(F.array(trial(F.concat(F.lit("N"), k.cast("string")), "ELIGIBLE", 4, ""), trial(F.lit("N2"), "INELIGIBLE", 1, "age")))
    answer = F.concat(F.lit(" Output: \nintro VERDICT: ELIGIBLE Concerns: "), k.cast("string"), F.lit(" **Trial 12** end\n"))
    return table(spark, d, "orders").select("o_orderkey", why["summary"].alias("summary"), why["score_reasoning"].alias("reasoning"), block.alias("block"), text.sectioned(answer).alias("sections"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latest_run(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("SELECT count(*) FILTER (c_custkey % 3 <> 2) AS uploaded, count(*) FILTER (c_custkey % 3 = 2) AS skipped FROM customer")
def upload_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return sinks.upload_counts(table(spark, d, "customer").select(F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "").alias("nct_number"), F.when(k % 3 == 1, F.col("c_name")).alias("nctnumber")), "nct_number", "nctnumber")
