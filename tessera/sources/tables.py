"""Readers of the engine's inputs. Schemas are explicit where the format has none."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a tabular file uses for "no value".
NA_TOKENS = ["", "NA", "N/A", "n/a", "null", "NULL", "None", "nan", "NaN", "-nan", "-NaN", "<NA>", "#N/A", "#NA", "#N/A N/A", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN"]
ORDINAL = "_ord"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores where the files make fewer pieces than there are cores; larger inputs are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_ordinal(df: DataFrame, name: str = ORDINAL) -> DataFrame:
    """Number rows in the order of the files that they are read from."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, schema: str | None = None, na: Sequence[str] = NA_TOKENS, ordinal: bool = False) -> DataFrame:
    """Quoted, multi-line CSV with a header. Without a schema all columns are strings; `na` tokens become null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    raw = reader.csv(path)
    df = raw.select(*(F.when(~F.col(f"`{c}`").isin(list(na)), F.col(f"`{c}`")).alias(c) for c in raw.columns))
    if schema:
        from pyspark.sql.types import _parse_datatype_string

        kinds = {f.name: f.dataType for f in _parse_datatype_string(schema).fields}
        df = df.select(*(F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))
    return with_ordinal(df) if ordinal else df


def _results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    df = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(folder)
    return df.withColumn("file", F.col("_metadata.file_name")).where("file <> 'summary.json'")


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON results without its summary; unreadable files are skipped."""
    return _results(spark, folder, schema).where("_corrupt IS NULL").drop("_corrupt")


def skipped_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(file, n_chars, n_fields): what read_results leaves out, for a warning, and how many fields could be read of it."""
    found = _results(spark, folder, schema)
    fields = [c for c in found.columns if c not in ("_corrupt", "file")]
    counted = found.withColumn("n_fields", F.size(F.array_compact(F.array(*(F.col(f"`{c}`").cast("string") for c in fields)))))
    # the reader wants a field to be asked for beside the corrupt text, whatever the caller selects
    return counted.where(F.col("_corrupt").isNotNull() & (F.col("n_fields") >= 0)).select("file", F.length("_corrupt").cast("long").alias("n_chars"), "n_fields")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as VARIANT, one row each: (file, bundle)."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("bundle"))


def resources(bundles: DataFrame) -> DataFrame:
    """(file, type, place, resource): the resources of bundles; entries without one, and files that are no bundle, give none."""
    entries = bundles.select("file", F.posexplode(F.try_variant_get("bundle", "$.entry", "array<variant>")).alias("place", "entry"))
    found = entries.select("file", F.try_variant_get("entry", "$.resource.resourceType", "string").alias("type"), "place", F.try_variant_get("entry", "$.resource", "variant").alias("resource"))
    return found.where("type IS NOT NULL")


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """Study JSON, one object a line or an array a file, as VARIANT rows; what cannot be parsed is skipped."""
    raw = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    many = raw.where("schema_of_variant(v) LIKE 'ARRAY%'").select(F.expr("inline(array(struct(cast(v AS array<variant>) AS items)))")).select(F.explode("items").alias("study"))
    one = raw.where("schema_of_variant(v) LIKE 'OBJECT%'").select(F.col("v").alias("study"))
    lines = spark.read.text(path).where("trim(value) LIKE '{%}'").select(F.try_parse_json("value").alias("study")).where("study IS NOT NULL")
    pages = one.where("try_variant_get(study, '$.studies', 'array<variant>') IS NOT NULL").select(F.explode(F.expr("try_variant_get(study, '$.studies', 'array<variant>')")).alias("study"))
    single = one.where("try_variant_get(study, '$.studies', 'array<variant>') IS NULL AND try_variant_get(study, '$.protocolSection', 'variant') IS NOT NULL")
    whole = many.unionByName(pages).unionByName(single)
    return whole if not whole.isEmpty() else lines


def union_of(tables: Iterable[DataFrame]) -> DataFrame:
    """Collections appended; columns that some lack are null there."""
    first, *rest = tables
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def first_where(df: DataFrame, condition: str, order: Sequence[str], n: int = 1) -> DataFrame:
    """A filtered, limited scan with a defined order."""
    return df.where(condition).orderBy(*order).limit(n)
