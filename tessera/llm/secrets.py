"""9. Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by pattern: assigned secrets, access identifiers and long hex
strings. Weak parts (identifiers, unnamed mixed strings, endpoints and hosts, and what is too
short for the base kinds) prove nothing alone: an interval join over the documents that have any, by bins of the scope's width, reports
one only where a complementary part lies within the scope around it. An unnamed secret
has 32 characters or more and may stand right behind a '=', as in KEY=value.

Spans are in code points, end exclusive. Defined results: null and empty texts have no
spans; ties in start are in the order of the kinds; rows equal in id and text get equal
spans; extra columns are carried along, and one that bears the name of the result column
is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, written

#: Kinds in order, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{12,}", 0, 24),
]
#: Matches that the lengths above drop are weak parts: kind, base kind, least length.
SHORT = [("link_assign", "assign", 1), ("link_access", "access", 8), ("link_hex", "hex", 12)]
#: Other weak parts by pattern. Roles: identifier, secret, endpoint. A host has 127 labels at most, as names
#: on the net do; Java matches a repeated group by recursion, so none here may repeat without a bound.
WEAK = [
    ("link_id", r"(?i)(?:client|account|user|key|tenant)[_-]?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_-]{6,}"),
    ("link_secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"),
    ("link_endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]{2,5})?(?:/[A-Za-z0-9._~/-]*)?|(?<![A-Za-z0-9.@-])[a-z0-9-]++(?:\.[a-z0-9-]++){0,125}\.(?:com|net|org|io|dev|cloud|internal|local)(?![A-Za-z0-9-])(?::[0-9]{2,5})?"),
]
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "link_assign": "secret", "link_access": "identifier", "link_hex": "secret", "link_id": "identifier", "link_secret": "secret", "link_endpoint": "endpoint"}
KINDS = list(ROLES)
#: A text in which none of these is has no span: each base kind and each secret, which every link needs, holds one.
GUARDS = [r"(?i:pass(?:word|wd)|secret|token|api_?key)", r"AKIA", r"[0-9a-f]{12}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32}"]
SPAN = "array<struct<start:int,rank:int,end:int>>"


def found(text: Column, pattern: str, group: int, ranks: list[tuple[int, int]]) -> Column:
    """The pattern's leftmost non-overlapping matches as (start, rank, end).

    `ranks` are (least length of the group, rank), longest first; shorter matches are dropped. The places come from the
    lengths of the matches and of what lies between them, summed in blocks of 256 matches so that no long array is copied for each.
    """
    matches, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    steps = F.arrays_zip(F.transform(F.slice(parts, 1, F.size(matches)), F.length).alias("gap"), F.transform(matches, F.length).alias("own"), F.transform(kept, F.length).alias("kept"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(steps) - 1) / 256), F.lit(0)).cast("int")), lambda b: F.slice(steps, b * 256 + 1, 256))

    def begin(done: Column, block: Column) -> Column:
        width = F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["own"])
        return F.struct((done["at"] + width).alias("at"), F.array_append(done["starts"], done["at"]).alias("starts"))

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        rank = F.lit(None).cast("int")
        for least, value in reversed(ranks):
            rank = F.when(x["kept"] >= least, F.lit(value)).otherwise(rank)
        span = F.struct(start.alias("start"), rank.alias("rank"), (start + x["own"]).alias("end"))
        return F.struct((start + x["own"]).alias("at"), F.when(rank.isNotNull(), F.array_append(done["out"], span)).otherwise(done["out"]).alias("out"))

    none = F.array().cast(SPAN)
    starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), begin, lambda done: done["starts"])
    spans = F.flatten(F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), add, lambda done: done["out"])))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def parts_of(text: Column) -> Column:
    """All parts of a text, base and weak, as (start, rank, end)."""
    short = {base: (least, KINDS.index(kind)) for kind, base, least in SHORT}
    strong = [found(text, pattern, group, [(least, KINDS.index(kind)), short[kind]]) for kind, pattern, group, least in BASE]
    return F.concat(*strong, *(found(text, pattern, 0, [(1, KINDS.index(kind))]) for kind, pattern in WEAK))


def scan(docs: DataFrame, *, scope: int = 200, id_col: str = "doc_id", text_col: str = "text", result_col: str = "secrets", most: int = 200_000) -> DataFrame:
    """Add `result_col`: all spans (start, kind, end), base and linked, by start and then kind.

    Texts are scanned once and only keys and parts are joined with what links them. The spans of up to `most` texts are
    then broadcast to the documents; more of them meet those documents that pass the guards again, and no others are moved.
    """
    rest = docs.drop(result_col)
    key, spans = free_name(rest, "_key"), free_name(rest, "_spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    guard = F.lit(False)
    for pattern in GUARDS:
        guard = guard | text.rlike(pattern)
    keyed = rest.withColumn(key, F.struct(F.xxhash64(id_col, text_col).alias("x"), F.xxhash64(F.lit(1), text_col, id_col).alias("y")))
    parts = written(keyed.where(guard).select(F.col(key).alias("key"), parts_of(text).alias("parts")).where(F.size("parts") > 0).dropDuplicates(["key"]), "secrets-parts")
    linked = link(parts.select("key", F.inline("parts")), scope).groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))
    base = F.filter("parts", lambda x: x["rank"] < len(BASE))
    every = F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast(SPAN))))
    names = F.array(*(F.lit(k) for k in KINDS))
    named = F.transform(every, lambda x: F.struct(x["start"].alias("start"), F.element_at(names, x["rank"] + 1).alias("kind"), x["end"].alias("end")))
    judged = written(parts.join(linked, "key", "left").select(F.col("key").alias(key), named.alias(spans)).where(F.size(spans) > 0), "secrets-spans")
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    count, longest = judged.agg(F.count("*"), F.max(F.size(spans))).first()
    if count * max(100, longest or 0) <= 100 * most:
        return keyed.join(F.broadcast(judged), key, "left").withColumn(result_col, F.coalesce(spans, none)).select(*rest.columns, result_col)
    some = keyed.where(guard).join(judged, key, "left").withColumn(result_col, F.coalesce(spans, none)).select(*rest.columns, result_col)
    return some.unionByName(rest.where(~guard).withColumn(result_col, none))


def link(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts (key, start, rank, end) within `scope` of a part of another role: an interval semi-join by bins.

    A secret needs an identifier or endpoint, these need a secret: two public parts make no credential. Overlapping parts are no partners.
    """
    roles = F.array(*(F.lit(ROLES[k]) for k in KINDS))
    parts = parts.withColumn("role", F.element_at(roles, F.col("rank") + 1))
    width = max(scope, 64)
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    reach = F.explode(F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / width), F.floor((F.col("end") + scope) / width)))
    partners = parts.select(F.col("key").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r"), F.col("rank").alias("o"), bins.alias("bin"))
    weak = parts.where(F.col("rank") >= len(BASE))
    near = (F.col("s") < F.col("end") + scope) & (F.col("e") > F.col("start") - scope)
    apart = (F.col("e") <= F.col("start")) | (F.col("s") >= F.col("end"))
    pair = ((F.col("role") == "secret") & (F.col("r") != "secret")) | ((F.col("role") != "secret") & (F.col("r") == "secret"))
    out = weak.withColumn("near_bin", reach).join(partners, (F.col("key") == F.col("k")) & (F.col("near_bin") == F.col("bin")) & near & apart & pair, "left_semi")
    return out.select("key", "start", "rank", "end").distinct()


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by `mark`."""

    def step(done: Column, x: Column) -> Column:
        fresh = x["start"] >= done["at"]
        piece = F.concat(F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit(mark))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(fresh, F.array_append(done["out"], piece)).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda which: F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base_kinds = F.array(*(F.lit(k) for k, *_ in BASE))
    base = F.filter("secrets", lambda x: F.array_contains(base_kinds, x["kind"]))
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind, *_ in BASE]
    return spans.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))
