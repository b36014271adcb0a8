"""12. PII: base patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Protected entities are the values that the base patterns find (e-mail and IP addresses, card and phone
numbers). Over the distinct texts of the whole corpus, N(e) of N texts hold entity e, N(t) hold term t, and N(t, e)
hold t within `window` words of e. The term's pointwise mutual information with e, log(N * N(t, e) / (N(t) * N(e))), against
the entity's information content, log(N / N(e)), says how much of e the term discloses: 1 where t stands by e alone.
From `generalise` on a term near the entity is replaced by its class, from `remove` on it is removed.
Fewer than `support` texts prove nothing, and copies of one text count once.

Only texts with an entity send anything: their (entity, term) pairs, counted by shuffles with partial sums. N(t) is
counted over all texts for the terms that can still reach the threshold, found by a bitmap of fixed size; common words cannot,
as the texts around entities show already, and are not counted. Hot entities, terms and copies are all
summed before they are moved; no list of the texts of an entity or a term is ever made. Terms are treated in the texts in which they
stand by the entity, at every place of that text.

Spans are in code points, end exclusive; a term's span never overlaps a base span. Defined results: null and empty texts have no
spans; repeated rows get equal spans; a term is a word of 2 to 64 characters (ASCII letters in lower case); extra columns are carried along, and one that
bears the name of a result column is replaced; where every text holds an entity, nothing more can be disclosed about it.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat as fl
from .common import free_name, in_bits, key_bits, maybe_in, table, written

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "generalise", "remove"]
#: The base patterns, in forms that no text makes slow. An address's local part is found backwards from its @.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every text with a base span has one of these.
GUARD = r"@[A-Za-z0-9-]|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[\x20-]?[0-9]){12}"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_DIGITS = re.compile("[0-9]")
SPANS = "array<struct<kind:string,start:int,end:int>>"


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end), by kind and then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = "".join(_DIGITS.findall(m[0]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> str:
    """One value for all the ways to write an entity."""
    shown = value.translate(_LOWER) if kind == 0 else ".".join(p.lstrip("0") or "0" for p in value.split(".")) if kind == 1 else "".join(_DIGITS.findall(value))
    return f"{BASE[kind]}:{shown}"


def words(text: str, spans: list[tuple[int, int, int]], longest: int = 64) -> list[tuple[int, int, str]]:
    """(start, end, term) of a text's words outside the spans, in order."""
    taken = sorted((s, e) for _, s, e in spans)
    reach, merged = -1, []
    for s, e in taken:
        if s < reach:
            merged[-1] = (merged[-1][0], max(reach, e))
        else:
            merged.append((s, e))
        reach = merged[-1][1]
    starts, ends = [s for s, _ in merged], [e for _, e in merged]
    out = []
    for m in _WORD.finditer(text.translate(_LOWER)):
        s, e = m.span()
        if 2 <= e - s <= longest:
            i = bisect.bisect_right(ends, s)  # the first span that ends behind the word's start
            if i == len(starts) or starts[i] >= e:
                out.append((s, e, m[0]))
    return out


def _key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y")]


def contexts(docs: DataFrame, text_col: str, window: int) -> DataFrame:
    """(x, y, entity, terms): the entities of each distinct text and the terms within `window` words of them."""
    source = docs.where(F.col(text_col).rlike(GUARD)).select(*_key(text_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # texts that this task has had
        for batch in batches:
            rows: list[tuple] = []
            for x, y, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add((x, y))
                spans = base_spans(text)
                if not spans:
                    continue
                found = words(text, spans)
                starts = [w[0] for w in found]
                near: dict[str, set[str]] = {}
                for kind, s, e in spans:
                    i = bisect.bisect_left(starts, s)
                    near.setdefault(entity(kind, text[s:e]), set()).update(w[2] for w in found[max(0, i - window) : i + window])
                rows += [(x, y, name, sorted(terms)) for name, terms in near.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())))], names=["x", "y", "entity", "terms"])

    return source.mapInArrow(run, "x long, y long, entity string, terms array<string>").dropDuplicates(["x", "y", "entity"])


def _search(docs: DataFrame, text_col: str, terms: DataFrame, copied: DataFrame, found) -> tuple[DataFrame, object]:
    """The texts with their keys, and found() over an iterator of (terms held, key if the text may be a copy) for each text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = fl.flat(batch.column(0))
            h = fl.span_hashes(np.ascontiguousarray(data), bounds[:-1], bounds[1:]) if len(bounds) > 1 else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    sc = docs.sparkSession.sparkContext
    known = written(terms.mapInArrow(hashed, "h long"), "privacy-hashes")  # one Python worker a task at a time
    bits = [sc.broadcast(key_bits(keys, min(27, max(16, (16 * n).bit_length())))) for keys, n in ((known, known.count()), (copied.select("x"), copied.count()))]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[set[str], tuple[int, int] | None]]:
        wanted, copies = (b.value for b in bits)
        for batch in batches:
            raw, bounds = fl.flat(batch.column(2))
            x, y = (np.asarray(batch.column(i)) for i in (0, 1))
            maybe = in_bits(x, copies)
            for low, high in fl.pieces(bounds):
                data, edges = fl.LOWER[raw[bounds[low] : bounds[high]]], bounds[low : high + 1] - bounds[low]
                starts, ends, of = fl.words(data, edges, fl.ALNUM)
                if not len(starts):
                    continue
                hit = np.flatnonzero(in_bits(fl.span_hashes(data, starts, ends).view(np.int64), wanted))
                doc = low + np.searchsorted(of, hit, "right") - 1
                for d, at in zip(*(a.tolist() for a in np.unique(doc, return_index=True))):
                    stop = int(np.searchsorted(doc, d, "right"))
                    held = {data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in hit[at:stop].tolist()}
                    yield held, (int(x[d]), int(y[d])) if maybe[d] else None

    source = docs.where(F.col(text_col) != "").select(*_key(text_col), F.col(text_col).alias("text"))
    return source, lambda batches: found(texts(batches))


def least_counts(docs: DataFrame, text_col: str, terms: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, n): a number of distinct texts that each of `terms` has at least: all that are no copies, and what one task has of others."""

    def found(texts: Iterator[tuple[set[str], tuple[int, int] | None]]) -> Iterator[pa.RecordBatch]:
        single: Counter[str] = Counter()
        copies: Counter[str] = Counter()
        seen: set[tuple[int, int]] = set()
        for held, key in texts:
            if key is None:
                single.update(held)
            elif key not in seen and len(seen) < 1 << 20:  # beyond, copies are not counted: the number stays one that is reached
                seen.add(key)
                copies.update(held)
        every = list(single.keys() | copies.keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([single[t] for t in every], pa.int64()), pa.array([copies[t] for t in every], pa.int64())], names=["term", "single", "copies"])

    source, run = _search(docs, text_col, terms, copied, found)
    told = source.mapInArrow(run, "term string, single long, copies long").groupBy("term").agg((F.sum("single") + F.max("copies")).alias("n"))
    return told.join(terms, "term", "left_semi")


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame, copied: DataFrame, most: int) -> DataFrame:
    """(term, n): how many distinct texts hold each of `terms`; a number above `most` may be any such.

    Texts that may be copies (x of `copied`) are told apart by their key; a task sends a term's keys, `most` of them at most, and
    of a term that it finds in more texts only that.
    """

    def found(texts: Iterator[tuple[set[str], tuple[int, int] | None]]) -> Iterator[pa.RecordBatch]:
        counts = _TermCounts(most)
        for held, key in texts:
            counts.add(held, key)
            if counts.size > 1 << 20:
                yield counts.taken()
        yield counts.taken()

    source, run = _search(docs, text_col, terms, copied, found)
    summed = source.mapInArrow(run, "x long, y long, term string, n long").groupBy("x", "y", "term").agg(F.sum("n").alias("n"))
    once = summed.groupBy("term").agg(F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(1)).alias("n"))
    return once.join(terms, "term", "left_semi")


class _TermCounts:
    """What a task has found: numbers of single texts and keys of those that may be copies, until a term has more than `most` of both."""

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.single: Counter[str] = Counter()
        self.keys: dict[str, set[tuple[int, int]]] = {}
        self.size = 0

    def add(self, terms: set[str], key: tuple[int, int] | None) -> None:
        for t in terms:
            if self.single[t] > self.most:
                continue
            before = len(self.keys.get(t, ()))
            if key is None:
                self.single[t] += 1
            else:
                self.keys.setdefault(t, set()).add(key)
            held = len(self.keys.get(t, ()))
            self.size += held - before + (key is None)
            if self.single[t] + held > self.most:
                self.single[t] = self.most + 1
                self.keys.pop(t, None)

    def taken(self) -> pa.RecordBatch:
        rows = [(None, None, t, n) for t, n in self.single.items() if n] + [(*key, t, 1) for t, keys in self.keys.items() for key in keys]
        self._clear()
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["x", "y", "term", "n"])


def disclosures(docs: DataFrame, near: DataFrame, *, text_col: str = "text", support: int = 3, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(entity, term, disclosed, kind): terms that disclose at least the share `generalise` of an entity's information."""
    texts = written(docs.where(F.col(text_col) != "").select(*_key(text_col)).groupBy("x", "y").agg(F.count("*").alias("rows")), "privacy-texts")
    n = float(max(1, texts.count()))
    entities = near.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    pairs = near.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    information = F.log(F.lit(n) / F.col("n_entity"))
    # a term of more texts than this cannot reach the threshold for the entity
    most = F.col("n_both") * F.pow(F.lit(n) / F.col("n_entity"), F.lit(1 - generalise))
    rated = written(pairs.join(entities, "entity").where(F.col("n_entity") < n).withColumns({"information": information, "most": most}), "privacy-pairs")
    around = near.select("x", "y", F.explode("terms").alias("term"))
    possible = rated.groupBy("term").agg(F.max("most").alias("most"))
    some = maybe_in(possible.select(F.xxhash64("term").alias("h")), F.xxhash64("term"))
    around = around if some is None else around.where(some)
    around = around.distinct().groupBy("term").agg(F.count("*").alias("n_around"))
    copied = texts.where("rows > 1")
    under = lambda counts: possible.join(counts, "term").where(F.col("n") <= F.col("most") + 1e-6).select("term", "most")
    terms = written(under(around.withColumnRenamed("n_around", "n")), "privacy-terms")
    if not terms.isEmpty():  # a cheap pass leaves the terms that are rare enough, whose texts are then told apart
        terms = written(under(least_counts(docs, text_col, terms.select("term"), copied)), "privacy-terms")
    limit = terms.agg(F.max("most")).first()[0]
    if limit is None:
        counts = terms.select("term", F.lit(0).cast("long").alias("n"))
    else:
        counts = term_counts(docs, text_col, terms.select("term"), copied, math.ceil(limit) + 1)
    share = F.log(F.lit(n) * F.col("n_both") / (F.col("n") * F.col("n_entity"))) / F.col("information")
    out = rated.join(counts, "term").select("entity", "term", share.alias("disclosed")).where(F.col("disclosed") >= generalise)
    return out.withColumn("kind", F.when(F.col("disclosed") >= remove, "remove").otherwise("generalise"))


def sanitise(docs: DataFrame, *, text_col: str = "text", result_col: str = "private", clean_col: str | None = None, window: int = 50, support: int = 3, generalise: float = 0.8, remove: float = 0.95, most_bytes: int = 32 << 20) -> DataFrame:
    """Add `result_col`: all spans (kind, start, end), by kind and then start; with `clean_col` also the sanitised text.

    Terms by text are broadcast if they take `most_bytes` or less; more of them meet the texts that may hold entities in a
    join, and no other text is moved.
    """
    rest = docs.drop(result_col, *([clean_col] if clean_col else []))
    near = written(contexts(docs.select(F.col(text_col)), text_col, window), "privacy-contexts")
    found = written(disclosures(docs.select(F.col(text_col)), near, text_col=text_col, support=support, generalise=generalise, remove=remove), "privacy-disclosed")
    pairs = near.select("x", "y", "entity", F.explode("terms").alias("term"))
    some = maybe_in(found.select(F.xxhash64("entity", "term").alias("h")), F.xxhash64("entity", "term"))
    pairs = pairs if some is None else pairs.where(some)
    told = pairs.join(found.select("entity", "term", "kind"), ["entity", "term"]).groupBy("x", "y", "term").agg(F.max("kind").alias("kind"))
    told = written(told.groupBy("x", "y").agg(F.collect_list(F.struct("term", "kind")).alias("told")), "privacy-told")
    size = told.agg(F.sum(F.aggregate("told", F.lit(32).cast("long"), lambda n, t: n + F.octet_length(t["term"]) + 48))).first()[0] or 0
    x, y, given = (free_name(rest, c) for c in ("_x", "_y", "_told"))
    told = told.select(F.col("x").alias(x), F.col("y").alias(y), F.col("told").alias(given))
    maybe = F.coalesce(F.col(text_col).rlike(GUARD), F.lit(False))
    keyed = rest.where(maybe).withColumns({x: F.xxhash64(text_col), y: F.xxhash64(F.lit(1), text_col)})
    joined = keyed.join(F.broadcast(told) if size <= most_bytes else told, [x, y], "left").drop(x, y)
    return _marked(joined, rest.columns, text_col, given, result_col, clean_col).unionByName(
        rest.where(~maybe).withColumns({result_col: F.array().cast(SPANS)} | ({clean_col: F.coalesce(text_col, F.lit(""))} if clean_col else {}))
    )


def _marked(df: DataFrame, columns: list[str], text_col: str, given: str, result_col: str, clean_col: str | None) -> DataFrame:
    """The spans of each row's text, and the text without them."""
    source = df.select(*columns, given)
    at, told_at = [c.lower() for c in columns].index(text_col.lower()), len(columns)
    out = df.select(*columns).withColumn(result_col, F.lit(None).cast(SPANS))
    out = out.withColumn(clean_col, F.lit(None).cast("string")) if clean_col else out
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for text, told in zip(batch.column(at).to_pylist(), batch.column(told_at).to_pylist()):
                found = base_spans(text)
                if told:
                    rank = {t["term"]: KINDS.index(t["kind"]) for t in told}
                    found += sorted((rank[w], s, e) for s, e, w in words(text, found) if w in rank)
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found])
                if clean_col:
                    clean.append(cleaned(text, found))
            more = [pa.array(spans, kind), *([pa.array(clean, pa.string())] if clean_col else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:told_at], *more], names=[*batch.schema.names[:told_at], result_col, *([clean_col] if clean_col else [])])

    return source.mapInArrow(run, out.schema)


def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the base spans named by kind, generalised terms by class, and removed ones gone."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
        if s >= at:
            out.append(text[at:s])
            if k < len(BASE):
                out.append(f"[{BASE[k].upper()}]")
            elif KINDS[k] == "generalise":
                word = text[s:e]
                out.append("[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), result_col="private")
    shown = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("private", lambda s: s["kind"].isin(*BASE))
    number = lambda kind: F.size(F.filter("private", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in BASE), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("private")).alias("spans"))
