"""1. Benchmark decontamination.

The normalised word n-grams of the test items form a hash set that is broadcast
after a check of its size; the documents' token windows are scanned against it in
one pass without a shuffle, every hash hit is verified word by word, and hit spans
or whole documents are removed. A benchmark beyond the size bound is split into
blocks by hash, each scanned in its own pass.

Defined results: a null or empty text has no words and is never contaminated; an
item without words has no windows; an item of fewer than n words is one window;
items whose id is null hit as all others do, and stand in a list of ids as one null at its end;
repeated rows get equal results; extra columns are carried along, and one that
bears the name of the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat as fl
from .common import free_name, shared_dir, table

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """The distinct windows of the items: length, hash, words and the ids of the items that have it."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = fl.flat(batch.column(1))
            data = fl.LOWER[data]
            starts, ends, at = fl.words(data, bounds, fl.ALNUM)
            hashes = fl.span_hashes(data, starts, ends)
            items = batch.column(0)
            out: dict[str, list] = {"k": [], "hash": [], "words": [], "item": []}
            sizes = np.diff(at)
            for k in {n, *sizes[(sizes > 0) & (sizes < n)].tolist()}:
                found, first = fl.window_hashes(hashes, at, k)
                for h, i, row in zip(found.view(np.int64).tolist(), first.tolist(), fl.rows_of(first, at).tolist()):
                    if k == n or sizes[row] == k:
                        out["k"].append(k)
                        out["hash"].append(h)
                        out["words"].append(_joined(data, starts[i : i + k], ends[i : i + k]))
                        out["item"].append(items[row].as_py())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("k", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item", pa.string())]))

    raw = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    found = raw.mapInArrow(windows, "k int, hash long, words binary, item string").groupBy("k", "hash", "words")
    nameless = F.when(F.max(F.col("item").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return found.agg(F.concat(F.sort_array(F.collect_set("item")), nameless).alias("items"))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist()))


class _Index:
    """Windows of one block, sorted by size and hash: a bitmap and the hashes find hits, the words beside them verify them.

    The columns stay where the broadcast value has them; only bitmaps of 1 MB a size are made.
    """

    def __init__(self, rows: pa.Table):
        self.words, self.items = (rows[c].combine_chunks() for c in ("words", "items"))
        sizes, hashes = rows["k"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
        self.sizes = np.unique(sizes).tolist()
        self.first = {k: int(np.searchsorted(sizes, k)) for k in self.sizes}
        self.hashes = {k: hashes[self.first[k] : int(np.searchsorted(sizes, k, "right"))] for k in self.sizes}
        self.bitmap = {k: np.zeros(1 << 20, bool) for k in self.sizes}
        for k, found in self.hashes.items():
            self.bitmap[k][(found >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes that windows have, where they start, and the first window with each."""
        found, first = fl.window_hashes(hashes, at, k)
        some = np.flatnonzero(self.bitmap[k][(found >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.hashes[k], found[some])
        same = self.hashes[k][np.minimum(place, len(self.hashes[k]) - 1)] == found[some]
        return found[some[same]], first[some[same]], place[same]

    def same(self, k: int, place: int, words: bytes) -> list[str | None]:
        """The items of the window of these words, among those that share the hash at `place`."""
        hashes, out = self.hashes[k], []
        at = place
        while at < len(hashes) and hashes[at] == hashes[place]:
            if self.words[self.first[k] + at].as_py() == words:
                out += self.items[self.first[k] + at].as_py()
            at += 1
        return out


def _scan(batches: Iterator[pa.RecordBatch], index: _Index, text_at: int, result_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = fl.flat(batch.column(text_at))
        results: list[dict] = []
        earlier = batch.column(result_at).to_pylist()
        for low, high in fl.pieces(bounds):
            part, rows = fl.LOWER[data[bounds[low] : bounds[high]]], bounds[low : high + 1] - bounds[low]
            starts, ends, at = fl.words(part, rows, fl.ALNUM)
            hashes = fl.span_hashes(part, starts, ends)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str | None]] = {}
            for k in index.sizes:
                _, first, places = index.hits(hashes, at, k)
                for i, place, row in zip(first.tolist(), places.tolist(), fl.rows_of(first, at).tolist()):
                    if ids := index.same(k, place, _joined(part, starts[i : i + k], ends[i : i + k])):
                        spans.setdefault(row, []).append((i - int(at[row]), i - int(at[row]) + k))
                        items.setdefault(row, set()).update(ids)
            for row in range(high - low):
                before = earlier[low + row]
                hit = [*spans.get(row, ()), *((x["start"], x["end"]) for x in before["hits"])] if before else spans.get(row, [])
                results.append({"n_words": int(at[row + 1] - at[row]), "hits": _merged(hit), "items": sorted({*items.get(row, ()), *(before["items"] if before else ())}, key=lambda x: (x is None, x))})
        columns = [pa.array(results, _ARROW) if i == result_at else batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 10, action: str = "report", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", result_col: str = "contamination", max_windows: int = 1_000_000
) -> DataFrame:
    """Find the benchmark's windows in the documents.

    action "report" adds `result_col` (words, merged hit word spans, item ids in string
    order, last a null for items without one); "documents" drops contaminated documents and "spans" cuts the hit words out
    of the text, both returning the columns of `docs`. max_windows bounds each broadcast.
    """
    if action not in ("report", "spans", "documents"):
        raise ValueError(f"unknown action {action!r}")
    spark: SparkSession = docs.sparkSession
    windows = benchmark_windows(benchmark, n, item_col, item_text_col)
    count = windows.count()
    blocks = max(1, -(-count // max_windows))
    result = result_col if action == "report" else free_name(docs, result_col)
    out = docs.drop(result).withColumn(result, F.lit(None).cast(RESULT))
    text_at, result_at = [c.lower() for c in out.columns].index(text_col.lower()), len(out.columns) - 1
    for block in range(blocks):
        rows = windows.where(F.pmod("hash", F.lit(blocks)) == block).toArrow()  # at most about max_windows rows
        shared = spark.sparkContext.broadcast(_packed(rows))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return _scan(batches, _Index(_unpacked(shared.value)), text_at, result_at)

        out = out.mapInArrow(scan, out.schema)
        if block < blocks - 1:
            shared_dir(spark)
            out = out.checkpoint()
    if action == "report":
        return out
    if action == "documents":
        return out.where(F.size(f"{result}.hits") == 0).drop(result)
    return _cut(out, text_col, result).select(*docs.columns)


def _packed(rows: pa.Table) -> bytes:
    rows = rows.take(pa.array(np.lexsort((rows["hash"].to_numpy().view(np.uint64), rows["k"].to_numpy()))))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _cut(df: DataFrame, text_col: str, result: str) -> DataFrame:
    """The texts without the hit words; what stands between two hit words of a span goes with them."""
    text_at, result_at = df.columns.index(text_col), df.columns.index(result)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for row, found in enumerate(batch.column(result_at).to_pylist()):
                if found["hits"]:
                    raw = np.frombuffer(texts[row].encode(), np.uint8)
                    starts, ends, _ = fl.words(fl.LOWER[raw], np.array([0, len(raw)]), fl.ALNUM)
                    keep = np.ones(len(raw), bool)
                    for span in found["hits"]:
                        keep[starts[span["start"]] : ends[span["end"] - 1]] = False
                    texts[row] = raw[keep].tobytes().decode()
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(cut, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contamination.*")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


#: The same in SQL: windows of words are joined as lists, the words under any of them counted once.
SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hit) AS h, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
