"""7. Suffix-array dedup of repeated byte strings.

Every window of `length` bytes holds an anchor: the least hash among its grams of `gram`
bytes. Equal windows hold the same anchor at the same place, so repeats are found among
occurrences of one anchor. Anchors with one occurrence go; occurrences whose whole contexts
(all windows around the anchor) are equal are settled by their count; of the rest, one context
of each kind meets the other kinds of its anchor in a task that builds their suffix array by
prefix doubling. In suffix order, previous and next smaller positions give each suffix its
longest earlier match (LPF), and greater ones its later match. The windows around an anchor are put
into bins, and a context is cut to the bins whose core, the bytes that all their windows hold, another one shares. Anchors with more than `most`
kinds of contexts are settled by counting blocks of windows, then single windows, over all executors.

keep="none" removes every byte under a window that starts anywhere else too; keep="first" keeps
the first occurrence and removes windows that have an earlier match. Its order is that of `id_col`
(nulls last), then of the texts' hashes, then of equal rows as they are stored once, then of places.
All judgements are on the input. Whole texts are treated as UTF-8 bytes and matches never cross documents.
With keep="none", rows of equal texts go whole and stand for one text in the search for other matches.

Defined results: null and empty texts have no bytes; texts shorter than `length` keep all; rows
equal in text are copies of each other, whatever their ids; removing may split characters, so kept bytes are
binary; extra columns are carried along, and ones that bear the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat as fl
from .common import free_name, maybe_in, table, written

CONTEXT = "h long, key long, base int, own int, alone boolean, bins int, bytes binary"
BINS = 4


def _bins(length: int, gram: int) -> list[tuple[int, int]]:
    """The windows around an anchor in bins, by the bytes before the anchor: (least, most), both included."""
    width = -(-(length - gram + 1) // BINS)
    return [(low, min(low + width - 1, length - gram)) for low in range(0, BINS * width, width)]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums that give any span's hash, and the inverse powers that place it."""
    up, down = fl.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(fl.BYTE_KEYS[data] * up[: len(data)], out=total[1:])
    return total, down


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, place in row, gram hash, context hash, cores of bins 0 and 1, of 2 and 3) of the anchors of all rows.

    A bin's core is what its windows have in common, as 32 bits of its hash; 0 if the row has no such window.
    """
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 6
    total, down = _sums(data)
    grams = fl.mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    width = length - gram + 1
    least = _least(grams, width)
    inside = np.zeros(len(least), bool)  # windows that lie in one row
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        inside[s : max(s, e - length + 1)] = True
    # a gram is an anchor if it equals the least of some window around it: spread each window's least over its grams
    same = np.flatnonzero(inside)
    change = np.append(True, (np.diff(same) > 1) | (least[same[1:]] != least[same[:-1]])) if len(same) else np.zeros(0, bool)
    first = same[change]
    last = same[np.append(np.flatnonzero(change)[1:] - 1, len(same) - 1)] if len(first) else first
    # grams first..last + width - 1 hold the windows of a run; equal grams in it are all anchors
    wanted = least[first]
    lengths = last - first + width
    at = np.repeat(first - np.append(0, np.cumsum(lengths))[:-1], lengths) + np.arange(int(lengths.sum())) if len(first) else first
    place = np.unique(at[grams[at] == np.repeat(wanted, lengths)]) if len(first) else first
    row = np.searchsorted(bounds, place, "right") - 1
    start = np.maximum(bounds[row], place - (length - gram))
    end = np.minimum(bounds[row + 1], place + length)
    context = fl.mix((total[end] - total[start]) * down[start] + (place - start).astype(np.uint64) * fl.PLACES[0] + (end - start).astype(np.uint64) * fl.PLACES[1])
    cores = []
    for low, high in _bins(length, gram):
        s, e = place - low, place - high + length
        there = (s >= bounds[row]) & (e <= bounds[row + 1]) & (low <= high)
        s, e = np.where(there, s, 0), np.where(there, e, 0)
        cores.append(np.where(there, fl.mix((total[e] - total[s]) * down[s]) >> np.uint64(32) | np.uint64(1), np.uint64(0)))
    pairs = [(cores[i] << np.uint64(32) | cores[i + 1]).view(np.int64) for i in (0, 2)]
    return row, place - bounds[row], grams[place].view(np.int64), context.view(np.int64), *pairs


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, key, pos, near, far) of all anchors of (key, text); near and far hold the cores of two bins each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of a task give their anchors once; forgotten at times, as repeats do no harm
        for batch in batches:
            keys = np.asarray(batch.column(0))
            fresh = np.sort([i for i in np.unique(keys, return_index=True)[1].tolist() if int(keys[i]) not in seen]).astype(np.int64)
            if len(seen) > 50_000:
                seen.clear()
            seen.update(keys[fresh].tolist())
            batch, keys = batch.take(pa.array(fresh)), keys[fresh]
            data, bounds = fl.flat(batch.column(1))
            for low, high in fl.pieces(bounds):
                row, pos, h, c, near, far = _anchors(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], length, gram)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(keys[low:high][row]), pa.array(pos.astype(np.int32)), pa.array(near), pa.array(far)], names=["h", "c", "key", "pos", "near", "far"])

    return docs.select("key", "text").mapInArrow(run, "h long, c long, key long, pos int, near long, far long")


def contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of the windows in the bins of each wanted (key, h, pos, alone, bins); one row of each key's text is read."""
    per_key = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "pos", "alone", "bins")).alias("places"))
    held = [[b for i, b in enumerate(_bins(length, gram)) if mask >> i & 1] for mask in range(1 << BINS)]
    least, reach = (np.array([x[i][i] if x else 0 for x in held]) for i in (0, -1))
    may_have = maybe_in(wanted.select("key").distinct(), F.col("key"))
    texts = (docs if may_have is None else docs.where(may_have)).select("key", "text").dropDuplicates(["key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = fl.flat(batch.column(1))
            lists = batch.column(2)
            h, pos, alone, bins = (lists.flatten().field(i) for i in range(4))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            at = np.asarray(pos).astype(np.int64)
            mask = np.asarray(bins)
            start = np.maximum(at - reach[mask], 0)
            end = np.minimum(at - least[mask] + length, np.diff(bounds)[row])
            keys = np.asarray(batch.column(0))
            for low in range(0, len(row), 2048):
                part = slice(low, low + 2048)
                first, size = bounds[row[part]] + start[part], (end - start)[part]
                offsets = np.append(0, np.cumsum(size))
                flat = data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
                found = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
                columns = [h.slice(low, 2048), pa.array(keys[row[part]]), pa.array(start[part].astype(np.int32)), pa.array((at - start)[part].astype(np.int32)), alone.slice(low, 2048), bins.slice(low, 2048), found]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "key", "base", "own", "alone", "bins", "bytes"])

    return texts.join(per_key, "key").select("key", "text", "places").mapInArrow(cut, CONTEXT)


def suffix_ranks(data: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that have `length` bytes left of their text and share them with another one, in order of their ranks by those bytes.

    Prefix doubling: ranks of 8, 16, ... bytes; the last step joins two overlapping blocks to exactly `length` (16 or
    more). A suffix that is alone in its rank keeps that rank, which no other can reach, and is not sorted again.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eight = np.zeros(n, np.uint64)
    for i in range(8):
        eight |= padded[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
    order = np.argsort(eight)
    rank, shared = np.empty(n, np.int64), np.zeros(n, bool)
    rank[order], shared[order] = _dense(eight[order])
    live, reach, base = np.flatnonzero(shared), 8, n
    while reach < length:
        step = min(reach, length - reach)
        live = live[left[live] >= reach + step]
        key = rank[live] * (16 * n) + rank[live + step]
        order = np.argsort(key)
        dense, several = _dense(key[order])
        rank[live[order]] = base + dense
        live = np.sort(live[order[several]])
        reach, base = reach + step, base + n
    order = live[np.argsort(rank[live], kind="stable")]
    return order, rank[order]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of sorted rows by their keys, and whether others have the same."""
    new = np.ones(len(keys) + 1, bool)
    new[1:-1] = keys[1:] != keys[:-1]
    return np.cumsum(new[:-1]) - 1, ~(new[:-1] & new[1:])


def nearest(values: np.ndarray, run: np.ndarray, side: int, smaller: bool) -> np.ndarray:
    """For each place, the nearest one before (side -1) or after it (1) in its run with a smaller (or greater) value; -1 for none.

    All places follow their candidates' pointers at once until every one is settled.
    """
    n = len(values)
    if side > 0:
        found = nearest(values[::-1], run[::-1], -1, smaller)[::-1]
        return np.where(found >= 0, n - 1 - found, -1)
    v = values if smaller else -values
    at = np.arange(n) - 1
    at[(at < 0) | (run[at] != run)] = -1
    todo = np.flatnonzero(at >= 0)
    while len(todo := todo[(at[todo] >= 0)]) and len(todo := todo[v[at[todo]] >= v[todo]]):
        at[todo] = at[at[todo]]
    return at


def _settle(key: np.ndarray, base: np.ndarray, alone: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int, first: bool) -> pa.RecordBatch:
    """(key, start, end) of bytes under matched windows of lone contexts; of several anchors' contexts, as equal bytes at two places match under any anchor."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(key)), sizes)
    left = bounds[1:][owner] - np.arange(len(data))
    order, rank = suffix_ranks(data, left, length)
    who = owner[order]
    place = (np.unique(key, return_inverse=True)[1][who].astype(np.int64) << 40) + base[who] + order - bounds[who]  # order of documents, then of places
    before, after = nearest(place, rank, -1, True), nearest(place, rank, 1, True)
    matched = (before >= 0) | (after >= 0)  # LPF reaches `length`
    if not first:
        matched |= (nearest(place, rank, -1, False) >= 0) | (nearest(place, rank, 1, False) >= 0)
    hit = np.sort(order[matched])
    hit = hit[alone[owner[hit]]]
    new = np.append(True, (np.diff(hit) > length) | (owner[hit[1:]] != owner[hit[:-1]])) if len(hit) else np.zeros(0, bool)
    starts, ends = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] + length if len(hit) else hit
    who = owner[starts]
    shift = base[who] - bounds[who]
    return pa.RecordBatch.from_arrays([pa.array(key[who]), pa.array((starts + shift).astype(np.int32)), pa.array((ends + shift).astype(np.int32))], names=["key", "start", "end"])


SPANS = "key long, start int, end int"


def settled(found: DataFrame, length: int, first: bool, flush: int = 1 << 18) -> DataFrame:
    """Spans of the contexts' matched windows; whole anchors are gathered up to about `flush` bytes a suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def judged(rows: pa.Table) -> pa.RecordBatch:
            key, base, alone = (rows[c].to_numpy() for c in ("key", "base", "alone"))
            return _settle(key, base.astype(np.int64), alone, *fl.flat(rows["bytes"]), length, first)

        for batch in batches:
            held.append(batch)
            size += batch.column(4).nbytes
            if size < flush:
                continue
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            cuts = np.flatnonzero(np.diff(h)) + 1
            ends = np.append(0, np.cumsum(pc.binary_length(rows["bytes"]).to_numpy()))
            low = 0
            while len(cuts) and cuts[-1] > low:
                high = int(cuts[max(0, np.searchsorted(ends[cuts], ends[low] + flush, "right") - 1)])
                if high <= low:
                    high = int(cuts[np.searchsorted(cuts, low, "right")])
                yield judged(rows.slice(low, high - low))
                low = high
            rest = rows.slice(low).combine_chunks()
            held = rest.to_batches()
            size = sum(b.column(4).nbytes for b in held)
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield judged(rows)

    slim = found.select("h", "key", "base", "alone", "bytes")
    return slim.repartition("h").sortWithinPartitions("h").mapInArrow(run, SPANS)


def counted(found: DataFrame, length: int, gram: int, first: bool) -> DataFrame:
    """The same for anchors with very many kinds of contexts: hashes are counted with partial sums.

    The windows of a bin whose core is met again make a block. Equal blocks settle their windows
    together; only lone blocks and the first of each kind of equal ones are taken apart, and their windows counted.
    """
    width = -(-(length - gram + 1) // BINS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                data, bounds = fl.flat(part.column("bytes"))
                if len(data) < length:
                    continue
                base, own = (np.asarray(part.column(c)).astype(np.int64) for c in ("base", "own"))
                total, down = _sums(data)
                start = np.arange(len(data) - length + 1)
                row = np.searchsorted(bounds, start, "right") - 1
                back = bounds[row] + own[row] - start  # bytes of the window before the anchor
                fits = (start + length <= bounds[row + 1]) & (back >= 0) & (back + gram <= length)
                fits &= np.asarray(part.column("bins"))[row] >> np.clip(back, 0, length - gram) // width & 1 == 1
                start, row, back = start[fits], row[fits], back[fits]
                if not len(start):
                    continue
                hashes = fl.mix((total[start + length] - total[start]) * down[start])
                edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (back[1:] // width != back[:-1] // width)))
                sizes = np.diff(np.append(edge, len(start)))
                begin, end = start[edge], start[edge] + sizes - 1 + length
                block = fl.mix((total[end] - total[begin]) * down[begin] + back[edge].astype(np.uint64) * fl.PLACES[0] + sizes.astype(np.uint64) * fl.PLACES[1])
                who = pa.array(row[edge])
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(start)).astype(np.int32)), pa.array(hashes.view(np.int64)))
                columns = [part.column("h").take(who), pa.array(block.view(np.int64)), part.column("key").take(who), pa.array((begin - bounds[row[edge]] + base[row[edge]]).astype(np.int32)), part.column("alone").take(who), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "block", "key", "start", "alone", "windows"])

    place = F.struct("key", "start")
    blocks = written(found.mapInArrow(cut, "h long, block long, key long, start int, alone boolean, windows array<long>"), "suffix-blocks")
    # equal windows have the same anchor, so 128 bits tell them apart: the anchor's hash and their own
    several = blocks.groupBy("h", "block").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").drop("most")
    judged = blocks.join(several, ["h", "block"], "left")
    later = F.coalesce(place > F.col("least"), F.lit(False))
    covered = judged.where(F.col("alone") & (later if first else F.col("least").isNotNull()))
    together = covered.select("key", "start", (F.col("start") + F.size("windows") - 1 + length).cast("int").alias("end"))

    each = judged.where(~later).select("h", "key", F.col("start").alias("from"), "alone", F.posexplode("windows").alias("nth", "w"))
    each = each.select("h", "w", "key", (F.col("from") + F.col("nth")).alias("start"), "alone")
    ends = each.groupBy("h", "w").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most")
    hit = each.where("alone").join(ends, ["h", "w"])
    hit = hit.where(place > F.col("least")) if first else hit
    islands = hit.select("key", "start").distinct().withColumn("run", F.col("start") - F.row_number().over(Window.partitionBy("key").orderBy("start")))
    return together.unionByName(islands.groupBy("key", "run").agg(F.min("start").alias("start"), (F.max("start") + length).cast("int").alias("end")).select("key", "start", "end"))


def repeats(docs: DataFrame, length: int = 200, gram: int = 50, keep: str = "none", most: int = 1024) -> DataFrame:
    """(key, spans) of bytes to remove from (key, text)."""
    if keep not in ("none", "first") or not 16 <= gram <= length // 2 * 2 or length < 32:
        raise ValueError("keep is 'none' or 'first', and 16 <= gram <= length")
    first = keep == "first"
    h, hc = Window.partitionBy("h"), Window.partitionBy("h", "c")
    place = F.struct("key", "pos")
    met = anchors(docs, length, gram).withColumn("n", F.count("*").over(h)).where("n > 1").drop("n")  # the shuffle by h serves all windows
    met = met.withColumn("same", F.min(place).over(hc) != F.max(place).over(hc)).withColumn("nth", F.row_number().over(hc.orderBy("key", "pos")))
    met = met.withColumn("kinds", F.sum((F.col("nth") == 1).cast("int")).over(h)).where("same OR kinds > 1")
    bins = F.lit(0)
    for i in range(BINS):  # equal windows of two kinds share the core of their bin; where no core is shared, there is nothing to match
        pair, core = F.col("near" if i < 2 else "far"), f"core{i}"
        met = met.withColumn(core, F.shiftrightunsigned(pair, 32) if i % 2 == 0 else pair.bitwiseAND(F.lit(0xFFFFFFFF)))
        shared = Window.partitionBy("h", core)
        met = met.withColumn(f"bin{i}", (F.col(core) != 0) & (F.min("c").over(shared) != F.max("c").over(shared)) & (F.lit(True) if first else ~F.min("same").over(shared)))
        bins = bins + F.col(f"bin{i}").cast("int") * (1 << i)
    met = met.select("h", "key", "pos", "same", "nth", bins.alias("bins"))
    met = met.withColumn("kinds", F.sum(((F.col("nth") == 1) & (F.col("bins") > 0)).cast("int")).over(h))
    met = written(met.where("same OR bins > 0"), "suffix-anchors")

    start, end = F.greatest(F.col("pos") - (length - gram), F.lit(0)).alias("start"), (F.col("pos") + length).alias("end")
    whole = met.where("nth > 1" if first else "same").select("key", start, end)
    wanted = met.where("bins > 0 AND nth = 1").select("key", "h", "pos", F.lit(True).alias("alone") if first else (~F.col("same")).alias("alone"), "bins", "kinds")
    spans = whole.unionByName(settled(contexts(docs, wanted.where(F.col("kinds") <= most), length, gram), length, first))
    if not wanted.where(F.col("kinds") > most).isEmpty():
        spans = spans.unionByName(counted(contexts(docs, wanted.where(F.col("kinds") > most), length, gram), length, gram, first))
    if not first:  # texts of several rows go whole
        spans = spans.unionByName(docs.groupBy("key").count().where("count > 1").select("key", F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end")))
    return spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, *, length: int = 200, gram: int = 50, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add kept (binary), n_bytes and removed (array of start, end in bytes, maximal runs) to the documents."""
    rest = docs.drop("kept", "n_bytes", "removed")
    key, spans = free_name(rest, "_key"), free_name(rest, "_spans")
    keyed = _numbered(rest, key, id_col, text_col) if keep == "first" else rest.withColumn(key, F.xxhash64(text_col))
    plain = keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    found = written(repeats(plain.where(F.octet_length("text") >= length), length, gram, keep), "suffix-spans").withColumnRenamed("key", key).withColumnRenamed("spans", spans)
    may_have = maybe_in(found.select(key), F.col(key))  # other texts keep all and are not moved
    joined = keyed.join(found, key, "left") if may_have is None else keyed.where(may_have).join(found, key, "left")
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    removed = "array<struct<start:bigint,end:bigint>>"
    out = joined.withColumns({"kept": F.lit(None).cast("binary"), "n_bytes": F.lit(None).cast("long"), "removed": F.lit(None).cast(removed)})
    text_at, spans_at, width = out.columns.index(_exact(out, text_col)), out.columns.index(spans), len(out.columns) - 3

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed = [], [], []
            for text, places in zip(batch.column(text_at), batch.column(spans_at).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs: list[list[int]] = []
                for x in places or ():
                    if runs and x["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], min(x["end"], len(raw)))
                    else:
                        runs.append([x["start"], min(x["end"], len(raw))])
                edges = [0, *(v for r in runs for v in r), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else raw)
                sizes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, arrow)], names=batch.schema.names)

    judged = out.mapInArrow(cut, out.schema).select(*rest.columns, "kept", "n_bytes", "removed")
    if may_have is None:
        return judged
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    whole = keyed.where(~may_have).select(*rest.columns, body.alias("kept"), F.octet_length(body).cast("long").alias("n_bytes"), F.array().cast(removed).alias("removed"))
    return judged.unionByName(whole)


def _numbered(docs: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """`docs` with an ascending number of its own for each row; stored once, as equal rows have no order that could be found again."""
    tie = free_name(docs, "_tie")
    ordered = docs.withColumn(tie, F.monotonically_increasing_id()).orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col), tie).drop(tie)
    return written(ordered.withColumn(key, F.monotonically_increasing_id()), "suffix-rows")


def _exact(df: DataFrame, name: str) -> str:
    return next(c for c in df.columns if c.lower() == name.lower())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
