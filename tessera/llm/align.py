"""11. Cross-tokenizer alignment: where the tokens of two tokenizers meet, and which of their ids go together.

The texts of an Arrow batch are one buffer of bytes with document offsets. The byte ends of
all A and all B tokens are counted once over that buffer (`bincount`); it is cut where both
have one. Groups, links and pairs of ids are then numbers of whole arrays, and segmented
prefix sums give each document its own. A pass over the documents writes their pairs of ids,
one binary value a document; the pairs are counted over the corpus, pre-aggregated in each task;
a second pass over the pairs rates every document's links. The commonest pairs (`max_rows` at most)
are broadcast in sorted arrays and found by binary search, all rarer ones are joined, so that no join
has a hot key.

Both tokenizers work on segments that start with a space behind something else. No token of
either crosses such a place (checked for B's vocabulary when it is read), so a segment has the
same tokens wherever it stands, and known segments come from a bounded cache.

Defined results: null and empty texts, and texts whose tokens do not spell space+text in A or in B (such as
those with U+2581), have no tokens, zeros and no groups; strings of special tokens are plain text; every row is a
document of its own, repeated rows and null ids included; extra columns are not carried unless named in `carry`; one
that bears the name of the result column is replaced. A document's distinct pairs are held by one task, its links never all at once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat as fl
from .bpe import PATTERN, Vocabulary, default_tokenizer
from .common import table, written

#: Links that are made at once; a group with more is counted by its distinct ids.
_LINKS = 1 << 20
#: A space with what stands up to the next space that follows no white space.
_SEGMENT = r" \s*\S*(?:[^\S ]\s*\S*)*"
#: Segments, and characters of them, that a task knows before it starts anew.
_CACHED, _CHARACTERS = 300_000, 8_000_000
_PAIRS = "pairs binary, times binary"
_SUMS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


@dataclass
class Aligner:
    """Two tokenizers with the bytes of their entries; of the size of their vocabularies."""

    a: Vocabulary
    model: bytes
    b_pieces: list[bytes] = field(default_factory=list)
    cuts: bool = True

    @classmethod
    def read(cls, tokenizer_a: str, tokenizer_b: str) -> Aligner:
        import regex

        a = Vocabulary.read(tokenizer_a)
        a.special = {}
        with open(tokenizer_b, "rb") as f:
            out = cls(a, f.read())
        b = out.processor()
        shown = [b.id_to_piece(i) for i in range(len(b))]
        plain = [not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i)) for i in range(len(b))]
        out.b_pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        # a piece that goes on with a space, or a model that changes a text before it is cut: whole texts are segments then
        odd = "x  y ÄÄﬁ  \t\n"
        as_is = b"".join(out.b_pieces[i] for i in b.encode(odd)) == b" " + odd.encode()
        out.cuts = as_is and "▁" in shown and not any(ok and regex.search(r"[^\s▁]▁", p) for p, ok in zip(shown, plain))
        return out

    def processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)


class _Worker:
    """One task's tokenizers, cache of segments and tables of entries."""

    def __init__(self, aligner: Aligner):
        import regex

        self.of, self.b = aligner, aligner.processor()
        self.pattern, self.segment = regex.compile(PATTERN), regex.compile(_SEGMENT)
        self.space = [self.b.piece_to_id("▁")]  # of a last space that stands alone: the model adds none to an empty text
        self.entries = [_Entries([p or b"" for p in aligner.a.pieces]), _Entries(aligner.b_pieces)]
        self.pairs = len(aligner.a.pieces) * len(aligner.b_pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # number of each segment
        self.words: dict[str, np.ndarray] = {}
        self.held = [(np.zeros(1, np.int64), np.zeros(0, np.int64)) for _ in range(2)]  # bounds of the segments' ids, ids
        self.size = 0

    def _learn(self, new: list[str]) -> None:
        """Tokens of new segments, by one call of either tokenizer for all of them."""
        parts = [self.pattern.findall(s) for s in new]
        words = list({w for part in parts for w in part if w not in self.words})
        self.words.update(zip(words, self.of.a.merge([w.encode() for w in words])))
        ids = [self.words[w] for part in parts for w in part]
        at = np.append(0, np.cumsum([len(x) for x in ids]))[np.append(0, np.cumsum([len(p) for p in parts]))]
        rows = [x or self.space for x in self.b.encode([s[1:] for s in new], num_threads=1)]
        sizes = np.array([len(x) for x in rows], np.int64)
        made = [(np.diff(at), np.concatenate(ids)), (sizes, np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(sizes.sum())))]
        self.held = [(np.append(bounds, bounds[-1] + np.cumsum(n)), np.append(flat, more)) for (bounds, flat), (n, more) in zip(self.held, made)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.size += sum(map(len, new))

    def tokens(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of all texts, and how many each has, for A and for B."""
        rows = [([] if not t else self.segment.findall(" " + t) if self.of.cuts else [" " + t]) for t in texts]
        segments = list(itertools.chain.from_iterable(rows))
        if len(self.known) > _CACHED or self.size > _CHARACTERS:
            self._forget()
        if new := [s for s in dict.fromkeys(segments) if s not in self.known]:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
        at = np.append(0, np.cumsum([len(row) for row in rows]))
        out = []
        for bounds, flat in self.held:
            n = np.diff(bounds)[place]
            upto = np.append(0, np.cumsum(n))
            out.append((flat[np.repeat(bounds[place] - upto[:-1], n) + np.arange(upto[-1])], np.diff(upto[at])))
        return out

    def rows(self, texts: Sequence[str], data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text. `data` holds the bytes of space+text of all."""
        (a, n_a), (b, n_b) = self.tokens(texts)
        ok = (n_a > 0) & (n_b > 0)
        for ids, n, side in ((a, n_a, 0), (b, n_b, 1)):
            ok &= self.entries[side].spells(ids, n, data, sizes)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b, sizes = np.where(ok, n_a, 0), np.where(ok, n_b, 0), np.where(ok, sizes, 0)
        total = int(sizes.sum())
        ends = [np.cumsum(self.entries[0].sizes[a]), np.cumsum(self.entries[1].sizes[b])]
        both = (np.bincount(ends[0], minlength=total + 1) > 0) & (np.bincount(ends[1], minlength=total + 1) > 0)
        cuts = np.flatnonzero(both)
        upto = np.cumsum(both)
        of_group = [upto[e - 1] for e in ends]
        in_a, in_b = (np.bincount(g, minlength=len(cuts)) for g in of_group)
        group_at = np.append(0, np.searchsorted(cuts, np.cumsum(sizes), "right"))
        linked = np.append(0, np.cumsum(in_a * in_b))
        digests = self._digests(a, b, of_group, in_a, in_b, n_a, n_b, group_at)
        pairs, times, pair_at = self._pairs(a, b, in_a, in_b, group_at)
        kind = "<u4" if self.pairs < 1 << 32 else "<u8"
        for d in range(len(texts)):
            low, high = pair_at[d], pair_at[d + 1]
            links = int(linked[group_at[d + 1]] - linked[group_at[d]])
            yield int(n_a[d]), int(n_b[d]), int(group_at[d + 1] - group_at[d]), links, digests[d], pairs[low:high].astype(kind).tobytes(), times[low:high].astype("<u4").tobytes()

    def _digests(self, a, b, of_group, in_a, in_b, n_a, n_b, group_at) -> list[str]:
        """Digests of the groups as text: each id is a row of digits and a mark behind it, and the rows are put in order at once."""
        before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        shown = np.zeros((len(a) + len(b), max(e.digits.shape[1] for e in self.entries) + 1), np.uint8)
        for side, (ids, place, last, mark) in enumerate(((a, np.arange(len(a)) + before_b[of_group[0]], np.cumsum(in_a) - 1, b"|"), (b, np.arange(len(b)) + upto_a[of_group[1]], np.cumsum(in_b) - 1, b";"))):
            digits, marks = self.entries[side].digits, np.full(len(ids), ord(","), np.uint8)
            marks[last] = ord(mark)
            if side:
                marks[last[group_at[1:][group_at[1:] > group_at[:-1]] - 1]] = 0
            shown[place, -1 - digits.shape[1] : -1], shown[place, -1] = digits[ids], marks
        used = shown != 0
        at = np.append(0, np.cumsum(n_a + n_b))
        bytes_at = np.append(0, np.cumsum(used.sum(1)))[at]
        whole = shown[used].tobytes()
        return [hashlib.sha256(whole[s:e]).hexdigest() if e > s else "" for s, e in zip(bytes_at[:-1].tolist(), bytes_at[1:].tolist())]

    def _pairs(self, a, b, in_a, in_b, group_at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of ids of each document, sorted, how often each is linked, and each document's bounds among them."""
        width, links = len(self.of.b_pieces), in_a * in_b
        first_a, first_b, at = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, np.append(0, np.cumsum(links))
        doc = np.repeat(np.arange(len(group_at) - 1), np.diff(group_at))
        docs, keys, times = [], [], []

        def add(d: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
            order = np.lexsort((key, d))
            d, key, n = d[order], key[order], n[order]
            new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            docs.append(d[new])
            keys.append(key[new])
            times.append(np.add.reduceat(n, new) if len(new) else n)

        g = 0
        while g < len(links):
            stop = max(g + 1, int(np.searchsorted(at, at[g] + _LINKS, "right")) - 1)
            if links[g] > _LINKS:  # one group with many links: its distinct ids, some of A's at a time
                left, n_left = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
                right, n_right = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
                step = max(1, _LINKS // len(right))
                for i in range(0, len(left), step):
                    key = (left[i : i + step, None] * width + right).ravel()
                    add(np.full(len(key), doc[g]), key, (n_left[i : i + step, None] * n_right).ravel())
                stop = g + 1
            else:
                of = np.repeat(np.arange(g, stop), links[g:stop])
                within = np.arange(len(of)) - (at[of] - at[g])
                key = a[first_a[of] + within // in_b[of]] * width + b[first_b[of] + within % in_b[of]]
                add(doc[of], key, np.ones(len(of), np.int64))
            g = stop
        if len(docs) > 1:
            parts = [np.concatenate(x) for x in (docs, keys, times)]
            for x in (docs, keys, times):
                x.clear()
            add(*parts)
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(group_at), np.int64)
        return keys[0], times[0], np.searchsorted(docs[0], np.arange(len(group_at)))


class _Entries:
    """Bytes, sizes and decimal digits of a vocabulary's ids."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        width = len(str(len(pieces)))
        self.digits = np.frombuffer("".join(str(i).rjust(width, "\0") for i in range(len(pieces))).encode(), np.uint8).reshape(-1, width)

    def spells(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each document: do its ids' bytes make its part of `data`?"""
        size = self.sizes[ids]
        token_at = np.append(0, np.cumsum(counts))
        byte_at = np.append(0, np.cumsum(size))
        ok = byte_at[token_at[1:]] - byte_at[token_at[:-1]] == sizes
        mine = np.repeat(ok, counts)
        ids, size = ids[mine], size[mine]
        made = self.bytes[np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        wrong = np.append(0, np.cumsum(made != data[np.repeat(ok, sizes)]))
        at = np.append(0, np.cumsum(np.where(ok, sizes, 0)))
        return ok & (wrong[at[1:]] == wrong[at[:-1]])


def pairs(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row a document, written to the shared folder: `carry`, the columns of its alignment, and its distinct pairs of ids.

    `pairs` are little-endian numbers a * (ids of B) + b, sorted; `times` says how often the document links each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Aligner.read(tokenizer_a, tokenizer_b))
    source = docs.select((F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))).alias("carried"), F.col(text_col).alias("text"))
    kept = source.select("carried").schema.fields[0].dataType.simpleString()
    arrow = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(shared.value)
        for batch in batches:
            raw, bounds = fl.flat(batch.column(1))
            for low, high in fl.pieces(bounds):
                texts = [raw[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(bounds[low:high].tolist(), bounds[low + 1 : high + 1].tolist())]
                spaced = [b" " + t.encode() for t in texts]
                data, sizes = np.frombuffer(b"".join(spaced), np.uint8), np.array([len(x) for x in spaced], np.int64)
                columns = [list(c) for c in zip(*worker.rows(texts, data, sizes))]
                made = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *made], names=["carried", *arrow.names])

    made = source.mapInArrow(run, f"carried {kept}, {_SUMS}, {_PAIRS}")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "align-pairs")


def _numbers(values: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of binary values, and each row's bounds among them."""
    data, bounds = fl.flat(values)
    width = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), bounds // width


def pair_counts(made: DataFrame, width: int, kind: str, most: int = 1 << 20) -> DataFrame:
    """(pair, a, b, n, best): how many documents link each pair of ids, and whether no pair of that A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more, n = np.unique(_numbers(batch.column(0), kind)[0], return_counts=True)
            both, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
            keys, counts = both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
            if len(keys) > most:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    counted = written(made.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    counted = counted.select("pair", F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n")
    highest = counted.groupBy("a").agg(F.max("n").alias("top"))  # a row an id of A at most
    return counted.join(F.broadcast(highest), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _commonest(counts: DataFrame, most: int) -> int:
    """The least n, of a geometric row of them, that `most` pairs or fewer reach; 0 if that are all pairs."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # a few hundred rows
    total, least = 0, None
    for s in steps:
        total += s.pairs
        if total > most:
            return least if least is not None else 1 << 62
        least = s.least
    return 0


def rated(made: DataFrame, counts: DataFrame, kind: str, max_rows: int = 1 << 20) -> DataFrame:
    """(row, carried, sums of `pairs`, n_best, count_sum): every document's links under the corpus-wide counts of their pairs."""
    counts = written(counts, "align-rated")
    least = _commonest(counts, max_rows)
    head = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow()  # max_rows rows at most
    order = np.argsort(head["pair"].to_numpy())
    shared = made.sparkSession.sparkContext.broadcast([head[c].to_numpy()[order] for c in ("pair", "n", "best")])

    def look(batch: pa.RecordBatch) -> tuple:
        keys, bounds = _numbers(batch.column(1), kind)
        times, _ = _numbers(batch.column(2), "<u4")
        pair, n, best = shared.value
        place = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
        there = pair[place] == keys if len(pair) else np.zeros(len(keys), bool)
        return keys, bounds, times, place, there, n, best

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, bounds, times, place, there, n, best = look(batch)
            summed = np.append(0, np.cumsum(np.where(there, times * (n[place] if len(n) else 0), 0)))
            top = np.append(0, np.cumsum(np.where(there, times * (best[place] if len(n) else 0), 0)))
            sums = [pa.array(x[bounds[1:]] - x[bounds[:-1]]) for x in (top, summed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], *sums], names=["row", *batch.schema.names[3:], "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bounds, times, _, there, _, _ = look(batch)
            rows = np.repeat(np.asarray(batch.column(0)), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(rows[~there]), pa.array(keys[~there]), pa.array(times[~there])], names=["row", "pair", "times"])

    kept = made.drop("pairs", "times", "row")
    shown = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    scored = made.select("row", "pairs", "times", *kept.columns).mapInArrow(score, f"row long, {shown}, n_best long, count_sum long")
    if not least:
        return scored
    rare = made.select("row", "pairs", "times").mapInArrow(rest, "row long, pair long, times long").join(counts.where(F.col("n") < least), "pair")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = scored.join(more, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("more_best", "more_sum")


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, text_col: str = "text", carry: Sequence[str] = ("doc_id",), result_col: str = "alignment", max_rows: int = 1 << 20) -> DataFrame:
    """`carry` with `result_col`: struct of n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    made = pairs(docs, tokenizer_a, tokenizer_b, text_col=text_col, carry=carry)
    width, kind = _sizes(tokenizer_a, tokenizer_b)
    out = rated(made, pair_counts(made, width, kind), kind, max_rows)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(*(F.col(f"carried.`{c}`").alias(c) for c in carry if c.lower() != result_col.lower()), F.struct(*names).alias(result_col))


def best_partners(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, text_col: str = "text") -> DataFrame:
    """(a, b, n): for each id of A in the corpus, the ids of B that it is linked with in most documents; ties stay."""
    made = pairs(docs, tokenizer_a, tokenizer_b, text_col=text_col, carry=())
    return pair_counts(made, *_sizes(tokenizer_a, tokenizer_b)).where("best").select("a", "b", "n")


def _sizes(tokenizer_a: str, tokenizer_b: str) -> tuple[int, str]:
    aligner = Aligner.read(tokenizer_a, tokenizer_b)
    width = len(aligner.b_pieces)
    return width, "<u4" if len(aligner.a.pieces) * width < 1 << 32 else "<u8"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return default_tokenizer(), str(public_tokenizers.path("piece_bpe_32k.model"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_tokenizers()).select("doc_id", "alignment.*")
