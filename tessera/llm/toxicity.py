"""2. Toxicity with noisy-channel deobfuscation.

Tokens that look written to evade filters (signs for letters, stretched letters, letters
set apart) become character lattices. The distinct ones of the corpus are gathered, the n-grams
their lattices can spell are joined to a character language model counted over all documents (see
`ngrams`), and Viterbi search restores each token. A lexicon of word and word-start features,
weighted by their log odds in labelled documents, then scores the text together with its
restored tokens. The lexicon's bound on odds and the logistic function are fitted on a fifth
of the labelled rows that the odds are not counted on.

The lexicon is fitted on at most about `fit_rows` labelled rows, chosen by a hash of
the id; the language model's counts cover every document. Labels of held-out rows are
never read, and lang, source and doc_id are no inputs of a score.

Runs of one character count as three; a sign that ends a word is punctuation when it is `!` or
comes in threes; longer tokens are restored in overlapping pieces, so that no length is left out.

Defined results: a null or empty text has no feature and gets the lowest score; without
labels of both classes every score is that lowest one; a doc_id with labels that differ is
learned from as toxic; repeated rows are scored each; extra columns are carried along if named
in `carry`, and one that bears the name of the score is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat as fl
from . import ngrams
from .common import free_name, held_out, table, written
from .langid import LETTERS

FEATURES, CHUNKS = 1 << 20, 64
#: Letters that a sign can stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = " .-_*"
PLAIN = np.zeros(256, bool)
PLAIN[0x41:0x5B] = PLAIN[0x61:0x7B] = True
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in SIGNS]] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
APART = np.zeros(256, bool)
APART[[ord(c) for c in SEPARATORS]] = True
#: costs in nats: a sign for a letter, a sign for itself, a stretched letter, a kept separator
COST = {"sign": 1.0, "self": 4.0, "stretch": 0.5, "apart": 3.0}
PIECE, SHARED = 96, 48
_RUN = re.compile(r"(.)\1{2,}", re.S)
_LONG = re.compile(r"(.)\1{3,}", re.S)
_EDGE = re.compile(r"""^(?:[.,;:?"'()\[\]#%&*!]|([$@|+-])\1{2,})+|(?:[.,;:?"'()\[\]#%&*!]|([$@|+-])\2{2,})+$""")
_SPOKEN = re.compile(r"[^\W\d_]|[@$|+!]{2}")


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place what it can stand for, and at what cost."""
    spaced = sum(c in SEPARATORS for c in token) * 2 >= len(token) - 1
    places: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c, run = token[at], _RUN.match(token, at)
        if spaced and c in SEPARATORS:
            places.append([("", 0.1), (" ", COST["apart"])])
        elif run and (c.isalpha() or c in SIGNS):
            letters = [c] if c.isalpha() else list(SIGNS[c])
            options = [(x * n, COST["stretch"] + COST["sign"] * (x != c)) for x in letters for n in (1, 2)]
            places.append([*options, (run[0], COST["self"])])
            at = run.end() - 1
        elif c in SIGNS:
            places.append([*((x, COST["sign"]) for x in SIGNS[c]), (c, COST["self"])])
        else:
            places.append([(c, 0.0)])
        at += 1
    return [*places, [(" ", 0.0)]]


_START = ngrams.PAD * (ngrams.ORDER - 2) + " "


def spelt(token: str) -> list[str]:
    """The n-grams of all paths through a token's lattice."""
    states, found = {_START}, set()
    for place in lattice(token):
        after = set()
        for state in states:
            for option, _ in place:
                now = state
                for c in option:
                    found.add(now + c)
                    now = now[1:] + c
                after.add(now)
        states = after
    return sorted(found)


def likeliest(token: str, nats: dict[str, float]) -> str:
    """The likeliest reading of a token, by Viterbi search over the states before each place."""
    paths: dict[str, tuple[float, str]] = {_START: (0.0, "")}
    for place in lattice(token):
        new: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in paths.items():
            for option, more in place:
                now, reached = state, cost + more
                for c in option:
                    reached += nats[now + c]
                    now = now[1:] + c
                if now not in new or (reached, text + option) < new[now]:
                    new[now] = (reached, text + option)
        paths = new
    return min(paths.values())[1].strip()


def _pieces(raw: str) -> list[str]:
    """A token in the form in which it is restored: lower case, runs of three at most, without what ends a word; in overlapping pieces if it is long."""
    token = _LONG.sub(r"\1\1\1", _EDGE.sub("", raw.lower()).strip())
    if not _SPOKEN.search(token):
        return []
    return [token[at : at + PIECE] for at in range(0, max(1, len(token) - SHARED), PIECE - SHARED)]


def suspects(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, str]]:
    """(row, piece) of tokens that may be obfuscated: a sign beside a letter or beside another sign, a letter three times, letters set apart."""
    starts, ends, at = fl.words(data, bounds, fl.NOT_SPACE)
    if not len(starts):
        return []
    letter, sign = PLAIN[data] | (data >= 0x80), SIGN[data]
    mark = sign & ~DIGIT[data]
    hit = np.zeros(len(data), bool)
    hit[:-1] |= sign[:-1] & letter[1:] | mark[:-1] & mark[1:] & (data[:-1] != data[1:]) | mark[:-1] & mark[1:] & np.append(letter[0], letter[:-1])[: len(data) - 1]
    hit[1:] |= sign[1:] & letter[:-1] & ((data[1:] != 0x21) | np.append(letter[2:] | sign[2:], False))
    hit[:-2] |= PLAIN[data[:-2]] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:])
    two = (data[:-5] >= 0xC0) & (data[:-5] < 0xE0)  # letters of two bytes
    hit[:-5] |= two & (data[:-5] == data[2:-3]) & (data[2:-3] == data[4:-1]) & (data[1:-4] == data[3:-2]) & (data[3:-2] == data[5:])
    one, gap = PLAIN[data] | sign, APART[data] & (data != 0x20)
    hit[:-4] |= one[:-4] & gap[1:-3] & one[2:-2] & gap[3:-1] & one[4:]
    owners = np.unique(np.searchsorted(starts, np.flatnonzero(hit), "right") - 1)
    owners = owners[owners >= 0]
    spans = [(int(starts[i]), int(ends[i])) for i in owners[np.flatnonzero(np.add.reduceat(letter | mark, starts)[owners])]] if len(owners) else []
    single = (ends - starts == 1) & one[starts] | (ends - starts == 2) & (data[starts] >= 0xC0)
    joined = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (data[ends[:-1]] == 0x20)
    joined[at[(at > 0) & (at < len(starts))] - 1] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
    spans += [(int(starts[a]), int(ends[b])) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= 2]
    rows = (np.searchsorted(bounds, [s for s, _ in spans], "right") - 1).tolist()
    return [(row, piece) for row, (s, e) in zip(rows, spans) for piece in _pieces(data[s:e].tobytes().decode("utf-8", "replace"))]


def _tokens(column: pa.Array) -> pa.Array:
    """The distinct suspect pieces of each text."""
    data, bounds = fl.flat(column)
    found: list[set[str]] = [set() for _ in range(len(column))]
    for low, high in fl.pieces(bounds):
        for row, piece in suspects(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]):
            found[low + row].add(piece)
    return pa.array([sorted(x) for x in found], pa.list_(pa.string()))


def language_model(docs: DataFrame, text_col: str = "text") -> ngrams.Levels:
    """The character model, counted over all whole texts."""
    return ngrams.fit(written(ngrams.count_grams(docs, F.lit(""), F.col(text_col)), "toxicity-counts"))


def restored(docs: DataFrame, model: ngrams.Levels, text_col: str = "text") -> DataFrame:
    """(token, reading) of the distinct suspect tokens of all documents."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_tokens(batch.column(0)).flatten().unique()], names=["token"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                tokens = batch.column(0).slice(low, 500)
                yield pa.RecordBatch.from_arrays([tokens, pa.array([spelt(t) for t in tokens.to_pylist()], pa.list_(pa.string()))], names=["token", "grams"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readings = [likeliest(t, {x["g"]: x["nats"] for x in known}) for t, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(readings, pa.string())], names=["token", "reading"])

    tokens = written(docs.select(text_col).mapInArrow(gather, "token string").distinct(), "toxicity-tokens")
    grams = written(tokens.repartition("token").mapInArrow(spell, "token string, grams array<string>").select("token", F.explode("grams").alias("g")), "toxicity-grams")
    valued = written(model.values(grams.select(F.lit("").alias("lang"), "g").distinct()), "toxicity-nats")
    lattices = grams.join(valued, "g").groupBy("token").agg(F.collect_list(F.struct("g", "nats")).alias("known"))
    return written(lattices.mapInArrow(decode, "token string, reading string"), "toxicity-readings")


def _features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all words and their rows: the word, and its first 3 to 6 bytes."""
    low = fl.LOWER[data]
    starts, ends, at = fl.words(low, bounds, LETTERS)
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    found, rows = [], []
    hashes = fl.many_span_hashes(low, starts, [ends, *(np.minimum(starts + k, ends) for k in range(3, 7))])
    for k, h in enumerate(hashes):
        some = slice(None) if k == 0 else ends - starts >= k + 2
        found.append((fl.mix(h[some] + np.uint64(k)) >> np.uint64(44)).astype(np.int64))
        rows.append(own[some])
    return np.concatenate(found), np.concatenate(rows)


@dataclass
class Lexicon:
    """Weights of FEATURES buckets and the logistic function of their sum."""

    weights: np.ndarray
    middle: float = 7.0
    slope: float = 0.7


def lexicon(docs: DataFrame, labels: DataFrame, readings: DataFrame, *, fit_rows: int = 200_000, bounds: Sequence[float] = (1.5, 2.0, 2.5, 3.0), id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Weights: log odds of a feature in toxic documents where it is well attested and at or over one of `bounds`, else 0."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    share = min(1.0, fit_rows / max(total, 1))
    sample = known.where(F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))  # about fit_rows rows at most
    sample = sample.withColumn("fifth", F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(5)) == 0)
    rows = written(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).select(F.monotonically_increasing_id().alias("row"), "toxic", "fifth", "text"), "toxicity-labelled")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _tokens(batch.column(1))], names=["row", "tokens"])

    told = rows.select("row", "text").mapInArrow(tell, "row long, tokens array<string>").select("row", F.explode("tokens").alias("token"))
    read = told.join(readings, "token").groupBy("row").agg(F.array_join(F.collect_list("reading"), " ").alias("reading"))
    rows = written(rows.join(read, "row", "left").select("toxic", "fifth", "text", "reading"), "toxicity-learned")

    def found(batch: pa.RecordBatch, low: int, high: int, flats: list) -> np.ndarray:
        """Distinct features of rows, the row in the upper bits."""
        parts = [_features(data[at[low] : at[high]], at[low : high + 1] - at[low]) for data, at in flats]
        return np.unique(np.concatenate([own << 20 | bucket for bucket, own in parts]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, of = np.zeros(2 * FEATURES, np.int32), np.zeros(2, np.int64)
        for batch in batches:
            toxic = (batch.column(0).to_numpy() == 1).astype(np.int64)
            flats = [fl.flat(batch.column(1)), fl.flat(batch.column(2))]
            of += np.bincount(toxic, minlength=2)
            for low, high in fl.pieces(flats[0][1], 1 << 20):
                once = found(batch, low, high, flats)
                seen += np.bincount((once & FEATURES - 1) | toxic[low:high][once >> 20] << 20, minlength=2 * FEATURES).astype(np.int32)
        size = 2 * FEATURES // CHUNKS
        parts = [(c, seen[c * size : (c + 1) * size]) for c in range(CHUNKS)]
        parts = [(c, x) for c, x in parts if x.any()] + ([(-1, of.astype(np.int32))] if of.any() else [])
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["chunk", "n"])

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(n.as_buffer(), np.int32).astype(np.int64)
                held[c] = held[c] + x if c in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "n"])

    schema = "chunk int, n binary"
    counted = rows.where("NOT fifth").select("toxic", "text", "reading").mapInArrow(count, schema)
    sums = counted.repartition(CHUNKS + 1, "chunk").mapInArrow(total_up, schema).toArrow()  # 2 * FEATURES numbers
    size = 2 * FEATURES // CHUNKS
    n, of = np.zeros(2 * FEATURES, np.int64), np.zeros(2, np.int64)
    for c, x in zip(sums["chunk"].to_pylist(), sums["n"].to_pylist()):
        values = np.frombuffer(x, np.int64)
        if c < 0:
            of = values
        else:
            n[c * size : (c + 1) * size] = values
    if not of.all():
        return Lexicon(np.zeros(FEATURES, np.float32))
    clean, toxic = n[:FEATURES], n[FEATURES:]
    odds = np.log((toxic + 0.5) / (of[1] + 1)) - np.log((clean + 0.5) / (of[0] + 1))
    attested = toxic >= max(4, 0.003 * of[1])
    weights = [np.where(attested & (odds >= b), np.minimum(odds, 6.0), 0).astype(np.float32) for b in bounds]
    shared = spark.sparkContext.broadcast(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats = [fl.flat(batch.column(1)), fl.flat(batch.column(2))]
            out = np.zeros((batch.num_rows, len(bounds)))
            for low, high in fl.pieces(flats[0][1], 1 << 20):
                once = found(batch, low, high, flats)
                for i, w in enumerate(shared.value):
                    out[low:high, i] = np.bincount(once >> 20, weights=w[once & FEATURES - 1], minlength=high - low)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["toxic", "sums"])

    fifth = rows.where("fifth").select("toxic", "text", "reading").mapInArrow(weigh, "toxic int, sums array<double>").toArrow()  # at most about fit_rows / 5 rows
    y = fifth["toxic"].to_numpy() == 1
    if not y.any() or y.all():
        return Lexicon(weights[min(2, len(bounds) - 1)])
    x = np.array(fifth["sums"].to_pylist(), float)
    fits = [_logistic(x[:, i], y) for i in range(len(bounds))]
    best = min(range(len(bounds)), key=lambda i: fits[i][0])
    return Lexicon(weights[best], *fits[best][1:])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """(loss, middle, slope) of the logistic function of x fitted to y by Newton's method; a little ridge keeps separable classes finite."""
    a, b = np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.0])
    features = np.stack([np.ones(len(x)), x], 1)
    theta = np.array([a, b])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        gradient = features.T @ (p - y) + ridge * theta
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(2), gradient)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(features @ theta, -30, 30))), 1e-9, 1 - 1e-9)
    loss = float(-np.where(y, np.log(p), np.log(1 - p)).mean())
    slope = max(float(theta[1]), 1e-3)
    return loss, float(-theta[0] / slope), slope


def score(docs: DataFrame, learned: Lexicon, readings: DataFrame, *, carry: Sequence[str] = ("doc_id",), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`carry` columns and `score_col` (0 to 1): a logistic function of the summed weights of a text's distinct features, those of its restored tokens included."""
    source = docs.select(*(c for c in carry if c.lower() != score_col.lower()), F.col(text_col))
    kept = source.columns[:-1]
    own = [free_name(source, f"_{x}") for x in ("row", "hits", "tokens", "more")]
    row, hits, tokens, more = own
    shared = docs.sparkSession.sparkContext.broadcast(learned.weights)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"{hits} array<int>", f"{tokens} array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = fl.flat(batch.column(len(kept)))
            lists = [_hits(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], shared.value) for low, high in fl.pieces(bounds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array([x for part in lists for x in part], pa.list_(pa.int32())), _tokens(batch.column(len(kept)))], names=[*kept, hits, tokens])

    def of_readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hits(*fl.flat(batch.column(1)), shared.value), pa.list_(pa.int32()))], names=["token", "hits"])

    parts = written(source.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "toxicity-parts")
    telling = written(readings.select("token", "reading").mapInArrow(of_readings, "token string, hits array<int>").where(F.size("hits") > 0), "toxicity-telling")
    extra = parts.select(row, F.explode(tokens).alias("token")).join(telling, "token").groupBy(row).agg(F.flatten(F.collect_list("hits")).alias(more))
    both = parts.join(extra, row, "left")

    def logistic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            sums = [float(weights[list({*a, *(b or ())})].sum()) if a or b else 0.0 for a, b in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())]
            values = 1 / (1 + np.exp(-learned.slope * (np.array(sums, float) - learned.middle)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(values)], names=[*kept, score_col])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{score_col}` double"])
    return both.select(*kept, hits, more).mapInArrow(logistic, out)


def _hits(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> list[list[int]]:
    """The distinct features of each row that have a weight."""
    found, own = _features(data, bounds)
    hit = weights[found] > 0
    once = np.unique(own[hit] << 20 | found[hit])
    cuts = np.searchsorted(once >> 20, np.arange(1, len(bounds) - 1))
    return [x.tolist() for x in np.split((once & FEATURES - 1).astype(np.int32), cuts)] if len(bounds) > 1 else []


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    readings = restored(docs, language_model(docs))
    scored = score(docs, lexicon(docs, labels, readings), readings)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
