"""4. BPE encoding and decoding.

Byte-level BPE in batched numpy merge rounds: the symbols of all new words of a
batch stand in one flat array; each round looks all neighbouring pairs up by binary
search over the sorted pair keys, takes every word's lowest rank and merges all its
occurrences at once, until no word has a pair left. In long words, every pair that is the lowest
as far around as a token can reach is merged in the same round: what happens farther away cannot
reach it first. Words seen before come from a
bounded cache. Ids and texts are made row by row, without a shuffle.

Defined results: null and empty texts give no ids and decode to the empty text;
invalid UTF-8 is read with replacement characters, as it is decoded; the strings of
added special tokens become their ids; ids that the vocabulary lacks decode to nothing;
repeated rows get equal results; extra columns are carried along, and one that bears the
name of a result column is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat as fl
from .common import table

#: Fixed value: the published split pattern of this kind of byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in printable else chr(256 + next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of one tokenizer file; small (as the vocabulary), so it is broadcast."""

    first: np.ndarray  # id of each byte
    keys: np.ndarray  # left id * size + right id, sorted
    ranks: np.ndarray
    merged: np.ndarray
    size: int
    pieces: list[bytes | None]
    special: dict[str, int]
    longest: np.ndarray  # bytes of the longest token with each byte: pairs farther apart cannot meet before they are merged
    cache: dict[str, bytes] = field(default_factory=dict)
    flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # bytes, starts and sizes of the pieces, made where ids are decoded

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file.get("normalizer") or file["pre_tokenizer"].get("type") != "ByteLevel" or file["pre_tokenizer"].get("add_prefix_space") or file["model"]["type"] != "BPE" or file["model"].get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        vocab, alphabet = file["model"]["vocab"], byte_alphabet()
        special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        bytes_of = {c: b for b, c in enumerate(alphabet)}
        pieces: list[bytes | None] = [None] * size
        for token, i in vocab.items():
            pieces[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        for token, i in special.items():
            pieces[i] = token.encode()
        longest = np.ones(256, np.int64)
        for i in vocab.values():
            inside = np.frombuffer(pieces[i], np.uint8)
            longest[inside] = np.maximum(longest[inside], len(inside))
        return cls(np.array([vocab[c] for c in alphabet], np.int32), keys[order], np.arange(len(pairs), dtype=np.int32)[order], np.array([vocab[a + b] for a, b in pairs], np.int32)[order], size, pieces, special, longest)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by merge rounds over all words together."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        reach = int(self.longest[np.frombuffer(b"".join(w for w in words if len(w) > 128), np.uint8)].max(initial=1))
        while len(symbols):
            same = owner[1:] == owner[:-1]
            keys = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = same & (self.keys[place] == keys)
            rank = np.append(np.where(found, self.ranks[place], _NONE), np.int32(_NONE))
            starts = np.flatnonzero(np.append(True, ~same))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            done = lowest == _NONE
            if done.any():
                for w, s, n in zip(owner[starts[done]].tolist(), starts[done].tolist(), lengths[done].tolist()):
                    out[w] = symbols[s : s + n]
                going = np.repeat(~done, lengths)
                if not going.any():
                    break
            else:
                going = np.ones(len(symbols), bool)
            hit = going & (rank == np.repeat(lowest, lengths))
            if lengths.max() > max(128, 4 * reach):  # long words: also what is lowest as far as any merge can reach
                hit |= going & (rank < _NONE) & (rank == _lowest_near(rank, reach))
                run = np.cumsum(np.append(True, (rank[1:] != rank[:-1]) | ~same))  # pairs of one rank in a row count from the first
                hit &= hit[np.append(True, run[1:] != run[:-1])][run - 1]
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))  # "aaa" has overlapping pairs: every other one counts
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.merged[place[at]]
            going[at + 1] = False
            symbols, owner = symbols[going], owner[going]
        return out

    def encode(self, texts: list[str], pattern, limit: int = 300_000) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        rows = [[pattern.findall(part) for part in self._split(text)] for text in texts]
        new = list({w for row in rows for part in row for w in part if w not in self.cache})
        if len(self.cache) + len(new) > limit:
            self.cache.clear()
            new = list({w for row in rows for part in row for w in part})
        for word, ids in zip(new, self.merge([w.encode() for w in new])):
            self.cache[word] = ids.astype("<u4").tobytes()
        get = self.cache.__getitem__
        out = []
        for text, row in zip(texts, rows):
            parts = [b"".join(map(get, part)) for part in row]
            if len(parts) > 1:
                marks = [np.array([i], "<u4").tobytes() for i in self._marks(text)]
                parts = [x for pair in zip(parts, [*marks, b""]) for x in pair]
            out.append(b"".join(parts))
        return out

    def _specials(self):
        import regex

        return regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def _split(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return [text]
        return self._specials().split(text)

    def _marks(self, text: str) -> list[int]:
        return [self.special[m] for m in self._specials().findall(text)]

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, rows: list[bytes]) -> list[str]:
        """The texts of lists of ids; the bytes of all pieces are gathered at once."""
        if self.flat is None:
            whole = [*(p or b"" for p in self.pieces), b""]  # the last stands for ids beyond the vocabulary
            sizes = np.array([len(p) for p in whole], np.int64)
            self.flat = np.frombuffer(b"".join(whole), np.uint8), np.cumsum(sizes) - sizes, sizes
        data, starts, sizes = self.flat
        ids = np.minimum(np.frombuffer(b"".join(rows), "<u4").astype(np.int64), self.size)
        upto = np.append(0, np.cumsum(sizes[ids]))
        made = data[np.repeat(starts[ids] - upto[:-1], sizes[ids]) + np.arange(upto[-1])].tobytes()
        at = upto[np.append(0, np.cumsum([len(r) // 4 for r in rows]))].tolist()
        return [made[s:e].decode("utf-8", "replace") for s, e in zip(at[:-1], at[1:])]


def _lowest_near(rank: np.ndarray, reach: int) -> np.ndarray:
    """The lowest rank within `reach` places of each."""
    width, edge = 2 * reach + 1, np.full(reach, _NONE, rank.dtype)
    least, size = np.concatenate([edge, rank, edge]), 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return np.minimum(least[: len(rank)], least[width - size : width - size + len(rank)])


def _with(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.drop(column).withColumn(column, F.lit(None).cast(kind))


def _mapped(df: DataFrame, source: str, targets: list[str], make) -> DataFrame:
    """`df` with `targets`, made from `source` by make()(part of a batch's column) -> one array each. Parts have 512 KB or one longer value."""
    source_at, at = [c.lower() for c in df.columns].index(source.lower()), [df.columns.index(t) for t in targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            _, bounds = fl.flat(whole.column(source_at))
            for low, high in fl.pieces(bounds):
                batch = whole.slice(low, high - low)
                made = dict(zip(at, work(batch.column(source_at))))
                yield pa.RecordBatch.from_arrays([made.get(i, batch.column(i)) for i in range(batch.num_columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def encode(df: DataFrame, tokenizer: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Add `ids_col`: the ids as little-endian unsigned 32-bit integers in one binary value.

    `tokenizer` is the path of a byte-level BPE file, read once here and broadcast. With `decoded_col`, the ids are also
    decoded again in the same pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer))
    out = _with(df, ids_col, "binary")
    if decoded_col:
        out = _with(out, decoded_col, "string")

    def make():
        import regex

        vocabulary, pattern = shared.value, regex.compile(PATTERN)

        def work(column: pa.Array) -> list[pa.Array]:
            data, bounds = fl.flat(column)
            texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            found = vocabulary.encode(texts, pattern)
            ids = pa.array(found, pa.binary())
            return [ids, pa.array(vocabulary.decode_all(found), pa.string())] if decoded_col else [ids]

        return work

    return _mapped(out, text_col, [ids_col, decoded_col] if decoded_col else [ids_col], make)


def decode(df: DataFrame, tokenizer: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add `text_col`: the text of the ids in `ids_col`, special tokens included."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer))

    def make():
        return lambda column: [pa.array(shared.value.decode_all([ids or b"" for ids in column.to_pylist()]), pa.string())]

    return _mapped(_with(df, text_col, "string"), ids_col, [text_col], make)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, path, decoded_col="decoded")
    return out.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
