"""Operator 11 against the tokenizers' own libraries, with all links made one by one."""

import hashlib
import itertools
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import align, bpe

ODD = [
    "", None, " ", "  ", "a", " a", "a ", "\n", "\r\n x\r\n\r\n y;\r\n", "a▁b", "foo  bar\n  baz \n\n   q", "日本語 текст déjà 😀😀  x", "<|endoftext|> <s></s> <unk> <0x41>", "=" * 3000, "x" * 5000 + " y", "\t\t tab\t x",
    "\x00 nul \x1c \x1d a", "nb sp　wide  x", "é̈ combining", "don't I'll 123 456,789", "a" * 300 + "\r" + "b" * 300 + " " * 300 + "c", "� ퟿", "the quick brown fox. The quick  brown fox", "the quick brown fox. The quick  brown fox",
]


def expected(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = align.default_tokenizers()
    a_lib, b_lib = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_lib.encode_special_tokens = True
    letter = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    with open(path_a, encoding="utf-8") as f:
        a_bytes = {i: bytes(letter[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if all(c in letter for c in t)}
    b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in range(len(b_lib)))]
    rows, held = [], Counter()
    for doc, text in docs:
        groups, a, b = [], [], []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            whole = (" " + text).encode()
            if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
                a, b = [], []
            ends = [list(itertools.accumulate(len(t[i]) for i in ids)) for t, ids in ((a_bytes, a), (b_bytes, b))]
            at = [0, 0]
            for cut in sorted(set(ends[0]) & set(ends[1])):
                stop = [e.index(cut) + 1 for e in ends]
                groups.append((a[at[0] : stop[0]], b[at[1] : stop[1]]))
                at = stop
        rows.append((doc, len(a), len(b), groups))
        held.update({p for g in groups for p in itertools.product(*g)})
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for doc, n_a, n_b, groups in rows:
        links = [p for g in groups for p in itertools.product(*g)]
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(out, key=str), held, top


@pytest.fixture(scope="module")
def odd(spark, docs):
    rows = [(100 + i, t) for i, t in enumerate(ODD)] + [(r.doc_id, r.text[:20_000] if r.text else r.text) for r in docs.collect()]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), expected(rows)


@pytest.mark.parametrize("max_rows", [1 << 20, 40, 0])
def test_links_of_every_document(odd, max_rows):
    df, (want, _, _) = odd
    clashing = df.withColumns({"alignment": F.lit("mine"), "row": F.lit(1), "pairs": F.lit("x"), "text ": F.lit(2)})
    out = align.align(clashing, *align.default_tokenizers(), max_rows=max_rows, carry=("doc_id", "row", "pairs", "alignment"))
    assert out.columns == ["doc_id", "row", "pairs", "alignment"]
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple([r.doc_id, *(r.alignment[n] for n in names)]) for r in out.collect()), key=str) == want


def test_large_groups_and_small_pieces(odd, monkeypatch):
    df, (want, _, _) = odd
    worker = align._Worker(align.Aligner.read(*align.default_tokenizers()))
    texts = [r.text or "" for r in df.collect()]
    import numpy as np

    def made():
        spaced = [b" " + t.encode() for t in texts]
        return list(worker.rows(texts, np.frombuffer(b"".join(spaced), np.uint8), np.array([len(x) for x in spaced])))

    plain = made()
    monkeypatch.setattr(align, "_LINKS", 2)  # groups of more than two links go by their distinct ids, a few at a time
    assert made() == plain and sorted(r[4] for r in plain) == sorted(r[7] for r in want)
    monkeypatch.setattr(align, "_CACHED", 3)
    assert made() == plain


def test_best_partners_and_nothing(spark, odd):
    df, (_, held, top) = odd
    found = {(r.a, r.b): r.n for r in align.best_partners(df, *align.default_tokenizers()).collect()}
    assert found == {p: n for p, n in held.items() if n == top[p[0]]}
    assert align.align(df.limit(0), *align.default_tokenizers()).count() == 0
