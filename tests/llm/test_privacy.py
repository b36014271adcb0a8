"""Operator 12: base spans against plain patterns, disclosures against counts in memory, and texts that make patterns slow."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import privacy

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) if i % 2 else int(d) for i, d in enumerate(digits[::-1]))
            keep = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15][kind]
            if keep:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.B@-_+1234567890 ()é%", max_size=40))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert privacy.base_spans(text) == plain_spans(text)
    assert not privacy.base_spans(text) or re.search(privacy.GUARD, text)


def test_numbers():
    text = "4871316720949013, 4111 1111-1111 1111 +1 (499) 555-6503, 8.196.197.208 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 a@b.c_d@e.f x@y@z.de 12345678901234567890"
    assert privacy.base_spans(text) == plain_spans(text) and {k for k, _, _ in privacy.base_spans(text)} == {0, 1, 2, 3}


@pytest.mark.parametrize("text", ["a" * 300_000, "@" * 300_000, "a@" * 150_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+" * 300_000, "+1" + "(" * 300_000, "a." * 150_000 + "@b", "b@c." * 80_000, "1.1.1" * 60_000, "-" * 300_000])
def test_no_text_is_slow(spark, text):
    began = time.time()
    privacy.base_spans(text)
    assert time.time() - began < 3
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(privacy.GUARD)).count() == 1


def corpus(seed=1):
    """Texts of common words; one address goes with a nickname, one with a place that also stands elsewhere, copies vouch for nothing."""
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(60)]
    say = lambda *more: " ".join(rng.sample(common, 30) + list(more) + rng.sample(common, 5))
    rows = [say("write", "to", "ann@mail.org", "known", "as", "Zorgblat") for _ in range(8)]
    rows += [say("call", "bob@mail.org", "in", "Velmora") for _ in range(8)] + [say("Velmora", "is", "fine") for _ in range(2)]
    rows += [say("mail", "ann@mail.org") for _ in range(3)]
    rows += [say("see", "eve@mail.org", "Quxomat")] * 9  # copies of one text
    rows += [say("from", "10.0.0.1", "port") for _ in range(30)] + [say() for _ in range(120)] + [say("Zorgblatt")]
    return [(i, t) for i, t in enumerate(rows)]


def told_in_memory(rows, window, support, generalise, remove):
    texts = {t for _, t in rows if t}
    n, held, entities, both, near = len(texts), Counter(), Counter(), Counter(), {}
    for t in texts:
        spans = privacy.base_spans(t)
        found = privacy.words(t, spans)
        held.update({w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({i: i + 32 for i in range(65, 91)}))})
        for k, s, e in spans:
            name, i = privacy.entity(k, t[s:e]), sum(w[0] < s for w in found)
            near.setdefault((t, name), set()).update(w[2] for w in found[max(0, i - window) : i + window])
    for (_, name), terms in near.items():
        entities[name] += 1
        both.update((name, w) for w in terms)
    out = {}
    for (name, w), k in both.items():
        if k >= support and n > entities[name]:
            share = math.log(n * k / (held[w] * entities[name])) / math.log(n / entities[name])
            if share >= generalise:
                out[name, w] = (round(share, 9), "remove" if share >= remove else "generalise")
    return out


@pytest.mark.parametrize(("window", "support"), [(50, 3), (4, 2), (2, 3)])
def test_disclosures_against_counts_in_memory(spark, window, support):
    rows = [*corpus(), (900, None), (901, ""), (None, "only ann@mail.org here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near = privacy.written(privacy.contexts(df, "text", window), "near")
    found = {(r.entity, r.term): (round(r.disclosed, 9), r.kind) for r in privacy.disclosures(df, near, support=support).collect()}
    want = told_in_memory(rows, window, support, 0.8, 0.95)
    assert found == want and (window < 3 or found["email:ann@mail.org", "zorgblat"][1] == "remove")
    assert window < 50 or found["email:bob@mail.org", "velmora"][1] == "generalise"
    assert not any(e == "email:eve@mail.org" for e, _ in found)


def test_texts_are_sanitised(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "mine", 7) for i, t in rows] + [(900, None, None, None), (901, "", "x", 1), (0, rows[0][1], "again", 2)], "doc_id long, text string, private string, _x int").repartition(3)
    for most in (32 << 20, 0):  # terms broadcast, terms joined
        out = privacy.sanitise(df, clean_col="clean", most_bytes=most).collect()
        assert len(out) == df.count() and set(out[0].asDict()) == {"doc_id", "text", "_x", "private", "clean"}
        for r in out:
            base = [(privacy.KINDS.index(s.kind), s.start, s.end) for s in r.private if s.kind in privacy.BASE]
            assert base == plain_spans(r.text or "") and [privacy.KINDS.index(s.kind) for s in r.private] == sorted(privacy.KINDS.index(s.kind) for s in r.private)
            terms = {(r.text[s.start : s.end], s.kind) for s in r.private if s.kind not in privacy.BASE}
            assert terms == ({("Zorgblat", "remove"), ("known", "remove"), ("write", "remove"), ("as", "remove"), ("to", "remove")} if "Zorgblat " in (r.text or "") else terms if "bob@" in (r.text or "") or "10.0.0.1" in (r.text or "") else set())
            if "bob@" in (r.text or ""):
                assert ("Velmora", "generalise") in terms and "[NAME]" in r.clean and "[EMAIL]" in r.clean and "Velmora" not in r.clean
            if not base:
                assert r.clean == (r.text or "")
    assert privacy.sanitise(df.limit(0)).count() == 0
    assert privacy.sanitise(df.where("doc_id > 60 AND doc_id < 90")).where("size(private) > 0").count() == 0


def test_query(spark):
    found = privacy.query(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in found.collect():
        spans = plain_spans(texts[r.doc_id])
        shown = ",".join(f"{privacy.BASE[k]}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and r.spans.startswith(shown)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]
