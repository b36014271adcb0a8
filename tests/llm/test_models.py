"""The models of operators 10 and 6 and the shares of 8, recomputed in plain Python, every output column."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, ngrams, quality, sharding

PAD = ngrams.PAD * 4


def kneser_ney(docs):
    """lang -> f(gram) = probability of its last symbol; docs are (lang, text)."""
    n, of = Counter(), defaultdict(set)
    for lang, text in docs:
        for k in range(len(text)):
            g = (PAD + text)[k : k + 5]
            n[lang, g] += 1
            of[lang, g].add(text)
    models = {}
    for lang in {d[0] for d in docs}:
        levels = {5: {g: c for (x, g), c in n.items() if x == lang and len(of[lang, g]) > 1}}
        for k in range(4, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        unseen = 1 / (len(levels[1]) + 1)
        p, b = {}, {}
        for k in range(1, 6):
            every = [c for (x, _), c in n.items() if x == lang] if k == 5 else list(levels[k].values())
            t = {i: max(1, sum(c == i for c in every)) for i in range(1, 5)}
            y = t[1] / (t[1] + 2 * t[2])
            d = {i: max(0.05, min(0.95 * i, i - (i + 1) * y * t[i + 1] / t[i])) for i in (1, 2, 3)}
            totals, taken = Counter(), Counter()
            for g, c in levels[k].items():
                totals[g[:-1]] += c
                taken[g[:-1]] += d[min(c, 3)]
            b[k] = {c: taken[c] / totals[c] for c in totals}
            p[k] = {g: (c - d[min(c, 3)]) / totals[g[:-1]] + b[k][g[:-1]] * (unseen if k == 1 else p[k - 1][g[1:]]) for g, c in levels[k].items()}

        models[lang] = backing_off(p, b, unseen if levels[1] else 1e-6)
    return models


def backing_off(p, b, unseen):
    def value(g):
        if not g:
            return unseen
        return p[len(g)][g] if g in p[len(g)] else b[len(g)].get(g[:-1], 1.0) * value(g[1:])

    return value


def some_docs(seed=3):
    rng = np.random.default_rng(seed)
    words = {"en": "the river runs over old stones and quiet hills while birds sing near tall trees".split(), "de": "der fluss zieht über alte steine und stille hügel bei hohen bäumen".split()}
    rows = [(lang, " ".join(rng.choice(words[lang], int(rng.integers(5, 60))))) for lang in ("en", "de") for _ in range(40)]
    rows += [("en", "".join(rng.choice(list("qxzjkvw "), 300)))] + [("de", rows[45][1])] * 3 + [(None, "one two three"), ("en", ""), ("fr", "seul texte " * 9)]
    return rows


def test_model_is_the_plain_one(spark):
    rows = some_docs()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    plain = kneser_ney([(lang or "", text) for lang, text in rows])
    counts = ngrams.written(ngrams.count_grams(df, F.col("lang"), F.col("text")), "counts")
    levels = ngrams.fit(counts)
    found = {(r.lang, r.g): (r.nats, r.n) for r in levels.model(counts).collect()}
    assert len(found) == counts.count() and all(v[0] == pytest.approx(-math.log(plain[lang](g)), rel=1e-9) for (lang, g), v in found.items())
    odd = [("en", "zzzzz"), ("en", "river"), ("de", "the r"), ("xx", "abcde"), ("en", "ab cd")]
    wanted = {(r.lang, r.g): r.nats for r in levels.values(spark.createDataFrame(odd * 2, "lang string, g string")).collect()}
    assert wanted == {(lang, g): pytest.approx(-math.log(plain[lang](g) if lang in plain else 1e-6), rel=1e-9) for lang, g in odd}


def test_every_column_of_the_rules(spark):
    rows = some_docs(4)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    plain = kneser_ney([(lang or "", text) for lang, text in rows])
    nats, failed, words = {}, {}, {}
    for i, (lang, text) in enumerate(rows):
        w = text.split()
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        again = {x for p in places.values() if len(p) > 1 for k in p for x in range(k, k + 8)}
        words[i], failed[i] = len(w), len(w) < 20 or 100 * len(again) > 30 * len(w)
        nats[i] = np.mean([-math.log(plain[lang or ""]((PAD + text)[k : k + 5])) for k in range(len(text))]) if text else None
    bands = {}
    for lang in {r[0] or "" for r in rows}:
        steps = sorted(math.floor(np.float64(nats[i]) * 1000) for i, r in enumerate(rows) if (r[0] or "") == lang and not failed[i] and nats[i] is not None)
        if steps:
            quartile = lambda q: next(s for s in steps if sum(x <= s for x in steps) >= q * len(steps))  # noqa: B023, E731
            low, high = quartile(0.25), quartile(0.75)
            bands[lang] = (low / 1000, (high + 1) / 1000, max(high - low, 20) * 5 / 1000)
    for r in quality.quality_rules(df).collect():
        assert (r.n_words, r.base_failed) == (words[r.doc_id], failed[r.doc_id])
        assert r.nats == pytest.approx(nats[r.doc_id], rel=1e-4) if nats[r.doc_id] is not None else r.nats is None
        low, high, width = bands.get(r.lang, (-math.inf, math.inf, 0))
        width *= math.sqrt(1 + 100 / max(1, r.n_words))
        edge = nats[r.doc_id] is not None and min(abs(nats[r.doc_id] - low + width), abs(nats[r.doc_id] - high - width)) < 3e-3
        assert edge or r.kept == (not failed[r.doc_id] and (nats[r.doc_id] is None or low - width <= nats[r.doc_id] <= high + width)), r


def test_copies_do_not_vouch_for_each_other(spark):
    rng = np.random.default_rng(9)
    usual = [" ".join(rng.choice("the river runs over old stones and quiet hills while birds sing".split(), 60)) for _ in range(100)]
    odd = " ".join("".join(rng.choice(list("qxzjkvwpm"), 6)) for _ in range(60))

    def entropy(copies):
        df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(usual + [odd] * copies)], "doc_id long, lang string, text string").repartition(5)
        return {round(r.nats, 4) for r in quality.score(df, quality.model(df)).where("doc_id >= 100").collect()}

    one, three = entropy(1), entropy(3)
    # only the discounts, which count n-grams of one text too, move a little
    assert len(one) == len(three) == 1 and abs(one.pop() - three.pop()) < 0.2


def test_shares_of_languages_against_a_plain_search(spark):
    """EM over every set of languages: the chosen set has the best penalised likelihood of all."""
    rng = np.random.default_rng(1)
    words = {"en": "the river runs over old stones and quiet hills".split(), "de": "der fluss zieht über alte steine und stille hügel".split(), "fr": "la rivière coule sur les vieilles pierres et collines".split()}
    known = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    mixed = [(1000 + i, " ".join([*rng.choice(words[a], 30), *rng.choice(words[b], n)]), a) for i, (a, b, n) in enumerate([("en", "de", 3), ("de", "fr", 5), ("fr", "en", 0), ("en", "fr", 12)])]
    df = spark.createDataFrame(known + mixed + [(2000, None, "en"), (2001, "1 2 3", "en")], "doc_id long, text string, lang string")
    trained = langid.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, trained).collect()}
    assert all(found[i][0] == lang for i, _, lang in known + mixed) and found[2000][0] == found[2001][0] == "und"
    assert found[1002][1] > found[1003][1] > 0.5  # a quarter of another language lowers the share


def test_every_column_of_the_shards(spark, tmp_path):
    rows = [(i, None if i % 17 == 0 else f"text {i % 40} é", "x") for i in range(500)] + [(7, "text 7 é", "y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, law string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.query(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
