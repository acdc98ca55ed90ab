import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glenfare.llm import language_id as L
from helpers import SF, documents, edge_docs, empty_docs, prose


def test_held_out_accuracy_and_contract(spark):
    rows = L.op5_language_id(spark, SF).collect()
    docs = {r["doc_id"]: r for r in documents(spark).collect()}
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert sum(right) >= 0.97 * len(right)


def brute_kn(texts, order):
    """log P(c | context) of one language, straight from the textbook formula, with dicts."""
    grams = Counter()
    for t in texts:
        s = " " * (order - 1) + L.letters(t) + " "
        grams.update(s[i:i + order] for i in range(len(s) - order + 1))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount = {}
    for k, c in levels.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    followers = {k: defaultdict(dict) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            followers[k][g[:-1]][g[-1]] = n

    def p(gram, k, n_chars):
        if k == 0:
            return 1 / n_chars
        ctx, low = gram[:-1], p(gram[1:], k - 1, n_chars)
        own = followers[k].get(ctx)
        if not own:
            return low
        total = sum(own.values())
        return max(own.get(gram[-1], 0) - discount[k], 0) / total + discount[k] * len(own) / total * low
    return p


def fitted(by_lang, order):
    out = {}
    for lang, texts in by_lang.items():
        c = Counter()
        for t in texts:
            s = " " * (order - 1) + L.letters(t) + " "
            c.update(s[i:i + order] for i in range(len(s) - order + 1))
        out[lang] = (L.codes("".join(c)).reshape(-1, order), np.array(list(c.values())))
    return L.joined_model(out)


@pytest.mark.parametrize("order", [2, 4])
def test_model_is_interpolated_kneser_ney(order, monkeypatch):
    rnd = random.Random(1)
    by_lang = {l: [prose(rnd, l, 60) for _ in range(5)] for l in ("en", "fr")}
    model = fitted(by_lang, order)
    n_chars = len({ch for ts in by_lang.values() for t in ts for ch in " " + L.letters(t)}) + 1
    probe = [by_lang["en"][0], prose(rnd, "fr", 30), "zzz qqq éé", "x"]
    monkeypatch.setattr(L, "SLICE", 50)  # long texts are scored in slices
    h, n = L.entropies(model, probe)
    for t, row, size in zip(probe, h, n):
        s = " " * (order - 1) + L.letters(t) + " "
        grams = [s[i:i + order] for i in range(len(s) - order + 1)]
        assert size == len(grams)
        for j, lang in enumerate(model["langs"]):
            p = brute_kn(by_lang[lang], order)
            assert row[j] == pytest.approx(-sum(math.log(p(g, order, n_chars)) for g in grams) / len(grams), rel=1e-4)


def test_edges(spark):
    docs = edge_docs(spark)
    model = L.fit(docs)
    rows = L.predict(docs, model).collect()
    assert len(rows) == docs.count()
    texts = docs.collect()
    none = sum(not any(c.isalpha() for c in r["text"] or "") for r in texts)
    und = [r for r in rows if r["lang_pred"] == "und"]
    assert len(und) == none and all(r["score"] == 0 and not r["accepted"] for r in und)
    assert {r["lang_pred"] for r in rows} <= {"en", "fr", "und"}
    assert L.fit(empty_docs(spark)) is None
    assert L.predict(empty_docs(spark), None).count() == 0 and L.predict(empty_docs(spark), model).count() == 0
    assert {r["lang_pred"] for r in L.predict(docs, None).collect()} == {"und"}


def test_sample_is_bounded_and_repeatable(spark):
    docs = documents(spark)
    a = L.training_sample(docs, 20).collect()
    assert sorted(a) == sorted(L.training_sample(docs.repartition(5), 20).collect())
    assert max(Counter(r["lang"] for r in a).values()) < 45


def test_stage_rejects_gibberish_and_keeps_prose(spark):
    rnd = random.Random(2)
    rows = [(k, prose(rnd, l, 80), l) for k in range(400) for l in [rnd.choice(["en", "fr"])]]
    noise = [(1000 + k, " ".join("".join(rnd.choice("qxzkvwjyg") for _ in range(9)) for _ in range(60)), None) for k in range(20)]
    docs = spark.createDataFrame(rows + noise + [(5000, None, "en"), (None, rows[0][1], None)],
                                 "doc_id bigint, text string, lang string")
    out = L.kept_documents(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert not kept & {1000 + k for k in range(20)} and 5000 not in kept and None in kept
    assert len(kept & set(range(400))) >= 396


def test_model_holds_every_gram_of_the_sample(spark):
    rnd = random.Random(3)
    # distinct letters from a large alphabet: over a million different 4-grams in "big", few in "small"
    big = [("".join(chr(0x4E00 + rnd.randrange(20_000)) for _ in range(12_000)), "big") for _ in range(200)]
    small = [(prose(rnd, "fr", 60), "small") for _ in range(40)]
    docs = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate(big + small)],
                                 "doc_id bigint, text string, lang string").repartition(4)
    model = L.fit(docs)
    assert model["langs"] == ["big", "small"]
    counted = L.training_sample(docs, L.TRAIN_DOCS).filter("NOT calibrate").collect()
    grams = set()
    for r in counted:
        s = " " * 3 + L.letters(r["text"]) + " "
        grams.update(s[i:i + 4] for i in range(len(s) - 3))
    assert len(grams) > 1_100_000
    assert len(model["keys"][-1]) >= len(grams)


def calibration(rnd):
    """(language, length, cross-entropy): many texts of 0 and 1, five of the rare 2."""
    out = []
    for j, count, middle in ((0, 400, 1.3), (1, 400, 1.5), (2, 5, 1.7)):
        for _ in range(count):
            n = rnd.randint(150, 4000)
            out.append((j, n, rnd.gauss(middle, 0.01 + 0.5 / math.sqrt(n))))
    return [np.array(x) for x in zip(*out)]


def test_limits_of_rare_languages_and_odd_texts():
    true, n, h = calibration(random.Random(6))
    limit = L.limits(true, n, h, 4, 3.6)
    assert (limit[2] < 3).sum() > 10 and (limit[3] < 3).sum() > 10  # 3 has no calibration text at all
    for size in (200, 1000, 3000):
        k = L.band(np.array([size]))[0]
        for j, middle in ((0, 1.3), (1, 1.5), (2, 1.7)):
            assert middle + 0.05 < limit[j, k] < middle + 0.6
    # a mislabelled long text, and one in fifty odd ones, hardly move any limit
    odd = L.limits(np.append(true, 0), np.append(n, 3000), np.append(h, 3.4), 4, 3.6)
    assert np.abs(odd - limit).max() < 0.05
    extra = L.limits(np.append(true, [0] * 8), np.append(n, [3000] * 8), np.append(h, [3.4] * 8), 4, 3.6)
    assert np.abs(extra - limit).max() < 0.25
    assert (L.limits(true[:5], n[:5], h[:5], 4, 3.6) == 3.6).all()


def test_rare_language_rejects_gibberish(spark):
    rnd = random.Random(7)
    rows = [(k, prose(rnd, "en", 80), "en") for k in range(300)] + [(1000 + k, prose(rnd, "fr", 80), "fr") for k in range(40)]
    noise = [(2000 + k, " ".join("".join(rnd.choice("éèçàùœ") for _ in range(9)) for _ in range(60)), None) for k in range(20)]
    kept = {r["doc_id"] for r in L.kept_documents(spark.createDataFrame(
        rows + noise, "doc_id bigint, text string, lang string")).collect()}
    assert not any(i >= 2000 for i in kept)
    assert sum(1000 <= i < 2000 for i in kept) >= 36 and sum(i < 1000 for i in kept) >= 297
