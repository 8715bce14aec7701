import math
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from veilwork.llm import language_id as g
from veilwork.llm.queries import op10_language_id

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    """Trigrams of letters and gaps, counted one by one."""
    codes = [0]
    for c in text.lower():
        if c.isalpha() or codes[-1]:
            codes.append(ord(c) if c.isalpha() else 0)
    codes += [0] if codes[-1] else []
    return Counter(tuple(codes[i : i + 3]) for i in range(len(codes) - 2) if codes[i + 1])


def plain_vector(text, dimension):
    """The bundle of a text, component by component."""
    out = [0] * dimension
    signs = {}
    for gram, n in plain_grams(text).items():
        for c in gram:
            if c not in signs:
                raw = np.random.default_rng([7, c]).bytes(dimension // 8)
                signs[c] = [1 if raw[k // 8] >> (7 - k % 8) & 1 else -1 for k in range(dimension)]
        for k in range(dimension):
            # A vector rotated by r has at k what it had at k - r.
            out[k] += n * signs[gram[0]][k - 2] * signs[gram[1]][k - 1] * signs[gram[2]][k]
    return out


TEXTS = ["Ab, cab!\n ÉZ", "", "12 -", "привет, мир", "漢字 𐐷 かな", "x", "aaaa " * 300, "\x00a"]


def test_bundle_against_letter_by_letter():
    letters = g._letters()
    got = g.bundle([g.grams(t, letters) for t in TEXTS], 64)
    for t, v in zip(TEXTS, got, strict=True):
        assert dict(zip(*map(list, g.grams(t, letters)), strict=True)) == {a << 42 | b << 21 | c: n for (a, b, c), n in plain_grams(t).items()}
        assert v.tolist() == plain_vector(t, 64)


def test_blocks_of_grams_add_up(monkeypatch):
    letters = g._letters()
    counted = [g.grams("the quick brown fox jumps over the lazy dog " * k, letters) for k in (0, 1, 3)]
    want = g.bundle(counted, 128)
    monkeypatch.setattr(g, "GRAMS", 7)
    assert np.array_equal(g.bundle(counted, 128), want)


def test_predictions_against_plain_cosines(spark, monkeypatch):
    monkeypatch.setattr(g, "TEXTS", 2)
    train = [("hello there friend", "en"), ("good day", "en"), ("bonjour mon ami", "fr"), ("доброе утро", "ru"), ("добро јутро", "sr"), ("bonjour mon ami", "fr")]
    texts = ["hello friend", "утро", "mon jour", "јутро", "zzz", None, "7", "漢字"] + [t for t, _ in train]
    prototypes = g.learn_prototypes(spark.createDataFrame(train, "text string, lang string").repartition(3), dimension=64)
    own = {}
    for t, name in train:
        size = math.hypot(*plain_grams(t).values())
        own[name] = [a + b / size for a, b in zip(own.get(name, [0] * 64), plain_vector(t, 64), strict=True)]
    learnt = {r.lang: list(r.prototype) for r in prototypes.collect()}
    assert learnt.keys() == own.keys() and all(np.allclose(learnt[n], own[n], atol=1e-5) for n in own)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in g.predict(df, prototypes, dimension=64).collect():
        v = plain_vector(r.text or "", 64)
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {n: sum(map(float.__mul__, map(float, v), map(float, p))) / (math.hypot(*v) * math.hypot(*p)) for n, p in own.items()}
        assert abs(r.score - min(1, max(0, cosine[r.lang_pred]))) < 1e-5
        assert cosine[r.lang_pred] >= max(cosine.values()) - 1e-6


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op10_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_one_long_text_does_not_overturn_a_prototype(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", g.fold(F.col("doc_id")) == 2)
    odd = spark.createDataFrame([(-1, "x" * 200_000, "fr", False), (-2, "long words " * 100_000, "de", False)], docs.schema)
    held = docs.where("held_out AND lang IS NOT NULL")
    found = g.predict(held, g.learn_prototypes(docs.unionByName(odd).where("NOT held_out"))).where("lang_pred <> 'und'")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_texts_without_letters(spark):
    train = spark.createDataFrame([("hello there friend", "en"), ("bonjour mon ami", "fr"), (None, "de"), ("12", "it"), ("x", None)], "text string, lang string")
    prototypes = g.learn_prototypes(train)
    assert sorted(r.lang for r in prototypes.collect()) == ["en", "fr"]
    df = spark.createDataFrame([(1, "hello friend", 3), (2, None, 3), (3, "", 3), (4, "1 2 -", 3), (5, "bonjour " * 9000, 3), (5, "bonjour", 3)], "k int, text string, score int")
    out = g.predict(df, prototypes)
    got = sorted((r.k, r.lang_pred) for r in out.collect())
    assert got == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "fr"), (5, "fr")]
    assert g.predict(df.limit(0), prototypes).count() == 0
    nothing = g.learn_prototypes(train.limit(0))
    assert {(r.lang_pred, r.score) for r in g.predict(df, nothing).collect()} == {("und", 0.0)}
