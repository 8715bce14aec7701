import random
import re

import numpy as np

from veilwork.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    w = fold(text)
    hit, found = set(), set()
    for item, t in items:
        v = fold(t)
        if not v:
            continue
        wins = [v[i : i + size] for i in range(max(1, len(v) - size + 1))]
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def test_words_fold_only_ascii():
    assert d.words("Été ÀB c-D_9\x00x".encode()) == [x.encode() for x in fold("Été ÀB c-D_9\x00x")]


def test_suffix_order_and_search_against_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        text = [rnd.randint(0, 3) for _ in range(rnd.randint(1, 80))] * rnd.randint(1, 3) + [0]
        index = d.FMIndex(np.array(text, np.int64))
        for length in (1, 2, 4):
            patterns = np.array([[rnd.randint(1, 4) for _ in range(length)] for _ in range(9)], np.int64)
            first, last = index.search(patterns)
            for p, a, b in zip(patterns.tolist(), first, last, strict=True):
                want = [i for i in range(len(text)) if text[i : i + length] == p]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_find_contamination_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["a", "B", "c1", "é", "x", "y"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.choice([0, 2, 3, 5, 9]))) for i in range(12)] + [(None, "only b"), (3, "x-y a"), (7, None)]
    docs = [(i, say(rnd.choice([0, 1, 4, 30, 60]))) for i in range(60)] + [(100, None), (101, ""), (5, "a B c1"), (102, "only   B!")]
    docs = [(i, None if t is None else t + " ; " + items[i % 12][1].upper() if i % 3 == 0 and t else t) for i, t in docs]
    df = spark.createDataFrame([(i, t, "old") for i, t in docs], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (1 << 20, 40):
        got = d.find_contamination(df, bench, window=3, block_bytes=blocks).withColumn("hit", d.words_hit(d.F.col("spans"))).collect()
        assert len(got) == len(docs)
        want = sorted((i, *brute(t, items, 3)) for i, t in docs)
        assert sorted((r.doc_id, r.n_words, r.hit, list(r["items"])) for r in got) == want
    kept = d.decontaminate(df, bench, window=3)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in want if not x[3])


def test_items_larger_than_a_block(spark):
    """One long item and many rows without id are cut into pieces that lose no window."""
    rnd = random.Random(11)
    say = lambda n: "-".join(rnd.choice(["ab", "Cd", "é", "x9", "long" * 3]) for _ in range(n))
    items = [(1, say(400)), (None, say(150)), (None, say(150)), (2, "a b"), (3, None), (4, "-" * 2000)]
    whole = fold(items[0][1])
    docs = [(i, " ".join(whole[k : k + n])) for i, (k, n) in enumerate([(0, 4), (17, 5), (1, 3), (396, 4), (200, 90)])] + [(9, say(300)), (10, items[1][1].upper())]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    blocks = list(d._blocks(bench, "item_id", "text", 4, 1024))
    assert len(blocks) > 1 and max(n for _, n in blocks) < 4 * 1024
    got = d.find_contamination(df, bench, window=4, block_bytes=1024).withColumn("hit", d.words_hit(d.F.col("spans"))).collect()
    assert sorted((r.doc_id, r.n_words, r.hit, list(r["items"])) for r in got) == sorted((i, *brute(t, items, 4)) for i, t in docs)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(df, none).first()["n_words"] == 3
    assert d.find_contamination(df.limit(0), none).count() == 0


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    windows = {}
    for r in bench.collect():
        v = fold(r.text)
        for i in range(max(1, len(v) - 9)):
            windows.setdefault(tuple(v[i : i + 10]), set()).add(str(r.item_id))
    for r in d.find_contamination(docs, bench).collect():
        w = fold(r.text)
        hit, found = set(), set()
        for i in range(len(w) - 9):
            if own := windows.get(tuple(w[i : i + 10])):
                hit |= set(range(i, i + 10))
                found |= own
        assert (r.n_words, sum(s["end"] - s["start"] for s in r.spans), list(r["items"])) == (len(w), len(hit), sorted(found))
