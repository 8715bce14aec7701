import hashlib
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from veilwork.llm import exact_dedup as e
from veilwork.llm import shared as s


def brute(docs):
    key = {n: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest() for n, (_, t) in enumerate(docs)}
    groups = {}
    for n, (i, _) in enumerate(docs):
        groups.setdefault(key[n], []).append(i)
    return sorted((i, key[n].hex(), min(groups[key[n]]), len(groups[key[n]]), i == min(groups[key[n]])) for n, (i, _) in enumerate(docs))


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_groups_against_brute_force(spark, counters):
    rnd = random.Random(counters)
    texts = ["hot  text", "hot\ntext", "Hot text", None, "", " ", "\x0b", "a b", "a  b", "a b", "long " * 4000] + [f"t{i}" for i in range(40)]
    docs = [(i, "hot text" if rnd.random() < 0.4 else rnd.choice(texts)) for i in range(400)] + [(3, "hot text"), (3, "hot text")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, digest int").repartition(5)
    got = sorted((r.id, r.digest.hex(), r.keep_id, r.group_size, r.kept) for r in e.duplicate_groups(df, counters=counters).collect())
    assert got == brute(docs)


def test_rows_that_stay(spark):
    docs = [(5, "a  b"), (2, "a b"), (9, "c"), (None, "a b"), (7, None), (8, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = e.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 2), (False, 7), (False, 9), (True, 0)]
    assert e.exact_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("counters", [1, 4, 9])
def test_misra_gries_finds_every_frequent_value(counters):
    rnd = random.Random(counters)
    stream = [bytes([min(rnd.randrange(40), rnd.randrange(40), rnd.randrange(40))]) for _ in range(3000)]
    found = e.misra_gries((stream[i : i + 100] for i in range(0, 3000, 100)), counters)
    counts = Counter(stream)
    assert len(found) <= counters
    assert {v for v, n in counts.items() if n > 3000 / (counters + 1)} <= set(found)
    assert all(counts[v] - 3000 / (counters + 1) <= n <= counts[v] for v, n in found.items())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_no_text_is_lost_where_ids_repeat(spark, kind):
    rows = [(1, "a", 0), (3, "a", 1), (3, "unique text here", 2), (4, "z", 3), (4, "z", 3), (4, "z", 5), (6, "z", 6), (2, "q", 7), (2, "r", 8)]
    rows = [(i if kind == "long" else f"d{i}", t, {"n": n}) for i, t, n in rows]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, KEPT map<string,int>").repartition(4)
    out = e.exact_dedup(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id)[-1], r.text) for r in out.collect())
    assert got == [("1", "a"), ("2", "q"), ("2", "r"), ("3", "unique text here"), ("4", "z")]
    assert all((r.doc_id, r.text, r.KEPT) in rows for r in out.collect())


def test_filter_lets_every_key_pass(spark):
    keys = spark.range(0, 30_000, 3).withColumnRenamed("id", "key")
    for most in (1 << 22, 1 << 10):
        rows = spark.range(30_000).withColumn("may", s.KeyFilter(keys, most).column(F.col("id"))).collect()
        assert all(r.may for r in rows if r.id % 3 == 0)
        if most > 1 << 19:
            assert sum(r.may for r in rows if r.id % 3) < 20_000 / 30
