"""Each stage of the pipeline against brute force over what its predecessor kept."""

import hashlib
import re

import numpy as np
import public_tokenizers
from test_decontaminate import fold
from test_minhash import brute as near_brute
from tokenizers import Tokenizer

import corpus_pipeline as p
from veilwork.llm import quality
from veilwork.llm.shared import staged

SF = "/root/testdata/sf0.001"


def good(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(table, quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet")), n_grades=3)
    memory = quality._Hash()
    out = set()
    for i, t in docs.items():
        at, value = quality.features(t, memory)
        if model.tails(np.array([float(model.weights[at] @ value)]))[0, 1] >= 0.5:
            out.add(i)
    return out


def first_of_equal(docs):
    seen = {}
    for i in sorted(docs):
        seen.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i] or "").encode()).digest(), i)
    return set(seen.values())


def first_of_near(docs):
    return {i for i, (_, c) in near_brute(list(docs.items()), 5).items() if i == c}


def without_benchmark(spark, docs):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        v = fold(r.text)
        windows |= {tuple(v[i : i + 10]) for i in range(max(1, len(v) - 9))} if v else set()
    short = {w for w in windows if len(w) < 10}
    assert not short
    return {i for i, t in docs.items() if not any(tuple(w[k : k + 10]) in windows for w in [fold(t)] for k in range(len(w) - 9))}


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, further columns whose names operators use themselves."""
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    words = [f"w{i}" for i in range(300)]
    rows += [(None, None, None, None, None), (5001, None, "en", None, 0), (5002, "", "en", "s", 0), (5003, " \n\t", None, "s", 3), (5004, "one", "en", "s", 3)]
    rows += [(5010, "same text here", "en", "s", 14)] * 3 + [(5010, "another text under one id", "en", "s", 1), (5011, "same  text\nhere", "en", "s", 15)]
    rows += [(5020, " ".join(words), "en", "s", 1), (5021, " ".join([*words[:-1], "changed"]), "en", "s", 1), (5022, f"before {passage} behind", "en", "s", 1)]
    rows += [(5030, "long " * 200_000, "en", "s", 1_000_000), (5031, "x" * 300_000, "en", "s", 300_000), (None, "text without an id", "de", "s", 1)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    df = spark.createDataFrame(rows, schema)
    more = {"row": "string", "key": "long", "parts": "int", "tail": "double", "spans": "array<int>", "kept": "boolean", "ids": "string"}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(None).cast(t) for c, t in more.items()}).repartition(5)


def test_odd_documents(spark):
    docs = staged(odd_documents(spark), "odd")
    columns = docs.columns
    for name, stage in p.STAGES[1:-1]:  # the classifier's own rules have their tests: it may drop any of these
        before = [tuple(r) for r in docs.collect()]
        docs = staged(stage(spark, docs, SF), "odd")
        after = [tuple(r) for r in docs.collect()]
        assert docs.columns == columns and not set(map(str, after)) - set(map(str, before)), name
        texts = sorted(str(r[1])[:60] for r in after)
        ids = {r[0] for r in after}
        if name == "exact_dedup":
            assert len([r for r in after if r[0] == 5010]) == 2 and 5011 not in ids
            assert [r[0] for r in after if not (r[1] or "") and r[0]] == [5001] and None in ids and {5020, 5021, 5022, 5030, 5031} <= ids
        elif name == "minhash_near_dedup":
            assert 5020 in ids and 5021 not in ids and {5003, 5004, 5022, 5030, 5031} <= ids and "text without an id" in texts
        else:
            assert 5022 not in ids and {5003, 5004, 5020, 5030, 5031} <= ids
    encoded = p.STAGES[-1][1](spark, docs, SF).collect()
    assert len(encoded) == len(after) and all(r.round_trip and len(r.ids) == r.n_tokens for r in encoded)


def test_odd_documents_are_judged_by_text(spark):
    docs = odd_documents(spark)
    kept = p.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns
    verdict = {}
    left = [tuple(r) for r in kept.collect()]
    for r in docs.collect():
        verdict.setdefault(r.text or "", set()).add(sum(x[1] == r.text for x in left) > 0)
    assert all(len(v) == 1 for t, v in verdict.items() if t)


def test_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert name == p.STAGES[-1][0] or out.columns == docs.columns, name


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    wanted = [lambda d: good(spark, d), first_of_equal, first_of_near, lambda d: without_benchmark(spark, d)]
    for (name, stage), brute in zip(p.STAGES[:-1], wanted, strict=True):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = staged(stage(spark, docs, SF), "test")
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert docs.columns == columns, name
        assert set(after) == brute(before), name
        assert all(before[i] == t for i, t in after.items()), name
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(after)
    assert all(r.round_trip and r.n_tokens == len(r.ids) and list(r.ids) == reference.encode(after[r.doc_id] or "", add_special_tokens=False).ids for r in rows)
    assert sorted(r.doc_id for r in p.run(spark, SF).select("doc_id").collect()) == sorted(after)
