import random

import pytest

from veilwork.llm import token_counts as t
from veilwork.llm.queries import op1_token_counts, tokenizer_path


def brute(text, pieces, marker=b" "):
    words = (text or "").encode().split()
    total, longest = 0, max(map(len, pieces), default=0)
    for w in words:
        w, at, n = marker + w, 0, 0
        while at < len(w):
            size = next((k for k in range(min(longest, len(w) - at), 0, -1) if w[at : at + k] in pieces), 0)
            if not size:
                n = 1
                break
            at, n = at + size, n + 1
        total += n
    return len(words), total


@pytest.mark.parametrize("seed", range(4))
def test_counts_against_greedy_matching(spark, seed):
    rnd = random.Random(seed)
    piece = lambda: bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5)))
    pieces = {piece() for _ in range(12)} | {b" ", b" a", b" ab"}
    texts = [None, "", " \n", "a" * 5000] + [" ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(20)) for _ in range(80)]
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(texts)], "doc_id long, text string, N_TOKENS string")
    out = t.count_tokens(df, pieces)
    assert out.columns == ["doc_id", "text", "n_words", "n_tokens"]
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in out.collect()} == {i: brute(x, pieces) for i, x in enumerate(texts)}


def test_no_pieces_and_empty_table(spark):
    df = spark.createDataFrame([("a bc d",)], "text string")
    assert t.count_tokens(df, []).first()["n_tokens"] == 3
    assert t.count_tokens(df.limit(0), [b"a"]).count() == 0


def test_whole_table_against_greedy_matching(spark):
    sf = "/root/testdata/sf0.001"
    pieces = set(t.byte_level_pieces(tokenizer_path("byte_bpe_50k.json")))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in op1_token_counts(spark, sf).collect()}
    assert got == {i: brute(x, pieces) for i, x in texts.items()}
