import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilwork.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [
    None, "", " ", "  ", "\n", "\n\n \t x", "a", " a", "a ", "don't we'LL I'M", "x" * 3000, "ab " * 2000, "12345 678", "<|endoftext|>", "a<|endoftext|> b", "é ü ß", "日本語 テキスト",
    "\U0001f600\U0001f468‍\U0001f469", " nbsp em space", "\x00\x01\x7f", "tab\tend \r\n next", "ﬁ Ǆ ١٢٣", "́ combining", "!!! ...", "a  b   c", " line", "end \n",
]


def expected(text, reference):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    return ids, reference.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def both_ways(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    at_once = bpe.encode_and_decode(df, PATH).collect()
    assert sorted(rows) == sorted(at_once)
    return {r.doc_id: (list(r.ids), r.decoded) for r in rows}


def test_edges_against_the_library(spark, reference):
    got = both_ways(spark, EDGES)
    assert got == {i: expected(t, reference) for i, t in enumerate(EDGES)}


def test_random_texts_against_the_library(spark, reference):
    rnd = random.Random(8)
    letters = "abcdeABC  \n\t.,'0129éß日́ <|>_-s"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    got = both_ways(spark, texts)
    assert got == {i: expected(t, reference) for i, t in enumerate(texts)}


def test_whole_table_against_the_library(spark, reference):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert rows
    for r in rows:
        assert (list(r.ids), r.decoded) == expected(r.text, reference)


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([("a b", "old", "old")], "text string, ids string, decoded string")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == df.columns and out.first().decoded == "a b"
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).count() == 0


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [10**6, -1, None])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(df, PATH).collect()} == {0: None, 1: "", 2: ""}


def test_long_words_and_texts_against_the_library(spark, reference):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for letters, n in (("ab", 30_000), ("abcdefgh012é日", 20_000), ("1", 50_000), ("the in, \n", 700_000), ("word ", 600_000))]
    assert both_ways(spark, texts) == {i: expected(t, reference) for i, t in enumerate(texts)}


def test_slices_cut_between_words_only():
    text = "ab  cd e\tf " * 40
    parts = list(bpe.slices(text, 7))
    assert "".join(parts) == text and len(parts) > 20 and all(p[0] == " " and p[1] != " " for p in parts[1:])
    assert list(bpe.slices("x" * 100, 7)) == ["x" * 100] and list(bpe.slices("", 7)) == [""]


def test_arcs_agree_with_the_growing_automaton():
    """The compiled tables against the copies that the gadgets made, and a word's path against merging by rank."""
    rnd = random.Random(1)
    single = [bytes([b]) for b in b"abc"]
    merges, tokens = [], list(single)
    while len(merges) < 60:
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        if a + b not in tokens and len(a + b) < 12:
            merges.append((a, b))
            tokens.append(a + b)
    automaton = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges)
    reader = bpe.Reader(automaton.compiled())
    live = [(automaton.target[a], t) for a in automaton.live for t in automaton.live]
    got = reader.has(*np.array(live).T)
    assert got.tolist() == [automaton._has(q, t) for q, t in live]
    rank = {m: k for k, m in enumerate(merges)}
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    flat, count = reader.read(words)
    at = 0
    for w, n in zip(words, count, strict=True):
        parts = [bytes([c]) for c in w]
        while True:
            k = min((rank.get(p, 10**9) for p in zip(parts, parts[1:])), default=10**9)
            if k == 10**9:
                break
            i = next(i for i, p in enumerate(zip(parts, parts[1:])) if rank.get(p) == k)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if all(tokens.index(p) in automaton.live for p in parts):
            assert [tokens[t] for t in flat[at : at + n]] == parts
        at += n


def test_ids_that_keys_cannot_hold_are_refused():
    with pytest.raises(ValueError, match="token ids"):
        bpe.Automaton({b"a": 1 << 20}, [])
