import random
import re

import numpy as np
import pytest

from veilwork.llm import minhash as m


def brute(docs, size):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def copies(seed, groups, each):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([3, 30, 120]))]
        for _ in range(each):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = word()
            docs.append(" ".join(own))
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_signature_against_plain_algorithm():
    def plain(elements, places):
        out = [None] * places
        for e in elements.tolist():
            p = list(range(places))
            for j in range(places):
                r = int(m.mixed(np.array([e], np.uint64) + m._GOLDEN * np.array([j + 1], np.uint64))[0])
                k = j + ((r & 0xFFFFFFFF) * (places - j) >> 32)
                p[j], p[k] = p[k], p[j]
                value = j << 32 | r >> 32
                out[p[j]] = value if out[p[j]] is None else min(value, out[p[j]])
        return out

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 50, 400)]
    assert m.superminhash(sets, 24).tolist() == [plain(s, 24) for s in sets]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    one, two = m.superminhash([a[:800], a[100:]], 512)
    assert abs((one == two).mean() - 700 / 900) < 0.06


@pytest.mark.parametrize("block", [256, 4])
def test_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    docs = copies(3, 9, 14) + [(900, None), (901, ""), (902, " \n"), (903, "one Two"), (904, "ONE  two")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_shingles string")
    got = {r.id: (r.n_shingles, r.component_id) for r in m.near_duplicate_groups(df).collect()}
    assert got == brute(docs, 4)
    kept = m.near_dedup(df, size=4)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)


def test_small_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.id: (r.n_shingles, r.component_id) for r in m.near_duplicate_groups(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], 4)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in m.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert sorted((r.id is None, r.kept) for r in m.near_duplicate_groups(df).collect()) == [(False, True), (False, True), (True, True)]
    assert m.near_duplicate_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_and_text_ids(spark, kind):
    base = " ".join(f"w{n}" for n in range(40))
    rows = [(1, base), (3, base + " end"), (3, "a text of its own that nobody has"), (4, "four words and more here"), (4, "four words and more here"), (5, None), (5, "")]
    rows = [(i if kind == "long" else f"d{i}", t, {"n": n}) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, bands map<string,int>").repartition(3)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in m.near_duplicate_groups(df).collect())
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    assert got == sorted((name(i), n, name(c)) for i, n, c in [(1, 37, 1), (3, 38, 1), (3, 5, 3), (4, 2, 4), (4, 2, 4), (5, 0, 5), (5, 0, 5)])
    out = m.near_dedup(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id)[-1], r.text or "") for r in out.collect()) == [("1", base), ("3", rows[2][1]), ("4", rows[3][1]), ("5", ""), ("5", "")]


def test_links_of_a_share_of_the_rows_at_a_larger_size(spark):
    """Recall: every row whose id is divisible by 20 against all rows; rows that are alike are in one component."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: set(m.shingles((t or "").encode()).tolist()) for i, t in rows}
    got = {r.id: r.component_id for r in m.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = [(a, b) for a in sets if a % 20 == 0 for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and all(got[a] == got[b] for a, b in links)


def test_parities_refute_no_link_and_most_others(spark):
    """Parities are a fraction of a set, bound the differing elements from below, and keep full sets of others from being moved."""
    rng = np.random.default_rng(5)
    one = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    rows, linked = [], []
    for shared in range(0, 401, 8):
        for n in (320, 400, 500):
            two = np.unique(np.concatenate([one[: min(shared, n)], rng.integers(0, 2**63, n - min(shared, n)).astype(np.uint64)]))
            both = len(np.intersect1d(one, two))
            linked.append(100 * both >= 80 * (len(one) + len(two) - both))
            rows.append((m.parities(one), m.parities(two), len(one) + len(two)))
    assert all(len(a) * 8 <= 4 * 400 for a, _, _ in rows)
    got = [r.may for r in spark.createDataFrame(rows, "a binary, b binary, n long").coalesce(1).select(m.may_be_close("a", "b", "n").alias("may")).collect()]
    assert any(linked) and all(may for may, is_ in zip(got, linked) if is_)
    assert sum(got) <= sum(linked) + 6
    # In blocks of unlike sizes: members 0 and 3 are alike, 1 is of their component, 2 is like none.
    sets = [one, one[:390], np.unique(rng.integers(0, 2**63, 390).astype(np.uint64)), np.concatenate([one, one[:1] + np.uint64(1)]), one[:30]]
    members = [(i, [0, 0, 2, 3, 4][i], i in (0, 2, 4), len(x), m.parities(np.unique(x))) for i, x in enumerate(sets)]
    assert m._possible(members, True) == [0, 1, 3] and m._possible(members, False) == [0, 3]
    assert m._possible(members[:3], True) == []
