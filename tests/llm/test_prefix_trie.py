import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from pyspark.sql import functions as F

from veilwork.llm import prefix_trie as p
from veilwork.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes by walking a dict of all prefixes."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += cost
            leaves[n[:d]] += n not in kids
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(n)) for n, m in members.items())


def made(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA + ", depth int, NODE string" if len(rows) and len(rows[0]) > 4 else SCHEMA)
    conv = F.col("conv_id")
    sequences, convs = p.rebuild(p.digests(df.repartition(5)), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    nodes = p.with_end_digests(*p.build(sequences, convs))
    order = lambda r: (*r[:2], -1 if r[2] is None else r[2], *r[3:])
    return sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=order)


def same(got, want):
    order = lambda r: (*r[:2], -1 if r[2] is None else r[2], *r[3:])
    assert got == sorted(want, key=order)


def conversations(seed, n, turns):
    rnd = random.Random(seed)
    out = []
    for c in rnd.sample(range(n * 3), n):
        for t in range(rnd.randrange(1, turns)):
            out.append((c, rnd.choice([t, t, t, None]) if t == 0 else t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "a b", "b", None, "", " \t", "c  d\ne", "long " * 50])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_against_brute_force(spark, seed):
    rows = conversations(seed, 70, 7)
    # Many equal conversations, a proper prefix of others, one without turns of its own, repeated rows, no conversation.
    rows += [(c, t, "user", "a") for c in range(1000, 1100) for t in range(3)]
    rows += [(2000, t, "user", "a") for t in range(2)] + [(2001, 0, "user", "x"), (3003, 0, "user", "only")] + [(4000, 5, "user", "twice")] * 4 + [(None, 0, "user", "lost")]
    same(made(spark, rows), brute(rows))


def test_one_long_conversation(spark):
    rows = [(7, t, "user", f"w {t % 3}") for t in range(3000)] + [(c, t, "user", f"w {t % 3}") for c in range(20, 40) for t in range(4)]
    got = made(spark, rows)
    assert len(got) > 2900
    long = [r for r in got if r[0] == 7 and r[1] > 10]
    assert all(r[3:7] == ((1, 0 if r[1] == max(x[1] for x in long) else 1, 1, 0)) for r in long)


def test_small_tables(spark):
    assert made(spark, []) == []
    one = [(5, 0, None, None, 1, "x")]
    same(made(spark, one), brute([r[:4] for r in one]))


def test_lists_in_pieces(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(0, 4000, 20)]
    monkeypatch.setattr(p, "PIECE", 7)
    df = spark.createDataFrame(rows, SCHEMA)
    nodes, lists = p.build(*p.rebuild(p.digests(df), F.col("conv_id"), F.lit(0), 3))
    assert lists.agg(F.max(F.size(F.split("ids", ","))), F.sum("n")).first()[:] == (7, 200)
    digest = hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert digest in {r.ends_sha256 for r in p.with_end_digests(nodes, lists).collect()}


def test_running_sums_over_ranges(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i, rnd.randrange(-(2**63), 2**63)) for i in range(5000)]
    got = p.running(spark.createDataFrame(rows, "k long, i long, v long").repartition(7), "k", ["i"], ["v"]).collect()
    total, rank = defaultdict(int), defaultdict(int)
    want = []
    for k, i, v in sorted(rows):
        rank[k] += 1
        total[k] = (total[k] + v + 2**63) % 2**64 - 2**63
        want.append((k, i, v, rank[k], total[k]))
    assert sorted(map(tuple, got)) == want


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = queries.op11_prefix_trie(spark, SF)
    assert df.columns == con.sql(queries.ORACLE_SQL["op11_prefix_trie"]).columns
    order = lambda r: tuple(map(str, r))
    got, want = sorted(map(tuple, df.collect()), key=order), sorted(con.sql(queries.ORACLE_SQL["op11_prefix_trie"]).fetchall(), key=order)
    assert got == want
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == sorted(brute(rows), key=order)
