import hashlib
from collections import Counter

import pytest

from veilwork.llm import sharding as s


def brute(names, slots):
    """Turns over whole permutations."""
    orders = []
    for n in names:
        h = hashlib.md5(n.encode()).digest()
        first, step = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1
        orders.append(iter([(first + k * step) % slots for k in range(slots)]))
    table = {}
    while len(table) < slots:
        for i, order in enumerate(orders):
            if len(table) < slots:
                table[next(x for x in order if x not in table)] = i
    return [table[k] for k in range(slots)]


@pytest.mark.parametrize("slots, shards", [(7, 3), (101, 7), (997, 20), (13, 13), (11, 1)])
def test_table_against_whole_permutations(slots, shards):
    names = [f"s{i}" for i in range(shards)]
    assert s.lookup_table(names, slots) == brute(names, slots)


def test_even_and_stable():
    names = [f"shard-{i}" for i in range(16)]
    table = s.lookup_table(names, 10_007)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = s.lookup_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 15)
    assert moved < 0.1 * 10_007
    weighted = Counter(s.lookup_table(names, 10_007, [3] + [1] * 15))
    assert abs(weighted[0] / weighted[1] - 3) < 0.1


@pytest.mark.parametrize("names, slots, weights", [([], 7, None), (["a"], 8, None), (["a", "a"], 7, None), (["a"], 7, [0]), (["a"], 7, [1, 1])])
def test_bad_parameters(names, slots, weights):
    with pytest.raises(ValueError):
        s.lookup_table(names, slots, weights)


def test_assignment(spark):
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (2, 8)], "doc_id long, slot int")
    out = s.assign_shards(df, names, slots=101)
    table = s.lookup_table(names, 101)
    want = {k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % 101 for k in (1, 2, None)}
    rows = out.collect()
    assert out.columns == ["doc_id", "slot", "shard"] and len(rows) == 4
    assert all(r.slot == want[r.doc_id] and r.shard == names[table[r.slot]] for r in rows)
    assert s.assign_shards(df.limit(0), names, slots=101).count() == 0


def test_salt_spreads_a_hot_key(spark):
    df = spark.range(2000).selectExpr("7L AS doc_id", "id AS row")
    shards = [f"s{i}" for i in range(8)]
    assert s.assign_shards(df, shards).select("shard").distinct().count() == 1
    spread = s.assign_shards(df, shards, salt="row", spread=64)
    assert spread.count() == 2000 and spread.select("shard").distinct().count() >= 6


def test_a_table_too_large_to_broadcast_is_refused(spark):
    with pytest.raises(ValueError, match="exceeds"):
        s.table_rows(spark, ["x" * (2 << 20), "y"], slots=101)


def test_written_shards(spark, tmp_path):
    rows = [(i if i % 9 else None, f"t{i}") for i in range(200)] + [(5, "t5")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shards = ["a", "b", "c"]
    path = str(tmp_path / "out")
    s.write_shards(df, path, files=2, key="doc_id", shards=shards)
    back = spark.read.parquet(path)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t) for i, t in rows)
    placed = {(r.doc_id, r.text): r.shard for r in s.assign_shards(df, shards).collect()}
    assert all(placed[r.doc_id, r.text] == r.shard for r in back.collect())


def test_query_against_whole_permutations(spark):
    from veilwork.llm.queries import op2_sharding

    sf = "/root/testdata/sf0.001"
    names = [f"shard-{n:04d}" for n in range(512)]
    table = brute(names, s.SLOTS)
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    slots = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % s.SLOTS for i in ids}
    got = sorted((r.doc_id, r.slot, r.shard) for r in op2_sharding(spark, sf).collect())
    assert got == sorted((i, slots[i], names[table[slots[i]]]) for i in ids)
