"""Near-duplicate grouping with SuperMinHash signatures, banding, verification on full sets and union-find.

Every element of a set deals itself over the signature in a random order of its own: in round j it offers
j plus a random fraction to the j-th place of its permutation, and a place keeps its least offer. Once all
places have an offer from an earlier round no later one can be lower, so rounds stop early. Because an
element visits each place once, the places of a signature are less alike by chance than independent
minima are.

Documents with the same set are one class from the start. Classes that agree in a band share a bucket.
Pairs are not formed within buckets: in each round a bucket has pivots, at first one, then twice as many,
and only members of another component than the pivot's are compared with it, by their full sets. A bucket
whose members are all in one component is done. Full sets move only for pairs that the parities of their elements, which
take a small part of the room, do not refute. After the last round every pair that shares a bucket has
been compared or is connected by confirmed links, so the components are those of all candidate links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.shared import KeyFilter, Scratch, broadcast_parameter, first_row, free_name, heavy_keys, join_one, spread_join, staged, tidy

#: Bands and rows of a band; pairs at a similarity of 0.8 are missed with a chance below 1 in 10,000.
BANDS, ROWS = 32, 6
#: Words of a shingle, and the least percentage of shared shingles.
SHINGLE, PERCENT = 4, 80

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(11).integers(0, 2**63, 64, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no pattern (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles; a text of fewer words, but some, is one shingle."""
    found = (text or b"").translate(FOLD).split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mixed(out * _ODD[0] + words[i : i + len(out)] + np.uint64(n))
    return np.unique(out)


def superminhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures of non-empty sets: for each place the least offer, its round in the upper and its fraction in the lower 32 bits."""
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Where places went: in round i an element put what stood at place i, came[i], to place went[i].
    went: list[np.ndarray] = []
    came: list[np.ndarray] = []
    for j in range(places):
        if not len(element):
            break
        r = mixed(element + _GOLDEN * np.array([j + 1], np.uint64))
        k = (j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(places - j) >> np.uint64(32))).astype(np.int16)
        place, own = k.copy(), np.full(len(k), j, np.int16)
        for w, c in zip(went, came, strict=True):
            np.copyto(place, c, where=w == k)
            np.copyto(own, c, where=w == j)
        place = np.where(k == j, own, place)
        went.append(k)
        came.append(own)
        at = owner * places + place
        open_ = flat[at] >= np.uint64(j << 32)
        np.minimum.at(flat, at[open_], np.uint64(j << 32) | (r[open_] >> np.uint64(32)))
        going = (out == np.iinfo(np.uint64).max).any(1)[owner]
        if not going.all():
            element, owner = element[going], owner[going]
            went, came = [w[going] for w in went], [c[going] for c in came]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for i in range(rows):
        key = mixed(key * _ODD[1] + parts[:, :, i])
    return key.astype(np.int64)


def set_features(df: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(id, text) to (id, n, set_key, bands): set size, a 128-bit key of the set (null if empty) and its band keys."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = [shingles(v.as_py(), size) for v in part.column("text")]
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                for i in some:
                    keys[i] = set_key(sets[i])
                # Sets that are equal within a part are signed once.
                once = {keys[i]: i for i in some}
                signed = dict(zip(once, band_keys(superminhash([sets[i] for i in once.values()], bands * rows), bands, rows) if once else [], strict=True))
                ends = np.cumsum([0, *(bands if k else 0 for k in keys)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *(signed[k] for k in keys if k)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["id", "n", "set_key", "bands"],
                )

    return df.mapInArrow(tidy(features), f"id {df.schema['id'].dataType.simpleString()}, n long, set_key binary, bands array<long>")


def set_key(elements: np.ndarray) -> bytes | None:
    """A 128-bit key of a set; null for the empty one."""
    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def shingle_sets(df: DataFrame, wanted: KeyFilter, size: int = SHINGLE) -> DataFrame:
    """(id, text) to (set_key, marks, elements), the sorted hashes of each whole text's shingles, for the ids that a filter lets pass.

    Texts without words are left out. marks: see parities.
    """
    may = wanted.test()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.filter(may(batch.column("place"))).column("text")
            for first in range(0, len(texts), 500):
                found = [x for x in (shingles(v.as_py(), size) for v in texts.slice(first, 500)) if len(x)]
                if found:
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int64)))
                    keys, marks = (pa.array([f(x) for x in found], pa.binary()) for f in (set_key, parities))
                    yield pa.RecordBatch.from_arrays([keys, marks, lists], ["set_key", "marks", "elements"])

    return df.select("text", wanted.place(F.xxhash64("id")).alias("place")).mapInArrow(tidy(sets), "set_key binary, marks binary, elements array<long>")


def parities(elements: np.ndarray) -> bytes:
    """A bit for each of two to four cells an element, a power of two of them: whether an odd number of elements is in the cell."""
    cells = 1 << max(6, int(2 * len(elements) - 1).bit_length())
    return np.packbits(np.bincount((elements & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(marks: bytes, size: int) -> np.ndarray:
    """Parities with as many bytes as asked for: cells that are equal modulo the smaller number are one."""
    return np.bitwise_xor.reduce(np.frombuffer(marks, np.uint8).reshape(-1, size), 0)


def _may_be_close(differing: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets with so many differing parities and so many elements in all can be alike enough.

    Each differing parity is an element at least that only one of them has, so no such pair is lost. With d of those elements
    and t in all, the shared part is (t - d) / (t + d).
    """
    return (100 - PERCENT) * total >= (100 + PERCENT) * differing


@F.arrow_udf(T.BooleanType())
def may_be_close(one: pa.Array, two: pa.Array, total: pa.Array) -> pa.Array:
    """By the parities of two sets and the number of their elements."""
    differing = []
    for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True):
        size = min(len(a), len(b))
        differing.append(int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum()))
    return pa.array(_may_be_close(np.array(differing, np.int64), total.to_numpy(zero_copy_only=False)))


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(up, up)
    return x


def _unite(parent: dict[int, int], a: int, b: int) -> bool:
    a, b = _root(parent, a), _root(parent, b)
    parent[max(a, b)] = min(a, b)
    return a != b


#: Nodes of one union-find within a task; more are done in several parts.
LOCAL_NODES = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, component): the smallest node that each linked node is connected with.

    Union-find within each task first replaces the links by those from each node to its local root. Then
    rounds pass the smaller label over each of these links to its ends and to the labels that they had, and
    labels take over their label's label, until none changes. What is shuffled is one row for each link and
    label, those of a heavy root or label spread over tasks; nothing but counts reaches the driver.
    """
    scratch = Scratch(links.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            pairs = [(x, _root(parent, x)) for x in list(parent)]
            pairs = [p for p in pairs if p[0] != p[1]]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["node", "root"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                _unite(parent, a, b)
            if len(parent) > LOCAL_NODES:
                yield out()
        yield out()

    stars = scratch.staged(links.select("a", "b").mapInArrow(tidy(local), "node long, root long").distinct(), "stars")
    roots = heavy_keys(stars, "root")
    ends = stars.select("node", F.col("root").alias("component")).unionByName(stars.select(F.col("root").alias("node"), F.col("root").alias("component")))
    labels = staged(ends.groupBy("node").agg(F.min("component").alias("component")), "labels")
    while True:
        last = Scratch(links.sparkSession)
        of = lambda name, out: labels.select(F.col("node").alias(name), F.col("component").alias(out))
        both = join_one(stars.join(of("node", "one"), "node"), of("root", "two"), "root", roots)
        least = F.least("one", "two")
        passed = both.where(F.col("one") != F.col("two")).select(F.explode(F.array("node", "root", "one", "two")).alias("node"), least.alias("component"))
        lower = last.staged(labels.unionByName(passed).groupBy("node").agg(F.min("component").alias("component")), "labels")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = staged(join_one(lower, jump, "component", heavy_keys(lower, "component")).select("node", F.col("next").alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where(F.col("component") != F.col("old")).limit(1).count()
        last.take(labels)
        last.clear()
        labels = new
        if not changed:
            scratch.clear()
            return labels


def _enough(shared: Column, one: Column, two: Column) -> Column:
    return 100 * shared >= PERCENT * (one + two - shared)


#: Members of a bucket that one task compares with each other, or with as many others.
BLOCK = 256


def _block_links(members: list[tuple[int, int, bool, np.ndarray]], same: bool) -> list[tuple[int, int]]:
    """Links between members (node, component, in the first block, elements) of different components, by exact
    intersection sizes; links that earlier ones connect are left out."""
    sizes = np.array([len(m[3]) for m in members])
    if same:
        left = right = np.arange(len(members))
    else:
        first = np.array([m[2] for m in members])
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
    if not len(left) or not len(right):
        return []
    elements, at, count = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(members)), sizes)
    often = count[at] > 1  # an element of one member is in no intersection
    used, at = np.unique(at[often], return_inverse=True)
    owner = owner[often]
    shared = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(used), 8192):
        own = (at >= begin) & (at < begin + 8192)
        matrix = np.zeros((len(members), min(8192, len(used) - begin)), np.float32)
        matrix[owner[own], at[own] - begin] = 1
        shared += matrix[left] @ matrix[right].T
    shared = np.rint(shared).astype(np.int64)
    total = sizes[left][:, None] + sizes[right][None, :]
    component = np.array([m[1] for m in members])
    close = (100 * shared >= PERCENT * (total - shared)) & (component[left][:, None] != component[right][None, :])
    parent: dict[int, int] = {}
    out = []
    for i, j in np.argwhere(close).tolist():
        a, b = members[left[i]], members[right[j]]
        if _unite(parent, a[1], b[1]):
            out.append((a[0], b[0]))
    return out


def _possible(members: list[tuple[int, int, bool, int, bytes]], same: bool) -> list[int]:
    """The nodes of members (node, component, in the first block, set size, parities) that another one, of another component, may be close to."""
    node, component, first, n = (np.array([m[i] for m in members]) for i in range(4))
    size = np.array([len(m[4]) for m in members])
    found = np.zeros(len(members), bool)
    for least in np.unique(size).tolist():
        # Sets of more than twice the cells have too many elements to be close.
        own = np.flatnonzero((size >= least) & (size <= 2 * least))
        marks = np.stack([_folded(members[i][4], least) for i in own])
        for row, i in enumerate(own.tolist()):
            if size[i] > least:
                continue
            meet = component[own] != component[i]
            if not same:
                meet &= first[own] != first[i]
            if meet.any():
                others = own[meet]
                close = _may_be_close(np.bitwise_count(marks[meet] ^ marks[row]).sum(1, dtype=np.int64), n[others] + n[i])
                found[others[close]] = True
                found[i] |= close.any()
    return np.unique(node[found]).tolist()


def _blocks_of(batches: Iterator[pa.RecordBatch], own: Callable[[pa.RecordBatch], Iterator], columns: list[str]) -> Iterator[tuple[tuple, list]]:
    """Members of each (bucket, one, two) of sorted rows: some columns, and what own takes from a batch."""
    key, members = None, []
    for batch in batches:
        for row, last in zip(zip(*(batch.column(c).to_pylist() for c in ("bucket", "one", "two", *columns)), strict=True), own(batch), strict=True):
            if row[:3] != key:
                if key:
                    yield key, members
                key, members = row[:3], []
            members.append((*row[3:], last))
    if key:
        yield key, members


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, one, two, first, node, component, elements): links within each (bucket, one, two)."""
    links = set()
    for key, members in _blocks_of(batches, lambda b: (e.values.to_numpy() for e in b.column("elements")), ["node", "component", "first"]):
        links.update(_block_links(members, key[1] == key[2]))
    links = sorted(links)
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, one, two, first, node, component, n, marks): the nodes of each bucket that may have links in a (bucket, one, two)."""
    for key, members in _blocks_of(batches, lambda b: iter(b.column("marks").to_pylist()), ["node", "component", "first", "n"]):
        if nodes := _possible(members, key[1] == key[2]):
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(nodes), pa.int64()), pa.array(nodes, pa.int64())], ["bucket", "node"])


def _met(groups: DataFrame, more: list[str]) -> DataFrame:
    """Rows of each pair of blocks of a bucket, sorted within the task that has them all."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") <= F.col("other")).alias("first"), "node", "component", *more)
    return rows.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")


def _links_within(groups: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between members (bucket, members, node, set_key, component) of each bucket, of different components, by full sets.

    Buckets of up to BLOCK members are compared in one task; larger ones are cut in blocks, each pair of blocks is compared. Parities
    move first, and full sets only of members that they leave a possible link.
    """
    groups = scratch.staged(groups.select("bucket", "members", "node", "set_key", "component"), "groups")
    marks = groups.join(sets.select("set_key", "marks", F.size("elements").alias("n")), "set_key")
    left = _met(marks, ["n", "marks"]).mapInArrow(tidy(_thin), "bucket long, node long").distinct()
    left = scratch.staged(groups.join(left, ["bucket", "node"]), "possible")
    return _met(left.join(_only(sets, left.select("set_key")), "set_key"), ["elements"]).mapInArrow(tidy(_compare), "a long, b long")


def _only(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(set_key, elements) of these keys, and some others that a filter of bounded size lets through."""
    wanted = KeyFilter(keys.select(F.xxhash64("set_key").alias("key")))
    return sets.where(wanted.column(F.xxhash64("set_key"))).select("set_key", "elements")


def _open(members: DataFrame) -> DataFrame:
    """(bucket, members) of the buckets (bucket, node, component) that are not in one component."""
    found = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    return found.where(F.col("low") != F.col("high")).select("bucket", "members")


#: About so many sets tell which elements are frequent: in one of FREQUENT of them. It bears on the work, not on results.
SAMPLE_SETS, FREQUENT = 512, 64


def _by_rare_elements(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets anew for (node, set_key, component) rows: sets that are alike enough share one of their rarest elements.

    Two sets that share 80 of 100 elements cannot differ in all of the n - ceil(0.8 n) + 1 first ones of any common order,
    n being the size of either. Elements that many of these sets have come last, so sets that merely come from one
    template, and are not alike, meet in few of these buckets.
    """
    rows = scratch.staged(members.join(_only(sets, members.select("set_key")), "set_key"), "large")
    share = max(1, rows.count() // SAMPLE_SETS)
    sample = rows.where(F.pmod(F.xxhash64("set_key"), F.lit(share)) == 0).select(F.explode("elements").alias("bucket"))
    often = sample.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") * FREQUENT > SAMPLE_SETS).orderBy(F.desc("n"), "bucket").limit(1 << 20)
    frequent = np.sort(often.toArrow().column("bucket").to_numpy())
    shared = broadcast_parameter(rows.sparkSession, frequent.tobytes(), frequent.nbytes)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            picked = []
            for v in batch.column("elements"):
                e = v.values.to_numpy()
                late = common[np.minimum(np.searchsorted(common, e), len(common) - 1)] == e if len(common) else np.zeros(len(e), bool)
                picked.append(e[np.lexsort((mixed(e.view(np.uint64)), late))[: len(e) + PERCENT * len(e) // -100 + 1]])
            owner = pa.array(np.repeat(np.arange(len(picked)), [len(x) for x in picked]))
            own = [batch.column(c).take(owner) for c in ("node", "set_key", "component")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *picked])), *own], ["bucket", "node", "set_key", "component"])

    return rows.select("node", "set_key", "component", "elements").mapInArrow(tidy(rarest), "bucket long, node long, set_key binary, component long")


def _groups(df: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """For each row of df: id, n, set_key and component_id. See near_duplicate_groups."""
    scratch = Scratch(df.sparkSession)
    source = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    features = staged(set_features(source, bands, rows, size), "features")
    known = features.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    classes = known.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    # A number for each class, which the written table fixes.
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", "set_key")
    # Buckets of two members or more; those with the same members count once.
    rows_of = classes.select("node", "n", F.explode("bands").alias("bucket"))
    counts = rows_of.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("sum"), F.min("node").alias("low")).where(F.col("members") > 1)
    counts = scratch.staged(counts.groupBy("members", "sum", "low").agg(F.min("bucket").alias("bucket")).select("bucket", "members"), "buckets")
    heavy = heavy_keys(counts, "bucket", "members")
    buckets = scratch.staged(join_one(rows_of, counts, "bucket", heavy), "members")
    degree = scratch.staged(buckets.groupBy("node").agg(F.sum("members").alias("degree")), "degree")
    # Sets of the members of buckets: a filter of bounded size names their ids, so that texts are shingled again, not shuffled.
    candidates = classes.join(degree, "node").select(F.xxhash64("rep").alias("key"))
    sets = scratch.staged(shingle_sets(source, KeyFilter(candidates), size), "sets")
    own = sets.select("set_key")
    if own.count() > own.distinct().count():  # rows that repeat an id or were let through by the filter
        sets = scratch.staged(sets.dropDuplicates(["set_key"]), "sets")
    # First all members of a bucket against its most central one.
    central = buckets.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("pivot"))
    central = central.select("bucket", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"))
    pairs = join_one(buckets, central, "bucket", heavy).where((F.col("node") != F.col("pivot")) & (100 * F.least("n", "pivot_n") >= PERCENT * F.greatest("n", "pivot_n")))
    pairs = scratch.staged(pairs.select("node", "pivot").distinct(), "pairs")
    pivots = keys.select(F.col("node").alias("pivot"), F.col("set_key").alias("pivot_key"))
    pairs = scratch.staged(join_one(pairs, pivots, "pivot", heavy_keys(pairs, "pivot")).join(keys, "node"), "pairs")
    # Pairs that parities refute go before full sets move.
    size = F.size("elements").alias
    one, two = sets.select("set_key", size("n"), F.col("marks").alias("one")), sets.select(F.col("set_key").alias("pivot_key"), size("pivot_n"), F.col("marks").alias("two"))
    compared = spread_join(pairs.join(one, "set_key"), two, "pivot_key", heavy_keys(pairs, "pivot_key"))
    pairs = scratch.staged(compared.where(may_be_close("one", "two", F.col("n") + F.col("pivot_n"))).select(pairs.columns), "pairs")
    full = _only(sets, pairs.select("set_key").unionByName(pairs.select(F.col("pivot_key").alias("set_key"))))
    one, two = full.withColumnRenamed("elements", "one"), full.select(F.col("set_key").alias("pivot_key"), F.col("elements").alias("two"))
    compared = spread_join(pairs.join(one, "set_key"), two, "pivot_key", heavy_keys(pairs, "pivot_key"))
    close = _enough(F.size(F.array_intersect("one", "two")), F.size("one"), F.size("two"))
    links = scratch.staged(compared.where(close).select(F.col("node").alias("a"), F.col("pivot").alias("b")), "links")
    # Then buckets that are not in one component.
    placed = buckets.select("bucket", "members", "node").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    opened = scratch.staged(_open(placed), "open")
    small, large = (opened.where(c).select("bucket") for c in (F.col("members") <= BLOCK, F.col("members") > BLOCK))
    more = _links_within(placed.join(small, "bucket", "left_semi").join(keys, "node"), sets, scratch)
    if not large.isEmpty():
        members = placed.join(large, "bucket", "left_semi").select("node", "component").distinct().join(keys, "node")
        anew = scratch.staged(_by_rare_elements(members, sets, scratch), "anew")
        more = more.unionByName(_links_within(join_one(anew, _open(anew), "bucket", heavy_keys(anew, "bucket")), sets, scratch))
    joined = components(scratch.staged(links.unionByName(more), "links"))
    # The smallest id of each component, then of each class, then of each row.
    own = classes.select("node", "set_key", "rep", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = scratch.staged(own, "own")
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = staged(join_one(own, least, "component", heavy_keys(own, "component")).select("set_key", "copies", "component_id"), "named")
    scratch.clear()
    often = heavy_keys(named, "set_key", "copies")
    out = join_one(known.select("id", "n", "set_key"), named.select("set_key", "component_id"), "set_key", often).select("id", "n", "set_key", "component_id")
    return out.unionByName(features.where(F.col("set_key").isNull() | F.col("id").isNull()).select("id", "n", "set_key", F.col("id").alias("component_id")))


def near_duplicate_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of df: id, n_shingles, component_id (the smallest id that links lead to), kept (id = component_id).

    A text's words are runs of other characters than ASCII white space, A-Z lower-cased; its set are the
    distinct shingles of `size` words, or all words as one where there are fewer. Documents that share a
    band and at least 80 of 100 shingles are linked, as are those with equal sets. Null and empty texts have
    no shingles and no links. Ids may have any type that can be ordered. Rows that repeat an id are each linked by their own
    text; those with a null id are in no component and are kept. An empty table gives an empty table; other columns are not read.

    Equal sets are one class, however many copies there are; only classes are in buckets. In each bucket all are compared first with
    the member that shares most buckets. Buckets that this does not connect are compared exactly, for links between their
    components alone: small ones each in a task, the members of larger ones in buckets by their rarest elements.
    """
    out = _groups(df, doc_id, text, size, bands, rows)
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of df that are the smallest of their component, with all columns; shingles have five words here.

    Rows with a null id and those without words are kept. Where rows share an id, each is judged by its own text, so no text goes
    for another's sake; of those that also have the same shingles one stays. See near_duplicate_groups.
    Rows whose id a filter of bounded size does not know stay where they are; the others are joined by id.
    """
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    flags = _groups(df, doc_id, text, size, bands, rows).where(F.col("id").isNotNull() & F.col("set_key").isNotNull()).select("id", "set_key", kept.alias("kept"))
    flags = flags.groupBy("id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"), F.collect_set(F.when(F.col("kept"), F.col("set_key"))).alias("sets"))
    gone, key, known = (free_name(df, x) for x in ("touched", "set_key", "known"))
    touched = staged(flags.where(~F.col("kept") | (F.col("n") > 1)).select(F.struct("id", (F.col("n") > 1).alias("several"), "sets").alias(gone)), "touched")
    rows_ = df.withColumn(known, KeyFilter(touched.select(F.xxhash64(f"{gone}.id").alias("key"))).column(F.xxhash64(F.col(f"`{doc_id}`"))))
    joined = rows_.where(known).drop(known).join(touched, F.col(f"`{doc_id}`") == F.col(f"{gone}.id"), "left")

    @F.arrow_udf("binary")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([set_key(shingles(v.as_py(), size)) for v in batch], pa.binary())

    columns = [F.col(f"`{c}`") for c in df.columns]
    stay = rows_.where(~F.col(known)).select(columns).union(joined.where(F.col(gone).isNull()).select(columns))
    several = joined.where(F.col(f"{gone}.several")).withColumn(key, keys(F.col(f"`{text}`").cast("binary")))
    stay = stay.union(several.where(F.col(key).isNull()).select(columns))
    return stay.union(first_row(several.where(F.array_contains(f"{gone}.sets", F.col(key))), [doc_id, key], df.columns))
