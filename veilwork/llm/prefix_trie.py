"""The trie of conversation prefixes by whole-sequence collapse.

Equal conversations become one weighted sequence with the list of those that end there; sequences that are a proper
prefix of another go by an anti-join, what is left are the leaves; prefixes of the weighted sequences are summed up to nodes.

Only digests move: a turn is its SHA-256 digest (16 bytes of it) and its number of words, and a prefix is named by the sum
of position-tagged hashes of its turns (two sums modulo 2^64), which tasks compute apart and add up. So a conversation of any length is dealt over
many tasks. Sums over a node's subtree need no walk through it: words that members spend are a weighted sum of what is left
of each sequence, words of distinct nodes are counted once, by the smallest member, whose nodes are an unbroken end of its sequence.

Null roles and texts count as empty, rows without conversation are left out, turns that are equal in number go by digest, repeated rows
are turns of their own. An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.shared import broadcast_parameter, heavy_keys, join_one, staged, tidy

#: Ids of one list that a row holds at most; longer lists have several rows.
PIECE = 4096
ROOT = bytes(16)


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a and b (the turn's digest), words (of the text, parted by ASCII white space) and tie, which tells equal turns apart, from conv_id, turn, role, text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", said("role"), said("text"), F.monotonically_increasing_id().alias("tie"))
    fields = [rows.schema["conv_id"], rows.schema["turn"], *(T.StructField(c, T.LongType()) for c in ("a", "b", "words", "tie"))]

    @tidy
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words = bytearray(), []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                names += hashlib.sha256(b"%d:%b%b" % (len(role), role, text)).digest()[:16]
                words.append(len(text.split()))  # bytes are split at ASCII white space, as words are
            halves = np.frombuffer(bytes(names), np.int64).reshape(-1, 2)
            columns = [batch.column("conv_id"), batch.column("turn"), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(words, pa.int64()), batch.column("tie")]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "a", "b", "words", "tie"])

    return rows.mapInArrow(short, T.StructType(fields))


def _restarts(keys: pa.Array) -> np.ndarray:
    """Where a sorted column takes a new value, the first row included."""
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def running(rows: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """Add rank (from 1) and, for each of sums, its running sum modulo 2^64, within key by order: <name>_sum.

    Rows are dealt by ranges of key and order, summed up within each range, and moved by what earlier ranges hold of the
    range's first key; of that the driver gets one short row for each range, as many as there are shuffle partitions.
    No task holds a key's rows together. The ranges are written, so that what a lost executor held is dealt alike.
    """
    names, made = rows.columns, ["rank", *(f"{c}_sum" for c in sums)]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in [*made, "part"])])
    at_key, at_sums = names.index(key), [names.index(c) for c in sums]

    @tidy
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, np.zeros(len(made), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(at_key)
            starts = _restarts(keys)
            lengths = np.diff(np.append(starts, len(keys)))
            values = np.stack([np.ones(len(keys), np.int64), *(batch.column(i).to_numpy() for i in at_sums)])
            total = np.cumsum(values, axis=1)
            before = np.concatenate([np.zeros((len(made), 1), np.int64), total], axis=1)[:, starts]
            if keys[0] == last:
                before[:, 0] -= carry
            total -= np.repeat(before, lengths, axis=1)
            last, carry = keys[len(keys) - 1], total[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, total), pa.array(np.full(len(keys), part))], [*names, *made, "part"])

    ranged = staged(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(local, schema), "running")
    ends = ranged.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(key, *made)).alias("last")).orderBy("part").collect()
    shift, held, own = {}, np.zeros(len(made), np.int64), None
    for r in ends:
        tail = np.array(r["last"][1:], np.int64)
        if r["first"] == own:
            shift[r["part"]] = (own, held)
        held = held + tail if r["last"][0] == own else tail
        own = r["last"][0]
    shared = broadcast_parameter(rows.sparkSession, shift, 256 * len(shift))

    @tidy
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(len(names) + len(made)).to_numpy()
            values = [batch.column(len(names) + i).to_numpy().copy() for i in range(len(made))]
            for part in np.unique(parts).tolist():
                if part in shared.value:
                    first, more = shared.value[part]
                    here = (parts == part) & pc.equal(batch.column(at_key), pa.scalar(first, batch.schema.field(at_key).type)).to_numpy(zero_copy_only=False)
                    for v, m in zip(values, more, strict=True):
                        v[here] += m
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, values)], [*names, *made])

    return ranged.mapInArrow(move, T.StructType(schema.fields[:-1])) if shift else ranged.drop("part")


def rebuild(turns: DataFrame, opened_by: Column, shared_turns: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as others do: (conv_id, depth, a, b, words) and all conv_ids.

    turns: see digests. Of conversation opened_by, a column of conv_id, the first shared_turns (`most` at most) come first, all
    if it has fewer and none if it is not there; what the conversation has behind its own first shared_turns follows.
    """
    ranked = running(staged(turns, "turns"), "conv_id", ["turn", "a", "b", "tie"], []).select("conv_id", "rank", "a", "b", "words")
    convs = staged(ranked.groupBy("conv_id").agg(F.max("rank").alias("own")), "convs")
    plan = convs.select("conv_id", opened_by.alias("opener"), shared_turns.cast("long").alias("shared"))
    plan = plan.join(convs.select(F.col("conv_id").alias("opener"), F.col("own").alias("there")), "opener", "left").withColumn("head", F.least("shared", F.coalesce("there", F.lit(0).cast("long"))))
    openers = ranked.where(F.col("rank") <= most).withColumnRenamed("conv_id", "opener")
    heads = plan.join(openers, "opener").where(F.col("rank") <= F.col("head")).select("conv_id", F.col("rank").alias("depth"), "a", "b", "words")
    tails = join_one(ranked, plan.select("conv_id", "shared", "head"), "conv_id", heavy_keys(convs, "conv_id", "own")).where(F.col("rank") > F.col("shared"))
    return heads.unionByName(tails.select("conv_id", (F.col("rank") - F.col("shared") + F.col("head")).alias("depth"), "a", "b", "words")), convs.select("conv_id")


def prefixes(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, words, spent (words up to there), node and parent (names of the prefixes with and without the last turn), from conv_id, depth, a, b, words."""
    lane = lambda n: F.xxhash64(F.lit(n), "depth", "a", "b")
    rows = running(sequences.select("conv_id", "depth", "words", lane(1).alias("x"), lane(2).alias("y")), "conv_id", ["depth"], ["x", "y", "words"])

    @tidy
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, sx, sy = (b.column(c).to_numpy() for c in ("x", "y", "x_sum", "y_sum"))
            names = (pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.stack(p, axis=1).tobytes())]).cast(pa.binary()) for p in ((sx, sy), (sx - x, sy - y)))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), b.column("words"), b.column("words_sum"), *names], ["conv_id", "depth", "words", "spent", "node", "parent"])

    conv = rows.schema["conv_id"]
    fields = [conv, *(T.StructField(c, T.LongType()) for c in ("depth", "words", "spent")), *(T.StructField(c, T.BinaryType()) for c in ("node", "parent"))]
    return rows.mapInArrow(name, T.StructType(fields))


def collapse(ended: DataFrame) -> DataFrame:
    """Lists of equal sequences: node, conv_id (the first of a piece), n and ids (decimal, ascending, joined by commas), in pieces of PIECE at most.

    ended: node and conv_id of each conversation's whole sequence. Pieces are made within ranges of both, so a sequence that very many share is dealt over tasks.
    """
    conv = ended.schema["conv_id"]

    @tidy
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(node: bytes, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([ids[0]], kind), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "conv_id", "n", "ids"])

        node, ids, kind = None, [], None
        for batch in batches:
            kind, out = batch.schema.field(1).type, []
            nodes, convs = batch.column(0), batch.column(1)
            starts = _restarts(nodes).tolist()
            for a, b in zip(starts, [*starts[1:], len(nodes)], strict=True):
                if (now := nodes[a].as_py()) != node:
                    out += [whole(node, ids)] if ids else []
                    node, ids = now, []
                ids += convs[a:b].to_pylist()
                while len(ids) >= PIECE:
                    out.append(whole(node, ids[:PIECE]))
                    ids = ids[PIECE:]
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield whole(node, ids)

    schema = T.StructType([T.StructField("node", T.BinaryType()), conv, T.StructField("n", T.LongType()), T.StructField("ids", T.StringType())])
    return ended.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, schema)


def list_digests(lists: DataFrame) -> DataFrame:
    """node and ends_sha256, the SHA-256 of each whole list of ids, from pieces (see collapse).

    SHA-256 goes through a list from its first id to its last, so one task does that for a list, piece by piece, and holds one batch of pieces.
    """

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != node:
                    done += [(node, state.hexdigest())] if state else []
                    node, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    return lists.select("node", "ids", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(hashed, "node binary, ends_sha256 string")


def build(sequences: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, lists): sequences are conv_id, depth from 1 on, a, b, words; convs all conv_ids, those without turns too.

    nodes: node, parent, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, words (of the last turn), saved_tokens.
    lists: see collapse.
    """
    zero = F.lit(0).cast("long")
    rows = staged(prefixes(sequences), "prefixes")
    whole = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "node", "spent")).alias("last"))
    ended = convs.join(whole, "conv_id", "left").select("conv_id", F.coalesce("last.node", F.lit(ROOT)).alias("node"), F.coalesce("last.spent", zero).alias("total"), F.coalesce("last.depth", zero).alias("size"))
    ended = staged(ended, "ended")
    lists = staged(collapse(ended), "lists")

    # One weighted sequence for equal ones; those that another one goes on from are no leaves.
    counted = lists.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    weighted = counted.join(ended.select("conv_id", "total", "size"), "conv_id")
    inner = rows.select(F.col("parent").alias("node")).distinct()
    weighted = weighted.join(inner, "node", "left_anti").withColumn("leaf", F.lit(1).cast("long")).unionByName(weighted.join(inner, "node", "left_semi").withColumn("leaf", zero))
    weighted = staged(weighted, "weighted")

    # Prefixes of the weighted sequences, the empty one included. Long sequences are heavy keys.
    heavy = heavy_keys(weighted, "conv_id", "size")
    paths = join_one(rows, weighted.select("conv_id", "n", "total", "leaf"), "conv_id", heavy)
    root = weighted.select("conv_id", zero.alias("depth"), zero.alias("words"), zero.alias("spent"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), "n", "total", "leaf")
    paths = staged(paths.unionByName(root).withColumn("left", F.col("total") - F.col("spent") + F.col("words")), "paths")
    nodes = paths.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.max("words").alias("words"), F.sum(F.col("n") * F.col("left")).alias("spent"),
    )
    nodes = staged(nodes, "nodes")

    # Words of distinct nodes: each node is counted by its smallest member, whose own nodes are those from some depth on.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("words").alias("owned"))
    once = join_one(paths, owned, "conv_id", heavy).groupBy("node").agg(F.sum(F.when(F.col("depth") >= F.col("since"), F.col("left")).otherwise(F.col("owned"))).alias("once"))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    upper = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    lower = nodes.where(F.col("parent").isNotNull())
    placed = join_one(lower, upper, "parent", heavy_keys(lower, "parent"))
    placed = placed.unionByName(nodes.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast(nodes.schema["conv_id"].dataType)))
    out = placed.join(children, "node", "left").join(once, "node")
    out = out.select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "words", (F.col("spent") - F.col("once")).alias("saved_tokens")
    )
    return out, lists


def with_end_digests(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """Nodes with ends_sha256, of the empty list where no conversation ends."""
    return nodes.join(list_digests(lists), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
