"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one for each partition and then added up, name every text that a large share of
the rows has. The named ones are counted exactly; the winners, fewer than `counters` by that count, are
broadcast, and their rows are settled where they are. All other texts are rare enough for an ordinary
shuffle by digest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import SPACE, KeyFilter, first_row, free_name, staged

#: Misra-Gries counters: texts that more than rows / (COUNTERS + 1) rows have go the heavy way.
COUNTERS = 1024


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def misra_gries(values: Iterator[list[bytes]], counters: int) -> dict[bytes, int]:
    """The summary of a stream that comes in batches: any value in more than n / (counters + 1) places is in it.

    A batch's counts are added, then the (counters + 1)-th largest is taken off all; what stays
    positive, at most `counters` values, is kept.
    """
    kept: Counter = Counter()
    for batch in values:
        kept.update(batch)
        if len(kept) > counters:
            off = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({v: n - off for v, n in kept.items() if n > off})
    return dict(kept)


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact (digest, group_size, keep_id) of each digest that more than rows / (counters + 1) rows have.

    At most `counters` rows, whatever the input: that bounds what is broadcast.
    """
    rows = digests.count()

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = misra_gries((b.column(0).to_pylist() for b in batches), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["digest", "seen"])

    named = (
        digests.select("digest").mapInArrow(summaries, "digest binary, seen long")
        .groupBy("digest").agg(F.sum("seen").alias("seen"))
        # Added summaries fall short of a value's count by rows / (counters + 1) at most, and never exceed it.
        .where(F.col("seen") * (counters + 1) > rows)
        .select("digest")
    )
    return (
        digests.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest").agg(F.count("*").alias("group_size"), F.min("id").alias("keep_id"))
        .where((F.col("group_size") > 1) & (F.col("group_size") * (counters + 1) > 2 * rows))
    )


def duplicate_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """For each row of df: id, digest (SHA-256 of the normalised text), keep_id, group_size, kept.

    Texts are equal when they are identical after each run of ASCII white space becomes one space; a null
    text counts as the empty one. The row with the smallest id stays. Rows that repeat both id and text
    share their flag, and each counts in group_size. A null id is larger than any other; where a group has
    only null ids, keep_id is null and its rows are kept. An empty table gives an empty table; other
    columns are not read. Texts are hashed whole in the scan and are never shuffled: only ids and digests are.
    """
    digests = staged(df.select(F.col(f"`{doc_id}`").alias("id"), digest_of(F.col(f"`{text}`")).alias("digest")), "digests")
    winners = staged(heavy_digests(digests, counters), "heavy")
    heavy = digests.join(F.broadcast(winners), "digest")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = light.join(light.groupBy("digest").agg(F.count("*").alias("group_size"), F.min("id").alias("keep_id")), "digest")
    columns = ["id", "digest", "keep_id", "group_size"]
    return heavy.select(columns).unionByName(light.select(columns)).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of df whose text no row with a smaller id has, all columns as they are.

    Rows are told apart by id and text, so rows that share an id lose no text. Of rows that repeat both,
    one stays, by a hash of its columns. Rows with a null id are all kept. See duplicate_groups for what counts as equal.
    Rows whose id and digest a filter of bounded size does not know stay where they are; only the others are
    joined with the dropped ones, so that few texts are shuffled.
    """
    copies = duplicate_groups(df, doc_id, text, counters).where((F.col("group_size") > 1) & F.col("id").isNotNull()).groupBy("id", "digest").agg(F.count("*").alias("n"), F.first("kept").alias("kept"))
    gone, digest = free_name(df, "touched"), free_name(df, "digest")
    touched = staged(copies.where(~F.col("kept") | (F.col("n") > 1)).select(F.struct("id", "digest").alias(gone), "kept"), "copies")
    rows = df.withColumn(digest, digest_of(F.col(f"`{text}`")))
    maybe = KeyFilter(touched.select(F.xxhash64(f"{gone}.id", f"{gone}.digest").alias("key"))).column(F.xxhash64(F.col(f"`{doc_id}`"), F.col(digest)))
    known = free_name(df, "known")
    rows = rows.withColumn(known, maybe)
    touched = touched.withColumnRenamed("kept", known)
    same = (F.col(f"`{doc_id}`") == F.col(f"{gone}.id")) & (F.col(digest) == F.col(f"{gone}.digest"))
    joined = rows.where(known).drop(known).join(touched, same, "left")
    columns = [F.col(f"`{c}`") for c in df.columns]
    stay = rows.where(~F.col(known)).select(columns).union(joined.where(F.col(gone).isNull()).select(columns))
    return stay.union(first_row(joined.where(known).drop(known), [gone], df.columns))
