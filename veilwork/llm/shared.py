"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of the word rules.
SPACE = r"[\x20\x09-\x0D]+"

#: Vocabularies and other parameters up to this size may be broadcast.
MAX_BROADCAST_BYTES = 64 << 20

_BUILT: dict[Any, Any] = {}


def once_per_worker(key: Any, build: Callable[[], Any]) -> Any:
    """What build() gives, built once in each Python worker. A worker keeps the two last used, as many as one task
    needs: Spark hands workers on from stage to stage, so what they keep adds up over a pipeline."""
    found = _BUILT.pop(key) if key in _BUILT else None
    if found is None:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        found = build()
    _BUILT[key] = found
    return found


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that gives freed memory back to the system when it ends: Spark hands its worker on to later stages."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def broadcast_parameter(spark: SparkSession, value: Any, n_bytes: int) -> Broadcast:
    """Broadcast a parameter whose size has been measured; larger ones are an error."""
    if n_bytes > MAX_BROADCAST_BYTES:
        raise ValueError(f"a parameter of {n_bytes} bytes exceeds {MAX_BROADCAST_BYTES}")
    return spark.sparkContext.broadcast(value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a local master gets a new temporary folder; a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + once_per_worker("shared_folder", lambda: tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/veilwork-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables that are removed together, when what was computed from them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        self.take(out)
        return out

    def take(self, table: DataFrame) -> None:
        """Have a staged table removed with the others."""
        self.paths += {f.rsplit("/", 1)[0] for f in table.inputFiles()}

    def clear(self) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


#: Keys with more than one in so many rows are heavy; there are fewer than that of them.
HEAVY = 1024
#: Tasks over which a heavy key is dealt.
SPREAD = 64


def heavy_keys(df: DataFrame, key: str, weight: str | None = None) -> list:
    """The values of a column that more than one in HEAVY rows have (rows counted by a weight column, if one is named), so
    fewer than HEAVY values."""
    n = F.count("*") if weight is None else F.sum(weight)
    total = df.agg(n).first()[0] or 0
    return [r[0] for r in df.groupBy(key).agg(n.alias("n")).where(F.col("n") * HEAVY > total).select(key).collect()]


def join_one(many: DataFrame, one: DataFrame, key: str, heavy: list) -> DataFrame:
    """Inner join of rows with the one short row of their key: those of heavy keys, fewer than HEAVY, are broadcast."""
    if not heavy:
        return many.join(one, key)
    hot = F.col(key).isin(heavy)
    return many.where(~hot).join(one.where(~hot), key).unionByName(many.where(hot).join(F.broadcast(one.where(hot)), key))


def spread_join(many: DataFrame, one: DataFrame, key: str, heavy: list) -> DataFrame:
    """Inner join of rows with the one row of their key, which may be long: rows of heavy keys are dealt over SPREAD tasks."""
    if not heavy:
        return many.join(one, key)
    part, hot = _free([*many.columns, *one.columns], "part"), F.col(key).isin(heavy)
    left = many.withColumn(part, F.when(hot, F.pmod(F.xxhash64(*many.columns), F.lit(SPREAD))).otherwise(F.lit(0).cast("long")))
    copies = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return left.join(one.withColumn(part, F.explode(copies)), [key, part]).drop(part)


#: The most bits of a filter: what is broadcast is 8 MB at most.
FILTER_BITS = 1 << 26


class KeyFilter:
    """A test whether a 64-bit key may be among `keys` (a column key), to be confirmed by a join.

    It is right for each key that is, and lets one in 64 others pass. From most / 64 keys on it lets more pass, up to
    all, so that it thins less but never loses a row.
    """

    def __init__(self, keys: DataFrame, most: int = FILTER_BITS):
        self.bits = min(most, max(1 << 16, 1 << (64 * keys.count()).bit_length()))
        words = keys.select(self.place(F.col("key")).alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")).alias("bits")).toArrow()
        flags = np.zeros(self.bits // 32, np.int64)
        flags[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.shared = broadcast_parameter(keys.sparkSession, flags.astype(np.uint32).tobytes(), self.bits // 8)

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def test(self) -> Callable[[pa.Array], pa.Array]:
        """For tasks: whether keys at these places may be among them."""
        shared = self.shared

        def may(places: pa.Array) -> pa.Array:
            bit = places.to_numpy(zero_copy_only=False)
            return pa.array((np.frombuffer(shared.value, np.uint32)[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool))

        return may

    def column(self, key: Column) -> Column:
        may = self.test()

        @F.arrow_udf("boolean")
        def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from map(may, batches)

        return passes(self.place(key))


def first_row(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each value of keys, by a hash of the columns that can be hashed; summed up before the shuffle."""
    own = free_name(rows, "row")
    order = F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema.fields if f.name in columns and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))))
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in columns)), order).alias(own))
    return picked.select(*(F.col(f"{own}.`{c}`") for c in columns))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the case."""
    return _free(df.columns, base)


def _free(columns: list[str], base: str) -> str:
    taken = {c.lower() for c in columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name
