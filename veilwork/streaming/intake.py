"""Structured Streaming twins of the intake and review operators.

Operators with state of their own need the RocksDB state store: set spark.sql.streaming.stateStore.providerClass to PROVIDER in the
session that starts the query. What is kept is bounded: as many events as the limit for an open window, one time for a record, both in
BUCKETS groups, and the edits of a box, which a reviewer's work bounds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilwork.functions import geometry as G
from veilwork.operators.detect import PAGE
from veilwork.operators.intake import DEPLOYED_TTL, RATE, WINDOW_SECONDS, early_status, late_status, parsed
from veilwork.operators.review import EDIT, folded_box, last_box

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times survive the way through JSON to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


#: Groups that keys are dealt over: what a call of a processor costs is paid for each group of a batch, not for each key. A group's state is read and
#: written as a whole.
BUCKETS = 4096


def _bucket(buckets: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def stream_rate_counts(events: DataFrame, key: str = "ip", ts: str = "ts", delay: str = "1 minute", seconds: int = WINDOW_SECONDS, limit: int = RATE) -> DataFrame:
    """Events of each key and fixed window, and how many of them are over the limit; late events up to `delay` count."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    counts = rows.groupBy(F.col(key), F.window("_ts", f"{seconds} seconds")).agg(F.count("*").alias("events"))
    return counts.select(key, F.col("window.start").alias("window_start"), "events", F.greatest(F.lit(0), F.col("events") - limit).alias("limited"))


class _Limiter(StatefulProcessor):
    """The first `limit` events of each open window of the holders in a bucket. An event that is behind so many others is limited whatever comes later, so it is
    given out at once; those that are kept are given out when the watermark closes their window. A bucket has one timer, for the first of its windows to close."""

    def __init__(self, seconds: int, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.windows = handle, handle.getValueState("windows", "kept string")

    def _held(self) -> dict[tuple[str, int], list]:
        return {(holder, start): kept for holder, start, kept in json.loads(self.windows.get()[0])} if self.windows.exists() else {}

    def _closes(self, windows: dict[tuple[str, int], list]) -> int | None:
        """When the first window closes, in ms."""
        return (min(start for _, start in windows) + self.seconds * 1_000_000) // 1000 if windows else None

    def _keep(self, windows: dict[tuple[str, int], list]) -> None:
        self.windows.update((json.dumps([[*at, kept] for at, kept in windows.items()]),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        closed, step, held = timerValues.getCurrentWatermarkInMs(), self.seconds * 1_000_000, self._held()
        before = self._closes(held)
        for batch in rows:
            fresh: dict[tuple[str, int], list] = {}
            for holder, micros, order, event in zip(batch["holder"], batch["micros"], batch["place"], batch["event"], strict=True):
                start = int(micros) // step * step
                # What comes when its window has been closed is no longer decided.
                if (start + step) // 1000 > closed:
                    fresh.setdefault((holder, start), []).append([int(micros), order, event])
            out = []
            for at, events in fresh.items():
                every = sorted(held.get(at, []) + events)
                out += every[self.limit :]
                held[at] = every[: self.limit]
            yield self._said(out, True)
        after = self._closes(held)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        if held:
            self._keep(held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, step, held = timerValues.getCurrentWatermarkInMs(), self.seconds * 1_000_000, self._held()
        over = [at for at in held if (at[1] + step) // 1000 <= now]
        yield self._said([e for at in over for e in held.pop(at)], False)
        if held:
            self._keep(held)
            self.handle.registerTimer(self._closes(held))
        else:
            self.windows.clear()

    @staticmethod
    def _said(events: list, limited: bool) -> pd.DataFrame:
        return pd.DataFrame({"event": pd.Series([e[2] for e in events], dtype=object), "limited": pd.Series([limited] * len(events), dtype=bool)})

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, key: str = "ip", ts: str = "ts", order: str = "event_id", limit: int = RATE, seconds: int = WINDOW_SECONDS, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Add limited to each event, once: as intake.rate_limit over all events that came before their window was closed.

    A window is closed when the watermark, the latest time seen less `delay`, has passed its end; events behind the watermark are left out. Repeated
    events count each. Limited events are given out at once, the others when their window closes. Windows of all holders are dealt over `buckets`
    groups, so neither many short windows nor a holder with most events make the work of one group long.
    """
    schema = events.schema
    time = F.col(ts).cast("timestamp")
    start = F.floor(F.unix_micros(time) / F.lit(seconds * 1_000_000)).cast("long")
    holder = F.to_json(F.struct(F.col(key).alias("key")))
    packed = events.select(
        _bucket(buckets, holder, start), holder.alias("holder"), time.alias("at"), F.unix_micros(time).alias("micros"), F.col(order).alias("place"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in schema.names)), _TIMES).alias("event")
    )
    decided = packed.withWatermark("at", delay).groupBy("bucket").transformWithStateInPandas(_Limiter(seconds, limit), "event string, limited boolean", "append", "EventTime")
    return decided.select(F.from_json("event", schema, _TIMES).alias("event"), "limited").select("event.*", "limited")


class _Keeper(StatefulProcessor):
    """The times of receipt of a bucket's records, until their time to live is over. A bucket has one timer, for the first of them to go."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.received = handle, handle.getValueState("received", "times string")

    def _held(self) -> dict[str, int]:
        return json.loads(self.received.get()[0]) if self.received.exists() else {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = min(held.values(), default=None)
        for batch in rows:
            for record, ms in zip(batch["holder"], batch["ms"].tolist(), strict=True):
                if ms > held.get(record, ms - 1):
                    held[record] = ms
        after = min(held.values())
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl)
            self.handle.registerTimer(after + self.ttl)
        self.received.update((json.dumps(held),))
        yield self._gone([], [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        gone = [record for record, ms in held.items() if ms + self.ttl <= now]
        yield self._gone(gone, [held.pop(record) for record in gone])
        if held:
            self.received.update((json.dumps(held),))
            self.handle.registerTimer(min(held.values()) + self.ttl)
        else:
            self.received.clear()

    @staticmethod
    def _gone(ids: list[str], times: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "ms": pd.Series(times, dtype="int64")})

    def close(self) -> None:
        pass


def stream_expiry(records: DataFrame, key: str, ts: str = "ts", ttl: int = DEPLOYED_TTL, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A row for each record when the watermark has passed its end: its key, received and expired, times to the millisecond.

    What was stored and is not given out is what intake.retention keeps at the watermark. A record that is written again lives from its latest
    receipt on. Records are dealt over `buckets` groups.
    """
    kind = records.schema[key].dataType
    time = F.col(ts).cast("timestamp")
    rows = records.where(F.col(key).isNotNull()).select(_bucket(buckets, F.col(key)), F.col(key).cast("string").alias("holder"), time.alias("at"), F.unix_millis(time).alias("ms")).withWatermark("at", delay)
    gone = rows.groupBy("bucket").transformWithStateInPandas(_Keeper(ttl), "id string, ms long", "append", "EventTime")
    return gone.select(F.col("id").cast(kind).alias(key), F.timestamp_millis("ms").alias("received"), F.timestamp_millis(F.col("ms") + ttl * 1000).alias("expired"))


def stream_retention(events: DataFrame, key: str, ts: str = "ts", ttl: int = DEPLOYED_TTL) -> DataFrame:
    """One record per key while its time to live lasts: the watermark drops the state of expired ones."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", f"{ttl} seconds").dropDuplicatesWithinWatermark([key])


class _Boxes(StatefulProcessor):
    """The seed of a box and its edits so far, by edit_seq; one that comes behind a larger edit_seq is left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.box, self.edits = handle.getValueState("box", "seed string"), handle.getValueState("edits", "edits string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.box.update((initialState["seed"].iloc[0],))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        edits = json.loads(self.edits.get()[0]) if self.edits.exists() else []
        last = edits[-1]["edit_seq"] if edits else None
        fresh = [e for batch in rows for e in batch.to_dict("records")]
        for e in sorted((json.loads(e["edit"]) for e in fresh), key=lambda e: e["edit_seq"]):
            if last is None or e["edit_seq"] > last:
                edits.append(e)
                last = e["edit_seq"]
        self.edits.update((json.dumps(edits),))
        seed = self.box.get()[0] if self.box.exists() else None
        row = (*key, seed, json.dumps(edits), fresh[0]["width"], fresh[0]["height"], last)
        yield pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in zip([*PAGE, "box_id", "seed", "edits", "width", "height", "edit_seq"], row, strict=True)})

    def close(self) -> None:
        pass


def stream_box_edits(edits: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Boxes after each batch of edits, by the rules of review.fold_box_edits: there is false where the edits leave none, and the box is then as it last was.

    edits: doc_id, page_index, box_id, edit_seq, op, handle, x1, y1, x2, y2, width, height. seeds, a table of doc_id, page_index, box_id
    and box (see review.seed_boxes), is the state that the stream begins with. Edits are folded by edit_seq; one that comes later than one of equal
    or larger edit_seq is left out, so that a repeated one does nothing.
    """
    key = [*PAGE, "box_id"]
    fields = [x.split(":")[0] for x in EDIT[7:-1].split(",")]
    rows = edits.select(*(F.col(c).cast("long").alias(c) for c in PAGE), "box_id", F.to_json(F.struct(*fields)).alias("edit"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    begin = None
    if seeds is not None:
        begin = seeds.select(*(F.col(c).cast("long").alias(c) for c in PAGE), "box_id", F.to_json("box").alias("seed")).groupBy(*key)
    out = "doc_id long, page_index long, box_id string, seed string, edits string, width double, height double, edit_seq long"
    kept = rows.groupBy(*key).transformWithStateInPandas(_Boxes(), out, "update", "None", begin)
    given = F.from_json("seed", G.BOX), F.from_json("edits", f"array<{EDIT}>"), F.col("width"), F.col("height")
    rows = kept.withColumns({"box": folded_box(*given), "last": last_box(*given)})
    return rows.select(*key, *(F.coalesce(F.col(f"last.{c}"), F.lit(0.0)).alias(c) for c in "xywh"), F.col("box").isNotNull().alias("there"), "edit_seq")


def stream_intake_status(events: DataFrame, origins: list[str], ttl: int | None = DEPLOYED_TTL, delay: str = "1 minute") -> DataFrame:
    """Add status, once for each request: at once where the limiter has no say or refuses, else when its window closes. See intake.intake_status."""
    rows = events.withColumn("early", early_status(origins, ttl))
    early = rows.where(F.col("early").isNotNull()).withColumn("status", F.col("early")).drop("early")
    through = stream_rate_limit(rows.where(F.col("early").isNull()).drop("early"), delay=delay)
    return early.unionByName(through.withColumn("status", late_status(F.col("limited"))).drop("limited"))


def intake_sink(folder: str, event_id: str = "event_id", ts: str = "ts", body: str = "body") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: accepted forms to folder/accepted, the others to folder/rejected without what they said.

    Each batch has a partition batch_id of its own in both, which a replayed batch writes anew: it changes nothing.
    """

    def table(batch: DataFrame, batch_id: int, name: str, test: Column, *columns: Column) -> None:
        batch.where(test).select(*columns).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/batch_id={batch_id}")

    def write(batch: DataFrame, batch_id: int) -> None:
        done = F.col("status") == 202
        batch = batch.persist()
        try:
            table(batch, batch_id, "accepted", done, F.col(event_id), F.col(ts), parsed(F.col(body)).alias("payload"))
            table(batch, batch_id, "rejected", ~done, F.col(event_id), F.col(ts), F.col("status"))
        finally:
            batch.unpersist()

    return write
