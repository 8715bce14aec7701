"""Streams over small folders of Parquet files against plain Python."""

import uuid
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest

from pyspark.sql import functions as F

from veilwork.functions import geometry as G
from veilwork.operators import intake, review
from veilwork.operators.intake import RATE, WINDOW_SECONDS
from veilwork.streaming.intake import PROVIDER, intake_sink, stream_box_edits, stream_expiry, stream_intake_status, stream_rate_counts, stream_rate_limit, stream_retention

START = datetime(2024, 5, 1, tzinfo=UTC)
EVENTS = "event_id long, ip string, ts timestamp"
EDITS = "doc_id long, page_index long, box_id string, edit_seq long, op string, handle string, x1 double, y1 double, x2 double, y2 double, width double, height double"


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def read(spark, folder, schema, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def all_rows(spark, stream, folder, mode):
    name = "t" + uuid.uuid4().hex
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name).collect()


def test_rate_counts(spark, tmp_path):
    rows = [(i, f"ip{i % 3 if i % 4 else 0}", START + timedelta(seconds=7 * i)) for i in range(200)]
    got = all_rows(spark, stream_rate_counts(read(spark, tmp_path / "in", EVENTS, [rows[:120], rows[120:]])), tmp_path / "out", "complete")
    want = Counter((ip, int(ts.timestamp()) // WINDOW_SECONDS * WINDOW_SECONDS) for _, ip, ts in rows)
    assert {(r.ip, int(r.window_start.replace(tzinfo=UTC).timestamp() if r.window_start.tzinfo is None else r.window_start.timestamp())): (r.events, r.limited) for r in got} == {k: (n, max(0, n - RATE)) for k, n in want.items()}


def test_retention_keeps_one_record_for_each_key(spark, tmp_path):
    rows = [(i, f"ip{i % 4}", START + timedelta(seconds=i)) for i in range(40)]
    got = all_rows(spark, stream_retention(read(spark, tmp_path / "in", EVENTS, [rows[:20], rows[20:]]), "ip"), tmp_path / "out", "append")
    assert sorted(r.ip for r in got) == ["ip0", "ip1", "ip2", "ip3"]


def test_box_edits_fold_by_sequence(spark, tmp_path):
    edit = lambda box, seq, op, handle="", x1=0.0, y1=0.0, x2=0.0, y2=0.0: (1, 0, box, seq, op, handle, x1, y1, x2, y2, 200.0, 200.0)
    first = [edit("a", 2, "move", x1=5.0, y1=5.0), edit("a", 1, "draw", "", 10.0, 20.0, 50.0, 60.0), edit("b", 1, "draw", "", 1.0, 1.0, 1.5, 1.5), edit("c", 1, "draw", "", 190.0, 10.0, 150.0, 90.0)]
    second = [edit("a", 3, "resize", "se", 100.0, 120.0), edit("a", 2, "move", x1=90.0), edit("b", 2, "delete"), edit("c", 2, "delete")]
    got = all_rows(spark, stream_box_edits(read(spark, tmp_path / "in", EDITS, [first, second])), tmp_path / "out", "update")
    last = {r.box_id: tuple(r)[3:] for r in sorted(got, key=lambda r: r.edit_seq)}
    assert last["a"] == (15.0, 25.0, 85.0, 95.0, True, 3)
    assert last["b"][4:] == (False, 2)
    assert last["c"] == (150.0, 10.0, 40.0, 80.0, False, 2)


def in_time(files, delay, seconds=WINDOW_SECONDS):
    """Rows of files (ts last) that a stream of one file a batch takes, and the watermark at the end, in seconds."""
    mark, taken = 0, []
    for rows in files:
        taken += [r for r in rows if r[2].timestamp() >= mark]
        mark = max([mark, *(r[2].timestamp() - delay for r in rows)])
    return taken, mark


def test_rate_limit_decides_as_the_batch_does(spark, tmp_path):
    import random

    rnd = random.Random(4)
    at = lambda s: START + timedelta(seconds=s)
    # Three files in which events come out of order, repeated ones too, and one that comes when its window is closed.
    files = [[(100 * f + i, f"ip{rnd.randrange(3)}", at(150 * f + rnd.randrange(190))) for i in range(60)] for f in range(3)]
    files[1] += files[1][:5] + [(900, "ip0", at(1)), (901, "ip1", at(100))]
    files.append([(990, "ip9", at(2000))])
    got = all_rows(spark, stream_rate_limit(read(spark, tmp_path / "in", EVENTS, files)), tmp_path / "out", "append")
    taken, mark = in_time(files, 60)
    assert len(taken) < sum(map(len, files))
    batch = intake.rate_limit(spark.createDataFrame(taken, EVENTS)).collect()
    closed = lambda r: (int(r.ts.replace(tzinfo=r.ts.tzinfo or UTC).timestamp()) // WINDOW_SECONDS + 1) * WINDOW_SECONDS <= mark
    rows = lambda rs: Counter((r.event_id, r.ip, r.ts, r.limited) for r in rs)
    assert rows(r for r in got if closed(r)) == rows(r for r in batch if closed(r))
    assert sum(r.limited for r in got) > 20 and all(r.limited for r in got if not closed(r))


def test_expiry_is_what_retention_drops(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    files = [[(i, "", at(10 * i)) for i in range(20)], [(3, "", at(250)), *((i, "", at(10 * i)) for i in range(20, 40))]]
    stream = read(spark, tmp_path / "in", EVENTS, files).select("event_id", "ts")
    got = {r.event_id: r for r in all_rows(spark, stream_expiry(stream, "event_id", ttl=120, delay="60 seconds"), tmp_path / "out", "append")}
    last = {i: ts for rows in files for i, _, ts in rows}
    stored = spark.createDataFrame([(i, "", ts) for i, ts in last.items()], EVENTS)
    kept = {r.event_id for r in intake.retention(stored, F.lit(at(330)), 120).collect()}
    assert set(got) == set(last) - kept and 3 in kept and 0 in got
    assert all((r.expired - r.received).total_seconds() == 120 for r in got.values())


def test_box_edits_over_seeds(spark, tmp_path):
    import random

    rnd = random.Random(2)
    boxes = [f"auto-{i}" for i in range(6)] + ["b0", "b1"]
    seeds = spark.createDataFrame([(1, 0, b, (float(10 * i), 5.0, 30.0, 20.0)) for i, b in enumerate(boxes[:6])], f"doc_id long, page_index long, box_id string, box {G.BOX}")
    number = lambda top: float(rnd.randrange(top))
    rows = [(1, 0, rnd.choice(boxes[1:]), seq, rnd.choice(["draw", "move", "resize", "resize", "delete"] if seq % 5 == 0 else ["draw", "move", "resize"]), rnd.choice(["nw", "se", "e", "n"]), number(150), number(150), number(220), number(220), 200.0, 180.0) for seq in range(60)]
    got = all_rows(spark, stream_box_edits(read(spark, tmp_path / "in", EDITS, [rows[:25], rows[25:40] + rows[:3], rows[40:]]), seeds), tmp_path / "out", "update")
    last = {r.box_id: r for r in sorted(got, key=lambda r: r.edit_seq)}
    pages = spark.createDataFrame([(1, 0, 200, 180)], "doc_id long, page_index long, width long, height long")
    batch = {r.box_id: tuple(r.box) for r in review.fold_box_edits(seeds, spark.createDataFrame(rows, EDITS), pages).collect()}
    assert batch.pop("auto-0") == (0.0, 5.0, 30.0, 20.0)  # not edited, so the stream says nothing of it
    assert {b: (r.x, r.y, r.w, r.h) for b, r in last.items() if r.there} == batch


FORM = "event_id long, ts timestamp, ip string, origin string, method string, content_type string, body string"


def forms():
    good = '{"email":"a@b.example","company":"Acme","useCase":"Insurance"}'
    request = lambda i, s=0, ip="1.1.1.1", origin="https://site.example", method="POST", kind="application/json", body=good: (i, START + timedelta(seconds=s), ip, origin, method, kind, body)
    first = [request(1), request(2, ip="2.2.2.2", body="{}"), request(3, ip="3.3.3.3", body="x" * 5000), request(4, kind="text/plain"), request(5, method="GET"), request(6, origin="https://evil.example"), request(7, ip=""), request(8, method="OPTIONS")]
    second = [request(10 + i, 5 + i, ip="9.9.9.9") for i in range(7)]
    return [first, second, [request(90, 1000)]]


def test_intake_sink_is_idempotent(spark, tmp_path):
    folder, files = str(tmp_path / "sink"), forms()
    sink, batches = intake_sink(folder), []

    def write(batch, n):
        batches.append((n, batch.schema, batch.collect()))
        sink(batch, n)

    stream = stream_intake_status(read(spark, tmp_path / "in", FORM, files), ["https://site.example"])
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    tables = lambda: (sorted(map(str, spark.read.parquet(f"{folder}/accepted").collect())), sorted(map(str, spark.read.parquet(f"{folder}/rejected").collect())))
    before = tables()
    for n, schema, rows in batches:  # as after a failure between writing and the commit
        sink(spark.createDataFrame(rows, schema), n)
    assert tables() == before
    batch = intake.intake_status(spark.createDataFrame(sum(files[:2], []), FORM), ["https://site.example"]).collect()
    rejected = {r.event_id: r.status for r in spark.read.parquet(f"{folder}/rejected").collect()}
    accepted = {r.event_id: r.payload.email for r in spark.read.parquet(f"{folder}/accepted").collect()}
    assert rejected == {r.event_id: r.status for r in batch if r.status != 202}
    assert accepted == {r.event_id: "a@b.example" for r in batch if r.status == 202}
    assert set(rejected.values()) == {204, 400, 403, 405, 413, 415, 429, 503}


def test_expiry_of_records_that_share_a_bucket(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    # One group holds all: each record goes at its own time, and one that is written again while it is there lives on.
    files = [[(i, "", at(10 * i)) for i in range(10)], [(0, "", at(20)), (5, "", at(95)), (50, "", at(155))], [(60, "", at(160)), (1, "", at(161))], [(70, "", at(400))]]
    for buckets in (1, 3):
        stream = read(spark, tmp_path / f"in{buckets}", EVENTS, files).select("event_id", "ts")
        got = all_rows(spark, stream_expiry(stream, "event_id", ttl=100, buckets=buckets), tmp_path / f"out{buckets}", "append")
        seconds = lambda r: int(r.received.replace(tzinfo=r.received.tzinfo or UTC).timestamp() - START.timestamp())
        want = [(i, 10 * i) for i in range(2, 10) if i != 5] + [(0, 20), (5, 95), (50, 155), (60, 160), (1, 161)]
        assert sorted((r.event_id, seconds(r)) for r in got) == sorted(want)


def test_rate_limit_of_holders_that_share_a_bucket(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    files = [[(100 * w + 10 * k + i, f"ip{k}" if k else None, at(60 * w + i)) for w in range(4) for k in range(3) for i in range(4 + k)], [(999, "ip0", at(900))]]
    for buckets in (1, 2):
        stream = stream_rate_limit(read(spark, tmp_path / f"in{buckets}", EVENTS, files), buckets=buckets)
        got = all_rows(spark, stream, tmp_path / f"out{buckets}", "append")
        assert Counter((r.event_id, r.limited) for r in got) == Counter((e, e % 10 >= 5) for e, _, _ in files[0])
