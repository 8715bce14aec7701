"""Repeated tokens, band recovery and anonymous numbers."""

from pyspark.sql import functions as F

from veilwork.functions.checksum import INVERSE, fold, verhoeff_valid12
from veilwork.operators import detect, passes, reports
from veilwork.sources.staging import written

BODY = "23412341234"
ID = BODY + str(INVERSE[fold([BODY], 1)[0][0]])
TOKEN = "doc_id long, page_index long, line_id long, token_seq int, text string, x double, y double, w double, h double, confidence double"
PAGES = "doc_id long, page_index long, width long, height long"


def token(line, x, y, w=120.0, h=20.0, text=ID, page=0):
    return (1, page, line, 0, text, float(x), float(y), float(w), float(h), 0.9)


def test_equal_tokens_stay_two(spark):
    rows = spark.createDataFrame([token(0, 20, 5), token(0, 20, 5)], TOKEN)
    assert detect.detect_id12_inline(rows).count() == 2


def test_first_valid_candidate_of_a_token(spark):
    rows = spark.createDataFrame([token(0, 20, 5, 300, 20, f"123456789012 {ID}"), token(1, 20, 5, text="123456789012")], TOKEN)
    assert [r.value for r in detect.detect_id12_inline(rows).collect()] == [ID]


def recovered(spark, full, bands):
    full = spark.createDataFrame(full, TOKEN) if full else spark.createDataFrame([], TOKEN)
    bands = spark.createDataFrame([(*t, b) for b, t in bands], TOKEN + ", band int")
    pages = spark.createDataFrame([(1, 0, 1000, 600)], PAGES)
    current = written(detect.numbered(detect.detect_text(full)), "current")
    new = passes.recover_from_bands(full, bands, current, pages)
    merged = passes.merge_recovery(current, new)
    boxes = lambda df: sorted((r.bbox.x, r.bbox.y, r.bbox.w, r.suspicious) for r in df.collect())
    return boxes(new), boxes(merged)


def test_one_id_read_in_two_bands_is_one(spark):
    new, merged = recovered(spark, [], [(0, token(1000, 20, 200)), (1, token(2000, 22, 201))])
    assert new == merged == [(20.0, 200.0, 120.0, False)]


def test_suspicious_id_gives_way_to_its_clean_twin(spark):
    wide = token(0, 20, 100, 900, 40)
    new, merged = recovered(spark, [wide], [(0, token(1000, 600, 105))])
    assert new == merged == [(600.0, 105.0, 120.0, False)]


def test_suspicious_id_elsewhere_stays(spark):
    new, merged = recovered(spark, [token(0, 20, 100, 900, 40)], [(0, token(1000, 600, 400))])
    assert merged == [(20.0, 100.0, 900.0, True), (600.0, 400.0, 120.0, False)]


def test_page_with_a_clean_id_is_left_alone(spark):
    new, merged = recovered(spark, [token(0, 20, 100)], [(0, token(1000, 600, 400))])
    assert new == [] and merged == [(20.0, 100.0, 120.0, False)]


def test_steps_are_read_once_unless_bands_tangle(spark, monkeypatch):
    """Tokens go to detection once, not once a step; on a page whose bands share lines each step is read on its own, as the lines then are others in each."""
    parts = [token(1000, x, 200, 40, text=ID[i : i + 4]) for i, x in ((0, 20), (4, 80), (8, 140))]
    seen, real = [], passes.detect_text_steps
    monkeypatch.setattr(passes, "detect_text_steps", lambda rows, steps: seen.append(rows.count()) or real(rows, steps))
    assert recovered(spark, [], [(0, t) for t in parts])[0] == [(20.0, 200.0, 160.0, False)] and seen == [3]
    # A token of band 1 between those of band 0, on the same line: the id is there in the first step only.
    new, _ = recovered(spark, [], [*((0, t) for t in parts), (1, token(1000, 70, 200, 5, text="-"))])
    assert new == [(20.0, 200.0, 160.0, False)] and seen == [3, 3 + 4 + 4]
    # Behind them, on a line of its own, it takes nothing away.
    assert recovered(spark, [], [*((0, t) for t in parts), (1, token(2000, 70, 200, 5, text="-"))])[0] == [(20.0, 200.0, 160.0, False)]


def test_numbers_of_many_samples_are_each_used_once(spark):
    n = 100_000
    docs = spark.range(n).select(F.format_string("name %08d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("name"), F.col("id").alias("doc_id"), F.lit(1).alias("num_pages")).repartition(64)
    found = spark.createDataFrame([(5, True)], "doc_id long, suspicious boolean")
    out = reports.regression_log(found, docs)
    numbers = [int(r.sample.split("-")[1]) for r in out.collect()]
    assert sorted(numbers) == list(range(1, n + 1))
    assert out.where("uncertain = 1").count() == 1


def test_text_is_detected_in_one_pass_without_python_workers(spark):
    """Tokens are shuffled once, by page, for all detectors, also where hits live in steps."""
    rows = spark.createDataFrame([token(0, 20, 5)], TOKEN)
    for found in (detect.detect_text(rows), detect.detect_text_steps(rows.withColumn("_born", F.lit(0)), 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_checksum_by_tables_is_the_fold(spark):
    texts = [f"{(n * 7919 + 104729) % 10**12:012d}" for n in range(0, 10**12, 499_999_993)] + ["000000000000", ID]
    c, _ = fold(texts, 0)
    rows = spark.createDataFrame([(t, bool(x == 0)) for t, x in zip(texts, c, strict=True)] + [(None, None)], "t string, ok boolean")
    assert rows.where(~verhoeff_valid12(F.col("t")).eqNullSafe(F.col("ok"))).count() == 0 and rows.where("ok").count() > 0


def test_tables_of_pages_are_never_broadcast(spark, monkeypatch):
    """Their files are small for what they hold: band plans, pages in need and hits meet by shuffles, so the driver holds none of them."""
    full, sizes = written(spark.createDataFrame([token(0, 20, 100, 900, 40)], TOKEN), "full"), written(spark.createDataFrame([(1, 0, 1000, 600)], PAGES), "sizes")
    read = written(spark.createDataFrame([(*token(0, 600, 105), 1)], TOKEN + ", band int"), "bands")
    current = written(detect.numbered(detect.detect_text(full)), "current")
    plans = []
    monkeypatch.setattr(passes, "written", lambda df, name: plans.append(df) or written(df, name))
    moved = passes.translate_band_tokens(read, passes.band_plan(sizes), full)
    new = passes.recover_from_bands(full, moved, current, sizes)
    merged = passes.merge_recovery(current, written(new, "new"))
    assert [(r.bbox.x, r.suspicious) for r in merged.collect()] == [(600.0, False)]
    names = [df._jdf.queryExecution().executedPlan().toString() for df in (*plans, moved, new, merged)]
    assert all("Broadcast" not in p for p in names) and all("SortMergeJoin" in p for p in names[:-1])
