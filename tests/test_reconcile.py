"""All passes of a page, one after the other."""

from test_recovery import ID, TOKEN, token

from veilwork.functions import geometry as G
from veilwork.operators import passes

OTHER = f"doc_id long, page_index long, kind string, bbox {G.BOX}, mask_bbox {G.BOX}, value string, confidence double, suspicious boolean"


def other(page, x):
    return (1, page, "face", (x, 1.0, 5.0, 5.0), (x, 1.0, 5.0, 5.0), "", 0.9, False)


def run(spark, auto_rotate):
    df = lambda rows, more="": spark.createDataFrame(rows, TOKEN + more)
    # Page 0 is read at once, 1 when enhanced, 2 when turned by 90, 3 from a band, 4 from nothing, 5 cannot be drawn.
    tokens = df([token(0, 20, 5, page=0), *(token(0, 20, 5, text="blurred", page=p) for p in (1, 2, 3, 4, 5))])
    enhanced = df([token(0, 40, 5, page=p) for p in (0, 1, 5)])
    probe = df([(*token(0, 1, 1, page=2), 90), (*token(1, 1, 400, page=2), 90), (*token(0, 1, 1, page=2), 180), (*token(0, 1, 1, page=0), 90)], ", rotation int")
    turned = df([(*token(0, 60, 5, page=2), 90), (*token(0, 70, 5, page=2), 180), (*token(0, 60, 5, page=0), 90)], ", rotation int")
    bands = df([(*token(0, 80, 9, page=3), 0, 0), (*token(0, 85, 9, page=3), 0, 90), (*token(0, 90, 9, page=1), 0, 0), (*token(0, 90, 9, page=5), 0, 0)], ", band int, rotation int")
    others = spark.createDataFrame([other(0, 1.0), other(2, 1.0), other(5, 1.0)], OTHER)
    turned_others = spark.createDataFrame([(*other(2, 9.0), 90), (*other(2, 7.0), 180)], OTHER + ", rotation int")
    pages = spark.createDataFrame([(1, p, 600, 1000, p != 5) for p in range(6)], "doc_id long, page_index long, width long, height long, drawable boolean")
    out = passes.reconcile(tokens, others, enhanced, probe, turned, turned_others, bands, pages, auto_rotate)
    return sorted((r.page_index, r.kind, r.bbox.x, r.bbox.y, r.value, r.rotation) for r in out.collect())


ALWAYS = [(0, "aadhaar", 20.0, 5.0, ID, 0), (0, "face", 1.0, 1.0, "", 0), (1, "aadhaar", 40.0, 5.0, ID, 0)]


def test_upright_passes(spark):
    assert run(spark, False) == [*ALWAYS, (2, "face", 1.0, 1.0, "", 0), (3, "aadhaar", 80.0, 309.0, ID, 0), (5, "face", 1.0, 1.0, "", 0)]


def test_turned_passes(spark):
    assert run(spark, True) == [*ALWAYS, (2, "aadhaar", 60.0, 5.0, ID, 90), (2, "face", 9.0, 1.0, "", 90), (3, "aadhaar", 80.0, 309.0, ID, 0), (5, "face", 1.0, 1.0, "", 0)]


def test_faces_and_codes_need_no_text(spark):
    from veilwork.plans.queries import QUERIES
    from veilwork.sources import staging

    before = len(staging._PATHS)
    assert QUERIES["reconcile"](spark, "/root/testdata/sf0.001").count()
    made = staging._PATHS[before:]
    assert not [p for p in made if "veilwork-detections" in p] and any("veilwork-others" in p for p in made)
