import pytest
from pyspark.sql import functions as F

from veilwork.functions import geometry as G
from veilwork.functions import text as X
from veilwork.functions.checksum import INVERSE, fold, verhoeff_check_digit, verhoeff_valid, verhoeff_valid_native
from veilwork.sources import admission


def test_checksum_goldens():
    c, digits = fold(["000000000000", "123456789010", "2363", "12a", None, "", "１２３"], 0)
    assert [bool(ok and x == 0) for x, ok in zip(c, digits, strict=True)] == [False, True, True, False, False, False, False]
    assert INVERSE[fold(["236"], 1)[0][0]] == 3


def test_every_substitution_and_swap_is_detected():
    body = "73510948261"
    text = body + str(INVERSE[fold([body], 1)[0][0]])
    wrong = [text[:i] + str(d) + text[i + 1 :] for i in range(12) for d in range(10) if str(d) != text[i]]
    wrong += [text[:i] + text[i + 1] + text[i] + text[i + 2 :] for i in range(11) if text[i] != text[i + 1]]
    assert fold([text], 0)[0][0] == 0 and (fold(wrong, 0)[0] != 0).all()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("out")).first()["out"]


def test_checksum_columns_agree(spark):
    df = spark.createDataFrame([("123456789010",), ("123456789011",), ("x",), (None,), ("",)], "t string")
    rows = df.select(verhoeff_valid("t").alias("a"), verhoeff_valid_native(F.col("t")).alias("b"), verhoeff_check_digit("t").alias("c")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [True, False, False, False, False]
    assert rows[2].c is None and rows[3].c is None


@pytest.mark.parametrize(("text", "want"), [("ABCPE1234F", True), (" ABCPE1234F\n", True), ("ABCZE1234F", False), ("abcpe1234f", False), ("ABCPE12345", False)])
def test_tax_ids(spark, text, want):
    assert one(spark, X.is_pan(F.col("t")), t=text) is want


def test_candidates_keep_the_left_to_right_scan(spark):
    assert one(spark, X.id12_candidates(F.col("t")), t="1234567890123456") == []
    assert one(spark, X.id12_candidates(F.col("t")), t="1234 5678 9012 3456") == ["1234 5678 9012"]
    assert one(spark, X.id12_candidates(F.col("t")), t="é123456789012") == ["123456789012"]


def test_mask_text(spark):
    df = spark.createDataFrame([("id 1234-5678 9010, ABCPE1234F; 123456789011",), (None,), ("",)], "text string")
    assert [(r.masked, r.n_masked) for r in X.mask_text(df).collect()] == [("id XXXX-XXXX 9010, XXXXXXXXXX; 123456789011", 2), (None, 0), ("", 0)]


def test_boxes(spark):
    box = lambda *v: G.box(*(F.lit(float(x)) for x in v))
    got = spark.range(1).select(
        G.mask_bounds(F.lit("other_qr"), box(100, 100, 50, 50), F.lit(1000), F.lit(1000)).alias("qr"),
        G.mask_bounds(F.lit("face"), box(400, 300, 100, 100), F.lit(1000), F.lit(1000)).alias("face"),
        G.boxes_overlap(box(0, 0, 10, 10), box(10, 0, 5, 5)).alias("touch"), G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)).alias("same"),
    ).first()
    assert tuple(got.qr) == (95, 95, 60, 60) and tuple(got.face) == (385, 285, 130, 130) and not got.touch and got.same == 1


@pytest.mark.parametrize(("name", "want"), [("file.v2.jpg", "file.v2_redacted.pdf"), (".hidden", ".hidden_redacted.pdf"), (" ", "document_redacted.pdf")])
def test_output_names(spark, name, want):
    assert one(spark, admission.output_name(F.col("n")), n=name) == want


def test_admission_limits(spark):
    rows = [("a.pdf", "", 20 << 20), ("a.pdf", "", (20 << 20) + 1), ("a.png", "image/heic", 5), ("a.PDF", None, 5)]
    df = spark.createDataFrame(rows, "name string, mime string, size long")
    assert [r.reason for r in admission.admit_files(df).collect()] == [None, "too_large", "unsupported_type", None]


def test_checksums_in_sql(spark):
    from veilwork.functions.checksum import register_functions

    register_functions(spark)
    row = spark.sql("SELECT verhoeff_valid('2363') AS ok, verhoeff_valid('2364') AS bad, verhoeff_valid(NULL) AS none, verhoeff_check_digit('236') AS digit").first()
    assert (row.ok, row.bad, row.none, row.digit) == (True, False, False, "3")


def test_change_counts_fold_every_changed_text():
    import random

    from veilwork.functions.checksum import change_counts, fold

    rnd = random.Random(7)
    # Texts that do not fold to 0 too: some of their changes do, so that both answers occur.
    texts = ["".join(rnd.choice("0123456789") for _ in range(rnd.randrange(1, 15))) for _ in range(60)] + ["7", "00", "236"]
    changed = [t[:i] + d + t[i + 1 :] for t in texts for i in range(len(t)) for d in "0123456789" if d != t[i]]
    swapped = [t[:i] + t[i + 1] + t[i] + t[i + 2 :] for t in texts for i in range(len(t) - 1) if t[i] != t[i + 1]]
    want = tuple((len(ts), int((fold(ts, 0)[0] != 0).sum())) for ts in (changed, swapped))
    assert change_counts(texts) == want and all(n > found for n, found in want)
    assert change_counts([]) == ((0, 0), (0, 0))
