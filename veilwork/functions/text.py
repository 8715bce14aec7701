"""Text predicates and extractions on token, file, form and payload columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions.checksum import fold, verhoeff_valid, verhoeff_valid12

#: White space as browsers count it: more than Java's \s.
BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: A word boundary that knows ASCII word characters only.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

#: How many letters may stand fourth in a tax id, and the marks of official payloads.
PAN_HOLDERS = "PFCHATBLJG"
OFFICIAL_MARKS = ("<?xml", "PrintLetterBarcodeData")
OFFICIAL_LENGTH = 500

#: Kinds in their order, label, and whether a mask is on at first.
KINDS = (
    ("aadhaar", "12-digit id", True),
    ("pan", "Tax id", True),
    ("passport_mrz", "Passport lines", True),
    ("face", "Face", True),
    ("uidai_qr", "Official QR", True),
    ("other_qr", "Other QR", False),
)
TEXT_KINDS = ("aadhaar", "pan", "passport_mrz")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+\\z", "")


def pure_group(text: Column) -> Column:
    """The four digits of a text that has exactly those between non-digits at its ends; else null."""
    return F.nullif(group_match(text), F.lit(""))


def group_match(text: Column) -> Column:
    """pure_group with the empty text for null, which is worked out once where it is a column of its own."""
    return F.regexp_extract(text, r"(?s)^[^0-9]*([0-9]{4})[^0-9]*\z", 1)


def id12_candidates(text: Column) -> Column:
    """All 4-4-4 digit runs from left to right, single spaces or hyphens allowed between the groups."""
    return F.regexp_extract_all(text, F.lit(f"{BEFORE}([0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}){AFTER}"), F.lit(1))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def with_valid_id12(df: DataFrame, text: str, out: str) -> DataFrame:
    """The first candidate of each text that passes the checksum, null where none does. Each step is a column of its own, so that none is worked out anew for each digit."""
    given = F.col(text)
    rows = df.withColumn("_found", F.when(F.length(given) >= 12, id12_candidates(given)))
    rows = rows.withColumn("_digits", digits_of(F.get("_found", F.lit(0))))
    pairs = F.transform("_found", lambda c: F.struct(c.alias("match"), digits_of(c).alias("digits")))
    later = F.when(F.size("_found") > 1, F.get(F.filter(pairs, lambda z: verhoeff_valid12(z["digits"])), F.lit(0))["match"])
    return rows.withColumn(out, F.when(verhoeff_valid12(F.col("_digits")), F.get("_found", F.lit(0))).otherwise(later)).drop("_found", "_digits")


def first8_length(match: Column) -> Column:
    """Characters up to the eighth digit, that included."""
    return F.length(F.regexp_extract(match, r"^(?:[^0-9]*[0-9]){8}", 0))


def mask_sub_box(x: Column, y: Column, w: Column, h: Column, text: Column, match: Column) -> Column:
    """The slice of a token's box over the first eight digits of the match, in proportion to its characters."""
    n = F.length(text)
    start = F.instr(text, match) - 1
    return F.struct((x + w * start / n).alias("x"), y.alias("y"), (w * first8_length(match) / n).alias("w"), h.alias("h"))


def plausible_glyphs(w: Column, h: Column, n: Column) -> Column:
    """Whether a box is 0.4 to 1.3 heights wide for each character."""
    return F.coalesce((h > 0) & (n > 0) & (w / (n * h)).between(0.4, 1.3), F.lit(False))


def is_pan(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"^{BLANK}*[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]{BLANK}*\z"), F.lit(False))


def mrz_sanitize(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9<]", "")


#: The two lines of a passport, of 44 characters each.
MRZ_LENGTH = 44
MRZ_LINE1 = r"^P<IND[A-Z<]{39}\z"
MRZ_LINE2 = r"^[A-Z0-9<]{9}[0-9<]IND[0-9]{6}[0-9][MF<][0-9]{6}[0-9][A-Z0-9<]{14}[0-9]{2}\z"


def is_mrz_line1(line: Column) -> Column:
    return line.rlike(MRZ_LINE1)


def is_mrz_line2(line: Column) -> Column:
    return line.rlike(MRZ_LINE2)


def classify_qr(payload: Column) -> Column:
    official = F.length(payload) >= OFFICIAL_LENGTH
    for mark in OFFICIAL_MARKS:
        official = official | payload.contains(mark)
    return F.when(official, "uidai_qr").otherwise("other_qr")


def email_valid(text: Column) -> Column:
    return F.coalesce(trim(text).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}\z"), F.lit(False))


def kind_dimension(spark: SparkSession) -> DataFrame:
    """The six kinds: kind, label, default_on, kind_order."""
    return spark.createDataFrame([(*k, i) for i, k in enumerate(KINDS)], "kind string, label string, default_on boolean, kind_order int")


#: Runs of text that can hold something to hide.
_SPAN = rf"{BEFORE}(?:[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}|[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]){AFTER}"
MASK = "X"


def mask_text(df: DataFrame, text: str = "text", out: str = "masked", hits: str = "n_masked") -> DataFrame:
    """Hide the first eight digits of valid 12-digit ids, and tax ids and the two lines of passports whole; count them in `hits`.

    Lines end at line feeds, carriage returns and all else that some reader takes for a line's end. Passport lines are neighbours among lines that are not blank, and a pair counts once, as in detection.
    Text is cut into what lies between candidates and the candidates; only those that pass the checksum or
    are tax ids are hidden, and everything else stays as it is. Null stays null.
    """
    given = F.col(f"`{text}`")
    # Only texts that can hold a passport's first line, whatever is strewn into it, go to a Python worker.
    df = df.withColumn("_mrz", _hide_mrz(F.when(given.rlike("[Pp][^A-Za-z0-9<]*<"), given)))
    source = F.coalesce("_mrz.text", given)
    found = F.regexp_extract_all(source, F.lit(f"({_SPAN})"), F.lit(1))
    rest = F.split(source, _SPAN, -1)
    rows = df.withColumns({"_found": found, "_rest": rest}).withColumn("_valid", valid_each(F.transform("_found", digits_of)))
    part = lambda x, i: F.when(
        F.get("_valid", i), F.concat(F.regexp_replace(F.substring(x, F.lit(1), first8_length(x)), "[0-9]", MASK), F.substring(x, first8_length(x) + 1, F.length(x)))
    ).when(is_pan(x), F.repeat(F.lit(MASK), F.length(x))).otherwise(x)
    hidden = F.transform("_found", part)
    joined = F.array_join(F.transform("_rest", lambda t, i: F.concat(t, F.coalesce(F.get(hidden, i), F.lit("")))), "")
    count = F.size(F.filter(F.arrays_zip("_found", F.col("_valid")), lambda z: z["_valid"] | is_pan(z["_found"])))
    return rows.withColumns({out: F.when(F.size("_found") > 0, joined).otherwise(source), hits: F.coalesce(F.when(source.isNotNull(), count), F.lit(0)) + F.coalesce("_mrz.n", F.lit(0))}).drop("_found", "_rest", "_valid", "_mrz")


_LINE1, _LINE2 = (re.compile(x.replace(r"\z", r"\Z")) for x in (MRZ_LINE1, MRZ_LINE2))
_BLANK_LINE = re.compile(f"{BLANK}*")
#: All that ends a line for some reader of the text.
_LINE_END = re.compile("(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])")


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("n", T.IntegerType()))
def _hide_mrz(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts with passport lines hidden, and how many pairs there were; null stays null."""
    for batch in batches:
        out = []
        for text in batch.to_pylist():
            if text is None:
                out.append(None)
                continue
            pieces, n = _LINE_END.split(text), 0
            lines = pieces[::2]
            present = [i for i, x in enumerate(lines) if not _BLANK_LINE.fullmatch(x)]
            clean = {i: re.sub("[^A-Z0-9<]", "", lines[i].upper()) for i in present}
            for a, b in zip(present, present[1:]):
                if _LINE1.search(clean.get(a, "")) and _LINE2.search(clean.get(b, "")):
                    lines[a], lines[b], n = MASK * len(lines[a]), MASK * len(lines[b]), n + 1
            pieces[::2] = lines
            out.append({"text": "".join(pieces), "n": n})
        yield pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int32())]))


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def valid_each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        lists = [x or [] for x in batch.to_pylist()]
        flat = [t if len(t) == 12 else None for x in lists for t in x]
        c, digits = fold(flat, 0) if flat else (np.zeros(0, np.int8), np.zeros(0, bool))
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(digits & (c == 0)))


def valid_id12(text: Column) -> Column:
    """Whether the digits of a candidate are a valid id."""
    return verhoeff_valid(digits_of(text))
