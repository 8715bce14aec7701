"""Secrets in whole texts: matches of strong patterns, and weak candidates that complementary parts nearby confirm.

A credential has up to three parts: who (an identifier), what opens (a secret) and where (an endpoint). Strong spans
count by themselves. A weak one is reported only where what it lacks lies in the same scope, a paragraph, with a start
within REACH code points of its own:

- a secret without a name (a mixed run of 20 to 128 characters): beside a strong identifier, or beside a weak one and an endpoint;
- a weak identifier (a named login or client): beside a strong secret, or beside a weak one and an endpoint;
- an endpoint (scheme://host...): beside an identifier and a secret of any kind.

Weak identifiers that overlap a strong span, and nameless secrets that overlap any other part, are no candidates. A null
text has no words and so no spans, as has an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.shared import staged

#: Strong patterns, in the order of their kinds, and the least length of what they hold.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: Weak parts: named identifiers of 4 characters and more, nameless mixed runs, and endpoints.
IDENT = r"""(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
NAMELESS = r"[A-Za-z0-9+/_=-]+"
ENDPOINT = r"[a-z]{2,15}://[A-Za-z0-9._~:@%/-]+"
LEAST_IDENT, NAMELESS_LENGTH = 4, (20, 128)
#: Scopes end at blank lines.
BREAK = r"\n[\x20\t\r]*\n"
#: Code points between the starts of parts that belong together.
REACH = 256

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
STRONG = KINDS[:3]
PART = "struct<start:int,place:int,kind:string,stop:int,scope:int>"
_PART = pa.struct([("start", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("stop", pa.int32()), ("scope", pa.int32())])

_ASSIGN, _ACCESS, _HEX, _IDENT, _NAMELESS, _ENDPOINT, _BREAK = map(re.compile, (ASSIGN, ACCESS, HEX, IDENT, NAMELESS, ENDPOINT, BREAK))
_LONG_HEX = re.compile(f"{HEX[:-1]}{{{LEAST_HEX},}}")
_UPPER, _LOWER, _DIGIT = map(re.compile, ("[A-Z]", "[a-z]", "[0-9]"))


def _clear(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, in order and apart, that overlap none of others; an overlap has one that starts before the span's end and is the last to do so, or reaches over it."""
    taken = sorted(taken)
    reach, top = [], 0
    for _, stop in taken:
        reach.append(top := max(top, stop))
    starts = [a for a, _ in taken]
    return [(a, b) for a, b in found if (n := bisect_right(starts, b - 1)) == 0 or reach[n - 1] <= a]


def parts_of(text: str) -> list[dict]:
    """Strong spans of a text and its weak candidates. Without an identifier no weak candidate can be confirmed, so none is looked for."""
    spans = {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE],
        "access": [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS],
        # A run that is long enough is found as such: what is shorter fails anyway.
        "hex": [m.span() for m in _LONG_HEX.finditer(text)],
    }
    strong = [s for kind in STRONG for s in spans[kind]]
    spans["ident"] = _clear([m.span() for m in _IDENT.finditer(text) if len(m[2]) >= LEAST_IDENT], strong)
    if spans["access"] or spans["ident"]:
        spans["endpoint"] = [m.span() for m in _ENDPOINT.finditer(text)] if "://" in text else []
        mixed = [m.span() for m in _NAMELESS.finditer(text) if NAMELESS_LENGTH[0] <= m.end() - m.start() <= NAMELESS_LENGTH[1] and all(p.search(m[0]) for p in (_UPPER, _LOWER, _DIGIT))]
        spans["secret"] = _clear(mixed, strong + spans["ident"] + spans["endpoint"])
    if not any(spans.values()):
        return []
    breaks = [m.end() for m in _BREAK.finditer(text)]
    return [{"start": a, "place": KINDS.index(kind), "kind": kind, "stop": b, "scope": bisect_right(breaks, a)} for kind in spans for a, b in spans[kind]]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(f.name, T.StringType() if f.name == "kind" else T.IntegerType()) for f in _PART])))
def parts_in(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Strong spans and weak candidates of each whole text."""
    for batch in batches:
        yield pa.array((parts_of(t.as_py() or "") for t in batch), pa.list_(_PART))


def confirmed(parts: DataFrame) -> DataFrame:
    """The weak candidates among parts (row, start, place, kind, stop, scope) that complementary parts confirm.

    The interval join is one by stretches of REACH: of each stretch of a scope only the first and the last start of
    each role are kept, and a candidate meets its own stretch and the two beside it. A part within REACH lies in one of
    them, and the nearest of a neighbouring stretch is its first or last one, so each candidate meets three
    rows, however many parts there are.
    """
    is_kind = lambda *kinds: F.col("kind").isin(*kinds)
    roles = {
        "sure_who": is_kind("access"), "who": is_kind("access", "ident"),
        "sure_what": is_kind("assign", "hex"), "what": is_kind("assign", "hex", "secret"), "where": is_kind("endpoint"),
    }
    at = parts.withColumn("stretch", F.floor(F.col("start") / REACH))
    ends = [f(F.when(test, F.col("start"))).alias(f"{name}_{end}") for name, test in roles.items() for end, f in (("first", F.min), ("last", F.max))]
    stretches = at.groupBy("row", "scope", "stretch").agg(*ends)
    near = F.explode(F.array(*(F.col("stretch") + d for d in (-1, 0, 1))))
    weak = at.where(~is_kind(*STRONG)).withColumn("stretch", near)
    within = lambda name: F.coalesce(F.least(F.abs(F.col("start") - F.col(f"{name}_first")), F.abs(F.col("start") - F.col(f"{name}_last"))) <= REACH, F.lit(False))
    met = weak.join(stretches, ["row", "scope", "stretch"]).groupBy("row", "start", "place", "kind", "stop", "scope").agg(*(F.bool_or(within(name)).alias(name) for name in roles))
    who, sure_who, what, sure_what, where = (F.col(c) for c in ("who", "sure_who", "what", "sure_what", "where"))
    rule = F.when(is_kind("secret"), sure_who | (who & where)).when(is_kind("ident"), sure_what | (what & where)).otherwise(who & what)
    return met.where(rule).select("row", "start", "place", "kind", "stop", "scope")


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of each row, with base (strong spans) and spans (those and confirmed weak ones): arrays of start, place (of the kind), kind, stop and scope, by start.

    Kept columns that are called base or spans are replaced. Rows stand for themselves, whatever their ids. One pass
    over the texts; only rows with weak candidates are joined, and only their spans.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in keep if c.lower() not in ("base", "spans"))).alias("keep")
    scanned = docs.select(own, parts_in(F.col(f"`{text}`")).alias("parts"), F.monotonically_increasing_id().alias("row"))
    scanned = staged(scanned, "secrets")  # settles row
    strong = F.filter("parts", lambda p: p["kind"].isin(*STRONG))
    weak = F.exists("parts", lambda p: ~p["kind"].isin(*STRONG))
    parts = scanned.where(weak).select("row", F.inline("parts"))
    more = confirmed(parts).groupBy("row").agg(F.collect_list(F.struct("start", "place", "kind", "stop", "scope")).alias("more"))
    none = F.array().cast(f"array<{PART}>")
    joined = scanned.where(weak).join(more, "row", "left").withColumn("more", F.coalesce("more", none))
    every = scanned.where(~weak).withColumn("more", none).unionByName(joined)
    return every.select("keep.*", F.array_sort(strong).alias("base"), F.array_sort(F.concat(strong, "more")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """A text with the characters of spans replaced by asterisks; spans that overlap are hidden together."""
    hidden = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.repeat(F.lit("*"), F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["at"])))).alias("out"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
    )
    return F.concat(hidden["out"], F.substring(text, hidden["at"] + 1, F.length(text)))
