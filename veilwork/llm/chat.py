"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The turns in which the two conversations of a pair agree, from the first on, are rendered once as the
prompt; each side's other turns are its completion, of which only the assistant's turns are trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers that a record covers; longer conversations have several records.
RECORD_TURNS = 256
#: Tasks over which the records of one conversation are dealt in a join.
SPREAD = 64


def rendered(role: Column, text: Column) -> Column:
    """A turn as text. Marks that occur in a text are broken by a space, so no text can open or close a turn."""
    inner = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), inner, F.lit(CLOSE + "\n"))


def _part(turn: Column) -> Column:
    """The task among SPREAD that a turn of a conversation goes to in joins, the same for all turns of a record."""
    return F.pmod(F.floor(turn / RECORD_TURNS), F.lit(SPREAD))


def deal(rows: DataFrame, key: str, turn: str) -> DataFrame:
    """Rows dealt over tasks by conversation and part of its records, with the part as a column _part. Texts move here once; all that
    follows finds a record's turns in one task and moves numbers only."""
    return rows.withColumn("_part", _part(F.col(f"`{turn}`").cast("long"))).repartition(F.col(f"`{key}`"), F.col("_part"))


def _with_value(rows: DataFrame, key: str, value: Column, source: DataFrame | None = None) -> DataFrame:
    """Add an aggregate over the rows of each key (of source, if it has the same keys and parts), joined back by key and _part, so that the rows of a key stay where they are."""
    values = (rows if source is None else source).groupBy(key).agg(value, F.collect_set("_part").alias("_parts"))
    return rows.join(values.select("*", F.explode("_parts").alias("_part")).drop("_parts"), [key, "_part"])


def _completion(turns: Column, side: str) -> tuple[Column, Column]:
    """The text of one side's turns and the spans of characters in it that are trained on."""
    said = F.filter(F.transform(turns, lambda t: t[side]), lambda t: t.isNotNull())
    text = F.array_join(F.transform(said, lambda t: rendered(t["role"], t["text"])), "")
    head = lambda t: F.length(F.concat(F.lit(OPEN), t["role"], F.lit("\n")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def add(done: Column, t: Column) -> Column:
        end = done["at"] + F.length(rendered(t["role"], t["text"]))
        span = F.struct((done["at"] + head(t)).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return text, F.aggregate(said, start, add, lambda done: done["spans"])


def format_preferences(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text", dealt: bool = False) -> DataFrame:
    """Turns (pair, side chosen or rejected, turn, role, text) to records of a prompt and its two completions.

    Columns: pair, record, prompt, chosen, rejected, chosen_spans, rejected_spans. The spans are the characters
    [start, end) of a completion that are trained on: the assistant's turns, after the line that opens them, up to and with
    their last mark. Turns are numbers; a record holds those of one stretch of RECORD_TURNS numbers, and `record` is the
    stretch: 0 for conversations of ordinary length. A longer pair has several records, which put together
    in order are its prompt and completions; nothing is cut. A record lies before, over or behind the end of the prompt.

    The prompt ends before the first turn in which role or text differ or that one side lacks. Null text and
    null role count as empty. Rows with a null pair, null turn or another side are part of no
    conversation and give nothing. Of rows that repeat pair, side and turn, the smallest (role, text)
    is the turn. A pair of which one side is missing has an empty prompt and one empty completion, two equal conversations
    have empty completions, and an empty table gives an empty table; other columns are not read.

    Turns are dealt over tasks once, by pair and one of SPREAD parts of its records; with dealt=True they have been already (see deal). The
    place of the first difference is aggregated before it is shuffled, and joined to each part.
    """
    said = F.struct(F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = turns.select(F.col(f"`{pair}`").alias("pair"), F.col(f"`{side}`").alias("side"), F.col(f"`{turn}`").cast("long").alias("turn"), said.alias("said"), *(["_part"] if dealt else []))
    own = own.where(F.col("pair").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin("chosen", "rejected"))
    own = own if dealt else deal(own, "pair", "turn")
    both = own.groupBy("pair", "_part", "turn").agg(*(F.min(F.when(F.col("side") == s, F.col("said"))).alias(s) for s in ("chosen", "rejected")))
    same = F.col("chosen").eqNullSafe(F.col("rejected"))
    # A turn that both sides have alike is kept once.
    both = both.select("pair", "turn", "_part", "chosen", F.when(~same, F.col("rejected")).alias("rejected"), same.alias("same"))
    both = _with_value(both, "pair", F.min(F.when(~F.col("same"), F.col("turn"))).alias("first"))
    record = F.floor(F.col("turn") / RECORD_TURNS).alias("record")
    whole = both.groupBy("pair", "_part", record).agg(F.first("first").alias("first"), F.array_sort(F.collect_list(F.struct("turn", "chosen", "rejected", "same"))).alias("turns"))
    shared = lambda t: F.col("first").isNull() | (t["turn"] < F.col("first"))
    sides = lambda t: F.struct(t["chosen"].alias("chosen"), F.when(t["same"], t["chosen"]).otherwise(t["rejected"]).alias("rejected"))
    prompt, later = F.filter("turns", shared), F.transform(F.filter("turns", lambda t: ~shared(t)), sides)
    completions = {s: _completion(later, s) for s in ("chosen", "rejected")}
    return whole.select(
        F.col("pair").alias(pair), "record", _completion(prompt, "chosen")[0].alias("prompt"),
        *(c[0].alias(s) for s, c in completions.items()), *(c[1].alias(f"{s}_spans") for s, c in completions.items()),
    )


def spans_text(spans: Column) -> Column:
    """Spans as text: start-end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def short_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of conversations: chosen as it is, rejected with its last reply cut to the first sentence. The rows are dealt (see deal).

    Rows with a null conv_id or turn give nothing, null text stays null, repeated rows stay, other columns are not read;
    a conversation without reply is rejected as it is, and an empty table gives an empty table.
    """
    said = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = said.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last")
    turns = _with_value(deal(said, "conv_id", "turn"), "conv_id", last, said.select("conv_id", "turn", "role", _part(F.col("turn")).alias("_part")))
    cut = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.substring_index("text", ". ", 1)).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), cut.alias("text")))
    return turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "_part", F.inline(sides))
