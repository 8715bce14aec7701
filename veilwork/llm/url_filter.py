"""URL filter with a path-template tree per host, with DataFrame functions only.

The tree grows level by level. Where a node has many children for the pages that it has, or more than a
bound, the segment is variable and becomes a wildcard. Where it has few, each child whose share of blocked
labelled pages does not differ from that of all the node's pages by a two-proportion test is merged with
the other such children. A leaf is a template, and its pages are blocked if the template's purity, smoothed
by the host's and that by the overall share, is above a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.shared import staged

#: Levels of the tree; what lies deeper in a path is one wildcard tail.
DEPTH = 4
#: Children up to which a segment can be constant, and the share of distinct values that makes it variable.
CHILDREN, VARIABLE = 16, 0.5
#: Weight of the smoothing share, in pages; standard errors within which branches are merged; purity to block.
SMOOTHING, SIMILAR, PURITY = 4.0, 1.96, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. Rules are (verdict, host/path): they fit the host and its
    subdomains where the path begins like theirs. Of equally long ones the first in text order wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Add the template of each page. pages: host, path and label (true: to block, false: to allow, null: none).

    Variable segments are called *, tails **, merged branches ~; a ~ of a path's own is written ~0.

    Each level's node counts and the pages' new templates are written to the shared folder, so plans stay short
    and a lost executor costs one level at most.
    """
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", depth + 1)
    rows = pages.withColumns({"segments": segments, "template": F.lit("")})
    label = {"n": F.count("*"), "labelled": F.count("label"), "blocked": F.coalesce(F.sum(F.col("label").cast("int")), F.lit(0))}
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    rows = staged(rows, "pages")
    for level in range(min(deepest, depth + 1)):
        here = F.get("segments", F.lit(level))
        # A last segment behind the last level is a tail.
        rows = rows.withColumn("segment", F.when(here.isNull(), F.lit("")).when(F.lit(level == depth), F.lit("**")).otherwise(F.concat(F.lit("="), here)))
        children = staged(rows.groupBy("host", "template", "segment").agg(*(c.alias(k) for k, c in label.items())), "nodes")
        total = {k: F.sum(k).alias(f"all_{k}") for k in label}
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("children"), *total.values())
        variable = (F.col("children") > CHILDREN) | ((F.col("children") > 4) & (F.col("children") >= VARIABLE * F.col("all_n")))
        nodes = nodes.withColumn("variable", variable)
        share = F.col("all_blocked") / F.col("all_labelled")
        rest = F.col("all_labelled") - F.col("labelled")
        error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest))
        gap = F.abs(F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / rest)
        # Without labels on either side, or where all agree, nothing tells the branches apart.
        alike = (F.col("labelled") == 0) | (rest == 0) | (F.col("all_blocked") == 0) | (F.col("all_blocked") == F.col("all_labelled")) | (gap <= SIMILAR * error)
        few = nodes.where(~F.col("variable"))
        apart = children.join(few, ["host", "template"]).where(~alike & (F.col("segment") != "")).select("host", "template", "segment", F.lit(True).alias("apart"))
        rows = rows.join(nodes.select("host", "template", "variable"), ["host", "template"]).join(apart, ["host", "template", "segment"], "left")
        step = F.when(F.col("segment") == "", F.lit("")).when(F.col("segment") == "**", F.lit("/**")).when(F.col("apart"), F.concat(F.lit("/"), F.replace(F.substr("segment", F.lit(2)), F.lit("~"), F.lit("~0"))))
        step = step.when(F.col("variable"), F.lit("/*")).otherwise(F.lit("/~"))
        rows = staged(rows.withColumn("template", F.concat("template", step)).drop("segment", "variable", "apart"), "pages")
    return rows.drop("segments")


def judge(
    df: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", key: str = "page_id", depth: int = DEPTH,
    purity: float = PURITY, smoothing: float = SMOOTHING,
) -> DataFrame:
    """For each row: key, host, path, rule, verdict (allow or block), template and its smoothed purity.

    The longest rule that fits decides; pages that no rule fits are judged by their template, for which
    the pages with a rule are the labelled ones. Host and path of a null url, or one without ://, are
    empty, and such pages share one template. Without any labelled page all are allowed. Rows stay,
    repeated ones and null keys too; an empty table gives an empty table; other columns are not read.

    All gathering is by aggregates that are summed before they are shuffled; pages of a hot host are joined
    with one row for each node, which Spark broadcasts when small and splits when skewed.
    """
    pages = df.select(F.col(f"`{key}`").alias("key"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "says": says}).withColumn("label", F.col("says") == "block")
    seen = pages.agg(F.count("label").alias("n"), F.sum(F.col("label").cast("int")).alias("b")).first()
    overall = (seen.b or 0) / seen.n if seen.n else 0.0
    rows = templates(pages, depth)
    counts = F.count("label").alias("l"), F.coalesce(F.sum(F.col("label").cast("int")), F.lit(0)).alias("b")
    leaves = rows.groupBy("host", "template").agg(*counts)
    hosts = leaves.groupBy("host").agg(((F.sum("b") + smoothing * overall) / (F.sum("l") + smoothing)).alias("host_purity"))
    leaves = leaves.join(hosts, "host").select("host", "template", ((F.col("b") + smoothing * F.col("host_purity")) / (F.col("l") + smoothing)).alias("purity"))
    judged = rows.join(leaves, ["host", "template"])
    verdict = F.coalesce("says", F.when(F.col("purity") > purity, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
