"""Audits of web pages and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCRIPT = r"(?is)<script(?![^>]*\ssrc\s*=)[^>]*>(.*?)</script>"


def inline_scripts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Per page: the distinct base64 SHA-256 digests of its inline scripts that are not blank, sorted."""
    bodies = F.filter(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), lambda s: F.trim(F.regexp_replace(s, r"\s", "")) != "")
    digests = F.transform(bodies, lambda s: F.base64(F.unhex(F.sha2(s.cast("binary"), 256))))
    return pages.select(key, F.array_join(F.array_sort(F.array_distinct(digests)), " ").alias("digests"), F.size(bodies).alias("scripts"))


def egress_audit(requests: DataFrame, origin: str, assets: DataFrame, routes: DataFrame) -> DataFrame:
    """Add allowed: local data; or a same-origin GET without body for a known asset without query, or for a
    known route without query but a framework token of up to 32 characters.

    requests: url, method, body; assets and routes: path.
    """
    local = F.coalesce(F.col("url").rlike("^(blob|data):"), F.lit(False))
    rows = requests.withColumns({
        "_origin": F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1),
        "_path": F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1),
        "_query": F.regexp_extract("url", r"^[^?#]*\??([^#]*)", 1),
    })
    known = lambda t, name: t.select(F.col("path").alias("_path"), F.lit(True).alias(name)).distinct()
    rows = rows.join(known(assets, "_asset"), "_path", "left").join(known(routes, "_route"), "_path", "left")
    plain = (F.col("_origin") == origin) & (F.col("method") == "GET") & (F.coalesce(F.octet_length("body"), F.lit(0)) == 0)
    token = F.col("_query").rlike(r"^(_rsc=[A-Za-z0-9_-]{1,32})?\z")
    allowed = local | (plain & ((F.col("_asset").isNotNull() & (F.col("_query") == "")) | (F.col("_route").isNotNull() & token)))
    return rows.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("_origin", "_path", "_query", "_asset", "_route")


def path_table(spark, paths: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")
