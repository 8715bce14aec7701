"""Form intake: payload rules, status of each request, rate limit and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilwork.functions.text import email_valid, trim

#: What a form may say, and limits.
USE_CASES = ("HR / payroll", "Fintech KYC", "Prop-tech / tenancy", "Insurance", "Healthcare", "Government / public sector", "Other")
KEYS = ("email", "company", "useCase")
EMAIL, COMPANY, BODY_BYTES = 254, (2, 200), 4096
RATE, WINDOW_SECONDS = 5, 60
TTL, DEPLOYED_TTL = (60, 31_536_000), 90 * 86_400


def parsed(body: Column) -> Column:
    """The form's fields as a struct, or null where the body is no such object."""
    raw = F.from_json(body, "map<string,string>")
    # A value that is no JSON string reads as text too, so the kinds are looked at apart.
    kinds = F.from_json(body, "map<string,variant>")
    exact = (F.size(F.array_except(F.map_keys(raw), F.array(*(F.lit(k) for k in KEYS)))) == 0) & (F.size(raw) == len(KEYS))
    strings = F.forall(F.map_values(kinds), lambda v: F.schema_of_variant(v) == "STRING")
    email, company = trim(raw["email"]), trim(raw["company"])
    sound = email_valid(email) & (F.length(email) <= EMAIL) & F.length(company).between(*COMPANY) & raw["useCase"].isin(*USE_CASES)
    return F.when(F.coalesce(exact & strings & sound, F.lit(False)), F.struct(email.alias("email"), company.alias("company"), raw["useCase"].alias("use_case")))


def parse_intake(events: DataFrame, body: str = "body") -> DataFrame:
    """Add payload: the trimmed fields of a valid form, else null."""
    return events.withColumn("payload", parsed(F.col(body)))


def rate_limit(events: DataFrame, key: str = "ip", ts: str = "ts", order: str = "event_id", limit: int = RATE, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Add limited: whether a key's event comes behind `limit` others in its fixed window of `seconds`."""
    window = F.window(F.col(ts), f"{seconds} seconds")
    rank = F.row_number().over(Window.partitionBy(key, "_window").orderBy(ts, order))
    return events.withColumn("_window", window).withColumn("limited", rank > limit).drop("_window")


def early_status(origins: list[str], ttl: int | None = DEPLOYED_TTL) -> Column:
    """The status of a request that an earlier rule than the limiter refuses or answers, else null."""
    typed = F.lower(trim(F.element_at(F.split("content_type", ";"), 1)))
    configured = ttl is not None and TTL[0] <= ttl <= TTL[1]
    return (
        F.when(~F.coalesce(F.col("origin").isin(*origins), F.lit(False)), 403).when(F.col("method") == "OPTIONS", 204)
        .when(F.coalesce(F.col("method"), F.lit("")) != "POST", 405).when(F.coalesce(typed, F.lit("")) != "application/json", 415)
        .when(F.coalesce(F.col("ip"), F.lit("")) == "", 503).when(F.lit(not configured), 503)
    )


def late_status(limited: Column) -> Column:
    """The status of a request that reached the limiter."""
    return F.when(limited, 429).when(F.octet_length("body") > BODY_BYTES, 413).when(parsed(F.col("body")).isNull(), 400).otherwise(202)


def intake_status(events: DataFrame, origins: list[str], ttl: int | None = DEPLOYED_TTL) -> DataFrame:
    """Add status, by the first rule that fails; 202 where none does.

    The limiter counts only requests that reach it, so the earlier rules are settled before it.
    """
    rows = events.withColumn("early", early_status(origins, ttl))
    through = rate_limit(rows.where(F.col("early").isNull()))
    done = rows.where(F.col("early").isNotNull()).withColumn("status", F.col("early")).drop("early")
    return done.unionByName(through.withColumn("status", late_status(F.col("limited"))).drop("early", "limited"))


def retention(records: DataFrame, as_of: Column, ttl: int = DEPLOYED_TTL, ts: str = "ts") -> DataFrame:
    """Records that have not expired at a time."""
    if not TTL[0] <= ttl <= TTL[1]:
        raise ValueError(f"ttl must be from {TTL[0]} to {TTL[1]} seconds")
    return records.where(F.col(ts) + F.expr(f"INTERVAL {ttl} SECONDS") > as_of)
