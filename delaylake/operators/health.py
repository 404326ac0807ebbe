"""Whether data still arrives: overall verdict, and every stream against its own rhythm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylake.functions.temporal import instant

MAX_AGE = 600
RECENT = 1800
LAST_POLLS = 200
MAX_ERROR_SHARE = 0.5
STREAM_WINDOW = 86_400
LEAST_POLLS = 5
MISSES = 6
UNKNOWN_GRACE = 3600


@dataclass
class Verdict:
    ok: bool
    age_minutes: float | None
    recent_polls: int
    error_share: float | None
    problems: list[str]


def upper_median(column: str) -> Column:
    """The middle value of a group, of two middles the greater (counted by distinct values, partly in each task)."""
    return F.expr(f"percentile_disc(0.5) within group (order by {column} desc)")


def stream_ages(polls: DataFrame, now: Column, configured: DataFrame | None = None) -> DataFrame:
    """``dataset, polls, age_seconds, cadence_seconds`` of successful polls in the last day.

    With ``configured`` (``dataset``) exactly those streams, silent ones with no
    polls. The rhythm is the upper median of the gaps, null below five polls.
    """
    seen = polls.filter("feed = 'et' and error is null").select("dataset", instant("polled_at").alias("at"))
    seen = seen.filter(F.unix_micros("at") > F.unix_micros(now) - STREAM_WINDOW * 1_000_000)
    gap = (F.unix_micros("at") - F.unix_micros(F.lag("at").over(Window.partitionBy("dataset").orderBy("at")))) / 1e6
    per = (
        seen.withColumn("gap", gap)
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("polls"), F.max("at").alias("newest"), upper_median("gap").alias("median"))
        .select(
            "dataset", "polls", ((F.unix_micros(now) - F.unix_micros("newest")) / 1e6).alias("age_seconds"),
            F.when(F.col("polls") >= LEAST_POLLS, F.col("median")).alias("cadence_seconds"),
        )
    )
    if configured is None:
        return per
    return configured.join(per, "dataset", "left").select("dataset", F.coalesce("polls", F.lit(0)).cast("long").alias("polls"), "age_seconds", "cadence_seconds")


def silent(streams: DataFrame) -> DataFrame:
    """Streams that are late by their own rhythm, with ``problem``."""
    allowed = F.greatest(F.lit(float(MAX_AGE)), F.col("cadence_seconds") * MISSES)
    problem = (
        F.when(F.col("polls") == 0, "has not answered once")
        .when(F.col("cadence_seconds").isNull() & (F.col("age_seconds") > UNKNOWN_GRACE), "has answered only a few times, not lately")
        .when(F.col("age_seconds") > allowed, "has not answered for longer than usual")
    )
    return streams.withColumn("problem", problem).filter("problem is not null")


def poll_summary(polls: DataFrame, now: Column) -> DataFrame:
    """One row over the newest 200 polls: ``age_seconds, recent_polls, recent_errors``."""
    last = polls.filter("feed = 'et'").orderBy(F.desc("polled_at")).limit(LAST_POLLS)
    age = (F.unix_micros(now) - F.unix_micros(instant("polled_at"))) / 1e6
    return last.select(age.alias("age"), F.col("error").isNotNull().alias("bad")).agg(
        F.min("age").alias("age_seconds"), F.count_if(F.col("age") <= RECENT).alias("recent_polls"), F.count_if((F.col("age") <= RECENT) & F.col("bad")).alias("recent_errors")
    )


def check(polls: DataFrame, now: str, configured: DataFrame | None = None) -> Verdict:
    """The verdict at ``now`` (an ISO text). Brings at most one row per stream to the driver."""
    at = instant(F.lit(now))
    s = poll_summary(polls, at).first()
    if s["age_seconds"] is None:
        return Verdict(False, None, 0, None, ["the archive has no polls at all"])
    share = s["recent_errors"] / s["recent_polls"] if s["recent_polls"] else None
    problems = []
    if s["age_seconds"] > MAX_AGE:
        problems.append(f"no new polls for {s['age_seconds'] / 60:.0f} minutes")
    if share is not None and share > MAX_ERROR_SHARE:
        problems.append(f"{share:.0%} of the last {s['recent_polls']} polls failed")
    if not s["recent_polls"]:
        problems.append("no polls in the last half hour")
    problems += [f"{r['dataset']} {r['problem']}" for r in silent(stream_ages(polls, at, configured)).orderBy("dataset").collect()]
    return Verdict(not problems, s["age_seconds"] / 60, s["recent_polls"], share, problems)
