"""Observed history in closed time buckets: segment runtimes, stop and line delays, passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylake.functions.temporal import bucket_of, instant, secs

BUCKET_SECONDS = 900
RECENT_SECONDS = 1800
LEAST_FOR_TYPICAL = 3


def passes(calls: DataFrame) -> DataFrame:
    """Recorded calls with a time, of journeys not cancelled, at the poll that first knew them.

    ``arrived`` prefers the arrival, ``departed`` the departure. Rows without
    journey or order are no pass. A pass without aimed time has no delay but
    still counts for runtimes.
    """
    known = calls.filter(
        (F.col("call_type") == "recorded") & (F.coalesce("cancelled", F.lit(0)) == 0) & F.col("journey_ref").isNotNull() & F.col("order_no").isNotNull()
    ).select(
        "journey_ref", "operating_date", "order_no", "line_ref", "direction", "stop_ref", "poll_id", "polled_at",
        instant("polled_at").alias("seen"),
        F.coalesce(instant("actual_arr"), instant("actual_dep")).alias("arrived"),
        F.coalesce(instant("actual_dep"), instant("actual_arr")).alias("departed"),
        F.coalesce(instant("aimed_arr"), instant("aimed_dep")).alias("aimed"),
    ).filter("arrived is not null")
    first = Window.partitionBy("journey_ref", "operating_date", "order_no").orderBy("seen", "polled_at", "poll_id", "stop_ref")
    return known.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth").withColumn("delay", secs(F.col("arrived"), F.col("aimed")))


def consecutive(first_seen: DataFrame) -> DataFrame:
    """Runtimes from each stop to the next order, visible once both ends are; null dates are one date."""
    trip = Window.partitionBy("journey_ref", "operating_date").orderBy("order_no")
    nxt = F.lead(F.struct("order_no", "stop_ref", "arrived", "seen")).over(trip)
    return (
        first_seen.withColumn("_next", nxt)
        .filter(F.col("_next.order_no") == F.col("order_no") + 1)
        .select(
            "line_ref", "direction", F.col("stop_ref").alias("stop_from"), F.col("_next.stop_ref").alias("stop_to"),
            F.greatest("seen", "_next.seen").alias("seen"), secs(F.col("_next.arrived"), F.col("departed")).alias("runtime"),
        )
        .filter("runtime > 0")
    )


def bucketed(rows: DataFrame, keys: list[str], at: str, value: str, seconds: int) -> DataFrame:
    """``keys, bucket, n, total`` of ``value``; nulls are left out."""
    return (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys, bucket_of(F.col(at), seconds).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    )


@dataclass
class History:
    """Bucketed history of an archive; frames are lazy."""

    segments: DataFrame
    stops: DataFrame
    lines: DataFrame
    passed: DataFrame
    bucket_seconds: int = BUCKET_SECONDS

    @property
    def recent_buckets(self) -> int:
        return max(1, RECENT_SECONDS // self.bucket_seconds)


def history(calls: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> History:
    seen = passes(calls)
    return History(
        segments=bucketed(consecutive(seen), ["line_ref", "direction", "stop_from", "stop_to"], "seen", "runtime", bucket_seconds),
        stops=bucketed(seen, ["stop_ref"], "seen", "delay", bucket_seconds),
        lines=bucketed(seen, ["line_ref", "direction"], "seen", "delay", bucket_seconds),
        passed=seen.filter("delay is not null"),
        bucket_seconds=bucket_seconds,
    )


def exported(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per entity with parallel ``buckets, counts, totals`` arrays in bucket order."""
    ordered = buckets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "total"))).alias("s"))
    return ordered.select(*keys, F.col("s.bucket").alias("buckets"), F.col("s.n").alias("counts"), F.col("s.total").alias("totals"))
