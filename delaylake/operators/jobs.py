"""Whole jobs over the archive: the training table, backfill from raw files, widening, situations, repair.

Each job reads, counts and only then writes; with ``dry_run`` it reports what it would do.
Days that have left the hot tier are closed: backfill and widening refuse them, repair
rewrites them whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylake import schemas
from delaylake.sources.archive import append, exists, poll_groups, raw_files, read_all, read_tier
from delaylake.sources.feeds import journey_calls, read_journeys, read_situations, situation_rows

from . import tiering
from .cut import cut
from .history import history
from .replay import feature_rows


@dataclass
class Report:
    """What a job found and did; ``rows`` by table."""

    found: int = 0
    skipped: int = 0
    rows: dict[str, int] = field(default_factory=dict)
    dry_run: bool = False


def rebuild_training(
    spark: SparkSession, hot: str, cold: str, target: str, sample: int = 0, with_bunching: bool = False, days: list[str] | None = None
) -> dict[str, int]:
    """Replay the archive into ``target``, partitioned by operating date. Returns rows per date.

    ``days`` are UTC days of polls to replay; history is always that of the whole archive. The
    new table takes the old one's place once it is counted.
    """
    tables = {t: read_all(spark, hot, cold, t) for t in ("calls", "weather", "situations")}
    past = history(tables["calls"])
    calls = tables["calls"]
    if days is not None:
        calls = calls.filter(tiering.poll_day(F.col("polled_at")).isin(days))
    rows = feature_rows(calls, tables["weather"], tables["situations"], past, sample, with_bunching)
    fresh = f"{target}.new"
    tiering.recovered(spark, target)
    out = rows.withColumn("service_day", F.coalesce("operating_date", F.lit("unknown")))
    out.repartition("service_day", F.pmod(F.xxhash64("journey_ref", "poll_id"), F.lit(16))).write.mode("overwrite").option("compression", "zstd").partitionBy("service_day").parquet(fresh)
    written = {str(r["service_day"]): r["count"] for r in training_rows(spark, fresh, keep_day=True).groupBy("service_day").count().collect()}
    if exists(spark, target):
        tiering.replace(spark, target)
    else:
        tiering.rename(spark, fresh, target)
    return written


def training_rows(spark: SparkSession, path: str, days: list[str] | None = None, keep_day: bool = False) -> DataFrame:
    """The stored training table; ``days`` prunes it by operating date."""
    schema = T.StructType([*schemas.TRAINING_ROWS.fields, T.StructField("service_day", T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    if days is not None:
        rows = rows.filter(F.col("service_day").isin(days))
    return rows if keep_day else rows.drop("service_day")


def _listed(spark: SparkSession, raw: str) -> DataFrame:
    """Paths of the raw files below ``raw``, a folder per day."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml*").load(raw)
    return raw_files(files.select("path"))


def _open_days(groups: DataFrame, cold: str) -> DataFrame:
    """Groups of days that are not in the cold tier."""
    spark = groups.sparkSession
    days = [r["day"] for r in groups.select("day").distinct().collect()]
    closed = [d for d in days if exists(spark, f"{cold}/calls/poll_day={d}")]
    if closed:
        raise ValueError(f"days that are compacted cannot be filled: {', '.join(sorted(closed))}")
    return groups


def _parsed(groups: DataFrame, poll_id: str = "poll_id") -> DataFrame:
    """Calls of the groups' files, with each group's ``poll_id`` and ``polled_at``."""
    spark = groups.sparkSession
    placed = cut(groups.select("paths", poll_id, "polled_at"), "groups")
    paths = [p for r in placed.select("paths").toLocalIterator() for p in r["paths"]]
    if not paths:
        return spark.createDataFrame([], schemas.CALLS)
    read = journey_calls(read_journeys(spark, paths))
    by_path = placed.select(F.explode("paths").alias("_path"), F.col(poll_id).alias("poll_id"), "polled_at")
    tail = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+)$", 1)
    joined = read.drop("poll_id", "polled_at").join(by_path, tail(F.col("path")) == tail(F.col("_path")))
    return tiering.coerced(joined)


def _iso(at):
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def backfill(spark: SparkSession, raw: str, hot: str, cold: str, lines: DataFrame, modes: list[str], dry_run: bool = False, tolerance: float = tiering.TOLERANCE) -> Report:
    """Fill holes: raw polls with no known poll of their dataset nearby become polls and calls. Running it again adds nothing."""
    groups = _open_days(poll_groups(_listed(spark, raw)), cold)
    holes = cut(tiering.new_groups(groups, read_all(spark, hot, cold, "polls"), tolerance), "holes")
    found = holes.count()
    report = Report(found, groups.count() - found, dry_run=dry_run)
    if dry_run or not found:
        return report
    named = holes.withColumns({"poll_id": F.abs(F.xxhash64("day", "stamp", F.coalesce("dataset", F.lit("")))), "polled_at": _iso("polled")})
    all_calls = cut(_parsed(named), "parsed")
    kept = cut(tiering.allowed(all_calls, lines, modes), "kept")
    every = all_calls.groupBy("poll_id").agg(F.countDistinct("journey_ref").alias("_all"))
    counts = kept.groupBy("poll_id").agg(F.countDistinct("journey_ref").alias("_j"), F.count(F.lit(1)).alias("_c"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    polls = named.join(every, "poll_id", "left").join(counts, "poll_id", "left").select(
        "poll_id", "polled_at", F.lit("et").alias("feed"), "dataset", F.col("pages").cast("long").alias("pages"), zero("_j").alias("n_journeys"), zero("_c").alias("n_calls"),
        (zero("_all") - zero("_j")).alias("n_dropped"), none("long").alias("duration_ms"), none("string").alias("error"),
    )
    report.rows = {"calls": kept.count(), "polls": found}
    # calls first: a poll without calls would not be filled again
    append(kept, hot, "calls")
    append(polls, hot, "polls")
    return report


def widen(spark: SparkSession, raw: str, hot: str, cold: str, lines: DataFrame, modes: list[str], dry_run: bool = False, tolerance: float = tiering.TOLERANCE) -> Report:
    """Add journeys of newly allowed modes to polls that are known: those their poll does not hold yet."""
    groups = _open_days(poll_groups(_listed(spark, raw)), cold)
    polls = read_tier(spark, hot, "polls")
    matched = tiering.matched_groups(groups, polls, tolerance).filter("poll_id is not null")
    calls = tiering.allowed(_parsed(matched), lines, modes)
    added = cut(tiering.absent_journeys(calls, read_tier(spark, hot, "calls")), "added")
    n = added.count()
    report = Report(n, 0, {"calls": n}, dry_run)
    if dry_run or not n:
        return report
    widened = tiering.widened_counters(polls, added)
    widened.write.mode("overwrite").option("compression", "zstd").parquet(f"{hot}/polls.new")
    append(added, hot, "calls")
    tiering.replace(spark, f"{hot}/polls")
    return report


def backfill_situations(spark: SparkSession, raw: str, hot: str, dry_run: bool = False) -> Report:
    """Situations of raw files whose time no stored row has yet."""
    files = _listed(spark, raw).select("path", _iso("polled").alias("polled_at"))
    known = read_tier(spark, hot, "situations").select("polled_at").distinct()
    new = cut(files.join(known, "polled_at", "left_anti"), "situations")
    found = new.count()
    report = Report(found, files.count() - found, dry_run=dry_run)
    if dry_run or not found:
        return report
    paths = [r["path"] for r in new.toLocalIterator()]
    tail = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+)$", 1)
    read = read_situations(spark, paths).withColumn("_path", tail(F.col("path")))
    rows = read.drop("path").join(new.select(tail(F.col("path")).alias("_path"), "polled_at"), "_path")
    listed = tiering.coerced(situation_rows(rows, F.col("polled_at")), schemas.SITUATIONS)
    report.rows = {"situations": listed.count()}
    append(listed, hot, "situations")
    return report


def repair(spark: SparkSession, raw: str, cold: str, day: str, lines: DataFrame, modes: list[str], dataset: str | None = None, dry_run: bool = False, tolerance: float = tiering.TOLERANCE) -> tiering.Rewritten | Report:
    """Rewrite a compacted day: its polls (of ``dataset``) that raw files hold are parsed anew and take the stored rows' place."""
    groups = poll_groups(_listed(spark, raw)).filter(F.col("day") == day)
    if dataset is not None:
        groups = groups.filter(F.col("dataset") == dataset)
    matched = tiering.matched_groups(groups, read_tier(spark, cold, "polls", days=[day]), tolerance, earliest=True).filter("poll_id is not null")
    recovered = cut(tiering.allowed(_parsed(matched), lines, modes), "recovered")
    if dry_run:
        return Report(matched.count(), 0, {"calls": recovered.count()}, True)
    return tiering.rewrite_day(spark, f"{cold}/calls/poll_day={day}", recovered, recovered.select("poll_id").distinct())
