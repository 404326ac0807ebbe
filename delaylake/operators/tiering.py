"""Storage maintenance: export of finished days, repair of a day, hole-filling from raw files.

A path is never overwritten while it is read: results go to a new folder, are
counted, and take the old one's place by renames. Counts are verified before
anything is deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake import schemas
from delaylake.sources.archive import TABLES, exists, poll_groups, raw_files

from .asof import nearest_within

TOLERANCE = 45.0


def poll_day(at: Column) -> Column:
    """The UTC day of a poll."""
    return F.substring(at, 1, 10)


def eligible_days(polls: DataFrame, keep_days: int, today: str) -> DataFrame:
    """Days that may leave the hot tier: at least ``keep_days`` old, and over."""
    limit = F.date_format(F.date_sub(F.lit(today).cast("date"), keep_days), "yyyy-MM-dd")
    return polls.select(poll_day(F.col("polled_at")).alias("day")).distinct().filter((F.col("day") <= limit) & (F.col("day") < F.lit(today)))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, a = _fs(spark, old)
    if not fs.rename(a, _fs(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def export_days(df: DataFrame, root: str, table: str, days: list[str], day: Column) -> dict[str, int]:
    """Write the days' rows to ``root/table/poll_day=...``. Returns rows per day written.

    A day that is there already is compared with the rows at hand: those it does not hold
    (late ones, or all but some after a broken run) are added, the others not written again.
    Raises where a folder does not hold in the end what it must.
    """
    spark = df.sparkSession
    rows = df.withColumn("poll_day", day).filter(F.col("poll_day").isin(days))
    old = [d for d in days if exists(spark, f"{root}/{table}/poll_day={d}")]
    if old:
        stored_ = spark.read.schema(df.schema).parquet(*[f"{root}/{table}/poll_day={d}" for d in old]).select(*df.columns).withColumn("poll_day", day)
        rows = rows.exceptAll(stored_)
    fresh = f"{root}/{table}.new"
    delete(spark, fresh)
    rows.repartition("poll_day", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy("poll_day").option("compression", "zstd").parquet(fresh)
    count = lambda part: {r["poll_day"]: r["count"] for r in part.groupBy("poll_day").count().collect()}
    written = spark.read.schema(df.schema).parquet(fresh).select(*df.columns).withColumn("poll_day", day)
    expected, stored = count(rows), count(written)
    if stored != expected:
        delete(spark, fresh)
        raise RuntimeError(f"{table}: wrote {stored}, expected {expected}")
    before = count(stored_) if old else {}
    fs, base = _fs(spark, f"{root}/{table}")
    fs.mkdirs(base)
    for d in expected:
        if d not in old:
            rename(spark, f"{fresh}/poll_day={d}", f"{root}/{table}/poll_day={d}")
            continue
        for part in fs.listStatus(_fs(spark, f"{fresh}/poll_day={d}")[1]):
            name = part.getPath().getName()
            if name.endswith(".parquet"):
                rename(spark, f"{fresh}/poll_day={d}/{name}", f"{root}/{table}/poll_day={d}/late-{name}")
    delete(spark, fresh)
    for d in [d for d in old if d in expected]:
        now = spark.read.schema(df.schema).parquet(f"{root}/{table}/poll_day={d}").count()
        if now != before.get(d, 0) + expected[d]:
            raise RuntimeError(f"{table}, {d}: holds {now} rows, expected {before.get(d, 0) + expected[d]}")
    return expected


@dataclass
class Compacted:
    days: list[str]
    rows: dict[str, int]


def replace(spark: SparkSession, folder: str) -> None:
    """Put ``folder.new`` in the place of ``folder``; what a broken run left is found by :func:`recovered`."""
    delete(spark, f"{folder}.old")
    rename(spark, folder, f"{folder}.old")
    rename(spark, f"{folder}.new", folder)
    delete(spark, f"{folder}.old")


def recovered(spark: SparkSession, folder: str) -> None:
    """Where a run broke off between the renames of :func:`replace`, the former folder comes back."""
    if exists(spark, f"{folder}.old") and not exists(spark, folder):
        rename(spark, f"{folder}.old", folder)


def compact(spark: SparkSession, hot: str, cold: str, today: str, keep_days: int = 7) -> Compacted:
    """Move finished days of calls, polls and weather to the cold tier.

    Hot rows go only after every table's export is verified; rows whose time is
    missing are of no day and stay.
    """
    read = lambda t: spark.read.schema(TABLES[t]).parquet(f"{hot}/{t}").select(*TABLES[t].fieldNames())
    for t in ("calls", "polls", "weather"):
        recovered(spark, f"{hot}/{t}")
    days = sorted(r["day"] for r in eligible_days(read("polls"), keep_days, today).collect())
    tables = [t for t in ("calls", "polls", "weather") if exists(spark, f"{hot}/{t}")]
    written = {t: sum(export_days(read(t), cold, t, days, poll_day(F.col("polled_at"))).values()) for t in tables}
    if days:
        for t in tables:
            gone = F.coalesce(poll_day(F.col("polled_at")).isin(days), F.lit(False))
            read(t).filter(~gone).write.mode("overwrite").option("compression", "zstd").parquet(f"{hot}/{t}.new")
            replace(spark, f"{hot}/{t}")
    return Compacted(days, written)


def prune_days(spark: SparkSession, root: str, before: str) -> list[str]:
    """Delete the raw folders of days (names of ten signs) before ``before``."""
    fs, p = _fs(spark, root)
    gone = []
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name = status.getPath().getName()
        if status.isDirectory() and len(name) == 10 and name < before:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def coerced(df: DataFrame, schema=schemas.CALLS) -> DataFrame:
    """The schema's columns in its order; what does not fit its type becomes null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


@dataclass
class Rewritten:
    before: int
    dropped: int
    added: int
    after: int


def kept_rows(calls: DataFrame, replaced: DataFrame) -> DataFrame:
    """Identified rows of polls that are not replaced; with nothing replaced all identified rows."""
    return calls.filter("journey_ref is not null").join(replaced.select("poll_id").distinct(), "poll_id", "left_anti").select(*calls.columns)


def rewrite_day(spark: SparkSession, folder: str, recovered: DataFrame, replaced: DataFrame) -> Rewritten:
    """Put the recovered rows in place of the replaced polls' rows; the former folder stays as ``.bak``."""
    source = f"{folder}.bak" if exists(spark, f"{folder}.bak") and not exists(spark, folder) else folder
    calls = spark.read.schema(schemas.CALLS).parquet(source)
    kept, new = kept_rows(calls, replaced), coerced(recovered)
    before, usable, added = calls.count(), kept.count(), new.count()
    fresh = f"{folder}.new"
    kept.unionByName(new).write.mode("overwrite").option("compression", "zstd").parquet(fresh)
    after = spark.read.schema(schemas.CALLS).parquet(fresh).count()
    if after != usable + added:
        delete(spark, fresh)
        raise RuntimeError(f"replacement holds {after} rows, expected {usable + added}")
    delete(spark, f"{folder}.bak")
    rename(spark, folder, f"{folder}.bak")
    rename(spark, fresh, folder)
    return Rewritten(before, before - usable, added, after)


def allowed(calls: DataFrame, lines: DataFrame, modes: list[str]) -> DataFrame:
    """Calls of lines with an allowed mode; unknown lines go."""
    return calls.join(lines.filter(F.col("mode").isin(modes)).select("line_ref"), "line_ref", "left_semi").select(*calls.columns)


def new_groups(listed: DataFrame, polls: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Raw polls (``dataset, polled``) with no known poll of their dataset within the tolerance: the holes."""
    known = polls.select("dataset", F.try_to_timestamp("polled_at").alias("at"), "poll_id")
    found = nearest_within(listed, known, ["dataset"], "polled", "at", tolerance, ["poll_id"])
    return found.filter("poll_id is null").drop("poll_id")


def matched_groups(listed: DataFrame, polls: DataFrame, tolerance: float = TOLERANCE, earliest: bool = False) -> DataFrame:
    """Raw polls with the ``poll_id`` and ``polled_at`` of the nearest (or earliest) known poll of their dataset."""
    known = polls.select("dataset", F.try_to_timestamp("polled_at").alias("at"), "poll_id", "polled_at")
    return nearest_within(listed, known, ["dataset"], "polled", "at", tolerance, ["poll_id", "polled_at"], earliest)


def absent_journeys(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls of journeys that their poll does not hold yet."""
    have = known.select("poll_id", "journey_ref").distinct()
    return calls.join(have, (calls["poll_id"] == have["poll_id"]) & calls["journey_ref"].eqNullSafe(have["journey_ref"]), "left_anti")


def widened_counters(polls: DataFrame, added: DataFrame) -> DataFrame:
    """Poll counters after ``added`` calls joined: more journeys and calls, fewer dropped (never below 0)."""
    more = added.groupBy("poll_id").agg(F.countDistinct("journey_ref").alias("_j"), F.count(F.lit(1)).alias("_c"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return polls.join(more, "poll_id", "left").withColumns(
        {"n_journeys": zero("n_journeys") + zero("_j"), "n_calls": zero("n_calls") + zero("_c"), "n_dropped": F.greatest(zero("n_dropped") - zero("_j"), F.lit(0).cast("long"))}
    ).select(*polls.columns)


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw polls of listed files."""
    return poll_groups(raw_files(spark.createDataFrame([(p,) for p in paths], "path string")))
