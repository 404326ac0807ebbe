"""The archive's tiers: append-only Parquet, one union of hot and cold, raw file listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylake import schemas

TABLES = {"calls": schemas.CALLS, "polls": schemas.POLLS, "weather": schemas.WEATHER, "situations": schemas.SITUATIONS, "lines": schemas.LINES, "quays": schemas.QUAYS}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_tier(spark: SparkSession, root: str, table: str, files: Iterable[str] | None = None, days: list[str] | None = None) -> DataFrame:
    """A tier's table by its fixed schema; empty where there is no folder. ``files`` pins the input, ``days`` prunes a tier kept by day."""
    schema = TABLES[table]
    if files is not None:
        files = list(files)
        return spark.read.schema(schema).parquet(*files) if files else empty(spark, schema)
    path = f"{root}/{table}"
    if not exists(spark, path):
        return empty(spark, schema)
    rows = spark.read.schema(schema).parquet(path)
    if days is not None:
        rows = rows.filter(F.col("poll_day").cast("string").isin(days)) if "poll_day" in rows.columns else rows.filter(F.substring("polled_at", 1, 10).isin(days))
    # folders by day or by batch add their own column
    return rows.select(*schema.fieldNames())


def read_all(spark: SparkSession, hot: str, cold: str, table: str) -> DataFrame:
    """Hot and cold rows of a table; filters and columns reach both scans."""
    return read_tier(spark, hot, table).unionByName(read_tier(spark, cold, table))


def pinned(df: DataFrame) -> list[str]:
    """The files a frame reads, so that one run sees one state of the archive."""
    return sorted(df.inputFiles())


def with_polls(calls: DataFrame, polls: DataFrame) -> DataFrame:
    """Calls with their poll's time where they carry none."""
    return calls.drop("polled_at").join(polls.select("poll_id", "polled_at"), "poll_id")


def append(df: DataFrame, root: str, table: str) -> None:
    df.select(*TABLES[table].fieldNames()).write.mode("append").option("compression", "zstd").parquet(f"{root}/{table}")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` by key; columns in ``keep`` stay as they were where the key was there."""
    was, now = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    found = F.col(f"n.{keys[0]}").isNotNull()
    had = F.col(f"o.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        if c in keep:
            return F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(found, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return was.join(now, on, "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Of each key the row with the greatest ``by``: a key-value state from its log."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*by)).alias("_r")).select("_r.*")


def raw_files(paths: DataFrame) -> DataFrame:
    """``path`` into ``day, stamp, dataset, page, polled``; names are ``HHMMSS[_DATASET]_pN`` in a folder per day."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    base = F.element_at(F.split(name, r"\."), 1)
    parts = F.split(base, "_")
    n = F.size(parts)
    rows = paths.select(
        "path",
        F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})/[^/]+$", 1).alias("day"),
        F.element_at(parts, 1).alias("stamp"),
        F.when(n >= 3, F.get(parts, F.lit(1))).alias("dataset"),
        F.when(n >= 3, F.get(parts, F.lit(2))).when(n == 2, F.get(parts, F.lit(1))).otherwise("p1").alias("page"),
        name.alias("name"),
    )
    return rows.withColumn("polled", F.try_to_timestamp(F.concat_ws(" ", "day", "stamp"), F.lit("yyyy-MM-dd HHmmss")))


def poll_groups(files: DataFrame) -> DataFrame:
    """Pages put together to polls: a new one starts at page 1 and where the dataset changes."""
    line = Window.partitionBy("day").orderBy("name")
    before = F.lag(F.struct("dataset")).over(line)
    starts = (F.col("page") == "p1") | before.isNull() | ~before["dataset"].eqNullSafe(F.col("dataset"))
    numbered = files.withColumn("_new", starts.cast("int")).withColumn("group", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("day", "group").agg(
        F.min_by("stamp", "name").alias("stamp"), F.min_by("dataset", "name").alias("dataset"), F.min_by("polled", "name").alias("polled"),
        F.count(F.lit(1)).alias("pages"), F.sort_array(F.collect_list("path")).alias("paths"),
    )
