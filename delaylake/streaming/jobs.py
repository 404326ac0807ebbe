"""Structured Streaming jobs: closed buckets, ingest of raw files, the current picture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from delaylake.sources.archive import TABLES, poll_groups, raw_files
from delaylake.sources.feeds import JOURNEY, journey_calls


def stream_buckets(stream: DataFrame, keys: list[str], at: str, value: str, seconds: int, delay: str = "1 hour") -> DataFrame:
    """``keys, bucket, n, total`` over tumbling buckets; a bucket comes out once the watermark has passed it."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    grouped = timed.groupBy(*keys, F.window("_at", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(*keys, F.floor(F.unix_seconds("w.start") / seconds).cast("long").alias("bucket"), "n", "total")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the sink is a Parquet folder."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def maintained_buckets(stream: DataFrame, keys: list[str], at: str, value: str, seconds: int, target: str, checkpoint: str) -> DataFrame:
    """All buckets of what a stream holds now, maintained by updates in ``target``."""
    grouped = stream_buckets(stream, keys, at, value, seconds)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    grouped.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    newest = F.max_by(F.struct("n", "total"), "batch")
    return stream.sparkSession.read.parquet(target).groupBy(*keys, "bucket").agg(newest.alias("_v")).select(*keys, "bucket", "_v.n", "_v.total")


def ingest(spark: SparkSession, raw: str, lines: DataFrame, modes: list[str], root: str, checkpoint: str) -> DataStreamWriter:
    """New XML files below ``raw`` into the hot tier's calls and polls; pages (``_p1``, ``_p2`` ...) that arrive together are one poll.

    Exactly the files of a batch are read once; a batch that is run again after a
    failure overwrites its own folder, so nothing is stored twice.
    """
    stream = spark.readStream.format("xml").option("rowTag", "EstimatedVehicleJourney").option("ignoreNamespace", "true").schema(JOURNEY).load(raw)
    stream = stream.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        files = batch.groupBy("path").agg(F.min("arrived").alias("arrived")).persist()
        pages = poll_groups(raw_files(files.select("path"))).select("dataset", F.col("pages").cast("long").alias("pages"), F.get("paths", F.lit(0)).alias("first"), F.explode("paths").alias("path"))
        groups = pages.join(files, "path").groupBy("first", "dataset", "pages").agg(F.min("arrived").alias("arrived"), F.collect_list("path").alias("paths"))
        groups = groups.select(
            F.abs(F.xxhash64("first")).alias("poll_id"), F.date_format("arrived", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("polled_at"), "dataset", "pages", "paths"
        ).persist()
        calls = journey_calls(batch.drop("arrived")).join(groups.select("poll_id", "polled_at", F.explode("paths").alias("path")), "path")
        kept = calls.join(lines.filter(F.col("mode").isin(modes)).select("line_ref"), "line_ref", "left_semi").persist()
        every = calls.groupBy("poll_id").agg(F.countDistinct("journey_ref").alias("all"))
        counts = kept.groupBy("poll_id").agg(F.countDistinct("journey_ref").alias("n_journeys"), F.count(F.lit(1)).alias("n_calls"))
        none = lambda kind: F.lit(None).cast(kind)
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        polls = groups.join(every, "poll_id", "left").join(counts, "poll_id", "left").select(
            "poll_id", "polled_at", F.lit("et").alias("feed"), "dataset", "pages", zero("n_journeys").alias("n_journeys"),
            zero("n_calls").alias("n_calls"), (zero("all") - zero("n_journeys")).cast("long").alias("n_dropped"), none("long").alias("duration_ms"), none("string").alias("error"),
        )
        for table, rows in (("calls", kept), ("polls", polls)):
            rows.select(*TABLES[table].fieldNames()).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{table}/batch={batch_id}")
        for held in (kept, groups, files):
            held.unpersist()

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def current_picture(stream: DataFrame, keys: list[str], at: str, minutes: int = 20) -> DataFrame:
    """The newest row per key of a stream, forgotten ``minutes`` after the newest event."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", f"{minutes} minutes")
    return timed.groupBy(*keys, F.window("_at", f"{minutes} minutes").alias("w")).agg(F.max_by(F.struct(*stream.columns), "_at").alias("_r")).select("_r.*")
