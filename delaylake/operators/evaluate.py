"""Scores of forecasts: by horizon, by source, intervals, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.functions.temporal import horizon_band, ladder_probability, prefix_before

BANDS = ("00-05", "05-10", "10-20", "20-45")
#: what :func:`horizon_report` reads of a row
REPORTED = ("horizon_sec", "label_delay_sec", "current_delay_sec", "entur_pred_delay_sec")
RAIL = ("VYG", "GOA", "SJN", "FLT")
LEVELS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


def usable() -> Column:
    """Rows that scores are taken over."""
    return (F.abs("label_delay_sec") < 3600) & (F.col("horizon_sec") < 2700) & F.col("entur_pred_delay_sec").isNotNull() & F.col("current_delay_sec").isNotNull()


def mae(error: Column) -> Column:
    """Mean absolute error; null over nothing."""
    return F.avg(F.abs(error))


def pinball(actual: Column, predicted: Column, level: float) -> Column:
    d = actual - predicted
    return F.avg(F.when(d >= 0, d * level).otherwise(d * (level - 1)))


def coverage(actual: Column, low: Column, high: Column) -> Column:
    """Share inside the interval, ends included; null over nothing."""
    return F.avg(actual.between(low, high).cast("double"))


def horizon_report(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``band, n`` and the errors of timetable, naive and official forecast (and ``model``); empty bands are left out."""
    label = F.col("label_delay_sec")
    scores = [mae(label).alias("timetable"), mae(label - F.col("current_delay_sec")).alias("naive"), mae(label - F.col("entur_pred_delay_sec")).alias("official")]
    if model:
        scores.append(mae(label - F.col(model)).alias("model"))
    band = horizon_band(F.col("horizon_sec")).alias("band")
    return rows.filter(usable()).groupBy(band).agg(F.count(F.lit(1)).alias("n"), *scores).filter("band is not null")


def weighted(report: DataFrame, columns: list[str], weight: str = "n") -> DataFrame:
    """One row: count-weighted means of a report's columns."""
    return report.agg(F.sum(weight).alias(weight), *[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in columns])


def source_counts(rows: DataFrame, ref: str = "line_ref") -> DataFrame:
    """Rows per prefix before the colon; rows without one are left out."""
    return rows.groupBy(prefix_before(F.col(ref)).alias("source")).count().filter("source != ''").withColumnRenamed("count", "n")


def source_report(rows: DataFrame, model: str, least: int = 1000) -> DataFrame:
    """Errors per operator prefix (``?`` if unknown) with at least ``least`` rows, and ``rail``, the rail ones together, where RUT is among them."""
    label = F.col("label_delay_sec")
    source = F.coalesce(F.nullif(prefix_before(F.col("line_ref")), F.lit("")), F.lit("?")).alias("source")
    per = (
        rows.groupBy(source)
        .agg(
            F.count(F.lit(1)).alias("n"),
            mae(label - F.col("current_delay_sec")).alias("naive"),
            mae(label - F.col("entur_pred_delay_sec")).alias("official"),
            mae(label - F.col(model)).alias("model"),
        )
        .filter(F.col("n") >= least)
    )
    rail = weighted(per.filter(F.col("source").isin(*RAIL)), ["naive", "official", "model"]).filter("n is not null")
    known = per.filter("source = 'RUT'").select(F.lit(1).alias("_has"))
    rail = rail.join(F.broadcast(known), F.lit(True), "left_semi")
    return per.unionByName(rail.withColumn("source", F.lit("rail")).select(*per.columns))


def interval_report(rows: DataFrame, low: str, high: str, median: str) -> DataFrame:
    """Per band: n, coverage and width of the interval (crossed bounds change places), error of the median."""
    a, b = F.least(low, high), F.greatest(low, high)
    label = F.col("label_delay_sec")
    band = horizon_band(F.col("horizon_sec")).alias("band")
    return rows.groupBy(band).agg(
        F.count(F.lit(1)).alias("n"), coverage(label, a, b).alias("coverage"), F.avg(b - a).alias("width_sec"), mae(label - F.col(median)).alias("median_mae")
    ).filter("band is not null")


def pit_histogram(rows: DataFrame, ladder: str, actual: str, levels: list[float] = LEVELS) -> DataFrame:
    """Outcomes per tenth of the predicted distribution: ``bin`` 0 to 9 (the last one closed), ``n``, ``share``."""
    p = ladder_probability(F.col(ladder), levels, F.col(actual))
    counts = rows.select(F.least(F.floor(p * 10), F.lit(9)).cast("long").alias("bin")).filter("bin is not null").groupBy("bin").count().withColumnRenamed("count", "n")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("bin", "n", (F.col("n") / F.col("total")).alias("share"))


def reliability(rows: DataFrame, ladder: str, minutes: int, levels: list[float] = LEVELS) -> DataFrame:
    """How often arrivals said to come within ``minutes`` did, per fifth of the probability said."""
    threshold = F.lit(minutes * 60.0) - (F.col("horizon_sec") - F.col("entur_pred_delay_sec"))
    asked = rows.withColumn("_x", threshold).filter("_x > -600")
    said = asked.select(F.floor(ladder_probability(F.col(ladder), levels, F.col("_x")) * 5).cast("long").alias("fifth"), (F.col("label_delay_sec") <= F.col("_x")).cast("double").alias("came"))
    return said.filter("fifth between 0 and 4").groupBy("fifth").agg(F.count(F.lit(1)).alias("n"), F.avg("came").alias("observed"))
