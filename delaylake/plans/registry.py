"""All registered queries of the library with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import driver_queries


def queries() -> dict:
    return dict(driver_queries.QUERIES)


def oracles() -> dict[str, str]:
    return dict(driver_queries.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of an archive and the error of its forecasts by horizon."""
    return driver_queries.q31(spark, sf_dir)
