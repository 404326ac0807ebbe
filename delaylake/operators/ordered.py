"""Ordered analytics: first rows, running sums that a gap ends, states of a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row; equals in ``order`` are told apart by the other columns.

    The row is its own sort key, so a task holds it once and not as value and as order.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return least.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def unbroken_sums(df: DataFrame, keys: list[str], order: str, value: str, expected: Column, name: str) -> DataFrame:
    """Running sums of ``value`` where no value up to here is missing (their number is the expected one)."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn(name, F.sum(value).over(upto)).withColumn("_known", F.count(value).over(upto))
    return summed.filter(F.col("_known") == expected).drop("_known")


def sequence_state(df: DataFrame, keys: list[str], order: str, value: str, back: int = 3) -> DataFrame:
    """``keys, current, current_value, n, trend``: the last element, and how far it is from the last one ``back`` or more before."""
    items = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("s"))
    last = F.element_at("s", -1)
    base = F.filter("s", lambda x: x["o"] <= last["o"] - back)
    return items.select(
        *keys, last["o"].alias("current"), last["v"].alias("current_value"), F.size("s").cast("long").alias("n"), F.when(F.size(base) > 0, last["v"] - F.element_at(base, -1)["v"]).alias("trend")
    )


def same_key_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of pairs per key, null being a key like any other; both sides are counted before they meet."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, a[key].eqNullSafe(b["_key"])).select(key, (F.col("_a") * F.col("_b")).alias("pairs"))
