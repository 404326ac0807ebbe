"""Column functions over ISO-8601 texts with offsets, instants and buckets.

Texts keep their offset; an instant is derived beside them. Calendar fields come
from the text (its own offset), differences and buckets from the instant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column | str) -> Column:
    """The instant of an ISO text (``Z`` or ``+hh:mm``); null for what is not one."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def epoch(text: Column | str) -> Column:
    """Seconds since 1970, fractions included."""
    return F.unix_micros(instant(text)) / F.lit(1e6)


def secs(later: Column, earlier: Column) -> Column:
    """Seconds between two instants; null if one is missing."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def bucket_of(at: Column, seconds: int) -> Column:
    """Number of the time bucket an instant falls into; fractions of a second never reach the next one."""
    return F.floor(F.unix_micros(at) / F.lit(1_000_000 * seconds)).cast("long")


def hour_floor(at: Column) -> Column:
    return F.date_trunc("hour", at)


def own_hour(text: Column) -> Column:
    """Hour of day in the text's own offset."""
    return F.substring(text, 12, 2).cast("long")


def own_weekday(text: Column) -> Column:
    """Monday 0 ... Sunday 6, in the text's own offset."""
    return F.weekday(F.to_date(F.substring(text, 1, 10))).cast("long")


def own_date(text: Column) -> Column:
    return F.substring(text, 1, 10)


def last_token(text: Column, mark: str = ":") -> Column:
    return F.element_at(F.split(text, mark), -1)


def prefix_before(text: Column, mark: str = ":") -> Column:
    """What stands before the first mark; empty where there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def flag(text: Column) -> Column:
    """1 for ``true`` in any case, else 0."""
    return F.coalesce((F.lower(F.trim(text)) == "true").cast("long"), F.lit(0).cast("long"))


def horizon_band(seconds: Column) -> Column:
    """0-5, 5-10, 10-20 and 20-45 minutes; null beyond."""
    m = seconds / 60
    return F.when(m < 0, None).when(m < 5, "00-05").when(m < 10, "05-10").when(m < 20, "10-20").when(m < 45, "20-45")


def ladder(*rungs: Column) -> Column:
    """Quantile predictions in rising order (crossed ones change places)."""
    return F.array_sort(F.array(*rungs))


def ladder_probability(values: Column, levels: list[float], x: Column) -> Column:
    """Chance of at most ``x`` read from a rising ladder of quantiles at ``levels``.

    Linear between rungs; a flat pair gives the upper level; strictly below the
    ladder half the lowest level, strictly above halfway between the highest and 1.
    """
    n = len(levels)
    v = [values[i] for i in range(n)]
    out = F.lit(float(levels[-1]))
    for i in range(n - 2, -1, -1):
        low, high = F.lit(float(levels[i])), F.lit(float(levels[i + 1]))
        inside = F.when(v[i + 1] <= v[i], high).otherwise(low + (high - low) * (x - v[i]) / (v[i + 1] - v[i]))
        out = F.when(x <= v[i + 1], inside).otherwise(out)
    out = F.when(x == v[-1], F.lit(float(levels[-1]))).when(x > v[-1], F.lit(levels[-1] + (1 - levels[-1]) * 0.5)).otherwise(out)
    return F.when(x < v[0], F.lit(levels[0] * 0.5)).when(x == v[0], F.lit(float(levels[0]))).when(x.isNotNull(), out)


def interpolate(a: Column, b: Column, share: Column) -> Column:
    """Point between two, the share kept within 0 and 1; a missing start is the end."""
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.coalesce(a, b) + (b - F.coalesce(a, b)) * kept


def sampled(ref: Column, keep: int) -> Column:
    """Whole journeys by the last hex sign of their reference: ``keep`` sixteenths (0 or 16 and more keep all)."""
    if keep <= 0 or keep >= 16:
        return F.lit(True)
    return F.lower(F.substring(ref, -1, 1)).isin([f"{i:x}" for i in range(keep)])
