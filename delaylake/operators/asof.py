"""As-of, closed-bucket, interval and nearest lookups as window and equi-join plans.

Spark lowers an inequality join to a nested loop, and its private as-of join is
quadratic per key, so every lookup here is a sorted window over the union of
facts and probes, or an equi-join on a derived key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 86_400


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def as_of(
    probes: DataFrame,
    facts: DataFrame,
    keys: list[str],
    probe_time: str,
    fact_time: str,
    values: list[str],
    ties: list[str] = (),
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """``probes`` with the ``values`` of the newest fact at or before ``probe_time`` (null if none).

    Keys match null-safely. Values travel as one struct, so a null value of the
    newest fact is not skipped. Of facts at one time the greatest ``ties`` win.

    Time is cut into slices: each (key, slice) is one window, and what a slice
    inherits comes from a summary of one row per slice, so a hot key spreads over
    its slices.
    """
    tick = slice_seconds * 1_000_000
    value = F.struct(*values).alias("_value")
    tie = F.struct(*[F.col(c) for c in ties]) if ties else F.struct(F.lit(0).alias("z"))
    key_cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    t = lambda c: _micros(F.col(c))
    right = facts.filter(F.col(fact_time).isNotNull()).select(*key_cols, t(fact_time).alias("_t"), value, tie.alias("_tie"))
    right = right.withColumn("_slice", F.floor(F.col("_t") / tick))
    left = probes.select(*key_cols, t(probe_time).alias("_t"), F.floor(t(probe_time) / tick).alias("_slice"), F.struct(*probes.columns).alias("_row"))

    events = right.select(*names, "_slice", "_t", "_tie", "_value", F.lit(0).alias("_probe")).unionByName(
        left.select(*names, "_slice", "_t", "_row", F.lit(1).alias("_probe")), allowMissingColumns=True
    )
    inside = Window.partitionBy(*names, "_slice").orderBy("_t", "_probe", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = events.withColumn("_local", F.last("_value", ignorenulls=True).over(inside)).filter("_probe = 1")

    newest = right.groupBy(*names, "_slice").agg(F.max_by("_value", F.struct("_t", "_tie")).alias("_value"))
    asked = left.select(*names, "_slice").distinct()
    before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = newest.unionByName(asked, allowMissingColumns=True).groupBy(*names, "_slice").agg(F.first("_value", ignorenulls=True).alias("_value"))
    carried = slices.withColumn("_carried", F.last("_value", ignorenulls=True).over(before)).drop("_value").filter("_carried is not null")
    same = [local[n].eqNullSafe(carried[n]) for n in names] + [local["_slice"] == carried["_slice"]]
    joined = local.join(carried, same, "left")
    found = F.coalesce("_local", "_carried")
    return joined.select("_row.*", *[found[v].alias(v) for v in values])


def closed_mean_table(asked: DataFrame, history: DataFrame, keys: list[str], bucket: str, window: int | None, name: str, least: int = 1) -> DataFrame:
    """``keys, bucket, name`` for every (keys, bucket) of ``asked``: the mean of ``history`` (``keys, bucket, n, total``) over closed buckets.

    Buckets ``[b - window, b - 1]``, or all before ``b`` where ``window`` is None;
    no row with fewer than ``least`` observations. One shuffle on the keys:
    distinct asked buckets join the series as empty ones, a range frame sums them.
    """
    empty = asked.select(*keys, bucket).distinct().select("*", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(1).alias("_asked"))
    series = history.select(*keys, bucket, F.col("n").cast("long").alias("n"), F.col("total").cast("double").alias("total"), F.lit(0).alias("_asked")).unionByName(empty)
    series = series.groupBy(*keys, bucket).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("_asked").alias("_asked"))
    low = Window.unboundedPreceding if window is None else -window
    frame = Window.partitionBy(*keys).orderBy(bucket).rangeBetween(low, -1)
    n, total = F.sum("n").over(frame), F.sum("total").over(frame)
    means = series.select(*keys, bucket, "_asked", F.when(n >= least, total / n).alias(name))
    return means.filter((F.col("_asked") == 1) & F.col(name).isNotNull()).drop("_asked")


def joined(rows: DataFrame, looked_up: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined with a lookup's result on its keys, null-safely."""
    new = [c for c in looked_up.columns if c not in keys]
    side = looked_up.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *new)
    return rows.join(side, [rows[k].eqNullSafe(side[f"_k_{k}"]) for k in keys], "left").select(*rows.columns, *new)


def closed_means(probes: DataFrame, history: DataFrame, keys: list[str], bucket: str, window: int | None, name: str, least: int = 1) -> DataFrame:
    """``probes`` with the mean of :func:`closed_mean_table` (null where that has none)."""
    return joined(probes, closed_mean_table(probes, history, keys, bucket, window, name, least), [*keys, bucket])


def _with_other(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events (``_t, _o, _cur``) with ``_pair``: the event, and the last one before it of another owner."""
    line = Window.partitionBy(*keys).orderBy("_t", "_o")
    previous = F.lag("_cur").over(line)
    changed = F.when(F.col("_prev").isNotNull() & ~F.col("_prev._owner").eqNullSafe(F.col("_cur._owner")), F.col("_prev"))
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("_prev", previous).withColumn("_pair", F.struct("_cur", F.last(changed, ignorenulls=True).over(upto).alias("_other"))).drop("_prev")


def last_by_other(
    probes: DataFrame,
    events: DataFrame,
    keys: list[str],
    probe_time: str,
    event_time: str,
    owner: str,
    order: list[str],
    values: list[str],
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """``probes`` with the ``values`` of the newest event at or before ``probe_time`` whose ``owner`` is another.

    Beside each event stands the last one of the run of another owner before it;
    a probe takes the newest event, or that other one if the newest is its own.
    Each (key, time slice) is one window; of a slice the last event and the last
    one of another owner are all that later slices can need.
    """
    tick = slice_seconds * 1_000_000
    names = [f"_k{i}" for i in range(len(keys))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, names)]
    at, by = _micros(F.col(event_time)), F.struct(*order)
    payload = F.struct(F.col(owner).alias("_owner"), *values, at.alias("_at"), by.alias("_by"))
    ev = events.select(*key_cols, at.alias("_t"), by.alias("_o"), payload.alias("_cur")).filter("_t is not null").withColumn("_slice", F.floor(F.col("_t") / tick))
    ev = _with_other(ev, [*names, "_slice"])
    probed = _micros(F.col(probe_time))
    left = probes.select(*key_cols, probed.alias("_t"), F.floor(probed / tick).alias("_slice"), F.struct(*probes.columns).alias("_row"))

    all_ = ev.select(*names, "_slice", "_t", "_o", "_pair", F.lit(0).alias("_probe")).unionByName(
        left.select(*names, "_slice", "_t", "_row", F.lit(1).alias("_probe")), allowMissingColumns=True
    )
    seen = Window.partitionBy(*names, "_slice").orderBy("_t", "_probe", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = all_.withColumn("_got", F.last("_pair", ignorenulls=True).over(seen)).filter("_probe = 1")

    ends = ev.groupBy(*names, "_slice").agg(F.max_by("_pair", F.struct("_t", "_o")).alias("_p")).select(*names, "_slice", F.explode(F.array("_p._cur", "_p._other")).alias("_cur"))
    ends = ends.filter("_cur is not null").select("*", F.col("_cur._at").alias("_t"), F.col("_cur._by").alias("_o"))
    ends = _with_other(ends, names)
    asked = left.select(*names, "_slice").distinct()
    steps = ends.select(*names, "_slice", "_t", "_o", "_pair", F.lit(1).alias("_event")).unionByName(asked.withColumn("_event", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*names).orderBy("_slice", "_event", "_t", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = steps.withColumn("_carried", F.last("_pair", ignorenulls=True).over(before)).filter("_event = 0").select(*names, "_slice", "_carried")

    same = [local[n].eqNullSafe(carried[n]) for n in names] + [local["_slice"].eqNullSafe(carried["_slice"])]
    both = local.join(carried, same, "left")
    me = F.col(f"_row.{owner}")
    choice = lambda pair: F.when(me.eqNullSafe(F.col(f"{pair}._cur._owner")), F.col(f"{pair}._other")).otherwise(F.col(f"{pair}._cur"))
    pick = F.coalesce(choice("_got"), choice("_carried"))
    return both.select("_row.*", *[pick[v].alias(v) for v in values])


def strictly_later(probes: DataFrame, facts: DataFrame, keys: list[str], probe_order: Column, fact_order: Column, values: list[str]) -> DataFrame:
    """``probes`` with the ``values`` of each key's last fact (of equals the greatest values), where that fact is strictly later."""
    last = facts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(F.struct(*values), F.struct(fact_order.alias("o"), *values)).alias("_value"), F.max(fact_order).alias("_order")
    )
    same = [probes[k].eqNullSafe(last[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = probes.withColumn("_mine", probe_order).join(last, same, "left")
    ok = F.col("_order") > F.col("_mine")
    return joined.select(*probes.columns, *[F.when(ok, F.col("_value")[v]).alias(v) for v in values])


def nearest_within(
    probes: DataFrame, facts: DataFrame, keys: list[str], probe_time: str, fact_time: str, tolerance: float, values: list[str], earliest: bool = False, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """``probes`` with the nearest fact at most ``tolerance`` seconds away (of two as near the later one).

    With ``earliest`` the first fact within the tolerance instead. The newest fact at or
    before a probe and the first one at or after it are two as-of lookups, so no
    probe meets more than two facts however many share its key. Of facts at one time
    the one with the least values (as JSON) counts.
    """
    at = lambda c, sign=1, shift=0: F.timestamp_micros(sign * (_micros(F.col(c)) + shift))
    side = facts.filter(F.col(fact_time).isNotNull()).groupBy(*keys, _micros(F.col(fact_time)).alias("_ft"))
    side = side.agg(F.min_by(F.struct(*values), F.to_json(F.struct(*values))).alias("_fact"))
    side = side.select(*keys, F.struct("_fact", "_ft").alias("_found"), F.timestamp_micros("_ft").alias("_up"), F.timestamp_micros(-F.col("_ft")).alias("_down"))
    wide = int(tolerance * 1_000_000)
    here = _micros(F.col(probe_time))
    # first at or after: the newest at or before where time runs backwards
    rows = probes.withColumn("_from", at(probe_time, -1, -wide if earliest else 0))
    found = as_of(rows, side, keys, "_from", "_down", ["_found"], slice_seconds=slice_seconds).withColumnRenamed("_found", "_after")
    after = F.when(F.abs(F.col("_after._ft") - here) <= wide, F.col("_after"))
    if earliest:
        best = after
    else:
        found = as_of(found.withColumn("_until", at(probe_time)), side, keys, "_until", "_up", ["_found"], slice_seconds=slice_seconds).withColumnRenamed("_found", "_before")
        before = F.when(here - F.col("_before._ft") <= wide, F.col("_before"))
        later = F.col("_after._ft") - here <= F.coalesce(here - F.col("_before._ft"), F.lit(1 << 62))
        best = F.when(later, F.coalesce(after, before)).otherwise(F.coalesce(before, after))
    return found.withColumn("_best", best).select(*[F.col(c) for c in probes.columns], *[F.col("_best._fact")[v].alias(v) for v in values])


def in_force(start: Column, end: Column, at: Column) -> Column:
    """Whether ``at`` lies in a validity period; open ends are null, both ends count."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def active_counts(
    probes: DataFrame, periods: DataFrame, keys: list[str], probe_time: str, start: str, end: str, name: str, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """``probes`` with the number of periods of their key in force at ``probe_time``.

    Starts minus ends before: two event streams and a running sum per time slice,
    onto which the sum of earlier slices is added. No range join.
    """
    tick = slice_seconds * 1_000_000
    names = [f"_k{i}" for i in range(len(keys))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, names)]
    lowest = F.lit(-(1 << 62)).cast("long")
    opens = periods.select(*key_cols, F.coalesce(_micros(F.col(start)), lowest).alias("_t"), F.lit(0).alias("_kind"), F.lit(1).alias("_d"))
    closes = periods.filter(F.col(end).isNotNull()).select(*key_cols, _micros(F.col(end)).alias("_t"), F.lit(2).alias("_kind"), F.lit(-1).alias("_d"))
    place = F.floor(F.col("_t") / tick)
    steps = opens.unionByName(closes).groupBy(*names, "_t", "_kind").agg(F.sum("_d").alias("_d")).withColumn("_slice", place)
    asked = probes.select(*key_cols, _micros(F.col(probe_time)).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).alias("_d"), F.struct(*probes.columns).alias("_row")).withColumn("_slice", place)
    running = Window.partitionBy(*names, "_slice").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = steps.unionByName(asked, allowMissingColumns=True).withColumn("_n", F.sum("_d").over(running)).filter("_kind = 1")
    sums = steps.select(*names, "_slice", "_d").unionByName(asked.select(*names, "_slice", "_d").distinct()).groupBy(*names, "_slice").agg(F.sum("_d").alias("_d"))
    earlier = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_carried", F.sum("_d").over(earlier)).drop("_d")
    same = [local[n].eqNullSafe(carried[n]) for n in names] + [local["_slice"].eqNullSafe(carried["_slice"])]
    return local.join(carried, same, "left").select("_row.*", (F.col("_n") + F.coalesce("_carried", F.lit(0))).cast("long").alias(name))
