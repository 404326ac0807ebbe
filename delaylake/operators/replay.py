"""Replay of an archive into feature rows: what was known at each poll, never later.

One row per (snapshot, stop ahead). A snapshot is one journey in one poll. The
plan is relational throughout: vehicle state and labels are windows over one
exchange by journey, history frames over closed buckets, forecasts and
situations as-of windows, and slack a running sum along each snapshot's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylake.functions.temporal import bucket_of, hour_floor, instant, own_date, own_hour, own_weekday, sampled, secs
from delaylake.schemas import TRAINING_ROWS

from .asof import as_of, closed_mean_table, closed_means, in_force, joined, last_by_other
from .cut import cut
from .history import BUCKET_SECONDS, LEAST_FOR_TYPICAL, History, history
from .ordered import unbroken_sums

TRIP = ["journey_ref", "operating_date"]
SNAPSHOT = [*TRIP, "polled_at", "poll_id"]
TREND_STOPS = 3


def replayable(calls: DataFrame, sample: int = 0) -> DataFrame:
    """Rows with journey and order; ``sample`` sixteenths of the journeys."""
    return calls.filter(F.col("journey_ref").isNotNull() & F.col("order_no").isNotNull() & sampled(F.col("journey_ref"), sample))


def _timed(calls: DataFrame) -> DataFrame:
    first = lambda a, b: F.coalesce(instant(a), instant(b))
    text = lambda a, b: F.when(instant(a).isNotNull(), F.col(a)).otherwise(F.col(b))
    return calls.withColumns(
        {
            "polled": instant("polled_at"),
            "aimed": first("aimed_arr", "aimed_dep"),
            "aimed_text": text("aimed_arr", "aimed_dep"),
            "expected": first("expected_arr", "expected_dep"),
            "expected_text": text("expected_arr", "expected_dep"),
            "actual": first("actual_arr", "actual_dep"),
            "actual_text": text("actual_arr", "actual_dep"),
            "leaves": first("aimed_dep", "aimed_arr"),
        }
    )


def in_context(calls: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (:func:`_timed`) of running, uncancelled snapshots, each with what its journey, its stop and its snapshot tell.

    Of the journey ``service_date``: its operating date, or where the feed has none
    the own date of its earliest aimed time. Of the stop ``truth``, the last seen
    actual time, and ``known``, when it was last seen. Of the snapshot current stop
    and delay, trend over at least three stops, staleness, and when the current stop
    was to be left. All are windows over one exchange by journey: no row is copied,
    grouped and joined back, and what nobody asks for falls out of the plan.
    """
    stop, journey = Window.partitionBy(*TRIP, "order_no"), Window.partitionBy(*TRIP)
    whole = Window.partitionBy(*SNAPSHOT).orderBy("order_no", "call_type", "stop_ref").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    recorded = F.col("call_type") == "recorded"
    last = F.struct("polled", "polled_at", "poll_id").alias("known")
    label = F.when(recorded & F.col("actual").isNotNull(), F.struct(last, F.struct("actual", "actual_text").alias("truth")))
    rows = calls.repartition(*([parts] if parts else []), "journey_ref").withColumn("_label", F.max(label).over(stop))
    earliest = F.min_by(own_date(F.col("aimed_text")), F.struct("aimed", "aimed_text")).over(journey)
    rows = rows.withColumn("service_date", F.coalesce("operating_date", earliest))

    delay = F.when(recorded, secs(F.col("actual"), F.col("aimed")))
    seen = F.when(delay.isNotNull(), F.struct(F.col("order_no").alias("order"), delay.alias("delay"), F.col("actual").alias("actual")))
    first = lambda c: F.first(c).over(whole)
    rows = rows.withColumn("_seen", seen).withColumns({
        "_cancelled": first("cancelled"), "_recorded_at": first("recorded_at"), "snapshot_line": first("line_ref"),
        "_current": F.max("_seen").over(whole), "n_recorded": F.count("_seen").over(whole),
    })
    rows = rows.filter((F.coalesce("_cancelled", F.lit(0)) == 0) & F.col("_current").isNotNull())
    rows = rows.withColumns({"current_order": F.col("_current.order"), "current_delay_sec": F.col("_current.delay")})
    base = F.max(F.when(F.col("_seen.order") <= F.col("current_order") - TREND_STOPS, F.col("_seen"))).over(whole)
    here = F.first(F.when(recorded & (F.col("order_no") == F.col("current_order")), F.struct("leaves")), ignorenulls=True).over(whole)
    return rows.withColumns({"_base": base, "_here": here}).select(
        *calls.columns, "_label.truth", "_label.known", "service_date", "snapshot_line", "current_order", "current_delay_sec", "n_recorded",
        (F.col("current_delay_sec") - F.col("_base.delay")).alias("delay_trend_sec"),
        secs(F.col("polled"), instant("_recorded_at")).alias("obs_age_sec"),
        secs(F.col("polled"), F.col("_current.actual")).alias("since_last_stop_sec"),
        F.col("_here.leaves").alias("current_leaves"),
    )


def path_typicals(placed: DataFrame, past: History) -> DataFrame:
    """Per (snapshot, order ahead) of rows in their context the typical runtime from the current stop there; no row where a piece is unknown.

    One edge per pair of consecutive orders in the snapshot, one history lookup
    per edge, then a running sum and count: the path is whole where the count
    equals the stops travelled.
    """
    stops = placed.groupBy(*SNAPSHOT, "order_no").agg(
        F.max_by(F.struct("stop_ref", "line_ref", "direction"), F.struct(F.col("call_type") == "estimated", F.col("stop_ref"))).alias("at"),
        F.max("current_order").alias("current_order"),
    )
    trip = Window.partitionBy(*SNAPSHOT).orderBy("order_no")
    before = F.lag(F.struct("order_no", "at")).over(trip)
    edges = (
        stops.withColumn("_before", before)
        .filter((F.col("_before.order_no") == F.col("order_no") - 1) & F.col("_before.at.stop_ref").isNotNull() & F.col("at.stop_ref").isNotNull())
        .filter("order_no > current_order")
        .select(
            *SNAPSHOT, "order_no", "current_order", F.col("at.line_ref").alias("line_ref"), F.col("at.direction").alias("direction"),
            F.col("_before.at.stop_ref").alias("stop_from"), F.col("at.stop_ref").alias("stop_to"),
            bucket_of(instant("polled_at"), past.bucket_seconds).alias("bucket"),
        )
    )
    ahead = cut(edges, "edges")
    known = closed_means(ahead, past.segments, ["line_ref", "direction", "stop_from", "stop_to"], "bucket", None, "typical", LEAST_FOR_TYPICAL)
    whole = unbroken_sums(known, SNAPSHOT, "order_no", "typical", F.col("order_no") - F.col("current_order"), "typical_sum")
    return whole.select(*SNAPSHOT, "order_no", "typical_sum")


def situation_counts(snapshots: DataFrame, situations: DataFrame) -> DataFrame:
    """``snapshots`` with the situations in force at ``polled`` as the newest stamp then knew them.

    ``sx_line_active`` counts rows of ``snapshot_line``, ``sx_network_active``
    distinct situations (the last listed period holds). No stamp yet gives nulls,
    a stamp without matches 0.
    """
    sx = situations.select(
        instant("polled_at").alias("stamp"), "situation_number", "line_ref", instant("start_time").alias("s"), instant("end_time").alias("e"),
    )
    stamps = sx.select("stamp").distinct().withColumn("known_stamp", F.col("stamp"))
    polls = snapshots.select("polled").distinct()
    placed = as_of(polls, stamps, [], "polled", "stamp", ["known_stamp"])
    per_poll = placed.filter("known_stamp is not null")
    listed = per_poll.join(sx, per_poll["known_stamp"] == sx["stamp"]).withColumn("on", in_force(F.col("s"), F.col("e"), F.col("polled")))
    by_line = listed.filter("on and line_ref != ''").groupBy("polled", "line_ref").agg(F.count(F.lit(1)).alias("sx_line_active"))
    last = listed.groupBy("polled", "situation_number").agg(F.max_by("on", F.struct(F.coalesce("s", F.lit("1970-01-01").cast("timestamp")), F.col("e"), "line_ref")).alias("on"))
    network = last.groupBy("polled").agg(F.count_if("on").alias("sx_network_active"))
    stamp_known = placed.select(F.col("polled").alias("_p"), "known_stamp")
    out = snapshots.join(stamp_known, snapshots["polled"] == stamp_known["_p"], "left").drop("_p")
    by_line = by_line.select(F.col("polled").alias("_p"), F.col("line_ref").alias("_l"), "sx_line_active")
    out = out.join(by_line, (out["polled"] == by_line["_p"]) & (out["snapshot_line"] == by_line["_l"]), "left").drop("_p", "_l")
    network = network.withColumnRenamed("polled", "_p")
    out = out.join(network, out["polled"] == network["_p"], "left").drop("_p")
    count = lambda c: F.when(F.col("known_stamp").isNotNull(), F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return out.select(*snapshots.columns, count("sx_line_active"), count("sx_network_active"))


def _iso(text: Column) -> Column:
    """ISO text with ``Z`` written as an offset."""
    return F.regexp_replace(text, "Z$", "+00:00")


def feature_rows(
    calls: DataFrame,
    weather: DataFrame,
    situations: DataFrame,
    past: History | None = None,
    sample: int = 0,
    with_bunching: bool = False,
    require_label: bool = True,
    columns: tuple[str, ...] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Training rows (or, without ``require_label``, live rows) in the stored column order.

    ``past`` is the history to look up (by default that of ``calls``, all of it:
    sampling never thins history). ``columns`` are those to return, by default all;
    every row is there either way, and a lookup that feeds none of them is not made.
    ``parts``: of the exchange by journey, where the caller knows the size of ``calls``.
    """
    fields = [f for f in TRAINING_ROWS.fields if columns is None or f.name in columns]
    asked = {f.name for f in fields}
    weathered, situated, pathed = {"fc_air_temp", "fc_precip_mm", "fc_wind_mps"} & asked, {"sx_line_active", "sx_network_active"} & asked, {"seg_slack_sec"} & asked
    recent = {"stop_recent_delay_sec", "line_recent_delay_sec"} & asked
    bunched = {"headway_ahead_sec", "delay_ahead_sec"} & asked if with_bunching else set()
    if pathed or recent or bunched:
        past = past or history(calls)
    placed = in_context(_timed(replayable(calls, sample)), parts)
    if pathed:
        placed = cut(placed, "placed")
    ahead = placed.filter((F.col("call_type") == "estimated") & (F.coalesce("call_cancelled", F.lit(0)) == 0))
    ahead = ahead.withColumn("horizon_sec", secs(F.col("expected"), F.col("polled"))).filter(
        F.col("aimed").isNotNull() & (F.col("order_no") > F.col("current_order")) & (F.col("horizon_sec") > 0)
    )
    later = F.col("known") > F.struct("polled", "polled_at", "poll_id")
    ahead = ahead.withColumn("label", F.when(later, F.col("truth"))).drop("truth", "known")
    if require_label:
        ahead = ahead.filter("label is not null")

    if weathered or situated or pathed or recent or bunched:
        # every lookup below answers the distinct questions of this one table
        seconds = past.bucket_seconds if past else BUCKET_SECONDS
        ahead = ahead.withColumns({"_hour": hour_floor(F.col("expected")), "bucket": bucket_of(F.col("polled"), seconds)})
        ahead = cut(ahead, "ahead")
    base = ahead

    if situated:
        ahead = joined(ahead, situation_counts(base.select("polled", "snapshot_line").distinct(), situations), ["polled", "snapshot_line"])
    else:
        ahead = ahead.withColumns({c: F.lit(None).cast("long") for c in ("sx_line_active", "sx_network_active")})
    values = ["air_temp", "precip_mm", "wind_mps"]
    if weathered:
        forecasts = weather.select(instant("polled_at").alias("issued"), hour_floor(instant("forecast_time")).alias("_hour"), *values)
        ahead = joined(ahead, as_of(base.select("_hour", "polled").distinct(), forecasts, ["_hour"], "polled", "issued", values, ties=values), ["_hour", "polled"])
    else:
        ahead = ahead.withColumns({c: F.lit(None).cast("double") for c in values})
    if pathed:
        ahead = joined(ahead, path_typicals(placed, past), [*SNAPSHOT, "order_no"])
    else:
        ahead = ahead.withColumn("typical_sum", F.lit(None).cast("double"))
    for series, keys, name in (("stops", ["stop_ref"], "stop_recent_delay_sec"), ("lines", ["line_ref", "direction"], "line_recent_delay_sec")):
        if name in asked:
            ahead = joined(ahead, closed_mean_table(base, getattr(past, series), keys, "bucket", past.recent_buckets, name), [*keys, "bucket"])
    if bunched:
        events = past.passed.select("line_ref", "direction", "stop_ref", "seen", "journey_ref", F.col("arrived").alias("ahead_pass"), F.col("delay").alias("delay_ahead_sec"))
        ahead = last_by_other(
            ahead, events, ["line_ref", "direction", "stop_ref"], "polled", "seen", "journey_ref", ["ahead_pass", "delay_ahead_sec", "journey_ref"], ["ahead_pass", "delay_ahead_sec"]
        )
    else:
        ahead = ahead.withColumns({"ahead_pass": F.lit(None).cast("timestamp"), "delay_ahead_sec": F.lit(None).cast("double")})

    runtime = secs(F.col("aimed"), F.col("current_leaves"))
    out = ahead.withColumns({
        "operating_date": F.col("service_date"),
        "dow": own_weekday(F.col("aimed_text")),
        "hour": own_hour(F.col("aimed_text")),
        "horizon_stops": F.col("order_no") - F.col("current_order"),
        "fc_air_temp": F.col("air_temp"), "fc_precip_mm": F.col("precip_mm"), "fc_wind_mps": F.col("wind_mps"),
        "sched_runtime_sec": runtime,
        "seg_slack_sec": runtime - F.col("typical_sum"),
        "headway_ahead_sec": secs(F.col("expected"), F.col("ahead_pass")),
        "aimed_ts": _iso(F.col("aimed_text")),
        "entur_expected_ts": _iso(F.col("expected_text")),
        "actual_ts": _iso(F.col("label.actual_text")),
        "label_delay_sec": secs(F.col("label.actual"), F.col("aimed")),
        "entur_pred_delay_sec": secs(F.col("expected"), F.col("aimed")),
    })
    out = out.withColumn("polled_at", _iso(F.col("polled_at")))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
