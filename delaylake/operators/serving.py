"""What is served: the current picture, vehicles on the map, the network, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delaylake.functions.temporal import instant, interpolate, last_token

from .evaluate import weighted
from .history import History
from .replay import feature_rows

RECENT_MINUTES = 20
BOX = (59.0, 61.5, 9.5, 12.5)
MODE_WEIGHT = {"rail": 2.0, "metro": 1.6, "tram": 1.2}
METRO_COLOURS = {"1": "#0073DB", "2": "#EC700C", "3": "#A85FA5", "4": "#004A98", "5": "#34B233"}
MODE_COLOURS = {"tram": "#0B91EF", "metro": "#EC700C", "rail": "#003087", "bus": "#E60000", "water": "#682C88"}
GREY = "#33404F"


def latest_poll(polls: DataFrame, dataset: str | None = None) -> DataFrame:
    """The newest successful poll with calls (one row or none)."""
    ok = polls.filter("feed = 'et' and error is null and n_calls > 0")
    if dataset:
        ok = ok.filter(F.col("dataset") == dataset)
    return ok.orderBy(F.desc("polled_at")).limit(1)


def recent_polls(polls: DataFrame, minutes: int = RECENT_MINUTES, per_dataset: bool = True) -> DataFrame:
    """Polls later than ``minutes`` before the newest one (of their dataset), not of the clock.

    An unrecorded call count is not an empty poll.
    """
    good = polls.filter("feed = 'et' and error is null").withColumn("at", instant("polled_at"))
    newest = F.max(F.when(F.col("n_calls") > 0, F.col("at")))
    keys = [F.col("dataset").alias("_dataset")] if per_dataset else []
    top = good.groupBy(*keys).agg(newest.alias("newest"))
    on = F.col("dataset").eqNullSafe(F.col("_dataset")) if per_dataset else F.lit(True)
    near = F.unix_micros("at") > F.unix_micros("newest") - minutes * 60_000_000
    return good.join(top, on).filter((F.coalesce("n_calls", F.lit(1)) > 0) & near).select(*polls.columns)


def live_rows(calls: DataFrame, polls: DataFrame, weather: DataFrame, situations: DataFrame, past: History, minutes: int = RECENT_MINUTES) -> DataFrame:
    """Feature rows of the current picture, without labels."""
    now = calls.join(recent_polls(polls, minutes).select("poll_id"), "poll_id", "left_semi").select(*calls.columns)
    return feature_rows(now, weather, situations, past, require_label=False)


def inside(lat: Column, lon: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    """Within the drawn area, borders included."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def newest_sightings(rows: DataFrame, keys: list[str] = ("journey_ref", "operating_date")) -> DataFrame:
    """Of each journey its newest row (of one poll the nearest stop), with ``dest``, the name of its highest stop."""
    order = F.struct(instant("polled_at"), -F.col("order_no"), F.col("poll_id"), F.col("stop_ref"))
    dest = F.max_by("stop_name", F.struct("order_no", instant("polled_at")))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_r"), dest.alias("dest")).select("_r.*", F.coalesce("dest", "_r.stop_name").alias("dest"))


def vehicles(rows: DataFrame, calls: DataFrame, quays: DataFrame, lines: DataFrame, now: str, predicted: str = "model_pred_delay_sec") -> DataFrame:
    """One row per running vehicle: position between the last stop and the next by time, and what is forecast."""
    places = quays.filter(F.col("lat").isNotNull() & inside(F.col("lat"), F.col("lon"))).select("quay_ref", "lat", "lon")
    seen = newest_sightings(rows)
    # the archive keeps the feed's own date, rows carry the derived one: stops are found by poll and journey
    stops = calls.select(F.col("poll_id").alias("_p"), F.col("journey_ref").alias("_j"), F.col("order_no").alias("_o"), F.col("stop_ref").alias("origin")).groupBy("_p", "_j", "_o").agg(F.min("origin").alias("origin"))
    v = seen.join(stops, (seen["poll_id"] == stops["_p"]) & (seen["journey_ref"] == stops["_j"]) & (seen["current_order"] == stops["_o"]), "left")
    target = places.select(F.col("quay_ref").alias("stop_ref"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    source = places.select(F.col("quay_ref").alias("origin"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    v = v.join(target, "stop_ref").join(source, "origin", "left").join(lines.select("line_ref", "mode"), "line_ref", "left")
    at = lambda c: F.unix_micros(instant(c)) / 1e6
    started = at("polled_at") - F.coalesce("since_last_stop_sec", F.lit(0.0))
    span = at("entur_expected_ts") - started
    share = F.when(span <= 0, 0.0).otherwise((at(F.lit(now)) - started) / span)
    whole = lambda c: F.bround(c, 0).cast("long")
    maybe = [whole(F.col(c)).alias(n) if c in rows.columns else F.lit(None).cast("long").alias(n) for c, n in (("pred_low_sec", "low"), ("pred_high_sec", "high"))]
    return v.select(
        F.bround(interpolate(F.col("slon"), F.col("tlon"), share), 5).alias("lon"), F.bround(interpolate(F.col("slat"), F.col("tlat"), share), 5).alias("lat"),
        F.bround("tlon", 5).alias("tlon"), F.bround("tlat", 5).alias("tlat"), whole(F.col("horizon_sec")).alias("eta"), last_token(F.coalesce("line_ref", F.lit(""))).alias("line"),
        F.coalesce("mode", F.lit("bus")).alias("mode"), F.col("stop_name").alias("stop"), "dest", F.bround(F.col("horizon_sec") / 60, 1).alias("in_min"),
        whole(F.col("entur_pred_delay_sec")).alias("entur"), whole(F.col(predicted)).alias("model"), *maybe, whole(F.col("current_delay_sec")).alias("now"),
    )


def longest_journeys(sized: DataFrame) -> DataFrame:
    """Of each line and direction the journey with most ``stops`` (ties: least reference)."""
    order = Window.partitionBy("line_ref", "direction").orderBy(F.desc("stops"), "journey_ref", "operating_date")
    return sized.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("line_ref", "direction", "journey_ref", "operating_date")


def longest_patterns(calls: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """``line_ref, direction, path``: the stops of each line's journey with most stops (ties: least reference).

    ``best`` are these journeys (:func:`longest_journeys`) where the caller knows them;
    one row per line and direction, so they are sent to the calls and not the calls to them.
    """
    known = calls.filter("stop_ref is not null and order_no is not null")
    if best is None:
        best = longest_journeys(known.groupBy("line_ref", "direction", "journey_ref", "operating_date").agg(F.countDistinct("order_no").alias("stops")))
    b = F.broadcast(best.select(*[F.col(c).alias(f"_{c}") for c in best.columns]))
    own = known.join(b, [known[c].eqNullSafe(b[f"_{c}"]) for c in best.columns], "left_semi")
    steps = own.select("line_ref", "direction", "order_no", "stop_ref").distinct()
    path = F.transform(F.array_sort(F.collect_list(F.struct("order_no", "stop_ref"))), lambda x: x["stop_ref"])
    return steps.groupBy("line_ref", "direction").agg(path.alias("path"))


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def network(calls: DataFrame, quays: DataFrame, lines: DataFrame, recent: int = 600) -> DataFrame:
    """Routes as run lately: ``line, mode, colour, weight, path`` (points of known stops in order), each path of a line once."""
    newest = calls.agg(F.max("poll_id").alias("_top"))
    last = calls.join(F.broadcast(newest), F.col("poll_id") >= F.col("_top") - recent, "left_semi")
    places = quays.filter(F.col("lat").isNotNull() & inside(F.col("lat"), F.col("lon")))
    point = F.struct(F.bround("lon", 5).alias("lon"), F.bround("lat", 5).alias("lat"), F.coalesce("stop_place_name", "name").alias("name"))
    stops = longest_patterns(last).select("line_ref", "direction", F.posexplode("path").alias("pos", "quay_ref")).join(places.select("quay_ref", point.alias("p")), "quay_ref")
    paths = stops.groupBy("line_ref", "direction").agg(F.array_sort(F.collect_list(F.struct("pos", "quay_ref", "p"))).alias("s")).filter(F.size("s") >= 2)
    once = paths.withColumn("refs", F.col("s.quay_ref")).dropDuplicates(["line_ref", "refs"])
    r = once.join(lines.select("line_ref", "mode", "public_code", "colour"), "line_ref", "left")
    mode = F.coalesce("mode", F.lit("bus"))
    colour = F.coalesce(
        F.when(mode == "metro", _mapped(METRO_COLOURS, F.col("public_code"))), F.when(F.col("colour") != "", F.concat(F.lit("#"), F.col("colour"))), _mapped(MODE_COLOURS, mode), F.lit(GREY)
    )
    weight = F.coalesce(_mapped({k: str(v) for k, v in MODE_WEIGHT.items()}, mode).cast("double"), F.lit(0.7))
    return r.select(F.coalesce("public_code", last_token(F.col("line_ref"))).alias("line"), mode.alias("mode"), colour.alias("colour"), weight.alias("weight"), F.col("s.p").alias("path"))


def missing_stops(calls: DataFrame, quays: DataFrame) -> DataFrame:
    """Stops in calls that have no position yet."""
    used = calls.filter("stop_ref is not null").select(F.col("stop_ref").alias("quay_ref")).distinct()
    return used.join(quays.select("quay_ref"), "quay_ref", "left_anti")


def totals(calls: DataFrame) -> DataFrame:
    """Number of calls and the span of their polls."""
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.min("polled_at").alias("first"), F.max("polled_at").alias("last"))


def score(report: DataFrame) -> DataFrame:
    """A horizon report in one row, weighted by its counts."""
    return weighted(report, [c for c in report.columns if c not in ("band", "n")])


def export_payload(path: str, **frames: DataFrame) -> None:
    """Each frame as JSON lines in ``path/name``, written by the executors."""
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def cached(spark: SparkSession, path: str, build, max_age: float, now: float, **parameters) -> DataFrame:
    """``build()`` kept as Parquet at ``path`` with a manifest; built anew if older, made with other parameters, or damaged."""
    import json

    from delaylake.sources.archive import exists

    if exists(spark, f"{path}/manifest") and exists(spark, f"{path}/data"):
        try:
            known = json.loads(spark.read.text(f"{path}/manifest").first()[0])
            df = spark.read.parquet(f"{path}/data")
            if known["parameters"] == parameters and 0 <= now - known["made"] <= max_age and df.count() == known["rows"]:
                return df
        except Exception:  # noqa: BLE001 - a damaged cache is no cache
            pass
    build().write.mode("overwrite").parquet(f"{path}/data")
    df = spark.read.parquet(f"{path}/data")
    manifest = json.dumps({"parameters": parameters, "made": now, "rows": df.count()})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return df
