"""Scores, health, feeds, tiers, serving and models on small inputs."""

from __future__ import annotations

import gzip
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from scenarios import three_polls

from delaylake import schemas
from delaylake.functions import temporal as fn
from delaylake.operators import evaluate, health, models, serving, tiering
from delaylake.operators import jobs as archive_jobs
from delaylake.sources import archive, feeds
from delaylake.streaming import jobs

NS = 'xmlns="http://www.siri.org.uk/siri"'


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scores(spark):
    one = spark.createDataFrame([(10.0, 0.0)], "y double, p double")
    loss = lambda df, a: df.agg(evaluate.pinball(F.col("y"), F.col("p"), a).alias("v")).first()["v"]
    assert (loss(one, 0.5), loss(one, 0.9)) == (5.0, 9.0)
    other = one.selectExpr("p as y", "y as p")
    assert loss(other, 0.5) == 5.0 and abs(loss(other, 0.9) - 1.0) < 1e-12
    inside = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (15.0,)], "y double").agg(evaluate.coverage(F.col("y"), F.lit(1.0), F.lit(11.0)).alias("v"))
    assert inside.first()["v"] == 0.5
    assert one.filter("y < 0").agg(evaluate.coverage(F.col("y"), F.lit(1.0), F.lit(11.0)).alias("v")).first()["v"] is None


def test_ladder(spark):
    ladder = fn.ladder(F.lit(300.0), F.lit(60.0), F.lit(120.0))
    at = [value(spark, fn.ladder_probability(ladder, [0.1, 0.5, 0.9], F.lit(float(x)))) for x in (0, 60, 90, 120, 300, 400)]
    assert [round(a, 9) for a in at] == [0.05, 0.1, 0.3, 0.5, 0.9, 0.95]
    assert value(spark, fn.ladder(F.lit(10), F.lit(5), F.lit(30))) == [5, 10, 30]


def test_time_texts(spark):
    t = F.lit("2026-07-25T23:30:00+02:00")
    assert value(spark, fn.own_hour(t)) == 23 and value(spark, fn.own_weekday(t)) == 5
    assert value(spark, fn.secs(fn.instant(F.lit("2026-07-25T10:00:01.5Z")), fn.instant(F.lit("2026-07-25T12:00:00+02:00")))) == 1.5
    assert value(spark, fn.instant(F.lit("no time"))) is None
    assert value(spark, fn.prefix_before(F.lit("RUT:Line:1"))) == "RUT" and value(spark, fn.prefix_before(F.lit("none"))) == ""


def polls(spark, minutes_and_errors, now):
    rows = [(i, (now - timedelta(minutes=m)).isoformat(), "et", "RUT", 1, 1, 1, 0, 1, e) for i, (m, e) in enumerate(minutes_and_errors)]
    return spark.createDataFrame(rows, schemas.POLLS)


@pytest.mark.parametrize(
    ("ages", "ok"),
    [([(m, None) for m in range(20)], True), ([(m, None) for m in range(120, 140)], False), ([(m, "timeout") for m in range(20)], False), ([], False), ([(0, "x")] + [(m, None) for m in range(1, 20)], True)],
)
def test_health(spark, ages, ok):
    now = datetime(2026, 8, 1, 12, tzinfo=timezone.utc)
    verdict = health.check(polls(spark, ages, now), now.isoformat())
    assert verdict.ok == ok and bool(verdict.problems) == (not ok)


def test_silent_streams(spark):
    now = datetime(2026, 8, 1, 12, tzinfo=timezone.utc)
    configured = spark.createDataFrame([("RUT",), ("VYG",)], "dataset string")
    verdict = health.check(polls(spark, [(m, None) for m in range(20)], now), now.isoformat(), configured)
    assert not verdict.ok and len(verdict.problems) == 1 and verdict.problems[0].startswith("VYG")


def journey(identity, calls, extra=""):
    return f"<EstimatedVehicleJourney><RecordedAtTime>2026-07-25T12:00:00+02:00</RecordedAtTime><LineRef>RUT:Line:12</LineRef><DirectionRef>1</DirectionRef>{identity}{extra}{calls}</EstimatedVehicleJourney>"


def test_journeys_from_xml(spark, tmp_path):
    framed = "<FramedVehicleJourneyRef><DataFrameRef>2026-07-25</DataFrameRef><DatedVehicleJourneyRef> F1 </DatedVehicleJourneyRef></FramedVehicleJourneyRef><DatedVehicleJourneyRef>X</DatedVehicleJourneyRef>"
    stop = lambda kind, n, more="": f"<{kind}><StopPointRef>Q{n}</StopPointRef><Order>{n}</Order><StopPointName>A, B ({n})</StopPointName><AimedArrivalTime>2026-07-25T12:0{n}:00+02:00</AimedArrivalTime>{more}</{kind}>"
    calls = f"<RecordedCalls>{stop('RecordedCall', 1)}</RecordedCalls><EstimatedCalls>{stop('EstimatedCall', 2)}{stop('EstimatedCall', 3, '<Cancellation>TRUE</Cancellation>')}</EstimatedCalls>"
    bare = journey("<DatedVehicleJourneyRef>B1</DatedVehicleJourneyRef>", f"<EstimatedCalls>{stop('EstimatedCall', 1)}</EstimatedCalls>", "<Cancellation>true</Cancellation><Monitored>true</Monitored>")
    code = journey("<EstimatedVehicleJourneyCode>C1</EstimatedVehicleJourneyCode>", "")
    body = f'<?xml version="1.0"?><Siri {NS}><D><MoreData>true</MoreData>{journey(framed, calls)}{bare}{code}</D></Siri>'
    day = tmp_path / "2026-07-25"
    day.mkdir()
    with gzip.open(day / "100030_RUT_p1.xml.gz", "wt") as f:
        f.write(body)
    rows = feeds.journey_calls(feeds.read_journeys(spark, str(day))).collect()
    assert sorted((r.journey_ref, r.order_no, r.call_type, r.call_cancelled, r.cancelled, r.monitored) for r in rows) == [
        ("B1", 1, "estimated", 0, 1, 1), ("F1", 1, "recorded", 0, 0, 0), ("F1", 2, "estimated", 0, 0, 0), ("F1", 3, "estimated", 1, 0, 0),
    ]
    assert {r.operating_date for r in rows if r.journey_ref == "F1"} == {"2026-07-25"}
    assert rows[0].aimed_arr.endswith("+02:00")
    (tmp_path / "plain.xml").write_text(body)
    assert feeds.more_data(spark, str(tmp_path / "plain.xml")).first()["more"]


def test_situations_from_xml(spark, tmp_path):
    one = "<PtSituationElement><SituationNumber>S1</SituationNumber><Progress>open</Progress><ValidityPeriod><StartTime>2026-07-25T06:00:00Z</StartTime></ValidityPeriod><Affects><N><LineRef>L2</LineRef></N><N><M><LineRef>L1</LineRef></M></N><LineRef>L2</LineRef></Affects></PtSituationElement>"
    none = "<PtSituationElement><SituationNumber>S2</SituationNumber></PtSituationElement>"
    (tmp_path / "sx.xml").write_text(f'<?xml version="1.0"?><Siri {NS}>{one}{none}</Siri>')
    found = feeds.read_situations(spark, str(tmp_path / "sx.xml"))
    got = {r.situation_number: (r.line_refs, r.start_time, r.end_time) for r in found.collect()}
    assert got == {"S1": (["L1", "L2"], "2026-07-25T06:00:00Z", None), "S2": ([], None, None)}
    assert sorted((r.situation_number, r.line_ref) for r in feeds.situation_rows(found, F.lit("t")).collect() if r.line_ref) == [("S1", "L1"), ("S1", "L2")]
    assert feeds.situation_rows(found, F.lit("t")).count() == 3


def test_forecasts_from_json(spark):
    entry = lambda t, temp: f'{{"time":"{t}","data":{{"instant":{{"details":{{"air_temperature":{temp}}}}},"next_1_hours":{{"summary":{{"symbol_code":"rain"}},"details":{{"precipitation_amount":0.5}}}}}}}}'
    body = f'{{"properties":{{"timeseries":[{entry("2026-07-25T10:00:00Z", 11.5)},{entry("2026-07-26T12:00:00Z", 1)},{entry("2026-07-25T11:00:00Z", 2)}]}}}}'
    rows = feeds.forecast_rows(spark.createDataFrame([("2026-07-25T10:00:00+00:00", body)], "polled_at string, body string"), 59.9, 10.7).collect()
    assert [(r.forecast_time, r.air_temp, r.precip_mm, r.symbol, r.wind_mps) for r in rows] == [("2026-07-25T10:00:00Z", 11.5, 0.5, "rain", None)]


def test_raw_files_and_holes(spark):
    names = ["100000_RUT_p1", "100001_RUT_p2", "100030_RUT_p1", "101500_VYG_p1", "102000_p1"]
    listed = tiering.listing(spark, [f"/raw/2026-07-28/{n}.xml.gz" for n in names])
    got = {(r.stamp, r.dataset): r.pages for r in listed.collect()}
    assert got == {("100000", "RUT"): 2, ("100030", "RUT"): 1, ("101500", "VYG"): 1, ("102000", None): 1}
    known = spark.createDataFrame([(7, "2026-07-28T10:00:25.123456+00:00", "et", "RUT", 1, 1, 1, 0, 1, None)], schemas.POLLS)
    assert sorted(r.stamp for r in tiering.new_groups(listed, known).collect()) == ["101500", "102000"]
    assert {r.stamp: r.poll_id for r in tiering.matched_groups(listed, known).collect()}["100030"] == 7


def test_compaction(spark, tmp_path):
    hot, cold = f"{tmp_path}/hot", f"{tmp_path}/cold"
    calls, weather, _ = three_polls(spark)
    old = lambda df: df.withColumn("polled_at", F.regexp_replace("polled_at", "2026-07-25", "2026-07-20"))
    p = calls.select("poll_id", "polled_at").distinct()
    poll_rows = p.select("poll_id", "polled_at", *[(F.lit("et") if f.name == "feed" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.POLLS.fields[2:]])
    for name, df in (("calls", calls), ("polls", poll_rows), ("weather", weather)):
        archive.append(df, hot, name)
        archive.append(old(df), hot, name)
    done = tiering.compact(spark, hot, cold, "2026-07-25", keep_days=1)
    assert done.days == ["2026-07-20"] and done.rows == {"calls": 10, "polls": 3, "weather": 3}
    assert archive.read_all(spark, hot, cold, "calls").count() == 20
    assert archive.read_tier(spark, hot, "calls").count() == 10
    assert archive.read_tier(spark, cold, "calls", days=["2026-07-20"]).count() == 10
    assert tiering.compact(spark, hot, cold, "2026-07-25", keep_days=1).days == []
    # a late row of a day that is there is added, rows without a time stay, and what is there is not written again
    late = archive.read_tier(spark, cold, "calls").limit(1).withColumn("stop_name", F.lit("late")).unionByName(archive.read_tier(spark, cold, "calls").limit(1))
    archive.append(late, hot, "calls")
    archive.append(late.withColumn("polled_at", F.lit(None).cast("string")), hot, "calls")
    archive.append(old(poll_rows).limit(1), hot, "polls")
    assert tiering.compact(spark, hot, cold, "2026-07-25", keep_days=1).rows == {"calls": 1, "polls": 0, "weather": 0}
    assert archive.read_tier(spark, cold, "calls", days=["2026-07-20"]).count() == 11
    assert archive.read_tier(spark, hot, "calls").filter("polled_at is null").count() == 2 and archive.read_tier(spark, hot, "calls").count() == 12
    # broken off between the renames
    os.rename(f"{hot}/calls", f"{hot}/calls.old")
    assert tiering.compact(spark, hot, cold, "2026-07-25", keep_days=1).days == []
    assert archive.read_tier(spark, hot, "calls").count() == 12
    os.makedirs(f"{tmp_path}/raw/2000-01-01")
    assert tiering.prune_days(spark, f"{tmp_path}/raw", "2026-01-01") == ["2000-01-01"]


def test_repair_of_a_day(spark, tmp_path):
    folder = f"{tmp_path}/calls/2026-07-28"
    row = lambda ref, poll, name: tuple({"journey_ref": ref, "poll_id": poll, "stop_name": name, "order_no": 1}.get(f.name) for f in schemas.CALLS.fields)
    spark.createDataFrame([row("T1", 6, "tram"), row(None, 7, "train"), row(None, 7, "train")], schemas.CALLS).write.parquet(folder)
    names = "journey_ref string, poll_id string, stop_name string, order_no string"
    new = spark.createDataFrame([("V1", "7", "Tangen (Bø, Lunde)", "1"), ("V1", "7", "x", "no number")], names)
    replaced = spark.createDataFrame([(7,)], "poll_id long")
    for _ in range(2):
        done = tiering.rewrite_day(spark, folder, new, replaced)
        assert (done.before, done.added, done.after) == (3, 2, 3)
        after = spark.read.parquet(folder)
        assert after.schema.simpleString() == schemas.CALLS.simpleString()
    assert {r.stop_name for r in after.collect()} == {"tram", "Tangen (Bø, Lunde)", "x"}
    assert tiering.kept_rows(after, replaced.filter("poll_id < 0")).count() == 3


def test_widening(spark):
    calls, _, _ = three_polls(spark)
    more = calls.filter("poll_id = 1").withColumn("journey_ref", F.concat(F.lit("new"), "journey_ref")).unionByName(calls.filter("poll_id = 1"))
    added = tiering.absent_journeys(more, calls)
    assert added.count() == 4
    p = spark.createDataFrame([(1, "t", "et", None, 1, 2, 4, 1, None, None), (2, "t", "et", None, 1, 1, 3, 5, None, None)], schemas.POLLS)
    got = {r.poll_id: (r.n_journeys, r.n_calls, r.n_dropped) for r in tiering.widened_counters(p, added).collect()}
    assert got == {1: (4, 8, 0), 2: (1, 3, 5)}


def test_upsert(spark):
    s = "line_ref string, mode string, name string"
    old, new = spark.createDataFrame([("a", "tram", "x"), ("b", "bus", "y")], s), spark.createDataFrame([("b", "rail", "z"), ("c", "bus", "w")], s)
    got = {tuple(r) for r in archive.upserted(old, new, ["line_ref"], keep=["name"]).collect()}
    assert got == {("a", "tram", "x"), ("b", "rail", "y"), ("c", "bus", "w")}


def test_stitching(spark):
    at = lambda m: f"2026-08-03T17:{m:02d}:00.123456+00:00"
    p = spark.createDataFrame([(1, at(10), "et", "RUT", 1, 1, 5, 0, 1, None), (2, at(25), "et", "RUT", 1, 1, None, 0, 1, None), (3, at(40), "et", "RUT", 1, 1, 2, 0, 1, None), (4, at(41), "et", "RUT", 1, 1, 0, 0, 1, None), (5, at(20), "et", "RUT", 1, 1, 9, 0, 1, None)], schemas.POLLS)
    assert serving.latest_poll(p).first()["poll_id"] == 3
    assert sorted(r.poll_id for r in serving.recent_polls(p).collect()) == [2, 3]


def test_network_and_vehicles(spark):
    calls, weather, situations = three_polls(spark)
    place = lambda n, lat: (f"NSR:Quay:{n}", f"Stop {n}", lat, 10.5, None, None, "t")
    quays = spark.createDataFrame([place("A", 59.9), place("B", 60.0), place("C", 60.1)], schemas.QUAYS)
    lines = spark.createDataFrame([("RUT:Line:12", "tram", "12", None, None, "t")], schemas.LINES)
    (route,) = serving.network(calls, quays, lines).collect()
    assert (route.line, route.mode, route.colour, len(route.path)) == ("12", "tram", "#0B91EF", 3)
    from delaylake.operators import history, replay

    rows = replay.feature_rows(calls, weather, situations, history.history(calls, 60), require_label=False).withColumn("model_pred_delay_sec", F.lit(100.5))
    (v,) = serving.vehicles(rows, calls, quays, lines, "2026-07-25T10:05:15+00:00").collect()
    assert (v.line, v.stop, v.dest, v.model, v.low) == ("12", "Stop C", "Stop C", 100, None)
    assert 60.0 <= v.lat <= 60.1
    assert serving.missing_stops(calls, quays.filter("name = 'Stop A'")).count() == 2


def test_cache(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3).toDF("x")

    path = f"{tmp_path}/cache"
    for now, bucket, times in ((0, 900, 1), (100, 900, 1), (5000, 900, 2), (5001, 60, 3)):
        assert serving.cached(spark, path, build, 3600, now, bucket=bucket).count() == 3
        assert len(made) == times


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    base = spark.range(3000).select(
        F.concat(F.lit("2026-07-2"), (i % 4).cast("string")).alias("operating_date"), F.concat(F.lit("2026-07-2"), (i % 4).cast("string"), F.lit("T10:00:00+00:00")).alias("polled_at"),
        F.concat(F.lit("RUT:Line:"), (i % 7).cast("string")).alias("line_ref"), F.lit("1").alias("direction"), F.concat(F.lit("Q"), (i % 11).cast("string")).alias("stop_ref"),
        (i * 13 % 2600).cast("double").alias("horizon_sec"), (i * 7 % 300).cast("double").alias("current_delay_sec"), (i * 5 % 200).cast("double").alias("entur_pred_delay_sec"),
    )
    noise = (F.hash("horizon_sec", "current_delay_sec") % 60).cast("double")
    return base.withColumn("label_delay_sec", F.col("current_delay_sec") * 0.8 + noise)


def test_models(spark, rows, tmp_path):
    split = models.day_split(rows, 1)
    assert {r.operating_date for r in split.filter("is_valid").select("operating_date").distinct().collect()} == {"2026-07-23"}
    with pytest.raises(ValueError):
        models.day_split(rows, valid_on=["2000-01-01"])
    with pytest.raises(ValueError):
        models.feature_names(exclude=("horizon_sec",))
    names = ["line_ref", "stop_ref", "horizon_sec", "current_delay_sec"]
    train, valid = split.filter("not is_valid"), split.filter("is_valid")
    fitted = models.fit_point(train, names, rounds=4, depth=3, rate=0.5)
    report = evaluate.horizon_report(fitted.predict(valid), "model_pred_delay_sec")
    score = serving.score(report).first()
    assert score["model"] < score["timetable"]
    models.save_point(fitted, f"{tmp_path}/model")
    again = models.load_point(spark, f"{tmp_path}/model")
    assert again.features == names
    same = [f.predict(valid).agg(F.sum("model_pred_delay_sec")).first()[0] for f in (fitted, again)]
    assert abs(same[0] - same[1]) < 1e-6
    low, high = models.fit_quantile(train, names, 0.1, rounds=4), models.fit_quantile(train, names, 0.9, rounds=4)
    both = models.predict_interval(valid, low, high)
    covered = both.agg(evaluate.coverage(F.col("label_delay_sec"), F.col("pred_low_sec"), F.col("pred_high_sec")).alias("c"), F.avg((F.col("pred_low_sec") > F.col("pred_high_sec")).cast("int")).alias("x")).first()
    assert 0.65 < covered["c"] < 0.95 and covered["x"] == 0
    rungs = models.with_ladder(valid, {0.9: high, 0.1: low})
    models.save_ladder({0.9: high, 0.1: low}, f"{tmp_path}/ladder")
    loaded = models.load_ladder(spark, f"{tmp_path}/ladder", [0.1, 0.9])
    total = F.sum(F.col("ladder")[0] + 3 * F.col("ladder")[1])
    assert abs(models.with_ladder(valid, loaded).agg(total).first()[0] - rungs.agg(total).first()[0]) < 1e-6
    assert rungs.filter("ladder[0] > ladder[1] or size(ladder) <> 2").count() == 0
    assert evaluate.pit_histogram(rungs, "ladder", "label_delay_sec", [0.1, 0.9]).agg(F.sum("n")).first()[0] == valid.count()


def test_fits_stop_by_the_validation_rows(spark, rows, monkeypatch):
    split = models.day_split(rows, 1)
    train, valid = split.filter("not is_valid"), split.filter("is_valid")
    label = F.col("label_delay_sec")
    fitted = models.fit_point(train, ["line_ref", "current_delay_sec"], rounds=60, depth=3, rate=1.0, valid=valid)
    assert 1 <= fitted.stages[0].getNumTrees < 60
    # far too large steps: the first trees help, later ones do not
    fitted = models.fit_quantile(train, ["line_ref", "current_delay_sec"], 0.5, rounds=40, depth=3, rate=1.5, valid=valid, patience=3)
    assert 1 <= len(fitted.stages) < 37
    loss = lambda f: f.predict(valid, "p").agg(F.avg(F.abs(label - F.col("p")))).first()[0]
    kept = loss(fitted)
    others = [loss(models.Fitted(fitted.features, fitted.vocabularies, fitted.stages[:k], fitted.base, fitted.rates[:k])) for k in range(len(fitted.stages))]
    assert all(kept < x for x in others)
    monkeypatch.setattr(models, "TREES_A_PLAN", 1)
    assert abs(loss(fitted) - kept) < 1e-9


def test_vocabulary(spark, rows):
    words = models.vocabulary(rows, "stop_ref")
    assert [(r.value, r.code) for r in words.orderBy("code").collect()] == [(v, k + 1) for k, v in enumerate(sorted(f"Q{i}" for i in range(11)))]
    new = spark.createDataFrame([("Q3",), ("new",), (None,)], "stop_ref string")
    assert sorted(r.stop_ref for r in models.encoded(new, "stop_ref", words).collect())[:2] == [0, 0]


def test_ingest_of_new_files(spark, tmp_path):
    raw, root = tmp_path / "raw" / "2026-07-25", f"{tmp_path}/hot"
    raw.mkdir(parents=True)
    lines = spark.createDataFrame([("RUT:Line:12", "tram", "12", None, None, "t")], schemas.LINES)
    body = lambda n: f'<?xml version="1.0"?><Siri {NS}>{journey(f"<DatedVehicleJourneyRef>J{n}</DatedVehicleJourneyRef>", "<EstimatedCalls><EstimatedCall><StopPointRef>Q</StopPointRef><Order>1</Order></EstimatedCall></EstimatedCalls>")}</Siri>'
    for n in (1, 2):
        (raw / f"10000{n}_RUT_p1.xml").write_text(body(n))
        jobs.ingest(spark, str(raw), lines, ["tram"], root, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        assert archive.read_tier(spark, root, "calls").select("journey_ref").distinct().count() == n
    assert archive.read_tier(spark, root, "polls").agg(F.sum("n_calls")).first()[0] == 2


def test_pages_of_one_poll(spark, tmp_path):
    raw, root = tmp_path / "raw" / "2026-07-25", f"{tmp_path}/hot"
    raw.mkdir(parents=True)
    lines = spark.createDataFrame([("RUT:Line:12", "tram", "12", None, None, "t")], schemas.LINES)
    for name in ("100000_RUT_p1", "100001_RUT_p2", "100030_VYG_p1"):
        (raw / f"{name}.xml").write_text(xml_of(name))
    jobs.ingest(spark, str(raw), lines, ["tram"], root, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.dataset, r.pages, r.n_journeys, r.n_calls) for r in archive.read_tier(spark, root, "polls").collect()) == [("RUT", 2, 2, 2), ("VYG", 1, 1, 1)]


def xml_of(ref):
    return f'<?xml version="1.0"?><Siri {NS}>{journey(f"<DatedVehicleJourneyRef>J{ref}</DatedVehicleJourneyRef>", "<EstimatedCalls><EstimatedCall><StopPointRef>Q</StopPointRef><Order>1</Order></EstimatedCall></EstimatedCalls>")}</Siri>'


def test_backfill_widen_and_repair(spark, tmp_path):
    raw, hot, cold = tmp_path / "raw" / "2026-07-25", f"{tmp_path}/hot", f"{tmp_path}/cold"
    raw.mkdir(parents=True)
    for name in ("100000_RUT_p1", "100001_RUT_p2", "101000_RUT_p1"):
        (raw / f"{name}.xml").write_text(xml_of(name))
    lines = lambda mode: spark.createDataFrame([("RUT:Line:12", mode, "12", None, None, "t")], schemas.LINES)
    known = spark.createDataFrame([(7, "2026-07-25T10:10:20+00:00", "et", "RUT", 1, 0, 0, 1, 1, None)], schemas.POLLS)
    archive.append(known, hot, "polls")
    folder = str(tmp_path / "raw")
    plan = archive_jobs.backfill(spark, folder, hot, cold, lines("tram"), ["tram"], dry_run=True)
    assert (plan.found, plan.skipped, plan.rows) == (1, 1, {}) and archive.read_tier(spark, hot, "calls").count() == 0
    done = archive_jobs.backfill(spark, folder, hot, cold, lines("tram"), ["tram"])
    assert (done.found, done.rows) == (1, {"calls": 2, "polls": 1})
    assert archive_jobs.backfill(spark, folder, hot, cold, lines("tram"), ["tram"]).found == 0
    assert {(r.pages, r.n_journeys) for r in archive.read_tier(spark, hot, "polls").filter("poll_id <> 7").collect()} == {(2, 2)}
    # another mode joins the polls that are known
    assert archive_jobs.widen(spark, folder, hot, cold, lines("bus"), ["bus"]).rows == {"calls": 1}
    assert archive_jobs.widen(spark, folder, hot, cold, lines("bus"), ["bus"]).rows == {"calls": 0}
    assert {(r.n_journeys, r.n_calls, r.n_dropped) for r in archive.read_tier(spark, hot, "polls").filter("poll_id = 7").collect()} == {(1, 1, 0)}
    # a compacted day is closed to both, and repaired as a whole
    tiering.compact(spark, hot, cold, "2026-08-05", keep_days=1)
    for job in (archive_jobs.backfill, archive_jobs.widen):
        with pytest.raises(ValueError, match="compacted"):
            job(spark, folder, hot, cold, lines("tram"), ["tram"])
    assert archive_jobs.repair(spark, folder, cold, "2026-07-25", lines("tram"), ["tram"], dry_run=True).rows == {"calls": 3}
    fixed = archive_jobs.repair(spark, folder, cold, "2026-07-25", lines("tram"), ["tram"])
    assert (fixed.before, fixed.dropped, fixed.added, fixed.after) == (3, 3, 3, 3)


def test_backfill_of_situations(spark, tmp_path):
    raw, hot = tmp_path / "raw" / "2026-07-25", f"{tmp_path}/hot"
    raw.mkdir(parents=True)
    one = "<PtSituationElement><SituationNumber>S1</SituationNumber><Affects><LineRef>L2</LineRef><LineRef>L1</LineRef></Affects></PtSituationElement>"
    (raw / "100000_p1.xml").write_text(f'<?xml version="1.0"?><Siri {NS}>{one}</Siri>')
    assert archive_jobs.backfill_situations(spark, str(tmp_path / "raw"), hot, dry_run=True).found == 1
    assert archive_jobs.backfill_situations(spark, str(tmp_path / "raw"), hot).rows == {"situations": 2}
    assert archive_jobs.backfill_situations(spark, str(tmp_path / "raw"), hot).found == 0
    assert {(r.polled_at[:19], r.line_ref) for r in archive.read_tier(spark, hot, "situations").collect()} == {("2026-07-25T10:00:00", "L1"), ("2026-07-25T10:00:00", "L2")}


def test_training_table_is_rebuilt(spark, tmp_path):
    hot, cold, target = f"{tmp_path}/hot", f"{tmp_path}/cold", f"{tmp_path}/training"
    calls, weather, situations = three_polls(spark)
    for name, df in (("calls", calls), ("weather", weather), ("situations", situations)):
        archive.append(df, hot, name)
    for _ in range(2):
        assert archive_jobs.rebuild_training(spark, hot, cold, target) == {"2026-07-25": 3}
        rows = archive_jobs.training_rows(spark, target, days=["2026-07-25"])
        assert rows.columns == schemas.TRAINING_ROWS.fieldNames() and rows.count() == 3
    assert not os.path.exists(f"{target}.new") and not os.path.exists(f"{target}.old")
