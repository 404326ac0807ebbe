"""Feature rows of small archives with known values; nothing may look ahead."""

from __future__ import annotations

import pytest
from scenarios import JOURNEY, LINE, call, more_traffic, three_polls

from delaylake import schemas
from delaylake.operators import history as h
from delaylake.operators import replay


@pytest.fixture(scope="module")
def golden(spark):
    calls, weather, situations = three_polls(spark)
    rows = replay.feature_rows(calls, weather, situations, h.history(calls, 60))
    assert rows.schema.simpleString() == schemas.TRAINING_ROWS.simpleString()
    return {(r.poll_id, r.order_no): r for r in rows.collect()}


def test_rows_and_labels(golden):
    assert set(golden) == {(1, 2), (1, 3), (2, 3)}
    a, b, c = golden[(1, 2)], golden[(1, 3)], golden[(2, 3)]
    assert (a.current_delay_sec, a.horizon_sec, a.horizon_stops, a.label_delay_sec, a.entur_pred_delay_sec, a.sched_runtime_sec) == (120, 270, 1, 150, 120, 300)
    assert (a.obs_age_sec, a.since_last_stop_sec, a.n_recorded, a.delay_trend_sec) == (30, 30, 1, None)
    assert (b.sched_runtime_sec, b.label_delay_sec, b.horizon_stops) == (480, 180, 2)
    assert (c.current_delay_sec, c.label_delay_sec, c.sched_runtime_sec, c.since_last_stop_sec, c.obs_age_sec) == (150, 180, 180, -210, 120)
    assert (a.dow, a.hour, a.operating_date) == (5, 12, "2026-07-25")


def test_nothing_later_is_seen(golden):
    # a forecast issued after the poll, a situation stamped after it, a bucket still open
    assert golden[(1, 2)].fc_air_temp == 12.0 and golden[(2, 3)].fc_air_temp == 99.0
    assert all((r.sx_line_active, r.sx_network_active) == (1, 1) for r in golden.values())
    assert golden[(1, 2)].line_recent_delay_sec is None and golden[(2, 3)].line_recent_delay_sec == 120
    assert all(r.seg_slack_sec is None and r.headway_ahead_sec is None for r in golden.values())


def test_history_of_other_vehicles(spark):
    calls, weather, situations = more_traffic(spark)
    rows = replay.feature_rows(calls, weather, situations, h.history(calls, 60), with_bunching=True)
    (r,) = rows.filter("journey_ref like '%test2'").collect()
    assert (r.sched_runtime_sec, r.seg_slack_sec, r.stop_recent_delay_sec) == (300, -30, 110)
    assert abs(r.line_recent_delay_sec - 750 / 7) < 1e-9
    assert (r.headway_ahead_sec, r.delay_ahead_sec) == (480, 120)


def test_live_rows_have_no_label(spark):
    calls, weather, situations = three_polls(spark)
    live = replay.feature_rows(calls.filter("poll_id = 1"), weather, situations, h.history(calls, 60), require_label=False).collect()
    assert len(live) == 2 and all(r.label_delay_sec is None and r.actual_ts is None for r in live)


def test_sample_keeps_whole_journeys(spark):
    calls, _, _ = three_polls(spark)
    assert [replay.replayable(calls, n).filter("journey_ref like '%test1'").count() for n in (1, 2, 0, 16)] == [0, 9, 9, 9]


def test_history_rules(spark):
    rows = [
        # seen twice: the first sighting counts; the last digit of a second never rounds up a bucket
        call(1, "10:00:59.600", "j1", 1, "recorded", "A", aimed_dep="11:58", actual_dep="12:00"),
        call(2, "10:02:00", "j1", 1, "recorded", "A", aimed_dep="11:58", actual_dep="12:01"),
        # no aimed time: no delay, but an end of a segment
        call(2, "10:02:00", "j1", 2, "recorded", "B", actual_arr="12:05"),
        # cancelled, or without identity: nothing
        call(2, "10:02:00", "j2", 1, "recorded", "A", aimed_dep="11:58", actual_dep="12:00", cancelled=1),
        call(2, "10:02:00", None, 1, "recorded", "A", aimed_dep="11:58", actual_dep="12:00"),
        # no date: two rows of one journey still are consecutive
        call(3, "10:03:00", "j3", 1, "recorded", "A", aimed_dep="12:00", actual_dep="12:00", date=None),
        call(3, "10:03:00", "j3", 2, "recorded", "B", aimed_arr="12:04", actual_arr="12:04", date=None),
    ]
    past = h.history(spark.createDataFrame(rows, schemas.CALLS), 60)
    minute = 29749560 + 0
    stops = {(r.stop_ref[-1], r.bucket - minute): (r.n, r.total) for r in past.stops.collect()}
    base = min(b for _, b in stops)
    assert {(s, b - base): v for (s, b), v in stops.items()} == {("A", 0): (1, 120.0), ("A", 3): (1, 0.0), ("B", 3): (1, 0.0)}
    segments = sorted((r.n, r.total) for r in past.segments.collect())
    assert segments == [(1, 240.0), (1, 300.0)]
    assert past.segments.filter(f"line_ref = '{LINE}'").count() == 2
    assert {tuple(r.counts) for r in h.exported(past.stops, ["stop_ref"]).collect()} == {(1, 1), (1,)}
    assert JOURNEY.endswith("test1")


def test_a_report_takes_one_pass_over_the_calls(spark):
    calls, weather, situations = more_traffic(spark)
    reported = ("horizon_sec", "label_delay_sec", "current_delay_sec", "entur_pred_delay_sec")
    some = replay.feature_rows(calls, weather, situations, columns=reported)
    # the calls meet no copy of themselves: one exchange, by journey, and not one join
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    whole = replay.feature_rows(calls, weather, situations)
    assert set(some.columns) == set(reported) and some.count() == whole.count() > 0
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*some.columns).collect()))


def test_what_a_snapshot_knows_without_a_date(spark):
    rows = [
        # two orders seen, the later one current although its row stands first; no date in the feed
        call(1, "10:06:00", "j1", 4, "recorded", "D", aimed_arr="12:04", actual_arr="12:05", date=None),
        call(1, "10:06:00", "j1", 1, "recorded", "A", aimed_dep="12:00", actual_dep="12:00", date=None),
        call(1, "10:06:00", "j1", 5, "estimated", "E", aimed_arr="12:10", expected_arr="12:12", date=None),
        # cancelled as its first row says: no snapshot
        call(2, "10:08:00", "j1", 1, "recorded", "A", aimed_dep="12:00", actual_dep="12:00", cancelled=1, date=None),
        call(2, "10:08:00", "j1", 5, "estimated", "E", aimed_arr="12:10", expected_arr="12:12", date=None),
        # passed with two times at the last poll: the later one counts
        call(3, "10:20:00", "j1", 5, "recorded", "E", aimed_arr="12:10", actual_arr="12:13", date=None),
        call(3, "10:20:00", "j1", 5, "recorded", "E", aimed_arr="12:10", actual_arr="12:14", date=None),
    ]
    calls = spark.createDataFrame(rows, schemas.CALLS)
    none = [spark.createDataFrame([], s) for s in (schemas.WEATHER, schemas.SITUATIONS)]
    for columns in (None, ("poll_id", "order_no", "operating_date", "current_order", "current_delay_sec", "delay_trend_sec", "n_recorded", "label_delay_sec", "sched_runtime_sec")):
        (r,) = replay.feature_rows(calls, *none, columns=columns).collect()
        assert (r.poll_id, r.order_no, r.current_order, r.current_delay_sec, r.delay_trend_sec, r.n_recorded, r.label_delay_sec) == (1, 5, 4, 60, 60, 2, 240)
        assert (r.operating_date, r.sched_runtime_sec) == ("2026-07-25", 360)
