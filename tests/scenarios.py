"""Small archives with known feature rows."""

from __future__ import annotations

from delaylake import schemas

DAY = "2026-07-25"
LINE, JOURNEY = "RUT:Line:12", "RUT:ServiceJourney:test1"


def at(clock: str, zone: str = "+02:00") -> str:
    return f"{DAY}T{clock}{':00' if clock.count(':') == 1 else ''}{zone}"


def call(poll, polled, journey, order, kind, stop, aimed_arr=None, expected_arr=None, actual_arr=None, aimed_dep=None, expected_dep=None, actual_dep=None, cancelled=0, line=LINE, date=DAY):
    local = lambda t: at(t) if t else None
    return (
        journey, date, poll, at(polled, "Z"), line, "1", kind, f"NSR:Quay:{stop}", f"Stop {stop}", order, local(aimed_arr), local(expected_arr), local(actual_arr),
        local(aimed_dep), local(expected_dep), local(actual_dep), cancelled, 0, at("12:00"), "RUT", 1,
    )


def _poll_rows():
    a = dict(aimed_dep="11:58", actual_dep="12:00")
    b_est, c_est = dict(aimed_arr="12:03", expected_arr="12:05"), dict(aimed_arr="12:06", expected_arr="12:08")
    b_rec, c_rec = dict(aimed_arr="12:03", actual_arr="12:05:30"), dict(aimed_arr="12:06", actual_arr="12:09")
    return [
        call(1, "10:00:30", JOURNEY, 1, "recorded", "A", **a),
        call(1, "10:00:30", JOURNEY, 2, "estimated", "B", **b_est),
        call(1, "10:00:30", JOURNEY, 3, "estimated", "C", **c_est),
        call(1, "10:00:30", "RUT:ServiceJourney:dead", 2, "estimated", "B", **b_est, cancelled=1),
        call(2, "10:02:00", JOURNEY, 1, "recorded", "A", **a),
        call(2, "10:02:00", JOURNEY, 2, "recorded", "B", **b_rec),
        call(2, "10:02:00", JOURNEY, 3, "estimated", "C", **c_est),
        call(3, "10:05:00", JOURNEY, 1, "recorded", "A", **a),
        call(3, "10:05:00", JOURNEY, 2, "recorded", "B", **b_rec),
        call(3, "10:05:00", JOURNEY, 3, "recorded", "C", **c_rec),
    ]


def _context(spark):
    hour = at("10:00", "Z")
    weather = [(at(t, "Z"), 59.9, 10.7, hour, temp, 0.0, 3.0, 180.0, "cloudy") for t, temp in (("09:00", 10.0), ("09:59", 12.0), ("10:01", 99.0))]
    situations = [
        (at("09:30", "Z"), "sit-1", LINE, "open", "normal", "general", at("06:00", "Z"), at("22:00", "Z")),
        (at("10:03", "Z"), "sit-2", LINE, "open", "normal", "general", at("10:00", "Z"), None),
    ]
    return spark.createDataFrame(weather, schemas.WEATHER), spark.createDataFrame(situations, schemas.SITUATIONS)


def three_polls(spark):
    """Calls, weather and situations of one journey seen in three polls."""
    return spark.createDataFrame(_poll_rows(), schemas.CALLS), *_context(spark)


def more_traffic(spark):
    """The same with two vehicles ahead and a second journey to predict."""
    rows = _poll_rows()
    for poll, polled, j, dep, aimed_dep, arr, aimed_arr in ((4, "10:06", "B", "12:10", "12:09", "12:15", "12:14"), (5, "10:08", "C", "12:12", "12:11", "12:18", "12:16")):
        rows.append(call(poll, polled, f"RUT:ServiceJourney:test{j}", 1, "recorded", "A", aimed_dep=aimed_dep, actual_dep=dep))
        rows.append(call(poll, polled, f"RUT:ServiceJourney:test{j}", 2, "recorded", "B", aimed_arr=aimed_arr, actual_arr=arr))
    second = "RUT:ServiceJourney:test2"
    for poll, polled in ((6, "10:10"), (7, "10:12")):
        rows.append(call(poll, polled, second, 1, "recorded", "A", aimed_dep="12:20", actual_dep="12:21"))
    rows.append(call(6, "10:10", second, 2, "estimated", "B", aimed_arr="12:25", expected_arr="12:26"))
    rows.append(call(7, "10:12", second, 2, "recorded", "B", aimed_arr="12:25", actual_arr="12:26:30"))
    return spark.createDataFrame(rows, schemas.CALLS), *_context(spark)
