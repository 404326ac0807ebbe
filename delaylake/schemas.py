"""Stored tables. Times are ISO-8601 texts with their offset; flags are 0/1 longs."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split(":") for x in text.split())])


CALLS = _schema(
    "journey_ref:s operating_date:s poll_id:l polled_at:s line_ref:s direction:s call_type:s stop_ref:s stop_name:s order_no:l "
    "aimed_arr:s expected_arr:s actual_arr:s aimed_dep:s expected_dep:s actual_dep:s cancelled:l call_cancelled:l recorded_at:s operator_ref:s monitored:l"
)
POLLS = _schema("poll_id:l polled_at:s feed:s dataset:s pages:l n_journeys:l n_calls:l n_dropped:l duration_ms:l error:s")
WEATHER = _schema("polled_at:s lat:d lon:d forecast_time:s air_temp:d precip_mm:d wind_mps:d wind_dir:d symbol:s")
SITUATIONS = _schema("polled_at:s situation_number:s line_ref:s progress:s severity:s report_type:s start_time:s end_time:s")
LINES = _schema("line_ref:s mode:s public_code:s name:s colour:s fetched_at:s")
QUAYS = _schema("quay_ref:s name:s lat:d lon:d stop_place_ref:s stop_place_name:s fetched_at:s")

TRAINING_ROWS = _schema(
    "poll_id:l polled_at:s journey_ref:s operating_date:s line_ref:s direction:s stop_ref:s stop_name:s order_no:l dow:l hour:l horizon_sec:d "
    "horizon_stops:l current_order:l n_recorded:l current_delay_sec:d delay_trend_sec:d fc_air_temp:d fc_precip_mm:d fc_wind_mps:d "
    "sched_runtime_sec:d seg_slack_sec:d headway_ahead_sec:d delay_ahead_sec:d stop_recent_delay_sec:d line_recent_delay_sec:d obs_age_sec:d "
    "since_last_stop_sec:d sx_line_active:l sx_network_active:l aimed_ts:s entur_expected_ts:s actual_ts:s label_delay_sec:d entur_pred_delay_sec:d"
)
