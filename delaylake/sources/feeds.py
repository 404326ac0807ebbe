"""Feed documents into rows: journeys and situations from XML, forecasts and metadata from JSON.

All leaves are read as text, so that times keep their offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylake.functions.temporal import blank_to_null, flag, instant

_S = T.StringType()


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


CALL = T.StructType(
    _fields("StopPointRef", "Order", "StopPointName", "AimedArrivalTime", "ExpectedArrivalTime", "ActualArrivalTime")
    + _fields("AimedDepartureTime", "ExpectedDepartureTime", "ActualDepartureTime", "Cancellation")
)
JOURNEY = T.StructType(
    _fields("RecordedAtTime", "LineRef", "DirectionRef", "DatedVehicleJourneyRef", "EstimatedVehicleJourneyCode", "OperatorRef", "Monitored", "Cancellation")
    + [
        T.StructField("FramedVehicleJourneyRef", T.StructType(_fields("DataFrameRef", "DatedVehicleJourneyRef"))),
        T.StructField("RecordedCalls", T.StructType([T.StructField("RecordedCall", T.ArrayType(CALL))])),
        T.StructField("EstimatedCalls", T.StructType([T.StructField("EstimatedCall", T.ArrayType(CALL))])),
    ]
)
SITUATION = T.StructType(
    _fields("SituationNumber", "CreationTime", "Progress", "Severity", "ReportType") + [T.StructField("ValidityPeriod", T.StructType(_fields("StartTime", "EndTime")))]
)


def read_journeys(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per journey element of the XML files (gzip or plain), with ``path``."""
    return spark.read.format("xml").option("rowTag", "EstimatedVehicleJourney").option("ignoreNamespace", "true").schema(JOURNEY).load(paths).withColumn("path", F.input_file_name())


def journey_columns() -> dict[str, Column]:
    """Identity and flags; the reference is the framed one, else the bare one, else the journey code."""
    return {
        "recorded_at": blank_to_null(F.col("RecordedAtTime")),
        "line_ref": blank_to_null(F.col("LineRef")),
        "direction": blank_to_null(F.col("DirectionRef")),
        "journey_ref": F.coalesce(
            blank_to_null(F.col("FramedVehicleJourneyRef.DatedVehicleJourneyRef")), blank_to_null(F.col("DatedVehicleJourneyRef")), blank_to_null(F.col("EstimatedVehicleJourneyCode"))
        ),
        "operating_date": blank_to_null(F.col("FramedVehicleJourneyRef.DataFrameRef")),
        "operator_ref": blank_to_null(F.col("OperatorRef")),
        "monitored": flag(F.col("Monitored")),
        "cancelled": flag(F.col("Cancellation")),
    }


def journey_calls(journeys: DataFrame) -> DataFrame:
    """One row per call: recorded ones, then estimated ones; journeys without calls give none."""
    tagged = lambda calls, kind: F.transform(F.coalesce(calls, F.array().cast(T.ArrayType(CALL))), lambda c: F.struct(F.lit(kind).alias("call_type"), c.alias("c")))
    both = F.concat(tagged(F.col("RecordedCalls.RecordedCall"), "recorded"), tagged(F.col("EstimatedCalls.EstimatedCall"), "estimated"))
    keep = [c for c in journeys.columns if c not in JOURNEY.fieldNames()]
    rows = journeys.select(*keep, *[c.alias(n) for n, c in journey_columns().items()], F.explode(both).alias("_x"))
    text = lambda n: blank_to_null(F.col(f"_x.c.{n}"))
    return rows.select(
        *keep, *journey_columns(), "_x.call_type", text("StopPointRef").alias("stop_ref"), text("StopPointName").alias("stop_name"),
        text("Order").try_cast("long").alias("order_no"), text("AimedArrivalTime").alias("aimed_arr"), text("ExpectedArrivalTime").alias("expected_arr"),
        text("ActualArrivalTime").alias("actual_arr"), text("AimedDepartureTime").alias("aimed_dep"), text("ExpectedDepartureTime").alias("expected_dep"),
        text("ActualDepartureTime").alias("actual_dep"), flag(F.col("_x.c.Cancellation")).alias("call_cancelled"),
    )


def more_data(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, more``: whether a response says that another page follows."""
    text = spark.read.option("wholetext", "true").text(paths)
    return text.select(F.input_file_name().alias("path"), F.coalesce(F.lower(F.regexp_extract("value", r"<(?:\w+:)?MoreData>\s*(\w+)\s*<", 1)) == "true", F.lit(False)).alias("more"))


def read_situations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per situation, its line references (at any depth) sorted and distinct in ``line_refs``."""
    raw = spark.read.option("wholetext", "true").text(paths)
    element = r"(?s)(<(?:\w+:)?PtSituationElement[ >].*?</(?:\w+:)?PtSituationElement>)"
    one = raw.select(F.input_file_name().alias("path"), F.posexplode(F.regexp_extract_all("value", F.lit(element), 1)).alias("pos", "xml"))
    plain = F.regexp_replace(F.regexp_replace("xml", r"<(/?)\w+:", "<$1"), r"\s+xmlns(:\w+)?=\"[^\"]*\"", "")
    x = one.withColumn("xml", plain)
    leaf = lambda p: blank_to_null(F.xpath_string("xml", F.lit(f"/PtSituationElement/{p}")))
    lines = F.transform(F.xpath("xml", F.lit("//LineRef/text()")), lambda r: F.trim(r))
    return x.select(
        "path", leaf("SituationNumber").alias("situation_number"), leaf("CreationTime").alias("created_at"), leaf("Progress").alias("progress"), leaf("Severity").alias("severity"),
        leaf("ReportType").alias("report_type"), leaf("ValidityPeriod/StartTime").alias("start_time"), leaf("ValidityPeriod/EndTime").alias("end_time"),
        F.array_sort(F.array_distinct(F.filter(lines, lambda r: r != ""))).alias("line_refs"),
    )


def situation_rows(situations: DataFrame, polled_at: Column) -> DataFrame:
    """Stored situations: one row per line, or one without line."""
    return situations.select(
        polled_at.alias("polled_at"), "situation_number", F.explode_outer("line_refs").alias("line_ref"), "progress", "severity", "report_type", "start_time", "end_time"
    )


FORECAST = (
    "struct<properties:struct<timeseries:array<struct<time:string,data:struct<instant:struct<details:struct<air_temperature:double,wind_speed:double,wind_from_direction:double>>,"
    "next_1_hours:struct<summary:struct<symbol_code:string>,details:struct<precipitation_amount:double>>>>>>>"
)


def forecast_rows(documents: DataFrame, lat: float, lon: float, hours: int = 24, key: str = "polled_at") -> DataFrame:
    """Forecasts of ``polled_at, body`` documents up to ``hours`` ahead; reading stops at the first entry beyond.

    ``key`` names a document, and comes first in the rows.
    """
    doc = F.from_json("body", FORECAST)
    limit = instant("polled_at") + F.make_interval(hours=F.lit(hours))
    names = list(dict.fromkeys([key, "polled_at"]))
    # the entries before the first one beyond, within each document
    listed = doc["properties"]["timeseries"]
    beyond = F.array_position(F.transform(listed, lambda e: F.coalesce(instant(e["time"]) > F.col("_limit"), F.lit(False))), True)
    ahead = F.when(F.col("_beyond") > 0, F.slice("_listed", F.lit(1), (F.col("_beyond") - 1).cast("int"))).otherwise(F.col("_listed"))
    kept = documents.select(*names, limit.alias("_limit"), listed.alias("_listed"), "body").withColumn("_beyond", beyond).select(*names, F.explode(ahead).alias("e"))
    now, nxt = F.col("e.data.instant.details"), F.col("e.data.next_1_hours")
    return kept.select(
        *names, F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.col("e.time").alias("forecast_time"), now["air_temperature"].alias("air_temp"),
        nxt["details"]["precipitation_amount"].alias("precip_mm"), now["wind_speed"].alias("wind_mps"), now["wind_from_direction"].alias("wind_dir"), nxt["summary"]["symbol_code"].alias("symbol"),
    )


def line_rows(spark: SparkSession, path: str, fetched_at: str) -> DataFrame:
    """Line metadata from JSON lines ``id, transportMode, publicCode, name, presentation.colour``."""
    schema = "id string, transportMode string, publicCode string, name string, presentation struct<colour:string>"
    return spark.read.schema(schema).json(path).select(
        F.col("id").alias("line_ref"), F.col("transportMode").alias("mode"), F.col("publicCode").alias("public_code"), "name", F.col("presentation.colour").alias("colour"), F.lit(fetched_at).alias("fetched_at")
    )


def quay_rows(spark: SparkSession, path: str, fetched_at: str) -> DataFrame:
    """Stop positions from JSON lines; those without position are left out."""
    schema = "id string, name string, latitude double, longitude double, stopPlace struct<id:string,name:string>"
    return spark.read.schema(schema).json(path).filter("latitude is not null and longitude is not null").select(
        F.col("id").alias("quay_ref"), "name", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("stopPlace.id").alias("stop_place_ref"),
        F.col("stopPlace.name").alias("stop_place_name"), F.lit(fetched_at).alias("fetched_at"),
    )
