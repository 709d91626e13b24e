"""The feed variant: the same four feeds as landed JSON, with its own thresholds, boxes and scores.

The silver functions are plain projections and filters (plus one deduplication for stations), so they run
unchanged on batch and on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import band, composite_key, first_match, inside, lookup, now_col, parse_ts
from ..operators.boxes import FEW_PLACES, keys_in_box
from ..operators.quality import expect_all_or_drop
from ..operators.rows import keep_latest
from ..operators.shape import region_of, rename
from .silver import charging_speed, hazard_severity

LABEL = "feed"


def _stamped(df: DataFrame, as_of) -> DataFrame:
    return df.withColumns({"processing_timestamp": now_col(as_of), "pipeline_source": F.lit(LABEL)})


def named(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Give columns the names the rules use (first name: what the rules want, second: what may arrive), and fail
    at once when one is missing."""
    for want, arrives in needed.items():
        if want not in df.columns and arrives in df.columns:
            df = df.withColumnRenamed(arrives, want)
    lost = [c for c in needed if c not in df.columns]
    if lost:
        raise ValueError(f"columns missing for the rules: {lost}")
    return df


def feed_station_columns(df: DataFrame, as_of=None) -> DataFrame:
    """Stations before deduplication."""
    df = rename(df, fixed.STATION_FEED_NAMES)
    df = expect_all_or_drop(df, fixed.STATION_RULES)
    df = df.withColumns({
        "charging_speed": charging_speed("charging_power_kw", "feed"),
        "has_valid_location": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        "has_valid_rating": F.col("charging_power_kw").isNotNull()})
    return _stamped(df, as_of)


def feed_stations(df: DataFrame, as_of=None) -> DataFrame:
    """One row per station id. On a batch the survivor is the row with the lowest hash, so a rerun keeps the same
    one; for streams see ``streaming.silver``."""
    rows = keep_latest(rename(df, fixed.STATION_FEED_NAMES).filter("station_id IS NOT NULL"), ["station_id"])
    return feed_station_columns(rows, as_of)


def active_filter(df: DataFrame, as_of=None, end: str = "end") -> DataFrame:
    """Add ``is_active`` (no end, or an end in the future; an end that does not parse is not active) and keep the
    active rows. On a stream the clock is read once per micro-batch, and rows written earlier stay after their
    end has passed; readers test again."""
    ends = F.col(end)
    until = ends if df.schema[end].dataType.typeName().startswith("timestamp") else parse_ts(end, fixed.FEED_TIME_FORMAT)
    active = first_match([(ends.isNull(), True), (until > now_col(as_of), True)], False)
    return df.withColumn("is_active", active).filter("is_active")


def feed_hazards(df: DataFrame, as_of=None) -> DataFrame:
    df = expect_all_or_drop(df, fixed.HAZARD_RULES)
    for text, ts in (("created", "created_timestamp"), ("lastUpdated", "last_updated_timestamp")):
        if text in df.columns:
            df = df.withColumn(ts, parse_ts(text, fixed.FEED_TIME_FORMAT))
    df = df.withColumn("severity", hazard_severity("isMajor", "isImpactNetwork"))
    df = active_filter(df, as_of)
    return _stamped(df.withColumn("composite_key", composite_key("hazard_id", "headline", "location")), as_of)


def _like(col: str, patterns):
    return first_match([(F.col(col).like(p), name) for p, name in patterns], "Other")


def feed_fuel(df: DataFrame, as_of=None) -> DataFrame:
    df = expect_all_or_drop(named(df, {"fuel_type": "fueltype", "price": "price"}), fixed.FUEL_RULES)
    df = df.withColumn("fuel_category", _like("fuel_type", fixed.FEED_FUEL_PATTERNS))
    if "lastupdated" in df.columns:
        df = df.withColumn("price_updated_timestamp", parse_ts("lastupdated", fixed.FEED_TIME_FORMAT))
    return _stamped(df, as_of)


def feed_weather(df: DataFrame, as_of=None) -> DataFrame:
    df = named(df, {"temperature_c": "temperature_celsius", "humidity_percent": "humidity_percent",
                    "weather": "weather_condition", "latitude": "location_lat", "longitude": "location_lon"})
    df = expect_all_or_drop(df, fixed.WEATHER_RULES)
    df = df.filter(inside("latitude", "longitude", fixed.STATE_LAT, fixed.STATE_LON))
    return _stamped(df.withColumn("weather_category", _like("weather", fixed.FEED_WEATHER_PATTERNS)), as_of)


REGION_SUMS = ["total_stations", "total_plugs", "_kw", "_rated", "fast_charger_count"]


def regional_parts(stations: DataFrame) -> DataFrame:
    """Totals per region that can be added up over tables which share no station.

    Stations are counted distinct. Reducing to one row per region and station first gives the distinct counts
    and the sums in two plain aggregations."""
    region = region_of(fixed.FEED_REGION_BOXES, "latitude", "longitude", fixed.FEED_REGION_DEFAULT)
    fast = F.col("charging_speed").isin(fixed.STRONG_SPEEDS)
    per_station = (stations.filter("has_valid_location").groupBy(region.alias("region"), "station_id")
                   .agg(F.sum("number_of_plugs").alias("_plugs"), F.sum("charging_power_kw").alias("_kw"),
                        F.count("charging_power_kw").alias("_rated"), F.max(fast).alias("_fast")))
    return per_station.groupBy("region").agg(
        F.count("station_id").alias("total_stations"), F.sum("_plugs").alias("total_plugs"),
        F.sum("_kw").alias("_kw"), F.sum("_rated").alias("_rated"),
        F.count_if(F.col("_fast") & F.col("station_id").isNotNull()).alias("fast_charger_count"))


def merge_regional(parts: DataFrame) -> DataFrame:
    return parts.groupBy("region").agg(*[F.sum(c).alias(c) for c in REGION_SUMS])


def regional_measures(parts: DataFrame, as_of=None) -> DataFrame:
    """The regional table, with the open-ended readiness score, from ``regional_parts``."""
    score = F.col("total_stations") * 0.4 + F.col("fast_charger_count") * 0.3 + F.col("_kw") / 1000 * 0.3
    df = parts.select("region", "total_stations", "total_plugs", F.round("_kw", 2).alias("total_capacity_kw"),
                      F.round(F.try_divide(F.col("_kw"), F.col("_rated")), 2).alias("avg_capacity_kw"),
                      "fast_charger_count", F.round(score, 0).alias("ev_readiness_score"))
    return df.withColumns({"pipeline_source": F.lit(LABEL), "calculated_at": now_col(as_of)})


def feed_regional(stations: DataFrame, as_of=None) -> DataFrame:
    """Regional measures with the open-ended readiness score."""
    return regional_measures(regional_parts(stations), as_of)


def feed_smart(stations: DataFrame, hazards: DataFrame, deg: float = 0.05, as_of=None,
               few: int = FEW_PLACES) -> DataFrame:
    """Score and tier per station from its speed and the distinct hazards in a box around it."""
    base = stations.filter("has_valid_location").select(
        "station_id", "operator_name", "address_line1", "suburb", "postcode", "latitude", "longitude",
        "number_of_plugs", "charger_type", "charging_power_kw", "charging_speed",
        lookup("charging_speed", fixed.FEED_SPEED_POINTS, 20).alias("charger_quality_score"))
    near = keys_in_box(base, hazards.filter("is_active"), deg, "composite_key", name="nearby_hazards", few=few)
    df = base.join(near, ["latitude", "longitude"], "left").select(
        *base.columns, F.coalesce("nearby_hazards", F.lit(0)).cast("bigint").alias("nearby_hazards"))
    n = F.col("nearby_hazards")
    df = df.withColumn("accessibility_score", first_match([(n == 0, 100), (n <= 2, 80), (n <= 5, 60)], 40))
    score = F.round(F.col("charger_quality_score") * 0.4 + F.col("accessibility_score") * 0.6, 2)
    df = df.withColumn("recommendation_score", score)
    df = df.withColumn("recommendation_tier",
                       band("recommendation_score", fixed.FEED_SMART_TIERS, fixed.FEED_SMART_DEFAULT))
    return df.withColumns({"pipeline_source": F.lit(LABEL), "calculated_at": now_col(as_of)})
