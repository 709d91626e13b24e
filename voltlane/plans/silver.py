"""Cleaned tables. Each function first keeps the newest row per key and derives columns afterwards, so the
only shuffle carries raw columns and no derived ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import (classify, filled, first_match, inside, is_true, now_col, parse_kw, parse_ts)
from ..operators.rows import keep_latest
from ..operators.shape import flag, snake_case_columns, stamp

STATION_FLAGS = ["has_valid_location", "has_valid_rating"]
FUEL_FLAGS = ["has_valid_price", "has_valid_station", "has_valid_timestamp"]
HAZARD_FLAGS = ["has_valid_location", "has_valid_hazard_id", "has_valid_headline", "has_valid_start_time"]
WEATHER_FLAGS = ["has_valid_temperature", "has_valid_humidity", "has_valid_precipitation", "has_valid_wind_speed",
                 "has_valid_location", "has_valid_timestamp", "has_valid_station"]


def charging_speed(kw, variant: str = "batch"):
    """Speed class. The variants differ at exactly 150 kW and at zero or less."""
    if variant == "batch":
        rules = [(lambda c: c < 7, "Slow"), (lambda c: c < 22, "Fast"), (lambda c: c <= 150, "Rapid"),
                 (lambda c: c > 150, "Ultra-Rapid")]
    elif variant == "feed":
        rules = [(lambda c: c >= 150, "Ultra-Rapid"), (lambda c: c >= 22, "Rapid"), (lambda c: c >= 7, "Fast"),
                 (lambda c: c > 0, "Slow")]
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return classify(kw, rules, "Unknown")


def silver_stations(df: DataFrame, as_of=None, tiebreak: Sequence[str] | None = ("objectid",)) -> DataFrame:
    """Newest row per name and coordinates; rating in kW, speed class, two flags."""
    df = keep_latest(snake_case_columns(df), ["station_name", "latitude", "longitude"],
                     ["ingestion_timestamp"], tiebreak)
    df = df.withColumn("charger_rating_kw", parse_kw("charger_rating"))
    df = df.withColumn("charging_speed", charging_speed("charger_rating_kw"))
    df = flag(df, "has_valid_location", inside("latitude", "longitude", (-90, 90), (-180, 180)))
    df = flag(df, "has_valid_rating", F.col("charger_rating_kw") > 0)
    return stamp(df, "silver_processed_at", as_of)


def silver_fuel(df: DataFrame, as_of=None, tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Newest price per station, cleaned type and day; price in cents, fuel group, three flags."""
    df = snake_case_columns(df)
    if "last_updated_ts" not in df.columns:
        df = df.withColumn("last_updated_ts", parse_ts("lastupdated", fixed.FEED_TIME_FORMAT))
    df = df.withColumn("fuel_type_clean", F.upper(F.trim("fueltype")))
    df = keep_latest(df, ["stationcode", "fuel_type_clean", F.to_date("last_updated_ts")], ["last_updated_ts"], tiebreak)
    df = df.withColumn("price_cents", F.col("price").try_cast("double"))
    group = first_match([(F.col("fuel_type_clean").isin(types), name) for types, name in fixed.FUEL_GROUPS], "Other")
    df = df.withColumn("fuel_category", group)
    df = flag(df, "has_valid_price", (F.col("price_cents") > 0) & (F.col("price_cents") <= fixed.MAX_PRICE_CENTS))
    df = flag(df, "has_valid_station", filled("stationcode"))
    df = flag(df, "has_valid_timestamp", F.col("last_updated_ts").isNotNull())
    return stamp(df, "silver_processed_at", as_of)


def hazard_severity(major, impact):
    return first_match([(F.col(major), "Major"), (F.col(impact), "Moderate")], "Minor")


def silver_hazards(df: DataFrame, as_of=None, tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Newest state per hazard id, or per headline, place and type where there is no id; times, severity,
    activity, four flags. ``*_ts`` columns that are already there are used as they are."""
    df = snake_case_columns(df)
    for text, ts in (("start_time", "start_time_ts"), ("end_time", "end_time_ts"),
                     ("created", "created_ts"), ("last_updated", "last_updated_ts")):
        if ts not in df.columns and text in df.columns:
            df = df.withColumn(ts, parse_ts(text))
    df = df.withColumn("hazard_type_clean", F.lower(F.trim("hazard_type")))
    parts = ["headline", "latitude", "longitude", "hazard_type_clean"]
    place = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    df = keep_latest(df, [F.when(filled("hazard_id"), F.col("hazard_id")).otherwise(place)], ["last_updated_ts"], tiebreak)
    now = now_col(as_of)
    started, end = F.col("start_time_ts") <= now, F.col("end_time_ts")
    df = df.withColumn("severity", hazard_severity("is_major", "impact"))
    df = flag(df, "is_active", started & (end.isNull() | (end >= now)))
    df = flag(df, "has_valid_location", inside("latitude", "longitude", fixed.STATE_LAT, fixed.STATE_LON))
    df = flag(df, "has_valid_hazard_id", filled("hazard_id"))
    df = flag(df, "has_valid_headline", filled("headline"))
    df = flag(df, "has_valid_start_time", F.col("start_time_ts").isNotNull())
    return stamp(df, "silver_processed_at", as_of)


def silver_weather(df: DataFrame, as_of=None, time: str = "timestamp",
                   tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Newest reading per site and time; condition group, seven flags."""
    df = keep_latest(snake_case_columns(df), ["station_id", time], ["ingestion_timestamp"], tiebreak)
    df = df.withColumn("weather_condition_clean", F.initcap(F.trim("weather_condition")))
    condition = F.col("weather_condition_clean")
    group = first_match([(condition.rlike(f"(?i)({words})"), name) for words, name in fixed.WEATHER_PATTERNS], "Other")
    df = df.withColumn("weather_category", group)
    df = flag(df, "has_valid_temperature", F.col("temperature_celsius").between(*fixed.TEMPERATURE_RANGE))
    df = flag(df, "has_valid_humidity", F.col("humidity_percent").between(*fixed.HUMIDITY_RANGE))
    df = flag(df, "has_valid_precipitation", F.col("precipitation_mm") >= 0)
    df = flag(df, "has_valid_wind_speed", F.col("wind_speed_kmh") >= 0)
    df = flag(df, "has_valid_location", inside("location_lat", "location_lon", fixed.STATE_LAT, fixed.STATE_LON))
    df = flag(df, "has_valid_timestamp", F.col(time) <= now_col(as_of))
    df = flag(df, "has_valid_station", filled("station_id"))
    return stamp(df, "silver_processed_at", as_of)


def fuel_price_stats(fuel: DataFrame) -> DataFrame:
    """Price range per fuel group over valid prices."""
    c = F.col("price_cents")
    return (fuel.filter("has_valid_price").groupBy("fuel_category")
            .agg(F.min(c).alias("min_price"), F.avg(c).alias("avg_price"), F.max(c).alias("max_price"),
                 F.count(F.lit(1)).alias("record_count")))


def weather_stats(weather: DataFrame) -> DataFrame:
    """Temperature, humidity and wind over readings where all three are valid; one row, of nulls if none is."""
    valid = is_true(F.col("has_valid_temperature")) & F.col("has_valid_humidity") & F.col("has_valid_wind_speed")
    t = F.col("temperature_celsius")
    return weather.filter(valid).agg(
        F.min(t).alias("min_temp"), F.avg(t).alias("avg_temp"), F.max(t).alias("max_temp"),
        F.avg("humidity_percent").alias("avg_humidity"), F.avg("wind_speed_kmh").alias("avg_wind_speed"))
