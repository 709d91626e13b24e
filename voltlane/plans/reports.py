"""Aggregates behind the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import span
from ..operators.summaries import distribution, histogram, long_form, top_operators  # noqa: F401  (part of this API)

# Distance bands of the trip-needs report.
DISTANCE_BANDS = [(0, 100, "0-100 km"), (101, 200, "101-200 km"), (201, 300, "201-300 km"), (301, 400, "301-400 km")]
DISTANCE_BAND_DEFAULT = "Over 400 km"


def congestion_heatmap(hourly: DataFrame) -> DataFrame:
    """Hour by weekday matrix of the score. The columns are listed, so no job is needed to find them."""
    return hourly.groupBy("hour_of_day").pivot("day_name", fixed.DAY_NAMES).agg(F.max("congestion_score"))


def peak_comparison(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("is_peak_hour").agg(
        F.count(F.lit(1)).alias("periods"), F.avg("congestion_score").alias("avg_score"),
        F.avg("total_hazards").alias("avg_hazards"), F.sum("total_hazards").alias("total_hazards"))


def delay_by_rating(routes: DataFrame) -> DataFrame:
    return routes.groupBy("route_safety_rating").agg(
        F.count(F.lit(1)).alias("locations"), F.avg("estimated_delay_minutes").alias("avg_delay"),
        F.max("estimated_delay_minutes").alias("max_delay"))


def hazard_type_totals(routes: DataFrame) -> DataFrame:
    totals = routes.agg(*[F.sum(c).alias(c) for c in fixed.HAZARD_CATEGORIES])
    return long_form(totals, [], fixed.HAZARD_CATEGORIES, "hazard_type", "total")


def needs_by_band(charging: DataFrame) -> DataFrame:
    """Trip needs per distance band, with driving and charging hours."""
    group = span("trip_distance_km", DISTANCE_BANDS, DISTANCE_BAND_DEFAULT)
    return charging.groupBy(group.alias("distance_band")).agg(
        F.count(F.lit(1)).alias("trips"), F.avg("charging_stops_needed").alias("avg_stops"),
        F.avg("base_driving_time_hours").alias("avg_driving_hours"),
        F.avg("charging_time_hours").alias("avg_charging_hours"))


def charger_mix(df: DataFrame, by: str) -> DataFrame:
    """Chargers per speed in long form, from the speed columns of a regional or gap table."""
    speeds = {"slow_chargers": "Slow", "fast_chargers": "Fast", "rapid_chargers": "Rapid",
              "ultra_rapid_chargers": "Ultra-Rapid"}
    return long_form(df, [by], speeds, "charging_speed", "chargers")


def hourly_trend(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("hour_of_day").agg(F.avg("congestion_score").alias("avg_score"))


def advice_distribution(recs: DataFrame) -> DataFrame:
    """Hours per period and category."""
    return recs.groupBy("time_period", "recommendation_category").agg(F.count(F.lit(1)).alias("hours"))
