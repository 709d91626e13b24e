"""Charging infrastructure: regions, gaps, nearest chargers, hazard-aware scores, the consumer query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import (avg_where, band, centroid, clamp, count_where, display_name, lookup, sum_where)
from ..operators.distance import nearby, nearest_k
from ..operators.reach import FEW_PAIRS, totals_within_km
from ..operators.rows import arg_best, attach_scalars, top_n
from ..operators.shape import assign_region, stamp
from ..operators.storage import materialize
from ..operators.summaries import labelled, metric_rows


def _speed_counts(include_unknown: bool = False):
    names = {"slow_chargers": "Slow", "fast_chargers": "Fast", "rapid_chargers": "Rapid",
             "ultra_rapid_chargers": "Ultra-Rapid"}
    if include_unknown:
        names["unknown_speed_chargers"] = "Unknown"
    return [count_where(F.col("charging_speed") == speed).alias(name) for name, speed in names.items()]


def regional_ev_metrics(stations: DataFrame, boxes=fixed.REGION_BOXES) -> DataFrame:
    """Station counts, capacity and speed mix per region."""
    placed = assign_region(stations, boxes, default=fixed.REGION_DEFAULT)
    kw, rated = F.col("charger_rating_kw"), F.col("has_valid_rating")
    return placed.groupBy("region").agg(
        F.count(F.lit(1)).alias("ev_station_count"),
        count_where(F.col("has_valid_location")).alias("valid_locations"),
        count_where(rated).alias("valid_ratings"),
        sum_where(rated, kw).alias("total_capacity_kw"),
        avg_where(rated, kw).alias("avg_capacity_kw"),
        F.max(kw).alias("max_capacity_kw"),
        *_speed_counts(include_unknown=True))


def fuel_metrics(fuel: DataFrame) -> DataFrame:
    """State-wide fuel measures, one row.

    Four distinct counts of stations in one aggregate would copy every row four times. Here each station is
    reduced to one row of sums and "sells this" marks first; the second step only adds those up."""
    valid = F.col("has_valid_price")
    groups = {"unleaded": "Regular Unleaded", "diesel": "Diesel", "lpg": "LPG"}
    per_station = [count_where(valid).alias("_valid")]
    for short, name in groups.items():
        has = F.col("fuel_category") == name
        per_station += [sum_where(has & valid, "price_cents").alias(f"_{short}_sum"),
                        F.count(F.when(has & valid, F.col("price_cents"))).alias(f"_{short}_n"),
                        F.max(has.cast("int")).alias(f"_{short}")]
    stations = fuel.groupBy("stationcode").agg(*per_station)
    known = F.col("stationcode").isNotNull()

    def mean(short):
        return F.try_divide(F.sum(f"_{short}_sum"), F.sum(f"_{short}_n"))

    def selling(short):
        return F.count_if(known & (F.col(f"_{short}") == 1))
    return stations.agg(
        F.count("stationcode").alias("fuel_station_count_nsw"),
        F.coalesce(F.sum("_valid"), F.lit(0)).alias("valid_prices_nsw"),
        mean("unleaded").alias("avg_regular_unleaded_price"),
        mean("diesel").alias("avg_diesel_price"),
        mean("lpg").alias("avg_lpg_price"),
        selling("unleaded").alias("stations_with_unleaded_nsw"),
        selling("diesel").alias("stations_with_diesel_nsw"),
        selling("lpg").alias("stations_with_lpg_nsw"))


def regional_infrastructure(stations: DataFrame, fuel: DataFrame, boxes=fixed.REGION_BOXES, as_of=None) -> DataFrame:
    """Regional measures beside the state-wide fuel measures, and a readiness score from 0 to 100."""
    df = attach_scalars(regional_ev_metrics(stations, boxes), fuel_metrics(fuel))
    df = df.fillna(0, subset=["total_capacity_kw", "avg_capacity_kw"])
    n = F.col("ev_station_count")
    strong = F.col("fast_chargers") + F.col("rapid_chargers") + F.col("ultra_rapid_chargers")
    size = clamp(n / 5, hi=40)
    mix = F.when(n > 0, clamp(strong / n * 30, hi=30)).otherwise(0)
    power = clamp(F.col("total_capacity_kw") / 1000 * 30, hi=30)
    df = df.withColumn("ev_readiness_score", clamp(size + mix + power, hi=100).cast("int"))
    return stamp(stamp(df, "gold_processed_at", as_of), "reporting_date", as_of, "date")


def regional_density(metrics: DataFrame, areas: DataFrame) -> DataFrame:
    """Stations per 1000 square km; ``areas`` has region and area_km2. A region without an area stays, with null."""
    per = F.try_divide(F.col("ev_station_count") * 1000.0, F.col("area_km2"))
    return metrics.join(areas, "region", "left").withColumn("stations_per_1000_km2", per)


def box_areas(spark, boxes=fixed.REGION_BOXES) -> DataFrame:
    """Area of each region box on the sphere."""
    rows = [(name, fixed.EARTH_RADIUS_KM ** 2 * math.radians(d - c)
             * (math.sin(math.radians(b)) - math.sin(math.radians(a)))) for name, a, b, c, d in boxes]
    return spark.createDataFrame(rows, "region string, area_km2 double")


def nearest_chargers(stations: DataFrame, places=fixed.REFERENCE_PLACES, k: int = 10, as_of=None) -> DataFrame:
    """The ``k`` nearest stations of each reference place."""
    ranked = nearest_k(places, stations, k)
    ranked = ranked.select("location_name", "ref_lat", "ref_lon", "rank", "station_name", "station_address",
                           "latitude", "longitude", F.round("distance_km", 2).alias("distance_km"), "operator",
                           "charging_speed", "charger_rating_kw", "has_valid_rating")
    return stamp(ranked, "generated_at", as_of)


def gap_analysis(stations: DataFrame, as_of=None) -> DataFrame:
    """Severity of missing infrastructure per local area, from 0 to 100, and its category."""
    df = stations.groupBy("lganame").agg(
        F.count(F.lit(1)).alias("charger_count"),
        sum_where(F.col("has_valid_rating"), "charger_rating_kw").alias("total_capacity_kw"),
        *centroid(), *_speed_counts())
    n, kw = F.col("charger_count"), F.col("total_capacity_kw")
    strong = F.col("rapid_chargers") + F.col("ultra_rapid_chargers")
    few = F.when(n > 0, clamp(40 * (1 / n), hi=40)).otherwise(40)
    weak = F.when(kw < 500, clamp(30 * (1 - kw / 500), hi=30)).otherwise(0)
    slow = F.when(strong == 0, 30).when(strong < 5, 20).otherwise(10)
    df = df.withColumn("gap_severity_score", clamp(few + weak + slow, hi=100).cast("int"))
    df = df.withColumn("gap_category", band("gap_severity_score", fixed.GAP_LEVELS, "Low"))
    return stamp(df, "analyzed_at", as_of)


def _hazards_by_point(stations: DataFrame, hazards: DataFrame, km: float, few: int) -> DataFrame:
    """Hazards around each distinct station location.

    Hazards become counts per location, category and severity, and are totalled around the locations by cubes, so
    there is a row per location and category, never one per location and hazard."""
    points = stations.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("latitude", "longitude")
    active = hazards.filter("is_active").select(
        F.col("latitude").alias("hazard_lat"), F.col("longitude").alias("hazard_lon"), "main_category",
        lookup("severity", fixed.SEVERITY_RANK, 1).alias("_severity"), F.lit(1).cast("bigint").alias("_n"))
    by_category = totals_within_km(points, active, km, ["main_category"], sums=["_n"], most=["_severity"], few=few)
    # _lone is 0 on every row, but computed, so that it stays a key of the join in _join_points.
    # One entry per category, not per hazard.
    entries = F.array_sort(F.collect_list(F.when(F.col("main_category").isNotNull(), F.struct("main_category", "_n"))))
    names = F.flatten(F.transform(entries, lambda e: F.array_repeat(e["main_category"], e["_n"].cast("int"))))
    return by_category.groupBy("latitude", "longitude").agg(
        F.sum("_n").alias("nearby_hazards_count"), names.alias("hazard_types"),
        F.max("_severity").alias("max_hazard_severity"), F.min(F.lit(0).cast("bigint")).alias("_lone"))


def _join_points(stations: DataFrame, by_point: DataFrame, how: str) -> DataFrame:
    """Equi-join on the coordinates. Stations without any are spread by key, so they do not pile up in the one
    partition that null keys hash to."""
    lone = F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), F.xxhash64("objectid")).otherwise(F.lit(0))
    return (stations.withColumn("_lone", lone)
            .join(by_point, ["latitude", "longitude", "_lone"], how)
            .select(*stations.columns, "nearby_hazards_count", "hazard_types", "max_hazard_severity"))


def hazard_summary(stations: DataFrame, hazards: DataFrame, km: float = 5, few: int = FEW_PAIRS) -> DataFrame:
    """Active hazards within ``km`` of each station: count, categories, worst severity. Stations without any are
    left out. Stations are unique by id, name and coordinates, as the silver table makes them."""
    keys = stations.select("objectid", "station_name", "latitude", "longitude")
    return _join_points(keys, _hazards_by_point(stations, hazards, km, few), "inner")


def smart_recommendations(stations: DataFrame, hazards: DataFrame, km: float = 5, null_safe: bool = False,
                          as_of=None, few: int = FEW_PAIRS) -> DataFrame:
    """Accessibility, score and tier of every station.

    A station without a name or id finds no hazards unless ``null_safe``: its keys are null, and null keys match
    nothing."""
    df = _join_points(stations, _hazards_by_point(stations, hazards, km, few), "left")
    if not null_safe:
        keyed = F.col("station_name").isNotNull() & F.col("objectid").isNotNull()
        df = df.withColumns({c: F.when(keyed, F.col(c)) for c in
                             ("nearby_hazards_count", "hazard_types", "max_hazard_severity")})
    df = df.fillna(0, subset=["nearby_hazards_count", "max_hazard_severity"])
    access = clamp(100 - F.col("nearby_hazards_count") * 10 - F.col("max_hazard_severity") * 10, hi=100)
    df = df.withColumn("accessibility_score", access.cast("int"))
    quality = lookup("charging_speed", fixed.SPEED_POINTS, 10)
    df = df.withColumn("recommendation_score", (quality + F.col("accessibility_score") * 0.6).cast("int"))
    df = df.withColumn("recommendation_tier", band("recommendation_score", fixed.SMART_TIERS, "Limited"))
    return stamp(df, "generated_at", as_of)


def recommendation_summary(nearest: DataFrame, gaps: DataFrame, smart: DataFrame) -> DataFrame:
    """section, label, value: sizes, gap and tier counts, stations near hazards, the extremes."""
    category, tier = F.col("gap_category"), F.col("recommendation_tier")
    total = F.count(F.lit(1))
    gap_row = gaps.agg(total.alias("areas"), count_where(category == "Critical").alias("critical"),
                       count_where(category == "High").alias("high"))
    gap_row = gap_row.withColumn("underserved", F.col("critical") + F.col("high"))
    smart_row = smart.agg(total.alias("stations"), count_where(tier == "Excellent").alias("excellent"),
                          count_where(tier == "Good").alias("good"),
                          count_where(F.col("nearby_hazards_count") > 0).alias("near_hazards"))
    good = F.col("excellent") + F.col("good")
    smart_row = (smart_row.withColumn("recommended", good)
                 .withColumn("recommended_pct", F.coalesce(F.round(F.try_divide(good * 100.0, F.col("stations")), 1), F.lit(0.0)))
                 .withColumn("unaffected", F.col("stations") - F.col("near_hazards")))
    worst = arg_best(gaps, "gap_severity_score", ["lganame"])
    best = arg_best(smart, "recommendation_score", ["objectid"])
    return (metric_rows(nearest.agg(total.alias("nearest_rows")), "sizes")
            .unionByName(metric_rows(gap_row, "gaps"))
            .unionByName(metric_rows(smart_row, "tiers"))
            .unionByName(labelled(worst, "worst_gap", "lganame", "gap_severity_score"))
            .unionByName(labelled(best, "best_station", "objectid", "recommendation_score")))


def ev_fuel_ratio(stations: DataFrame, fuel: DataFrame) -> DataFrame:
    """Share of EV stations among EV and fuel stations, in percent; one row."""
    ev = stations.agg(F.count(F.lit(1)).alias("ev_stations"))
    fuel_n = fuel.filter(F.col("stationcode").isNotNull()).select("stationcode").distinct().agg(
        F.count(F.lit(1)).alias("fuel_stations"))
    both = F.col("ev_stations") + F.col("fuel_stations")
    return attach_scalars(ev, fuel_n).withColumn(
        "ev_ratio_pct", F.round(F.try_divide(F.col("ev_stations") * 100.0, both), 1))


def regional_summary(gold: DataFrame) -> DataFrame:
    """section, label, value: totals, the EV share, the five most ready regions, the extremes."""
    one = gold.agg(F.sum("ev_station_count").alias("total_ev"), F.sum("total_capacity_kw").alias("total_capacity_kw"),
                   F.max("fuel_station_count_nsw").alias("total_fuel"))
    ratio = F.try_divide(F.col("total_ev") * 100.0, F.col("total_ev") + F.col("total_fuel"))
    one = one.withColumn("ev_ratio_pct", F.round(ratio, 1))
    score = "ev_readiness_score"
    return (metric_rows(one, "totals")
            .unionByName(labelled(top_n(gold, score, 5, ["region"]), "top_regions", "region", score))
            .unionByName(labelled(arg_best(gold, score, ["region"]), "most_ready", "region", score))
            .unionByName(labelled(arg_best(gold, score, ["region"], ascending=True), "least_ready", "region", score)))


# --- consumer query ----------------------------------------------------------------------------------

def _presented(df: DataFrame) -> list:
    """The columns a caller gets, with defaults for missing texts."""
    return [F.col("objectid"),
            display_name("station_name", "station_address", "objectid").alias("name"),
            F.coalesce(F.nullif(F.col("station_address"), F.lit("")), F.lit(fixed.NO_ADDRESS)).alias("address"),
            F.round("distance_km", 2).alias("distance_km"), "latitude", "longitude", "operator", "number_of_plugs",
            F.col("charger__type").alias("charger_type"), "charging_speed",
            F.col("charger_rating_kw").alias("power_kw"), "recommendation_tier", "recommendation_score",
            "accessibility_score", F.col("nearby_hazards_count").alias("nearby_hazards"),
            F.coalesce("hazard_types", F.array().cast("array<string>")).alias("hazard_types"),
            F.col("pcode").alias("postcode")]


def _wanted(smart: DataFrame, charger_type, operator, postcode) -> DataFrame:
    out = smart.filter("has_valid_location")
    for column, value in (("charger__type", charger_type), ("operator", operator), ("pcode", postcode)):
        if value is not None:
            out = out.filter(F.col(column) == F.lit(value))
    return out


def nearby_stations(smart: DataFrame, lat: float, lon: float, max_km: float = fixed.NEARBY_KM,
                    charger_type: str | None = None, operator: str | None = None, postcode=None,
                    limit: int = fixed.NEARBY_LIMIT) -> DataFrame:
    """Stations within ``max_km`` of a place, nearest first, with optional equality filters."""
    found = nearby(_wanted(smart, charger_type, operator, postcode), lat, lon, max_km)
    return found.orderBy("distance_km", "objectid").limit(limit).select(*_presented(found))


def nearby_batch(smart: DataFrame, probes: DataFrame, max_km: float = fixed.NEARBY_KM,
                 charger_type: str | None = None, operator: str | None = None, postcode=None,
                 limit: int = fixed.NEARBY_LIMIT) -> DataFrame:
    """The same for a table of places (probe_id, probe_lat, probe_lon)."""
    found = nearest_k(probes.select("probe_id", "probe_lat", "probe_lon"),
                      _wanted(smart, charger_type, operator, postcode), limit, point_key="probe_id",
                      point_at=("probe_lat", "probe_lon"), max_km=max_km)
    return found.select("probe_id", "rank", *_presented(found))


def nearest_weather(stations: DataFrame, sites: DataFrame) -> DataFrame:
    """The weather site nearest to each station; ``sites`` has station_id, site_lat, site_lon."""
    points = stations.select("objectid", F.col("latitude").alias("ref_lat"), F.col("longitude").alias("ref_lon"))
    sites = sites.select(F.col("station_id").alias("site_id"), "site_lat", "site_lon")
    return (nearest_k(points, sites, 1, point_key="objectid", target_at=("site_lat", "site_lon"), tiebreak=("site_id",))
            .select("objectid", "site_id", "distance_km"))
