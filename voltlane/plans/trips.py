"""Trip planning: route safety, charging needs, travel windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import band, centroid, clamp, count_where, first_match, lookup, span
from ..operators.rows import arg_best, attach_scalars, global_rank, top_n
from ..operators.shape import small_dim, stamp
from ..operators.summaries import labelled, metric_rows
from .traffic import category_counts, located, severity_counts


def trip_routes(hazards: DataFrame, drop_blank_location: bool = False, as_of=None) -> DataFrame:
    """Counts, risk from 0 to 100, rating, primary hazard and expected delay per location."""
    df = located(hazards.filter("has_valid_location"), drop_blank_location).groupBy("location").agg(
        F.count(F.lit(1)).alias("total_hazards"), count_where(F.col("is_active")).alias("active_hazards"),
        *severity_counts("Major", "Moderate"), *centroid(),
        *category_counts("roadwork_count", "incident_count", "flood_count", "event_count"),
        F.min("start_time_ts").alias("earliest_hazard_time"), F.max("end_time_ts").alias("latest_hazard_time"))
    risk = (clamp(F.col("total_hazards") * 0.5, hi=30) + F.col("major_hazards") * 12
            + clamp(F.col("active_hazards") * 1.5, hi=25) + F.col("flood_count") * 10)
    df = df.withColumn("route_risk_score", clamp(risk, hi=100).cast("int"))
    df = df.withColumn("route_safety_rating", band("route_risk_score", fixed.ROUTE_RATINGS, fixed.ROUTE_RATING_DEFAULT))
    work, incident, flood, event = (F.col(c) for c in fixed.HAZARD_CATEGORIES)
    primary = first_match([(flood > 0, "Flooding - Road Closures Likely"),
                           (work >= F.greatest(incident, event), "Roadwork - Expect Delays"),
                           (incident >= F.greatest(work, event), "Traffic Incidents"),
                           (event > 0, "Special Event - Heavy Traffic")], "Mixed Hazards")
    delay = F.col("active_hazards") * lookup("route_safety_rating", fixed.DELAY_MINUTES, 1)
    df = df.withColumn("primary_hazard_type", primary).withColumn("estimated_delay_minutes", delay)
    return stamp(df, "analysis_timestamp", as_of)


def trip_distances(spark, lengths=fixed.TRIP_DISTANCES_KM) -> DataFrame:
    return small_dim(spark, [(d,) for d in lengths], "trip_distance_km bigint")


def charging_requirements(distances: DataFrame, stations: DataFrame, range_km: int = fixed.EV_RANGE_KM,
                          speed_kmh: int = fixed.EV_SPEED_KMH, buffer_km: int = fixed.EV_BUFFER_KM,
                          as_of=None) -> DataFrame:
    """Stops, hours, starting charge and feasibility per trip length, beside the size of the network.

    At exactly the range a trip counts as easy and still gets one stop and a starting charge above 100: the three
    rules have different limits."""
    d = F.col("trip_distance_km")
    df = distances.withColumn("charging_stops_needed",
                              clamp(F.ceil((d - range_km + buffer_km) / (range_km - buffer_km)), lo=0))
    stops = F.col("charging_stops_needed")
    df = df.withColumns({"base_driving_time_hours": d / speed_kmh,
                         "charging_time_hours": stops * fixed.CHARGE_HOURS_PER_STOP})
    df = df.withColumns({
        "total_trip_time_hours": F.col("base_driving_time_hours") + F.col("charging_time_hours"),
        "recommended_charger_type": F.when(stops > 0, "Fast Charger (50+ kW)").otherwise("Any Charger"),
        "minimum_starting_battery_pct": F.when(d <= range_km, F.ceil((d + buffer_km) / range_km * 100)).otherwise(100),
        "trip_feasibility": first_match([(d <= range_km, "Easy - No charging needed"),
                                         (stops <= 1, "Moderate - One charging stop"),
                                         (stops <= 3, "Complex - Multiple stops needed")],
                                        "Challenging - Plan carefully")})
    network = stations.agg(F.count(F.lit(1)).alias("total_stations"), F.sum("number_of_plugs").alias("total_plugs"),
                           count_where(F.col("charging_speed") == "Fast").alias("fast_charger_stations"))
    df = attach_scalars(df, network)
    df = df.withColumn("charger_availability_score", band("fast_charger_stations", fixed.NETWORK_LEVELS, "Limited"))
    return stamp(df, "calculated_at", as_of)


def trip_recommendations(hourly: DataFrame, as_of=None) -> DataFrame:
    """Suitability, category, advice and rank of every hour and weekday."""
    df = hourly.select("hour_of_day", "day_name", "congestion_score", "congestion_level", "total_hazards",
                       "active_hazards", "is_peak_hour").distinct()
    df = df.withColumn("trip_suitability_score", clamp(100 - F.col("congestion_score"), lo=0).cast("int"))
    df = df.withColumn("trip_window_category", band("trip_suitability_score", fixed.WINDOW_CATEGORIES, "Avoid"))
    df = df.withColumns({
        "time_period": span("hour_of_day", fixed.TRIP_PERIODS, "Night"),
        "trip_advice": lookup("trip_window_category", fixed.TRIP_ADVICE, fixed.TRIP_ADVICE_DEFAULT),
        "charging_availability": F.when(F.col("hour_of_day").between(0, 6), "24/7 stations only")
                                  .otherwise("All stations available"),
        "congestion_delay_factor": lookup("congestion_level", fixed.DELAY_FACTORS, 1.0)})
    # One row per hour and weekday, 168 at most, whatever the number of hazards.
    df = global_rank(df, [F.desc("trip_suitability_score"), F.asc("hour_of_day"), F.asc("day_name")],
                     "priority_rank", small=True)
    return stamp(df, "generated_at", as_of)


def trip_summary(routes: DataFrame, charging: DataFrame, recs: DataFrame) -> DataFrame:
    """section, label, value: extremes of the routes, charging needs, best and worst windows, shares."""
    total = F.count(F.lit(1))
    route_row = routes.agg(total.alias("routes"),
                           count_where(F.col("route_safety_rating").contains("High Risk")).alias("high_risk_routes"))
    charge_row = charging.agg(total.alias("profiles"), F.round(F.avg("charging_stops_needed"), 1).alias("avg_stops"),
                              F.max("trip_distance_km").alias("max_distance_km"))
    optimal = count_where(F.col("trip_window_category") == "Optimal")
    window_row = recs.agg(total.alias("windows"), optimal.alias("optimal_windows"),
                          F.round(F.try_divide(optimal * 100.0, total), 1).alias("optimal_pct"),
                          F.round(F.avg("congestion_delay_factor"), 2).alias("avg_delay_factor"))
    slot = F.concat(F.col("day_name"), F.lit(" "), F.col("hour_of_day").cast("string"))
    ties = ["hour_of_day", "day_name"]
    riskiest = arg_best(routes, "route_risk_score", ["location"])
    parts = [
        metric_rows(route_row, "routes"), metric_rows(charge_row, "charging"), metric_rows(window_row, "windows"),
        labelled(arg_best(routes, "route_risk_score", ["location"], ascending=True), "safest_route", "location", "route_risk_score"),
        labelled(riskiest, "riskiest_route", "location", "route_risk_score"),
        labelled(riskiest, "riskiest_route_delay", "location", "estimated_delay_minutes"),
        labelled(top_n(recs, "trip_suitability_score", 3, ties), "best_window", slot, "trip_suitability_score"),
        labelled(top_n(recs, "trip_suitability_score", 3, ties, ascending=True), "worst_window", slot, "trip_suitability_score"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
