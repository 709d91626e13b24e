"""Gold rules on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from voltlane.functions import fixed
from voltlane.plans import infrastructure, reports, traffic, trips


def stations(spark, n, speed="Fast"):
    return spark.range(n).select(F.lit(speed).alias("charging_speed"), F.lit(2).alias("number_of_plugs"))


GOLDEN = [  # km, stops, start percent, feasibility
    (25, 0, 22, "Easy - No charging needed"), (50, 0, 29, "Easy - No charging needed"), (75, 0, 36, "Easy - No charging needed"),
    (100, 0, 43, "Easy - No charging needed"), (150, 0, 58, "Easy - No charging needed"), (200, 0, 72, "Easy - No charging needed"),
    (250, 0, 86, "Easy - No charging needed"), (300, 0, 100, "Easy - No charging needed"), (350, 1, 115, "Easy - No charging needed"),
    (400, 1, 100, "Moderate - One charging stop"), (500, 1, 100, "Moderate - One charging stop"),
]


def test_charging_requirements_golden(spark):
    rows = trips.charging_requirements(trips.trip_distances(spark), stations(spark, 20)).orderBy("trip_distance_km").collect()
    assert [(r["trip_distance_km"], r["charging_stops_needed"], r["minimum_starting_battery_pct"], r["trip_feasibility"]) for r in rows] == GOLDEN
    assert rows[0]["recommended_charger_type"] == "Any Charger" and rows[8]["recommended_charger_type"] == "Fast Charger (50+ kW)"
    assert rows[9]["total_trip_time_hours"] == pytest.approx(400 / 60 + 0.5)
    assert (rows[0]["total_stations"], rows[0]["total_plugs"], rows[0]["charger_availability_score"]) == (20, 40, "Moderate")


@pytest.mark.parametrize("km,stops,text", [(600, 1, "Moderate - One charging stop"), (601, 2, "Complex - Multiple stops needed"),
                                           (1200, 3, "Complex - Multiple stops needed"), (1201, 4, "Challenging - Plan carefully")])
def test_long_trips(spark, km, stops, text):
    r = trips.charging_requirements(trips.trip_distances(spark, [km]), stations(spark, 0)).first()
    assert (r["charging_stops_needed"], r["trip_feasibility"], r["charger_availability_score"]) == (stops, text, "Limited")


def hazards(spark, rows):
    """rows: (hour text, category, severity, active, location)"""
    df = spark.createDataFrame(rows, "start string, main_category string, severity string, is_active boolean, location string")
    return df.select(F.to_timestamp("start").alias("start_time_ts"), F.to_timestamp("start").alias("end_time_ts"), "main_category", "severity", "is_active", "location",
                     F.lit(True).alias("has_valid_location"), F.lit(-33.0).alias("latitude"), F.lit(151.0).alias("longitude"))


T = "2024-01-08 08:15:00"  # a Monday


@pytest.mark.parametrize("minor,major,active,score,level", [(4, 0, 0, 8, "Minimal"), (5, 0, 0, 10, "Low"), (30, 0, 0, 50, "High"), (0, 5, 0, 60, "High"),
                                                            (0, 4, 2, 50, "High"), (0, 5, 5, 65, "High"), (0, 9, 0, 100, "Critical"), (30, 0, 30, 70, "Critical")])
def test_congestion_score(spark, minor, major, active, score, level):
    rows = [(T, "Hazard", "Minor", i < active, "x") for i in range(minor)] + [(T, "Hazard", "Major", i < active - minor, "x") for i in range(major)]
    r = traffic.congestion_hourly(hazards(spark, rows)).first()
    assert (r["congestion_score"], r["congestion_level"]) == (score, level)
    assert (r["hour_of_day"], r["day_of_week"], r["day_name"], r["is_peak_hour"]) == (8, 2, "Monday", True)


def test_location_and_route_types(spark):
    rows = ([(T, "Other", "Minor", False, "zero")] + [(T, c, "Minor", False, "tie") for c in ("Scheduled Roadwork", "Hazard", "Flooding")]
            + [(T, "Hazard", "Minor", False, "inc")] * 2 + [(T, "Flooding", "Minor", False, "flood")] * 3 + [(T, "Flooding", "Minor", True, "inc")]
            + [(T, "Special Event", "Minor", True, "event")] + [(None, "Hazard", "Major", True, "")] + [(T, "Hazard", "Minor", True, None)])
    h = hazards(spark, rows)
    got = {r["location"]: r for r in traffic.congestion_location(h).collect()}
    assert {k: v["dominant_hazard_type"] for k, v in got.items()} == {"zero": "Roadwork", "tie": "Roadwork", "inc": "Incidents", "flood": "Flooding", "event": "Roadwork", "": "Incidents"}
    assert got[""]["risk_score"] == int(0.5 + 10 + 2) and "" not in {r["location"] for r in traffic.congestion_location(h, drop_blank_location=True).collect()}
    routes = {r["location"]: r for r in trips.trip_routes(h).collect()}
    assert routes["tie"]["primary_hazard_type"] == "Flooding - Road Closures Likely"
    assert routes["event"]["primary_hazard_type"] == "Special Event - Heavy Traffic"
    assert routes["zero"]["primary_hazard_type"] == "Roadwork - Expect Delays"
    assert routes["flood"]["route_risk_score"] == int(1.5 + 30) and routes["flood"]["route_safety_rating"] == "Acceptable - Low Risk"


@pytest.mark.parametrize("floods,active,rating,delay", [(2, 0, "Recommended - Minimal Risk", 0), (3, 1, "Acceptable - Low Risk", 3), (5, 2, "Caution - Moderate Risk", 16), (7, 3, "Avoid - High Risk", 45)])
def test_route_delay(spark, floods, active, rating, delay):
    r = trips.trip_routes(hazards(spark, [(T, "Flooding", "Minor", i < active, "x") for i in range(floods)])).first()
    assert (r["route_safety_rating"], r["estimated_delay_minutes"]) == (rating, delay)


def test_recommendations_and_missing_hours(spark):
    rows = [(T, "Hazard", "Minor", False, "x")] * 10 + [("2024-01-06 23:00:00", "Hazard", "Major", True, "x")] * 6
    hourly = traffic.congestion_hourly(hazards(spark, rows))
    recs = {r["hour_of_day"]: r for r in traffic.congestion_recommendations(hourly).collect()}
    assert set(recs) == {8, 23}
    assert (recs[8]["recommendation_category"], recs[8]["time_period"]) == ("Good", "Morning Rush")
    assert (recs[23]["recommendation_category"], recs[23]["travel_recommendation"]) == ("Poor", fixed.TRAVEL_ADVICE[0][1])
    windows = trips.trip_recommendations(hourly).orderBy("priority_rank").collect()
    assert [(w["hour_of_day"], w["trip_suitability_score"], w["trip_window_category"], w["charging_availability"]) for w in windows] == [
        (8, 80, "Good", "All stations available"), (23, 22, "Avoid", "All stations available")]
    profile = traffic.weekday_weekend(hourly)
    assert {r["day_type"]: r["peak_hour"] for r in traffic.day_type_peaks(profile).collect()} == {"Weekday": 8, "Weekend": 23}
    heat = {r["hour_of_day"]: r for r in reports.congestion_heatmap(hourly).collect()}
    assert heat[8]["Monday"] == 20 and heat[8]["Sunday"] is None


def silver_like(spark, rows):
    return spark.createDataFrame(rows, "lganame string, latitude double, longitude double, charger_rating_kw double, charging_speed string, has_valid_rating boolean").withColumn("has_valid_location", F.lit(True))


@pytest.mark.parametrize("n,speed,kw,score,category", [(1, "Slow", 5.0, 99, "Critical"), (1, "Rapid", 100.0, 84, "Critical"), (5, "Rapid", 100.0, 18, "Low"),
                                                       (4, "Rapid", 250.0, 30, "Moderate"), (40, "Slow", 5.0, 49, "Moderate")])
def test_gap_severity(spark, n, speed, kw, score, category):
    r = infrastructure.gap_analysis(silver_like(spark, [("l", -33.0, 151.0, kw, speed, True)] * n)).first()
    assert (r["gap_severity_score"], r["gap_category"]) == (score, category)


def fuel_like(spark, rows):
    return spark.createDataFrame(rows, "stationcode string, fuel_category string, price_cents double, has_valid_price boolean")


def test_fuel_metrics(spark):
    fuel = fuel_like(spark, [("a", "Diesel", 200.0, True), ("a", "Diesel", 100.0, True), ("b", "Diesel", 0.0, False), (None, "Diesel", 300.0, True), ("b", "LPG", 90.0, True), ("a", "Other", 1.0, True)])
    r = infrastructure.fuel_metrics(fuel).first()
    assert r.asDict() == {"fuel_station_count_nsw": 2, "valid_prices_nsw": 5, "avg_regular_unleaded_price": None, "avg_diesel_price": 200.0, "avg_lpg_price": 90.0,
                          "stations_with_unleaded_nsw": 0, "stations_with_diesel_nsw": 2, "stations_with_lpg_nsw": 1}
    empty = infrastructure.fuel_metrics(fuel.limit(0)).first()
    assert empty["fuel_station_count_nsw"] == 0 and empty["avg_lpg_price"] is None


def test_readiness_and_first_region_wins(spark):
    both = (-33.5, 151.25)  # inside Sydney Metro and Central Coast
    rows = [("l", *both, 50.0, "Rapid", True)] * 10 + [("l", 0.0, 0.0, None, "Unknown", False)]
    gold = {r["region"]: r for r in infrastructure.regional_infrastructure(silver_like(spark, rows), fuel_like(spark, [("a", "LPG", 1.0, True)]), as_of="2024-01-15 00:00:00").collect()}
    assert set(gold) == {"Sydney Metro", "Other"}
    assert gold["Sydney Metro"]["ev_readiness_score"] == int(2 + 30 + 15) and gold["Other"]["ev_readiness_score"] == 0
    assert gold["Other"]["avg_capacity_kw"] == 0.0 and str(gold["Other"]["reporting_date"]) == "2024-01-15"


def test_summaries_of_empty_tables(spark):
    smart = spark.createDataFrame([], "objectid int, recommendation_tier string, recommendation_score int, nearby_hazards_count bigint")
    gaps = spark.createDataFrame([], "lganame string, gap_category string, gap_severity_score int")
    rows = infrastructure.recommendation_summary(gaps, gaps, smart).collect()
    assert all(r["value"] == 0.0 for r in rows) and len(rows) == 12


def test_needs_by_band(spark):
    got = {r["distance_band"]: r["trips"] for r in reports.needs_by_band(trips.charging_requirements(trips.trip_distances(spark), stations(spark, 1))).collect()}
    assert got == {"0-100 km": 4, "101-200 km": 2, "201-300 km": 2, "301-400 km": 2, "Over 400 km": 1}


def test_nearby_filters(spark):
    df = silver_like(spark, [("l", -33.0, 151.0, 50.0, "Rapid", True)] * 3).withColumn("objectid", F.monotonically_increasing_id() % 100).withColumns({
        "station_name": F.lit(None).cast("string"), "station_address": F.lit(None).cast("string"), "operator": F.lit("o"), "number_of_plugs": F.lit(1),
        "charger__type": F.lit("AC"), "pcode": F.lit(2000), "recommendation_tier": F.lit("Good"), "recommendation_score": F.lit(70),
        "accessibility_score": F.lit(90), "nearby_hazards_count": F.lit(1), "hazard_types": F.lit(None).cast("array<string>")})
    rows = infrastructure.nearby_stations(df, -33.0, 151.0, limit=2).collect()
    assert len(rows) == 2 and rows[0]["hazard_types"] == [] and rows[0]["address"] == "Address not available" and rows[0]["name"].startswith("Station ")
    assert infrastructure.nearby_stations(df, -33.0, 151.0, charger_type="DC").count() == 0
    assert infrastructure.nearby_stations(df, -33.0, 151.0, operator="o' OR 1=1 --").count() == 0
    assert infrastructure.nearby_stations(df, 0.0, 151.0).count() == 0 and infrastructure.nearby_stations(df, -33.0, 151.0, postcode=2000).count() == 3
