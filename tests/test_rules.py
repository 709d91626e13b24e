"""Every threshold at, just below and just above, and nulls."""

import pytest
from pyspark.sql import functions as F

from voltlane.functions import columns as C
from voltlane.functions import fixed
from voltlane.operators.shape import apply_hints, snake_case, snake_case_columns
from voltlane.plans import feeds, silver, traffic, trips
from pyspark.sql import types as T


def values(spark, inputs, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_speed_batch(spark):
    got = values(spark, [None, -1.0, 6.9, 7.0, 21.9, 22.0, 150.0, 150.1], "double", silver.charging_speed("v"))
    assert got == ["Unknown", "Slow", "Slow", "Fast", "Fast", "Rapid", "Rapid", "Ultra-Rapid"]


def test_speed_feed(spark):
    got = values(spark, [None, -1.0, 0.0, 0.1, 7.0, 22.0, 149.9, 150.0], "double", silver.charging_speed("v", "feed"))
    assert got == ["Unknown", "Unknown", "Unknown", "Slow", "Fast", "Rapid", "Rapid", "Ultra-Rapid"]


def test_speed_variant_name():
    with pytest.raises(ValueError):
        silver.charging_speed("v", "other")


def test_parse_kw(spark):
    texts = ["50 kW", "50.5 kW", "2 x 50 kW", "AC", "", None, "7.", "350kW"]
    assert values(spark, texts, "string", C.parse_kw("v")) == [50.0, 50.5, 2.0, None, None, None, 7.0, 350.0]


@pytest.mark.parametrize("floors,default,cases", [
    (fixed.CONGESTION_LEVELS, "Minimal", {70: "Critical", 69: "High", 50: "High", 49: "Moderate", 30: "Moderate", 29: "Low", 10: "Low", 9: "Minimal"}),
    (fixed.RISK_LEVELS, "Low Risk", {70: "High Risk", 69: "Moderate Risk", 40: "Moderate Risk", 39: "Low Risk"}),
    (fixed.GAP_LEVELS, "Low", {70: "Critical", 50: "High", 30: "Moderate", 29: "Low"}),
    (fixed.SMART_TIERS, "Limited", {85: "Excellent", 84: "Good", 70: "Good", 69: "Fair", 50: "Fair", 49: "Limited", -10: "Limited"}),
    (fixed.WINDOW_CATEGORIES, "Avoid", {90: "Optimal", 89: "Good", 70: "Good", 50: "Fair", 30: "Poor", 29: "Avoid"}),
    (fixed.ROUTE_RATINGS, fixed.ROUTE_RATING_DEFAULT, {70: "Avoid - High Risk", 50: "Caution - Moderate Risk", 25: "Acceptable - Low Risk", 24: "Recommended - Minimal Risk"}),
    (fixed.NETWORK_LEVELS, "Limited", {100: "Excellent", 99: "Good", 50: "Good", 49: "Moderate", 20: "Moderate", 19: "Limited"}),
])
def test_bands(spark, floors, default, cases):
    assert values(spark, list(cases), "int", C.band("v", floors, default)) == list(cases.values())


def test_periods_differ(spark):
    hours = [0, 5, 6, 8, 9, 11, 12, 15, 17, 18, 20, 22, 23]
    assert values(spark, hours, "int", C.span("v", fixed.HOUR_PERIODS, "Night")) == [
        "Late Night", "Late Night", "Morning Rush", "Morning Rush", "Mid-Morning", "Mid-Morning", "Midday", "Afternoon",
        "Evening Rush", "Evening Rush", "Evening", "Evening", "Night"]
    assert values(spark, hours, "int", C.span("v", fixed.TRIP_PERIODS, "Night")) == [
        "Late Night", "Late Night", "Morning Rush", "Morning Rush", "Morning Rush", "Late Morning", "Midday", "Afternoon",
        "Afternoon", "Evening Rush", "Evening Rush", "Night", "Night"]


def test_station_flags(spark):
    rows = [(1, "a", "0 kW", 90.0, 180.0), (2, "b", "7 kW", -90.0, -180.0), (3, "c", None, 90.1, 0.0), (4, "d", "1 kW", None, 0.0)]
    raw = spark.createDataFrame(rows, "objectid int, station_name string, charger_rating string, latitude double, longitude double")
    got = {r["objectid"]: (r["has_valid_location"], r["has_valid_rating"]) for r in silver.silver_stations(raw).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False), 4: (False, True)}


def test_stations_keep_one_per_name_and_place(spark):
    rows = [(5, None, 1.0, 2.0), (3, None, 1.0, 2.0), (9, "x", 1.0, 2.0), (8, "x", 1.0, 2.1)]
    raw = spark.createDataFrame(rows, "objectid int, station_name string, latitude double, longitude double").withColumn("charger_rating", F.lit("7"))
    assert sorted(r["objectid"] for r in silver.silver_stations(raw).collect()) == [3, 8, 9]


def test_fuel_batch_and_text_time(spark):
    rows = [("1", " e10 ", "150.5", "01/02/2024 10:00:00"), ("1", "E10", "151.0", "01/02/2024 11:00:00"), ("", "dl", "500", "bad"),
            ("2", "Premium 95", "500.1", None), ("3", "autogas", "x", "03/02/2024 00:00:00"), (None, "EV", "0", "03/02/2024 00:00:00")]
    raw = spark.createDataFrame(rows, "stationcode string, fueltype string, price string, lastupdated string")
    got = {(r["stationcode"], r["fuel_type_clean"]): r for r in silver.silver_fuel(raw).collect()}
    assert got[("1", "E10")]["price_cents"] == 151.0 and got[("1", "E10")]["fuel_category"] == "Regular Unleaded"
    dl = got[("", "DL")]
    assert (dl["fuel_category"], dl["has_valid_price"], dl["has_valid_station"], dl["has_valid_timestamp"]) == ("Diesel", True, False, False)
    assert not got[("2", "PREMIUM 95")]["has_valid_price"] and got[("2", "PREMIUM 95")]["fuel_category"] == "Premium 95"
    assert got[("3", "AUTOGAS")]["price_cents"] is None and got[("3", "AUTOGAS")]["fuel_category"] == "LPG"
    assert got[(None, "EV")]["has_valid_price"] is False and got[(None, "EV")]["has_valid_station"] is False


def test_hazards_text_times_and_activity(spark):
    now = "2024-01-15 00:00:00"
    rows = [("1", "2024-01-15T00:00:00Z", "2024-01-15T00:00:00Z", True, True), ("2", "2024-01-15T00:00:01Z", None, False, True),
            ("3", "2024-01-01T00:00:00Z", "2024-01-14T23:59:59Z", None, None), ("4", "nonsense", None, False, False)]
    raw = spark.createDataFrame(rows, "hazard_id string, start_time string, end_time string, is_major boolean, impact boolean")
    raw = raw.withColumns({"hazard_type": F.lit(" Fire "), "headline": F.lit(""), "latitude": F.lit(-37.5), "longitude": F.lit(154.0),
                           "created": F.lit(None).cast("string"), "last_updated": F.lit(None).cast("string")})
    got = {r["hazard_id"]: r for r in silver.silver_hazards(raw, now).collect()}
    assert [got[k]["is_active"] for k in "1234"] == [True, False, False, False]
    assert [got[k]["severity"] for k in "1234"] == ["Major", "Moderate", "Minor", "Minor"]
    assert got["4"]["start_time_ts"] is None and not got["4"]["has_valid_start_time"]
    assert got["1"]["has_valid_location"] and not got["1"]["has_valid_headline"] and got["1"]["hazard_type_clean"] == "fire"


def test_hazard_key_without_id(spark):
    rows = [("", "h", -33.0, 151.0, "fire", 1), (None, "h", -33.0, 151.0, "FIRE ", 2), ("", "h", -33.0, 151.1, "fire", 3), ("", None, None, None, None, 4)]
    raw = spark.createDataFrame(rows, "hazard_id string, headline string, latitude double, longitude double, hazard_type string, n int").withColumns({
        "is_major": F.lit(False), "impact": F.lit(False), "start_time_ts": F.lit(None).cast("timestamp"),
        "end_time_ts": F.lit(None).cast("timestamp"), "last_updated_ts": F.lit(None).cast("timestamp")})
    assert sorted(r["n"] for r in silver.silver_hazards(raw, tiebreak=["n"]).collect()) == [1, 3, 4]


def test_weather_groups(spark):
    words = {"Thunderstorm with rain": "Rain", "THUNDERSTORM": "Storm", "hail": "Snow/Ice", "Hazy": "Other", "haze": "Fog", "gusts": "Windy",
             "61": "Other", "fine": "Clear", "overcast": "Cloudy", None: "Other"}
    raw = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "station_id string, weather_condition string").withColumns({
        "timestamp": F.to_timestamp(F.lit("2024-01-15 00:00:00")), "temperature_celsius": F.lit(60.0), "humidity_percent": F.lit(100.1),
        "precipitation_mm": F.lit(0.0), "wind_speed_kmh": F.lit(-0.1), "location_lat": F.lit(-28.0), "location_lon": F.lit(None).cast("double")})
    rows = silver.silver_weather(raw, "2024-01-15 00:00:00").orderBy(F.col("station_id").cast("int")).collect()
    assert [r["weather_category"] for r in rows] == list(words.values())
    r = rows[0]
    assert (r["has_valid_temperature"], r["has_valid_humidity"], r["has_valid_precipitation"], r["has_valid_wind_speed"],
            r["has_valid_location"], r["has_valid_timestamp"]) == (True, False, True, False, False, True)


def test_weather_stats_without_valid_rows(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, True, False, True)],
                               "temperature_celsius double, humidity_percent double, wind_speed_kmh double, "
                               "has_valid_temperature boolean, has_valid_humidity boolean, has_valid_wind_speed boolean")
    assert [tuple(r) for r in silver.weather_stats(df).collect()] == [(None,) * 5]


def test_feed_patterns(spark):
    fuel = spark.createDataFrame([(t, p) for t, p in [("U91", 0.0), ("P95", 500.0), ("98", 500.1), ("Diesel", -0.1), ("LPG", 1.0), ("E10", 1.0), ("DL", 1.0), ("X", None), (None, 1.0)]],
                                 "fueltype string, price double")
    got = {r["fuel_type"]: r["fuel_category"] for r in feeds.feed_fuel(fuel).collect()}
    assert got == {"U91": "Regular Unleaded", "P95": "Premium 95", "LPG": "LPG", "E10": "Other", "DL": "Other"}


def test_feed_rules_fail_fast_on_missing_columns(spark):
    with pytest.raises(ValueError):
        feeds.feed_fuel(spark.createDataFrame([(1.0,)], "price double"))


def test_feed_activity(spark):
    rows = [("a", None), ("b", "15/01/2024 00:00:00"), ("c", "15/01/2024 00:00:01"), ("d", "soon")]
    df = feeds.active_filter(spark.createDataFrame(rows, "id string, `end` string"), "2024-01-15 00:00:00")
    assert sorted(r["id"] for r in df.collect()) == ["a", "c"]


def test_temporal_zone(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-06 20:30:00' AS t")
    r = df.select(*[c.alias(n) for n, c in C.hour_and_day("t").items()], *[c.alias(n + "_s") for n, c in C.hour_and_day("t", "Australia/Sydney").items()]).first()
    assert (r["hour_of_day"], r["day_of_week"], r["day_name"]) == (20, 7, "Saturday")
    assert (r["hour_of_day_s"], r["day_of_week_s"], r["day_name_s"]) == (7, 1, "Sunday")


def test_epoch_ms(spark):
    got = values(spark, ["1704067200000", "1704067200123", "2024-01-01", None], "string", C.epoch_ms("v"))
    assert got == ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123000Z", "2024-01-01", None]


def test_names_and_hints(spark):
    assert [snake_case(n) for n in ["Charger Type", "stationName", "HTTPServer-Name", "OBJECTID", "a  b"]] == [
        "charger__type", "station_name", "http_server__name", "objectid", "a_b"]
    assert snake_case_columns(spark.createDataFrame([(1,)], "`Charger Type` int")).columns == ["charger__type"]
    hinted = apply_hints(T.StructType.fromDDL("StationID bigint, other string"), "stationid string, Latitude double")
    assert hinted.simpleString() == "struct<stationid:string,other:string,Latitude:double>"


def test_display_name(spark):
    df = spark.createDataFrame([("n", "a, b", 1), (None, " 12 Main St , X", 2), ("", "", 3), (None, None, 4)], "n string, a string, i int")
    got = [r["x"] for r in df.orderBy("i").select(C.display_name("n", "a", "i").alias("x")).collect()]
    assert got == ["n", "12 Main St", "Station 3", "Station 4"]


def test_composite_key(spark):
    df = spark.createDataFrame([("i", "h", "l"), (None, "h", "l"), (None, None, "l")], "hazard_id string, headline string, location string")
    import hashlib
    assert [r["x"] for r in df.select(C.composite_key().alias("x")).collect()] == ["i", hashlib.sha256(b"hl").hexdigest(), None]


def test_clamp_skips_nulls(spark):
    assert values(spark, [None, -5, 5, 50], "int", C.clamp(F.col("v"), 0, 10)) == [10, 0, 5, 10]
