"""Input views over the test tables, one text for both engines, in the shapes of the four feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-15 00:00:00"

VIEWS = {
    "stations_raw": ("customer", """
SELECT c_custkey AS objectid,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS station_name,
       CASE WHEN c_custkey % 11 = 0 THEN NULL
            ELSE concat(CAST(c_custkey AS VARCHAR(20)), ' Main St, ', c_mktsegment) END AS station_address,
       concat('LGA_', CAST(c_nationkey AS VARCHAR(20))) AS lganame,
       2000 + c_custkey % 900 AS pcode,
       c_mktsegment AS operator,
       CASE c_custkey % 3 WHEN 0 THEN 'AC' WHEN 1 THEN 'DC' ELSE 'Upcoming' END AS charger__type,
       1 + c_custkey % 8 AS number_of_plugs,
       CASE c_custkey % 8 WHEN 0 THEN 'AC' WHEN 1 THEN '3.6 kW' WHEN 2 THEN '7 kW' WHEN 3 THEN '22 kW'
            WHEN 4 THEN '50 kW' WHEN 5 THEN '150 kW' WHEN 6 THEN '2 x 350 kW' ELSE '350kW' END AS charger_rating,
       CASE WHEN c_custkey % 97 = 0 THEN NULL
            WHEN c_custkey % 4 = 0 THEN -34.2e0 + (c_custkey * 7919 % 1700) / 1000e0
            ELSE -37.5e0 + (c_custkey * 7919 % 9500) / 1000e0 END AS latitude,
       CASE WHEN c_custkey % 4 = 0 THEN 150.5e0 + (c_custkey * 10007 % 1500) / 1000e0
            ELSE 140.0e0 + (c_custkey * 10007 % 14000) / 1000e0 END AS longitude
FROM {customer}"""),
    "hazards_raw": ("events", """
SELECT event_id,
       CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('H', CAST(event_id % 900 AS VARCHAR(20))) END AS hazard_id,
       CASE event_type WHEN 'click' THEN ' Roadwork ' WHEN 'error' THEN 'incident' WHEN 'purchase' THEN 'FLOOD'
            WHEN 'signup' THEN 'majorevent' ELSE 'fire' END AS hazard_type,
       CASE event_type WHEN 'click' THEN 'Scheduled Roadwork' WHEN 'error' THEN 'Hazard' WHEN 'purchase' THEN 'Flooding'
            WHEN 'signup' THEN 'Special Event' ELSE 'Other' END AS main_category,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('Headline ', CAST(event_id % 40 AS VARCHAR(20))) END AS headline,
       concat('LOC_', CAST(user_id % 12 AS VARCHAR(20))) AS location,
       CASE WHEN event_id % 8 = 0 THEN NULL ELSE ts END AS start_time_ts,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL '5' DAY END AS end_time_ts,
       ts AS last_updated_ts,
       event_id % 10 = 0 AS is_major,
       event_id % 4 = 1 AS impact,
       -34.3e0 + (event_id * 7919 % 1800) / 1000e0 AS latitude,
       150.4e0 + (event_id * 10007 % 1700) / 1000e0 AS longitude
FROM {events}"""),
    "fuel_raw": ("lineitem", """
SELECT CASE WHEN l_orderkey % 50 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS stationcode,
       CASE l_linenumber % 7 WHEN 0 THEN ' e10' WHEN 1 THEN 'U91' WHEN 2 THEN 'U95' WHEN 3 THEN 'U98 '
            WHEN 4 THEN 'dl' WHEN 5 THEN 'LPG' ELSE 'EV' END AS fueltype,
       CASE WHEN l_linenumber % 7 = 6 THEN 0e0 ELSE l_quantity * 11 END AS price,
       l_shipdate AS last_updated_ts,
       l_orderkey AS tie_key
FROM {lineitem}"""),
    "weather_raw": ("orders", """
SELECT concat('WS', CAST(o_custkey % 20 AS VARCHAR(20))) AS station_id,
       o_orderdate AS obs_ts,
       CASE o_orderkey % 9 WHEN 0 THEN ' sunny' WHEN 1 THEN 'partly cloudy' WHEN 2 THEN 'light drizzle'
            WHEN 3 THEN 'Thunderstorm' WHEN 4 THEN 'sleet' WHEN 5 THEN 'mist' WHEN 6 THEN 'gale'
            WHEN 7 THEN 'Thunderstorm with rain' ELSE '61' END AS weather_condition,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 4000e0 - 5e0 END AS temperature_celsius,
       o_orderkey % 110 AS humidity_percent,
       o_orderkey % 17 - 1 AS precipitation_mm,
       o_orderkey % 60 AS wind_speed_kmh,
       -38.0e0 + (o_custkey % 20) / 2e0 AS location_lat,
       141e0 + (o_custkey % 20) * 0.6e0 AS location_lon,
       o_orderkey AS tie_key
FROM {orders}"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, text = VIEWS[name]
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def view_sql(name: str) -> str:
    base, text = VIEWS[name]
    return text.replace("{%s}" % base, base)


# The feed shapes. Texts of times are built from parts, which reads the same in both engines.
_TEXT_TIME = ("concat(lpad(CAST(day({0}) AS VARCHAR(2)), 2, '0'), '/', lpad(CAST(month({0}) AS VARCHAR(2)), 2, '0'), '/', "
              "CAST(year({0}) AS VARCHAR(4)), ' ', lpad(CAST(hour({0}) AS VARCHAR(2)), 2, '0'), ':', "
              "lpad(CAST(minute({0}) AS VARCHAR(2)), 2, '0'), ':', lpad(CAST(second({0}) AS VARCHAR(2)), 2, '0'))")

VIEWS["stations_landing"] = ("customer", """
SELECT CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR(20)) END AS StationID,
       c_mktsegment AS OperatorName,
       concat(CAST(c_custkey AS VARCHAR(20)), ' Main St') AS AddressLine1,
       concat('Suburb ', CAST(c_nationkey AS VARCHAR(20))) AS Suburb,
       'NSW' AS State,
       CAST(2000 + c_custkey % 900 AS VARCHAR(20)) AS Postcode,
       CASE WHEN c_custkey % 97 = 0 THEN NULL
            WHEN c_custkey % 4 = 0 THEN -34.2e0 + (c_custkey * 7919 % 1700) / 1000e0
            WHEN c_custkey % 89 = 0 THEN 95e0
            ELSE -37.5e0 + (c_custkey * 7919 % 9500) / 1000e0 END AS Latitude,
       CASE WHEN c_custkey % 4 = 0 THEN 150.5e0 + (c_custkey * 10007 % 1500) / 1000e0
            ELSE 140.0e0 + (c_custkey * 10007 % 14000) / 1000e0 END AS Longitude,
       CAST(1 + c_custkey % 8 AS INT) AS NumberOfPlugs,
       CASE c_custkey % 3 WHEN 0 THEN 'AC' WHEN 1 THEN 'DC' ELSE 'Upcoming' END AS ChargerType,
       CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 0e0 WHEN 2 THEN 3.6e0 WHEN 3 THEN 7e0 WHEN 4 THEN 22e0
            WHEN 5 THEN 50e0 WHEN 6 THEN 149.9e0 WHEN 7 THEN 150e0 ELSE 350e0 END AS ChargingPowerKW
FROM {customer}""")

VIEWS["hazards_landing"] = ("events", """
SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('H', CAST(event_id % 900 AS VARCHAR(20))) END AS hazard_id,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('Headline ', CAST(event_id % 40 AS VARCHAR(20))) END AS headline,
       concat('LOC_', CAST(user_id % 12 AS VARCHAR(20))) AS location,
       """ + _TEXT_TIME.format("ts") + """ AS created,
       CASE WHEN event_id % 50 = 7 THEN 'soon' WHEN event_id % 3 = 0 THEN NULL
            ELSE """ + _TEXT_TIME.format("(ts + INTERVAL '5' DAY)") + """ END AS end_text,
       event_id % 10 = 0 AS isMajor,
       event_id % 4 = 1 AS isImpactNetwork,
       -34.3e0 + (event_id * 7919 % 1800) / 1000e0 AS latitude,
       150.4e0 + (event_id * 10007 % 1700) / 1000e0 AS longitude
FROM {events}""")

VIEWS["weather_landing"] = ("orders", """
SELECT concat('WS', CAST(o_custkey % 20 AS VARCHAR(20))) AS station_id,
       CASE o_orderkey % 8 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Partly Cloudy' WHEN 2 THEN 'Rain showers'
            WHEN 3 THEN 'Storm with Rain' WHEN 4 THEN 'Snow' WHEN 5 THEN 'Fog' WHEN 6 THEN 'Thunderstorm'
            ELSE 'Windy' END AS weather,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 4000e0 - 5e0 END AS temperature_c,
       CAST(o_orderkey % 110 AS DOUBLE) AS humidity_percent,
       -38.0e0 + (o_custkey % 20) / 2e0 AS latitude,
       141e0 + (o_custkey % 20) * 0.6e0 AS longitude
FROM {orders}""")
