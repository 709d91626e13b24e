"""The same questions as SQL for DuckDB. Shared steps are common table expressions, joined in as needed."""

from __future__ import annotations

import re

from voltlane.functions import fixed
from voltlane.plans import silver

from .views import AS_OF, VIEWS, view_sql

NOW = f"TIMESTAMP '{AS_OF}'"
STEPS: dict[str, str] = {name: view_sql(name) for name in VIEWS}
SQL: dict[str, str] = {}


def _case(rules, default) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _floors(col, floors, default) -> str:
    return _case([(f"{col} >= {f}", _text(v)) for f, v in floors], _text(default))


def _map(col, table, default) -> str:
    quote = lambda v: _text(v) if isinstance(v, str) else str(v)
    return _case([(f"{col} = {quote(k)}", quote(v)) for k, v in table.items()], quote(default))


def _spans(col, spans, default) -> str:
    return _case([(f"{col} BETWEEN {a} AND {b}", _text(v)) for a, b, v in spans], _text(default))


def _boxes(boxes, default) -> str:
    return _case([(f"latitude BETWEEN {a} AND {b} AND longitude BETWEEN {c} AND {d}", _text(n)) for n, a, b, c, d in boxes],
                 _text(default))


def _km(lat1, lon1, lat2, lon2) -> str:
    root = (f"sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
            f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(asin(least(1e0, {root})) * 12742e0)"


def _ts(col) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def _union(*selects: str) -> str:
    return " UNION ALL ".join(selects)


def sql(name: str, text: str) -> None:
    """Register a query with the steps it mentions, in the order they depend on each other."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for step in STEPS:
            if re.search(rf"\b{step}\b", body) and step not in needed:
                visit(STEPS[step])
                if step not in needed:
                    needed.append(step)
    visit(text)
    ctes = ", ".join(f"{s} AS ({STEPS[s]})" for s in needed)
    SQL[name] = f"WITH {ctes} {text}" if needed else text


# --- silver -------------------------------------------------------------------------------------------

STEPS["st_silver"] = """
SELECT *, CASE WHEN kw < 7 THEN 'Slow' WHEN kw < 22 THEN 'Fast' WHEN kw <= 150 THEN 'Rapid' WHEN kw > 150 THEN 'Ultra-Rapid'
               ELSE 'Unknown' END AS charging_speed,
       coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS has_valid_location,
       coalesce(kw > 0, false) AS has_valid_rating
FROM (SELECT *, TRY_CAST(regexp_extract(charger_rating, '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS kw,
             row_number() OVER (PARTITION BY station_name, latitude, longitude ORDER BY objectid) AS rn FROM stations_raw)
WHERE rn = 1"""
STEPS["fu_silver"] = f"""
SELECT *, {_case([("fuel_type_clean IN (" + ", ".join(_text(t) for t in types) + ")", _text(n)) for types, n in fixed.FUEL_GROUPS], "'Other'")} AS fuel_category,
       coalesce(price > 0 AND price <= 500, false) AS has_valid_price, coalesce(length(stationcode) > 0, false) AS has_valid_station,
       last_updated_ts IS NOT NULL AS has_valid_timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY stationcode, fuel_type_clean, CAST(last_updated_ts AS DATE)
                                   ORDER BY last_updated_ts DESC NULLS LAST, tie_key, price) AS rn
      FROM (SELECT *, upper(trim(fueltype)) AS fuel_type_clean FROM fuel_raw))
WHERE rn = 1"""
STEPS["hz_silver"] = f"""
SELECT *, CASE WHEN is_major THEN 'Major' WHEN impact THEN 'Moderate' ELSE 'Minor' END AS severity,
       coalesce(start_time_ts <= {NOW} AND (end_time_ts IS NULL OR end_time_ts >= {NOW}), false) AS is_active,
       coalesce(latitude BETWEEN -37.5 AND -28 AND longitude BETWEEN 140 AND 154, false) AS has_valid_location,
       coalesce(length(hazard_id) > 0, false) AS has_valid_hazard_id, coalesce(length(headline) > 0, false) AS has_valid_headline,
       start_time_ts IS NOT NULL AS has_valid_start_time
FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN length(hazard_id) > 0 THEN hazard_id
                 ELSE coalesce(headline, '') || '|' || coalesce(CAST(latitude AS VARCHAR), '') || '|'
                      || coalesce(CAST(longitude AS VARCHAR), '') || '|' || coalesce(hazard_type_clean, '') END
                 ORDER BY last_updated_ts DESC NULLS LAST, event_id) AS rn
      FROM (SELECT *, lower(trim(hazard_type)) AS hazard_type_clean FROM hazards_raw))
WHERE rn = 1"""
STEPS["we_silver"] = f"""
SELECT *, {_case([(f"regexp_matches(lower(trim(weather_condition)), '{w}')", _text(n)) for w, n in fixed.WEATHER_PATTERNS], "'Other'")} AS weather_category,
       coalesce(temperature_celsius BETWEEN -50 AND 60, false) AS has_valid_temperature,
       coalesce(humidity_percent BETWEEN 0 AND 100, false) AS has_valid_humidity,
       coalesce(precipitation_mm >= 0, false) AS has_valid_precipitation, coalesce(wind_speed_kmh >= 0, false) AS has_valid_wind_speed,
       coalesce(location_lat BETWEEN -37.5 AND -28 AND location_lon BETWEEN 140 AND 154, false) AS has_valid_location,
       coalesce(obs_ts <= {NOW}, false) AS has_valid_timestamp, coalesce(length(station_id) > 0, false) AS has_valid_station
FROM (SELECT *, row_number() OVER (PARTITION BY station_id, obs_ts ORDER BY tie_key) AS rn FROM weather_raw) WHERE rn = 1"""

sql("silver_stations", """SELECT objectid, station_name, station_address, lganame, pcode, operator, charger__type, number_of_plugs,
 round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(kw, 3) AS charger_rating_kw, charging_speed,
 has_valid_location, has_valid_rating FROM st_silver""")
sql("silver_fuel", f"""SELECT stationcode, fuel_type_clean, fuel_category, round(price, 3) AS price_cents,
 {_ts('last_updated_ts')} AS last_updated_ts, has_valid_price, has_valid_station, has_valid_timestamp FROM fu_silver""")
sql("silver_hazards", f"""SELECT event_id, hazard_id, hazard_type_clean, main_category, headline, location, severity, is_active,
 {_ts('start_time_ts')} AS start_time_ts, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
 {", ".join(silver.HAZARD_FLAGS)} FROM hz_silver""")
sql("silver_weather", f"""SELECT station_id, {_ts('obs_ts')} AS obs_ts, weather_category,
 round(temperature_celsius, 8) AS temperature_celsius, humidity_percent, {", ".join(silver.WEATHER_FLAGS)} FROM we_silver""")


def _dq(step, flags, shares=()):
    one = ("SELECT '{0}' AS \"check\", count(*) AS total, count(*) FILTER (WHERE {1}) AS hits, "
           "coalesce(round(count(*) FILTER (WHERE {1}) * 100e0 / nullif(count(*), 0), 2), 0e0) AS pct FROM " + step)
    return _union(*[one.format(f, f"{f} IS NOT TRUE") for f in flags], *[one.format(s, f"{s} IS TRUE") for s in shares])


sql("dq_stations", _dq("st_silver", silver.STATION_FLAGS))
sql("dq_fuel", _dq("fu_silver", silver.FUEL_FLAGS))
sql("dq_hazards", _dq("hz_silver", silver.HAZARD_FLAGS, ["is_active", "is_major"]))
sql("dq_weather", _dq("we_silver", silver.WEATHER_FLAGS))
sql("weather_stats", """SELECT round(min(temperature_celsius), 4) AS min_temp, round(avg(temperature_celsius), 4) AS avg_temp,
 round(max(temperature_celsius), 4) AS max_temp, round(avg(humidity_percent), 4) AS avg_humidity,
 round(avg(wind_speed_kmh), 4) AS avg_wind_speed
 FROM we_silver WHERE has_valid_temperature AND has_valid_humidity AND has_valid_wind_speed""")
sql("fuel_price_stats", """SELECT fuel_category, round(min(price), 3) AS min_price, round(avg(price), 4) AS avg_price,
 round(max(price), 3) AS max_price, count(*) AS record_count FROM fu_silver WHERE has_valid_price GROUP BY 1""")

# --- infrastructure --------------------------------------------------------------------------------------

_SPEEDS = ", ".join(f"count(*) FILTER (WHERE charging_speed = '{s}') AS {c}" for s, c in
                    [("Slow", "slow_chargers"), ("Fast", "fast_chargers"), ("Rapid", "rapid_chargers"),
                     ("Ultra-Rapid", "ultra_rapid_chargers"), ("Unknown", "unknown_speed_chargers")])
_SPEED_COLS = "slow_chargers, fast_chargers, rapid_chargers, ultra_rapid_chargers"
STEPS["reg_ev"] = f"""
SELECT region, count(*) AS ev_station_count, count(*) FILTER (WHERE has_valid_location) AS valid_locations,
       count(*) FILTER (WHERE has_valid_rating) AS valid_ratings,
       coalesce(sum(kw) FILTER (WHERE has_valid_rating), 0e0) AS total_capacity_kw,
       avg(kw) FILTER (WHERE has_valid_rating) AS avg_capacity_kw, max(kw) AS max_capacity_kw, {_SPEEDS}
FROM (SELECT *, {_boxes(fixed.REGION_BOXES, fixed.REGION_DEFAULT)} AS region FROM st_silver) GROUP BY region"""


def _fuel_avg(name):
    return f"avg(price) FILTER (WHERE fuel_category = '{name}' AND has_valid_price)"


def _fuel_n(name):
    return f"count(DISTINCT stationcode) FILTER (WHERE fuel_category = '{name}')"


STEPS["fuel_state"] = f"""
SELECT count(DISTINCT stationcode) AS fuel_station_count_nsw, count(*) FILTER (WHERE has_valid_price) AS valid_prices_nsw,
       {_fuel_avg('Regular Unleaded')} AS avg_regular_unleaded_price, {_fuel_avg('Diesel')} AS avg_diesel_price,
       {_fuel_avg('LPG')} AS avg_lpg_price, {_fuel_n('Regular Unleaded')} AS stations_with_unleaded_nsw,
       {_fuel_n('Diesel')} AS stations_with_diesel_nsw, {_fuel_n('LPG')} AS stations_with_lpg_nsw
FROM fu_silver"""
STEPS["reg_gold"] = """
SELECT r.*, f.*, CAST(trunc(least(100e0, least(40e0, ev_station_count / 5e0)
   + least(30e0, CAST(fast_chargers + rapid_chargers + ultra_rapid_chargers AS DOUBLE) / ev_station_count * 30)
   + least(30e0, total_capacity_kw / 1000 * 30))) AS INTEGER) AS ev_readiness_score
FROM reg_ev r, fuel_state f"""
STEPS["gaps"] = f"""
SELECT *, {_floors('gap_severity_score', fixed.GAP_LEVELS, 'Low')} AS gap_category FROM (
 SELECT *, CAST(trunc(least(100e0, least(40e0, 40 * (1e0 / charger_count))
    + CASE WHEN total_capacity_kw < 500 THEN least(30e0, 30 * (1 - total_capacity_kw / 500)) ELSE 0 END
    + CASE WHEN rapid_chargers + ultra_rapid_chargers = 0 THEN 30 WHEN rapid_chargers + ultra_rapid_chargers < 5 THEN 20 ELSE 10 END
   )) AS INTEGER) AS gap_severity_score
 FROM (SELECT lganame, count(*) AS charger_count, coalesce(sum(kw) FILTER (WHERE has_valid_rating), 0e0) AS total_capacity_kw,
              avg(latitude) AS center_lat, avg(longitude) AS center_lon, {_SPEEDS} FROM st_silver GROUP BY lganame))"""
_PLACES = "(VALUES " + ", ".join(f"('{n}', {a}e0, {b}e0)" for n, a, b in fixed.REFERENCE_PLACES) + ") p(location_name, ref_lat, ref_lon)"
STEPS["nearest"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_name ORDER BY distance_km, objectid) AS rank
 FROM (SELECT *, {_km('ref_lat', 'ref_lon', 'latitude', 'longitude')} AS distance_km FROM st_silver, {_PLACES})
 WHERE distance_km IS NOT NULL) WHERE rank <= 10"""
STEPS["hz_active"] = "SELECT * FROM hz_silver WHERE is_active"
STEPS["hz_pairs"] = f"""
SELECT s.objectid, s.station_name, s.latitude, s.longitude, h.event_id, h.main_category,
       CASE h.severity WHEN 'Major' THEN 3 WHEN 'Moderate' THEN 2 ELSE 1 END AS sev,
       {_km('s.latitude', 's.longitude', 'h.latitude', 'h.longitude')} AS km
FROM st_silver s, hz_active h WHERE {_km('s.latitude', 's.longitude', 'h.latitude', 'h.longitude')} <= 5"""
STEPS["hz_near"] = """
SELECT objectid, station_name, latitude, longitude, count(*) AS nearby_hazards_count,
       string_agg(main_category, ',' ORDER BY main_category) AS hazard_types, max(sev) AS max_hazard_severity
FROM hz_pairs GROUP BY ALL"""


def _smart(join: str) -> str:
    return f"""
SELECT *, {_floors('recommendation_score', fixed.SMART_TIERS, 'Limited')} AS recommendation_tier FROM (
 SELECT *, CAST(trunc({_map('charging_speed', fixed.SPEED_POINTS, 10)} + accessibility_score * 0.6e0) AS INTEGER) AS recommendation_score
 FROM (SELECT *, CAST(least(100, 100 - nearby_hazards_count * 10 - max_hazard_severity * 10) AS INTEGER) AS accessibility_score
  FROM (SELECT s.*, coalesce(h.nearby_hazards_count, 0) AS nearby_hazards_count, h.hazard_types,
               coalesce(h.max_hazard_severity, 0) AS max_hazard_severity
        FROM st_silver s LEFT JOIN hz_near h ON {join})))"""


STEPS["smart_gold"] = _smart("s.objectid = h.objectid AND s.station_name = h.station_name AND s.latitude = h.latitude AND s.longitude = h.longitude")
STEPS["smart_safe"] = _smart("s.objectid = h.objectid")

sql("regional_ev", f"""SELECT region, ev_station_count, valid_locations, valid_ratings, round(total_capacity_kw, 3) AS total_capacity_kw,
 round(avg_capacity_kw, 4) AS avg_capacity_kw, round(max_capacity_kw, 3) AS max_capacity_kw, {_SPEED_COLS}, unknown_speed_chargers FROM reg_ev""")
sql("fuel_statewide", """SELECT fuel_station_count_nsw, valid_prices_nsw, round(avg_regular_unleaded_price, 4) AS avg_regular_unleaded_price,
 round(avg_diesel_price, 4) AS avg_diesel_price, round(avg_lpg_price, 4) AS avg_lpg_price, stations_with_unleaded_nsw,
 stations_with_diesel_nsw, stations_with_lpg_nsw FROM fuel_state""")
sql("regional_infrastructure", f"""SELECT region, ev_station_count, round(total_capacity_kw, 3) AS total_capacity_kw,
 round(coalesce(avg_capacity_kw, 0), 4) AS avg_capacity_kw, {_SPEED_COLS}, fuel_station_count_nsw, round(avg_diesel_price, 4) AS avg_diesel_price,
 ev_readiness_score, '{AS_OF}' AS reporting_date FROM reg_gold""")


def _metric(section, label, value, source, tail=""):
    label = label if label.startswith("=") else _text(label)
    return (f"SELECT '{section}' AS section, {label.lstrip('=')} AS label, "
            f"round(CAST({value} AS DOUBLE), 4) AS value FROM {source}{tail}")


def _top(section, label, value, source, order, n):
    return f"SELECT * FROM ({_metric(section, label, value, source, f' ORDER BY {order} LIMIT {n}')})"


sql("regional_summary", _union(
    _metric("totals", "total_ev", "sum(ev_station_count)", "reg_gold"),
    _metric("totals", "total_capacity_kw", "sum(total_capacity_kw)", "reg_gold"),
    _metric("totals", "total_fuel", "max(fuel_station_count_nsw)", "reg_gold"),
    _metric("totals", "ev_ratio_pct", "round(sum(ev_station_count) * 100e0 / (sum(ev_station_count) + max(fuel_station_count_nsw)), 1)", "reg_gold"),
    _top("top_regions", "=region", "ev_readiness_score", "reg_gold", "ev_readiness_score DESC, region", 5),
    _top("most_ready", "=region", "ev_readiness_score", "reg_gold", "ev_readiness_score DESC, region", 1),
    _top("least_ready", "=region", "ev_readiness_score", "reg_gold", "ev_readiness_score, region", 1)))
_AREAS = "(VALUES " + ", ".join(f"('{n}', {a}e0, {b}e0, {c}e0, {d}e0)" for n, a, b, c, d in fixed.REGION_BOXES) + ") a(name, a1, a2, o1, o2)"
sql("regional_density", f"""SELECT region, ev_station_count, round(ev_station_count * 1000e0 / (6371e0 * 6371e0 * radians(o2 - o1)
 * (sin(radians(a2)) - sin(radians(a1)))), 6) AS stations_per_1000_km2 FROM reg_ev LEFT JOIN {_AREAS} ON region = name""")
sql("ev_fuel_ratio", """SELECT ev_stations, fuel_stations, round(ev_stations * 100e0 / (ev_stations + fuel_stations), 1) AS ev_ratio_pct
 FROM (SELECT count(*) AS ev_stations FROM st_silver), (SELECT count(DISTINCT stationcode) AS fuel_stations FROM fu_silver)""")
sql("nearest_chargers", """SELECT location_name, CAST(rank AS INTEGER) AS rank, station_name, station_address, round(latitude, 6) AS latitude,
 round(longitude, 6) AS longitude, round(distance_km, 2) AS distance_km, operator, charging_speed, has_valid_rating FROM nearest""")
sql("nearest_weather_site", f"""SELECT objectid, site_id, round(km, 4) AS distance_km FROM (
 SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY km, site_id) AS rn FROM (
  SELECT objectid, site_id, {_km('latitude', 'longitude', 'site_lat', 'site_lon')} AS km FROM st_silver,
   (SELECT DISTINCT station_id AS site_id, location_lat AS site_lat, location_lon AS site_lon FROM weather_raw)
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL)) WHERE rn = 1""")
sql("gap_analysis", f"""SELECT lganame, charger_count, round(total_capacity_kw, 3) AS total_capacity_kw, round(center_lat, 6) AS center_lat,
 round(center_lon, 6) AS center_lon, {_SPEED_COLS}, gap_severity_score, gap_category FROM gaps""")
sql("hazard_summary", """SELECT objectid, station_name, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
 nearby_hazards_count, hazard_types, max_hazard_severity FROM hz_near""")
sql("smart_recommendations", """SELECT objectid, station_name, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, charging_speed,
 nearby_hazards_count, hazard_types, max_hazard_severity, accessibility_score, recommendation_score, recommendation_tier FROM smart_gold""")
sql("smart_recommendations_null_safe", """SELECT objectid, nearby_hazards_count, accessibility_score, recommendation_score,
 recommendation_tier FROM smart_safe""")
_TIER = "count(*) FILTER (WHERE recommendation_tier = '{}')"
_GAP = "count(*) FILTER (WHERE gap_category = '{}')"
sql("recommendation_summary", _union(
    _metric("sizes", "nearest_rows", "count(*)", "nearest"),
    _metric("gaps", "areas", "count(*)", "gaps"), _metric("gaps", "critical", _GAP.format("Critical"), "gaps"),
    _metric("gaps", "high", _GAP.format("High"), "gaps"),
    _metric("gaps", "underserved", "count(*) FILTER (WHERE gap_category IN ('Critical', 'High'))", "gaps"),
    _metric("tiers", "stations", "count(*)", "smart_gold"), _metric("tiers", "excellent", _TIER.format("Excellent"), "smart_gold"),
    _metric("tiers", "good", _TIER.format("Good"), "smart_gold"),
    _metric("tiers", "near_hazards", "count(*) FILTER (WHERE nearby_hazards_count > 0)", "smart_gold"),
    _metric("tiers", "recommended", "count(*) FILTER (WHERE recommendation_tier IN ('Excellent', 'Good'))", "smart_gold"),
    _metric("tiers", "recommended_pct", "round(count(*) FILTER (WHERE recommendation_tier IN ('Excellent', 'Good')) * 100e0 / count(*), 1)", "smart_gold"),
    _metric("tiers", "unaffected", "count(*) FILTER (WHERE nearby_hazards_count <= 0)", "smart_gold"),
    _top("worst_gap", "=lganame", "gap_severity_score", "gaps", "gap_severity_score DESC, lganame", 1),
    _top("best_station", "=CAST(objectid AS VARCHAR)", "recommendation_score", "smart_gold", "recommendation_score DESC, objectid", 1)))

_SHOWN = """objectid, coalesce(nullif(station_name, ''), nullif(trim(split_part(station_address, ',', 1)), ''), 'Station ' || objectid) AS name,
 coalesce(nullif(station_address, ''), 'Address not available') AS address, round(distance_km, 2) AS distance_km,
 round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, operator, number_of_plugs, charger__type AS charger_type, charging_speed,
 recommendation_tier, recommendation_score, accessibility_score, nearby_hazards_count AS nearby_hazards,
 coalesce(hazard_types, '') AS hazard_types, pcode AS postcode"""
for _name, _radius, _filter in (("nearby_stations", 30, ""), ("nearby_stations_dc", 60, " AND charger__type = 'DC'")):
    sql(_name, f"""SELECT {_SHOWN} FROM (SELECT *, {_km('-33.8688e0', '151.2093e0', 'latitude', 'longitude')} AS distance_km FROM smart_gold
 WHERE has_valid_location{_filter}) WHERE distance_km <= {_radius} ORDER BY distance_km, objectid LIMIT 10""")
sql("nearby_batch", f"""SELECT probe_id, CAST(rn AS INTEGER) AS rank, objectid, round(km, 2) AS distance_km, recommendation_score FROM (
 SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY km, objectid) AS rn FROM (
  SELECT probe_id, objectid, recommendation_score, {_km('probe_lat', 'probe_lon', 'latitude', 'longitude')} AS km
  FROM smart_gold, (SELECT s_suppkey AS probe_id, -34.3e0 + (s_suppkey * 7919 % 1800) / 1000e0 AS probe_lat,
                           150.4e0 + (s_suppkey * 10007 % 1700) / 1000e0 AS probe_lon FROM supplier)
  WHERE has_valid_location) WHERE km <= 30) WHERE rn <= 10""")


def _bearing(a1, o1, a2, o2):
    return (f"atan2(sin(radians({o2}) - radians({o1})) * cos(radians({a2})), cos(radians({a1})) * sin(radians({a2})) "
            f"- sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2}) - radians({o1})))")


_A, _B = ("-33.8688e0", "151.2093e0"), ("-32.9283e0", "151.7817e0")
sql("corridor", f"""SELECT objectid, round(km, 4) AS route_distance_km FROM (
 SELECT objectid, CASE WHEN along < 0 THEN d * 6371e0 WHEN along > whole THEN {_km(*_B, 'latitude', 'longitude')}
                       ELSE abs(asin(sin(d) * sin(turn))) * 6371e0 END AS km
 FROM (SELECT *, atan2(sin(d) * cos(turn), cos(d)) * 6371e0 AS along FROM (
  SELECT *, {_km(*_A, 'latitude', 'longitude')} / 6371e0 AS d, {_km(*_A, *_B)} AS whole,
         {_bearing(*_A, 'latitude', 'longitude')} - {_bearing(*_A, *_B)} AS turn FROM st_silver))) WHERE km <= 15""")
sql("within_km", "SELECT objectid, event_id, round(km, 4) AS distance_km FROM hz_pairs")
sql("within_box", """SELECT s.objectid, h.event_id FROM st_silver s LEFT JOIN hz_active h
 ON abs(s.latitude - h.latitude) < 0.05e0 AND abs(s.longitude - h.longitude) < 0.05e0""")

# --- traffic -------------------------------------------------------------------------------------------------

_N = "count(*) FILTER (WHERE {})"
_CATS = {c: _N.format(f"main_category = '{v}'") + f" AS {c}" for c, v in fixed.HAZARD_CATEGORIES.items()}
_SEV = {s: _N.format(f"severity = '{s}'") + f" AS {s.lower()}_hazards" for s in ("Major", "Moderate", "Minor")}
_DAYS = {i + 1: n for i, n in enumerate(fixed.DAY_NAMES)}
STEPS["hourly"] = f"""
SELECT *, {_floors('congestion_score', fixed.CONGESTION_LEVELS, 'Minimal')} AS congestion_level,
       hour_of_day IN (7, 8, 9, 17, 18, 19) AS is_peak_hour
FROM (SELECT *, CAST(least(100, least(50, total_hazards * 2) + major_hazards * 10 + least(20, active_hazards)) AS INTEGER) AS congestion_score
 FROM (SELECT hour_of_day, day_of_week, {_map('day_of_week', _DAYS, 'Unknown')} AS day_name, count(*) AS total_hazards,
        {", ".join(_SEV.values())}, {", ".join(_CATS.values())}, {_N.format('is_active')} AS active_hazards
  FROM (SELECT *, CAST(hour(start_time_ts) AS INTEGER) AS hour_of_day, CAST(dayofweek(start_time_ts) + 1 AS INTEGER) AS day_of_week
        FROM hz_silver WHERE start_time_ts IS NOT NULL) GROUP BY hour_of_day, day_of_week))"""
STEPS["loc_risk"] = f"""
SELECT *, {_floors('risk_score', fixed.RISK_LEVELS, 'Low Risk')} AS risk_level,
       CASE WHEN roadwork_count >= incident_count AND roadwork_count >= flood_count THEN 'Roadwork'
            WHEN incident_count >= roadwork_count AND incident_count >= flood_count THEN 'Incidents'
            WHEN flood_count > 0 THEN 'Flooding' ELSE 'Mixed' END AS dominant_hazard_type
FROM (SELECT *, CAST(trunc(least(100e0, least(40e0, total_hazards / 2e0) + major_hazards * 10 + least(30, active_hazards * 2))) AS INTEGER) AS risk_score
 FROM (SELECT location, count(*) AS total_hazards, {_N.format('is_active')} AS active_hazards, {_SEV['Major']}, avg(latitude) AS center_lat,
        avg(longitude) AS center_lon, {_CATS['roadwork_count']}, {_CATS['incident_count']}, {_CATS['flood_count']},
        min(start_time_ts) AS earliest_hazard, max(start_time_ts) AS latest_hazard
  FROM hz_silver WHERE location IS NOT NULL GROUP BY location))"""
STEPS["hour_recs"] = f"""
SELECT *, CASE WHEN avg_score < 20 THEN 'Excellent' WHEN avg_score < 40 THEN 'Good' WHEN avg_score < 60 THEN 'Fair' ELSE 'Poor' END AS recommendation_category,
       {_spans('hour_of_day', fixed.HOUR_PERIODS, 'Night')} AS time_period
FROM (SELECT hour_of_day, avg(congestion_score) AS avg_score, avg(total_hazards) AS avg_hazards,
        CAST(sum(total_hazards) AS BIGINT) AS total_hazards_all_days, max(congestion_score) AS max_congestion_score FROM hourly GROUP BY hour_of_day)"""
STEPS["day_profile"] = """
SELECT CASE WHEN day_of_week IN (1, 7) THEN 'Weekend' ELSE 'Weekday' END AS day_type, hour_of_day, avg(total_hazards) AS avg_hazards,
       avg(congestion_score) AS avg_congestion, CAST(sum(total_hazards) AS BIGINT) AS total_hazards FROM hourly GROUP BY 1, 2"""

sql("congestion_hourly", """SELECT hour_of_day, day_of_week, day_name, total_hazards, major_hazards, moderate_hazards, minor_hazards,
 roadwork_count, incident_count, flood_count, event_count, active_hazards, congestion_score, congestion_level, is_peak_hour FROM hourly""")
sql("congestion_location", f"""SELECT location, total_hazards, active_hazards, major_hazards, round(center_lat, 6) AS center_lat,
 round(center_lon, 6) AS center_lon, roadwork_count, incident_count, flood_count, {_ts('earliest_hazard')} AS earliest_hazard,
 {_ts('latest_hazard')} AS latest_hazard, risk_score, risk_level, dominant_hazard_type FROM loc_risk""")
sql("congestion_recommendations", f"""SELECT hour_of_day, round(avg_score, 4) AS avg_congestion_score, round(avg_hazards, 4) AS avg_hazards,
 total_hazards_all_days, max_congestion_score, recommendation_category, time_period,
 {_map('recommendation_category', fixed.CHARGE_ADVICE, fixed.CHARGE_ADVICE_DEFAULT)} AS charging_recommendation,
 {_floors('avg_score', fixed.TRAVEL_ADVICE, fixed.TRAVEL_ADVICE_DEFAULT)} AS travel_recommendation FROM hour_recs""")
sql("weekday_weekend", """SELECT day_type, hour_of_day, round(avg_hazards, 4) AS avg_hazards, round(avg_congestion, 4) AS avg_congestion,
 total_hazards FROM day_profile""")
sql("day_type_peaks", """SELECT day_type, hour_of_day AS peak_hour, round(avg_hazards, 4) AS avg_hazards, round(avg_congestion, 4) AS avg_congestion
 FROM (SELECT *, row_number() OVER (PARTITION BY day_type ORDER BY avg_congestion DESC, hour_of_day) AS rn FROM day_profile) WHERE rn = 1""")
_SLOT = "=day_name || ' ' || hour_of_day"
sql("congestion_summary", _union(
    _metric("periods", "periods", "count(*)", "hourly"),
    _metric("periods", "critical_periods", _N.format("congestion_level = 'Critical'"), "hourly"),
    _metric("periods", "critical_pct", "round(count(*) FILTER (WHERE congestion_level = 'Critical') * 100e0 / count(*), 1)", "hourly"),
    _metric("level_count", "=congestion_level", "count(*)", "hourly", " GROUP BY congestion_level"),
    _metric("level_pct", "=congestion_level", "round(count(*) * 100e0 / (SELECT count(*) FROM hourly), 1)", "hourly", " GROUP BY congestion_level"),
    _metric("peak_share", "peak_hazards", "coalesce(sum(total_hazards) FILTER (WHERE is_peak_hour), 0)", "hourly"),
    _metric("peak_share", "off_peak_hazards", "coalesce(sum(total_hazards) FILTER (WHERE NOT is_peak_hour), 0)", "hourly"),
    _metric("peak_share", "peak_pct", "round(sum(total_hazards) FILTER (WHERE is_peak_hour) * 100e0 / sum(total_hazards), 1)", "hourly"),
    _metric("peak_share", "off_peak_pct", "round(sum(total_hazards) FILTER (WHERE NOT is_peak_hour) * 100e0 / sum(total_hazards), 1)", "hourly"),
    _metric("risk", "locations", "count(*)", "loc_risk"),
    _metric("risk", "high_risk", _N.format("risk_level = 'High Risk'"), "loc_risk"),
    _metric("risk", "moderate_risk", _N.format("risk_level = 'Moderate Risk'"), "loc_risk"),
    _metric("advice", "hours", "count(*)", "hour_recs"),
    _metric("advice", "excellent_hours", _N.format("recommendation_category = 'Excellent'"), "hour_recs"),
    _top("worst_time", _SLOT, "congestion_score", "hourly", "congestion_score DESC, day_of_week, hourly.hour_of_day", 3),
    _top("best_hour", "=CAST(hour_of_day AS VARCHAR)", "round(avg_score, 1)", "hour_recs", "avg_score, hour_of_day", 3),
    _top("riskiest_location", "=location", "risk_score", "loc_risk", "risk_score DESC, location", 1)))

# --- trips ------------------------------------------------------------------------------------------------------

STEPS["route_gold"] = f"""
SELECT *, active_hazards * {_map('route_safety_rating', fixed.DELAY_MINUTES, 1)} AS estimated_delay_minutes
FROM (SELECT *, {_floors('route_risk_score', fixed.ROUTE_RATINGS, fixed.ROUTE_RATING_DEFAULT)} AS route_safety_rating,
  CASE WHEN flood_count > 0 THEN 'Flooding - Road Closures Likely'
       WHEN roadwork_count >= incident_count AND roadwork_count >= event_count THEN 'Roadwork - Expect Delays'
       WHEN incident_count >= roadwork_count AND incident_count >= event_count THEN 'Traffic Incidents'
       WHEN event_count > 0 THEN 'Special Event - Heavy Traffic' ELSE 'Mixed Hazards' END AS primary_hazard_type
 FROM (SELECT *, CAST(trunc(least(100e0, least(30e0, total_hazards * 0.5e0) + major_hazards * 12 + least(25e0, active_hazards * 1.5e0)
                                  + flood_count * 10)) AS INTEGER) AS route_risk_score
  FROM (SELECT location, count(*) AS total_hazards, {_N.format('is_active')} AS active_hazards, {_SEV['Major']}, {_SEV['Moderate']},
         avg(latitude) AS center_lat, avg(longitude) AS center_lon, {", ".join(_CATS.values())},
         min(start_time_ts) AS earliest_hazard_time, max(end_time_ts) AS latest_hazard_time
   FROM hz_silver WHERE has_valid_location AND location IS NOT NULL GROUP BY location)))"""
_LENGTHS = "(VALUES " + ", ".join(f"(CAST({d} AS BIGINT))" for d in fixed.TRIP_DISTANCES_KM) + ") v(trip_distance_km)"
STEPS["charge_gold"] = f"""
SELECT *, base_driving_time_hours + charging_time_hours AS total_trip_time_hours,
       CASE WHEN charging_stops_needed > 0 THEN 'Fast Charger (50+ kW)' ELSE 'Any Charger' END AS recommended_charger_type,
       CASE WHEN trip_distance_km <= 350 THEN 'Easy - No charging needed' WHEN charging_stops_needed <= 1 THEN 'Moderate - One charging stop'
            WHEN charging_stops_needed <= 3 THEN 'Complex - Multiple stops needed' ELSE 'Challenging - Plan carefully' END AS trip_feasibility,
       {_floors('fast_charger_stations', fixed.NETWORK_LEVELS, 'Limited')} AS charger_availability_score
FROM (SELECT *, trip_distance_km / 60e0 AS base_driving_time_hours, charging_stops_needed * 0.5e0 AS charging_time_hours
 FROM (SELECT trip_distance_km, CAST(greatest(0, ceil((trip_distance_km - 350 + 50) / 300e0)) AS BIGINT) AS charging_stops_needed,
        CAST(CASE WHEN trip_distance_km <= 350 THEN ceil((trip_distance_km + 50) / 350e0 * 100) ELSE 100 END AS BIGINT) AS minimum_starting_battery_pct
       FROM {_LENGTHS})),
     (SELECT count(*) AS total_stations, CAST(sum(number_of_plugs) AS BIGINT) AS total_plugs,
             {_N.format("charging_speed = 'Fast'")} AS fast_charger_stations FROM st_silver)"""
STEPS["windows"] = f"""
SELECT *, CAST(row_number() OVER (ORDER BY trip_suitability_score DESC, hour_of_day, day_name) AS INTEGER) AS priority_rank
FROM (SELECT *, {_floors('trip_suitability_score', fixed.WINDOW_CATEGORIES, 'Avoid')} AS trip_window_category,
             {_spans('hour_of_day', fixed.TRIP_PERIODS, 'Night')} AS time_period,
             CASE WHEN hour_of_day BETWEEN 0 AND 6 THEN '24/7 stations only' ELSE 'All stations available' END AS charging_availability,
             CAST({_map('congestion_level', fixed.DELAY_FACTORS, 1.0)} AS DOUBLE) AS congestion_delay_factor
 FROM (SELECT DISTINCT hour_of_day, day_name, congestion_score, congestion_level, total_hazards, active_hazards, is_peak_hour,
              CAST(greatest(0, 100 - congestion_score) AS INTEGER) AS trip_suitability_score FROM hourly))"""

sql("trip_routes", f"""SELECT location, total_hazards, active_hazards, major_hazards, moderate_hazards, round(center_lat, 6) AS center_lat,
 round(center_lon, 6) AS center_lon, roadwork_count, incident_count, flood_count, event_count, {_ts('earliest_hazard_time')} AS earliest_hazard_time,
 {_ts('latest_hazard_time')} AS latest_hazard_time, route_risk_score, route_safety_rating, primary_hazard_type, estimated_delay_minutes FROM route_gold""")
sql("charging_requirements", """SELECT trip_distance_km, charging_stops_needed, round(base_driving_time_hours, 6) AS base_driving_time_hours,
 round(charging_time_hours, 2) AS charging_time_hours, round(total_trip_time_hours, 6) AS total_trip_time_hours, recommended_charger_type,
 minimum_starting_battery_pct, trip_feasibility, total_stations, total_plugs, fast_charger_stations, charger_availability_score FROM charge_gold""")
sql("trip_recommendations", f"""SELECT hour_of_day, day_name, congestion_score, trip_suitability_score, trip_window_category, time_period,
 {_map('trip_window_category', fixed.TRIP_ADVICE, fixed.TRIP_ADVICE_DEFAULT)} AS trip_advice, charging_availability,
 round(congestion_delay_factor, 2) AS congestion_delay_factor, priority_rank FROM windows""")
sql("trip_summary", _union(
    _metric("routes", "routes", "count(*)", "route_gold"),
    _metric("routes", "high_risk_routes", _N.format("contains(route_safety_rating, 'High Risk')"), "route_gold"),
    _metric("charging", "profiles", "count(*)", "charge_gold"),
    _metric("charging", "avg_stops", "round(avg(charging_stops_needed), 1)", "charge_gold"),
    _metric("charging", "max_distance_km", "max(trip_distance_km)", "charge_gold"),
    _metric("windows", "windows", "count(*)", "windows"),
    _metric("windows", "optimal_windows", _N.format("trip_window_category = 'Optimal'"), "windows"),
    _metric("windows", "optimal_pct", "round(count(*) FILTER (WHERE trip_window_category = 'Optimal') * 100e0 / count(*), 1)", "windows"),
    _metric("windows", "avg_delay_factor", "round(avg(congestion_delay_factor), 2)", "windows"),
    _top("safest_route", "=location", "route_risk_score", "route_gold", "route_risk_score, location", 1),
    _top("riskiest_route", "=location", "route_risk_score", "route_gold", "route_risk_score DESC, location", 1),
    _top("riskiest_route_delay", "=location", "estimated_delay_minutes", "route_gold", "route_risk_score DESC, location", 1),
    _top("best_window", _SLOT, "trip_suitability_score", "windows", "trip_suitability_score DESC, hour_of_day, day_name", 3),
    _top("worst_window", _SLOT, "trip_suitability_score", "windows", "trip_suitability_score, hour_of_day, day_name", 3)))

# --- feed variant ---------------------------------------------------------------------------------------------------

STEPS["fs_clean"] = """
SELECT DISTINCT StationID AS station_id, OperatorName AS operator_name, AddressLine1 AS address_line1, Suburb AS suburb, State AS state,
       Postcode AS postcode, Latitude AS latitude, Longitude AS longitude, NumberOfPlugs AS number_of_plugs, ChargerType AS charger_type,
       ChargingPowerKW AS charging_power_kw,
       CASE WHEN ChargingPowerKW >= 150 THEN 'Ultra-Rapid' WHEN ChargingPowerKW >= 22 THEN 'Rapid' WHEN ChargingPowerKW >= 7 THEN 'Fast'
            WHEN ChargingPowerKW > 0 THEN 'Slow' ELSE 'Unknown' END AS charging_speed,
       true AS has_valid_location, ChargingPowerKW IS NOT NULL AS has_valid_rating
FROM stations_landing WHERE StationID IS NOT NULL AND Latitude BETWEEN -90 AND 90 AND Longitude BETWEEN -180 AND 180"""
STEPS["fh_clean"] = f"""
SELECT *, strptime(created, '%d/%m/%Y %H:%M:%S') AS created_timestamp,
       CASE WHEN isMajor THEN 'Major' WHEN isImpactNetwork THEN 'Moderate' ELSE 'Minor' END AS severity, true AS is_active,
       coalesce(hazard_id, sha256(headline || location)) AS composite_key
FROM hazards_landing WHERE (hazard_id IS NOT NULL OR (headline IS NOT NULL AND location IS NOT NULL))
  AND (end_text IS NULL OR try_strptime(end_text, '%d/%m/%Y %H:%M:%S') > {NOW})"""
_FS = """SELECT station_id, operator_name, address_line1, suburb, state, postcode, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
 number_of_plugs, charger_type, round(charging_power_kw, 3) AS charging_power_kw, charging_speed, has_valid_location, has_valid_rating FROM fs_clean"""
_FH = f"""SELECT hazard_id, headline, location, {_ts('created_timestamp')} AS created_timestamp, severity, is_active, composite_key,
 round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM fh_clean"""
_LIKE = lambda col, patterns: _case([(f"{col} LIKE '{p}'", _text(n)) for p, n in patterns], "'Other'")
_FW = f"""SELECT station_id, weather, {_LIKE('weather', fixed.FEED_WEATHER_PATTERNS)} AS weather_category, round(temperature_c, 8) AS temperature_c,
 round(humidity_percent, 2) AS humidity_percent, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude FROM weather_landing
 WHERE temperature_c BETWEEN -50 AND 60 AND humidity_percent BETWEEN 0 AND 100 AND latitude BETWEEN -37.5 AND -28 AND longitude BETWEEN 140 AND 154"""
_FF = f"""FROM (SELECT *, {_LIKE('fueltype', fixed.FEED_FUEL_PATTERNS)} AS fuel_category FROM fuel_raw) WHERE price BETWEEN 0 AND 500 AND fueltype IS NOT NULL"""
sql("feed_stations", _FS)
sql("feed_hazards", _FH)
sql("feed_fuel", f"""SELECT stationcode, fueltype AS fuel_type, round(price, 3) AS price, fuel_category, tie_key, {_ts('last_updated_ts')} AS last_updated_ts {_FF}""")
sql("feed_weather", _FW)
sql("feed_regional", f"""SELECT region, count(DISTINCT station_id) AS total_stations, CAST(sum(number_of_plugs) AS BIGINT) AS total_plugs,
 round(sum(charging_power_kw), 2) AS total_capacity_kw, round(avg(charging_power_kw), 2) AS avg_capacity_kw,
 count(DISTINCT station_id) FILTER (WHERE charging_speed IN ('Rapid', 'Ultra-Rapid')) AS fast_charger_count,
 round(count(DISTINCT station_id) * 0.4e0 + count(DISTINCT station_id) FILTER (WHERE charging_speed IN ('Rapid', 'Ultra-Rapid')) * 0.3e0
       + sum(charging_power_kw) / 1000 * 0.3e0, 0) AS ev_readiness_score
 FROM (SELECT *, {_boxes(fixed.FEED_REGION_BOXES, fixed.FEED_REGION_DEFAULT)} AS region FROM fs_clean) GROUP BY region""")
sql("feed_smart", f"""SELECT station_id, charging_speed, charger_quality_score, nearby_hazards, accessibility_score,
 round(charger_quality_score * 0.4e0 + accessibility_score * 0.6e0, 2) AS recommendation_score,
 {_floors('round(charger_quality_score * 0.4e0 + accessibility_score * 0.6e0, 2)', fixed.FEED_SMART_TIERS, fixed.FEED_SMART_DEFAULT)} AS recommendation_tier
 FROM (SELECT *, CASE WHEN nearby_hazards = 0 THEN 100 WHEN nearby_hazards <= 2 THEN 80 WHEN nearby_hazards <= 5 THEN 60 ELSE 40 END AS accessibility_score
  FROM (SELECT s.station_id, s.charging_speed, {_map('s.charging_speed', fixed.FEED_SPEED_POINTS, 20)} AS charger_quality_score,
               count(DISTINCT h.composite_key) AS nearby_hazards
        FROM fs_clean s LEFT JOIN fh_clean h ON abs(s.latitude - h.latitude) < 0.05e0 AND abs(s.longitude - h.longitude) < 0.05e0
        GROUP BY 1, 2, 3))""")

# --- documents and retrieval -----------------------------------------------------------------------------------------

sql("station_documents", f"""SELECT 'ev_station_' || objectid AS doc_id, 'Electric Vehicle Charging Station: ' || coalesce(station_name, 'Unnamed Station')
 || '. Location: ' || coalesce(station_address, 'Address not available') || ', ' || lganame || ' (Postcode: ' || pcode || '). Operator: ' || operator
 || '. Charging Type: ' || charger__type || ' with ' || number_of_plugs || ' plugs. Charging Speed: ' || charging_speed
 || ' (' || coalesce(CAST(CAST(kw AS DOUBLE) AS VARCHAR), 'N/A') || ' kW). Coordinates: Latitude ' || CAST(round(latitude, 6) AS VARCHAR) || ', Longitude '
 || CAST(round(longitude, 6) AS VARCHAR) || '.' AS content, 'silver.ev_charging_stations' AS source_table, objectid, station_name, operator, lganame, pcode,
 round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(kw, 3) AS charger_rating_kw, charging_speed FROM st_silver WHERE has_valid_location AND objectid IS NOT NULL""")
sql("route_documents", f"""SELECT 'route_' || replace(location, ' ', '_') AS doc_id, 'Route Safety Report for ' || location || '. Overall Safety Rating: '
 || route_safety_rating || ' with a risk score of ' || route_risk_score || '. Total Hazards: ' || total_hazards || ' (' || active_hazards
 || ' currently active). Hazard Breakdown: ' || roadwork_count || ' roadwork sites, ' || incident_count || ' incidents, ' || flood_count
 || ' flood warnings, ' || event_count || ' events. Primary Hazard Type: ' || primary_hazard_type || '. Estimated Delay: ' || estimated_delay_minutes
 || ' minutes. Location Center: Latitude ' || CAST(round(center_lat, 6) AS VARCHAR) || ', Longitude ' || CAST(round(center_lon, 6) AS VARCHAR) || '.' AS content,
 'gold.trip_routes_optimal' AS source_table, location, route_safety_rating, route_risk_score, total_hazards, active_hazards, primary_hazard_type,
 estimated_delay_minutes, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon FROM route_gold WHERE total_hazards > 0""")
sql("doc_stats", """SELECT source AS source_table, count(*) AS document_count, round(avg(length(text)), 4) AS avg_content_length FROM documents GROUP BY source""")
sql("doc_preview", "SELECT doc_id, substring(text, 1, 200) AS content_preview, source AS source_table FROM documents ORDER BY doc_id LIMIT 5")
sql("built_document_keys", """SELECT doc_id, count(*) AS row_count FROM (SELECT 'ev_station_' || objectid AS doc_id FROM st_silver WHERE has_valid_location
 UNION ALL SELECT 'route_' || replace(location, ' ', '_') FROM route_gold, range(2) WHERE total_hazards > 0) GROUP BY doc_id HAVING count(*) > 1""")
STEPS["centres"] = """
SELECT label AS query_id, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM
 (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"""


def _hits(where=""):
    return f"""
SELECT query_id, vec_id, score, CAST(rn AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM (
  SELECT query_id, vec_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM centres, embeddings{where})) WHERE rn <= 5"""


STEPS["label_hits"] = _hits()
sql("vector_top_k_labels", "SELECT * FROM label_hits")
sql("vector_top_k_partitioned", "SELECT * FROM label_hits")
sql("vector_top_k_near_copies", """
SELECT query_id, vec_id, score, CAST(rn AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM (
  SELECT q.vec_id AS query_id, t.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], t.v), 6) AS score FROM embeddings q,
   (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    UNION ALL SELECT -1 - vec_id, list_concat([embedding[1]::DOUBLE + 5e-4], embedding[2:]::DOUBLE[]) FROM embeddings) t
  WHERE q.vec_id % 50 = 0)) WHERE rn <= 5""")
sql("vector_top_k_filtered", _hits(" WHERE label = 3"))
_words = "SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {table}"
sql("text_retrieval", f"""
WITH doc_words AS (SELECT k, term, count(*) AS n FROM ({_words.format(key="doc_id", text="text", table="documents")}) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM documents WHERE text IS NOT NULL) + 1.0e0) / (count(*) + 1.0e0)) AS idf FROM doc_words GROUP BY term),
doc_weights AS (SELECT k, term, n * idf AS w FROM doc_words JOIN idf USING (term) WHERE idf > 0),
doc_units AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM doc_weights),
turn_words AS (
  SELECT k, term, count(*) AS n FROM ({_words.format(key="concat_ws('-', conv_id, turn)", text="text", table="conversations")}) GROUP BY ALL),
turn_weights AS (SELECT k, term, n * idf AS w FROM turn_words JOIN idf USING (term) WHERE idf > 0),
turn_units AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM turn_weights),
scores AS (SELECT q.k AS question_id, d.k AS doc_id, round(sum(q.w * d.w), 6) AS score FROM turn_units q JOIN doc_units d USING (term) GROUP BY ALL)
SELECT question_id, doc_id, score, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rn FROM scores WHERE score > 0) WHERE rn <= 5""")
STEPS["doc_hits"] = "SELECT h.*, d.text AS content FROM label_hits h JOIN documents d ON d.doc_id = h.vec_id"
sql("prompts", """SELECT q.question_id, question, CASE WHEN context IS NULL
  THEN 'No passage on chargers or roads matches what was asked: ' || question
  ELSE 'Passages on chargers and roads, best match first:' || chr(10) || chr(10) || context || chr(10) || chr(10)
    || 'Answer from these passages alone, and say so where they do not tell.' || chr(10) || 'Asked: ' || question || chr(10) || 'Reply:' END AS prompt
 FROM (SELECT n_nationkey AS question_id, 'What is known about ' || n_name || '?' AS question FROM nation) q
 LEFT JOIN (SELECT query_id, string_agg('Document ' || rank || ' (Score: ' || printf('%.3f', round(score, 3)) || '):' || chr(10) || content,
                                        chr(10) || chr(10) ORDER BY rank) AS context FROM doc_hits GROUP BY query_id) h
 ON h.query_id = q.question_id""")
sql("citations", """SELECT query_id AS question_id, rank, vec_id AS id, round(score, 6) AS score, substring(content, 1, 200) || '...' AS preview
 FROM doc_hits WHERE rank <= 3""")

# --- reports -----------------------------------------------------------------------------------------------------------

sql("hazard_type_distribution", "SELECT hazard_type_clean, count(*) AS row_count FROM hz_silver GROUP BY 1")
sql("histogram", """SELECT CAST(bin AS INTEGER) AS bin, round(min(lo + (hi - lo) / 10 * (bin - 1)), 4) AS lower_edge, count(*) AS row_count FROM (
 SELECT lo, hi, least(10, coalesce(floor((v - lo) / nullif((hi - lo) / 10, 0)) + 1, 1)) AS bin
 FROM (SELECT CAST(recommendation_score AS DOUBLE) AS v FROM smart_gold),
      (SELECT CAST(min(recommendation_score) AS DOUBLE) AS lo, CAST(max(recommendation_score) AS DOUBLE) AS hi FROM smart_gold)) GROUP BY bin""")
sql("top_operators", """SELECT operator, count(*) AS station_count, round(avg(recommendation_score), 4) AS avg_score FROM smart_gold
 GROUP BY operator ORDER BY avg(recommendation_score) DESC, operator LIMIT 10""")
sql("congestion_heatmap", "SELECT hour_of_day, " + ", ".join(
    f"CAST(max(congestion_score) FILTER (WHERE day_name = '{n}') AS DOUBLE) AS \"{n}\"" for n in fixed.DAY_NAMES) + " FROM hourly GROUP BY hour_of_day")
sql("peak_comparison", """SELECT is_peak_hour, count(*) AS periods, round(avg(congestion_score), 4) AS avg_score, round(avg(total_hazards), 4) AS avg_hazards,
 CAST(sum(total_hazards) AS BIGINT) AS total_hazards FROM hourly GROUP BY is_peak_hour""")
sql("delay_by_rating", """SELECT route_safety_rating, count(*) AS locations, round(avg(estimated_delay_minutes), 4) AS avg_delay,
 max(estimated_delay_minutes) AS max_delay FROM route_gold GROUP BY 1""")
sql("hazard_type_totals", _union(*[f"SELECT '{v}' AS hazard_type, CAST(sum({c}) AS BIGINT) AS total FROM route_gold" for c, v in fixed.HAZARD_CATEGORIES.items()]))
sql("needs_by_band", """SELECT CASE WHEN trip_distance_km <= 100 THEN '0-100 km' WHEN trip_distance_km <= 200 THEN '101-200 km'
 WHEN trip_distance_km <= 300 THEN '201-300 km' WHEN trip_distance_km <= 400 THEN '301-400 km' ELSE 'Over 400 km' END AS distance_band,
 count(*) AS trips, round(avg(charging_stops_needed), 4) AS avg_stops, round(avg(base_driving_time_hours), 4) AS avg_driving_hours,
 round(avg(charging_time_hours), 4) AS avg_charging_hours FROM charge_gold GROUP BY 1""")
sql("charger_mix", _union(*[f"SELECT region, '{s}' AS charging_speed, {c} AS chargers FROM reg_ev" for c, s in
                            [("slow_chargers", "Slow"), ("fast_chargers", "Fast"), ("rapid_chargers", "Rapid"), ("ultra_rapid_chargers", "Ultra-Rapid")]]))
sql("hourly_trend", "SELECT hour_of_day, round(avg(congestion_score), 4) AS avg_score FROM hourly GROUP BY hour_of_day")
sql("advice_distribution", "SELECT time_period, recommendation_category, count(*) AS hours FROM hour_recs GROUP BY 1, 2")

# --- quality and comparison ------------------------------------------------------------------------------------------------

_RULES = {"valid_latitude": "Latitude BETWEEN -90 AND 90", "valid_longitude": "Longitude BETWEEN -180 AND 180",
          "valid_station_id": "StationID IS NOT NULL"}
sql("expectations", _union(*[f"SELECT '{n}' AS rule, count(*) FILTER (WHERE ({r}) IS TRUE) AS passed, count(*) FILTER (WHERE ({r}) IS NOT TRUE) AS dropped FROM stations_landing"
                             for n, r in _RULES.items()]))
sql("expect_or_drop", "SELECT StationID AS station_id, AddressLine1 AS address_line1 FROM stations_landing WHERE " + " AND ".join(_RULES.values()))
sql("quarantine", "SELECT address_line1, failed_rules FROM (SELECT AddressLine1 AS address_line1, concat_ws(',', " + ", ".join(
    f"CASE WHEN ({r}) IS NOT TRUE THEN '{n}' END" for n, r in _RULES.items()) + ") AS failed_rules FROM stations_landing) WHERE failed_rules <> ''")
sql("flagged_sample", """SELECT objectid, has_valid_location, has_valid_rating FROM st_silver WHERE NOT has_valid_location OR NOT has_valid_rating
 ORDER BY objectid LIMIT 10""")
sql("parity_report", """SELECT 'row_count_drift' AS "check", round(abs(b.n - a.n) / CAST(a.n AS DOUBLE), 6) AS value, abs(b.n - a.n) <= 0.05e0 * a.n AS passed
 FROM (SELECT count(*) AS n FROM st_silver) a, (SELECT count(*) AS n FROM fs_clean) b
 UNION ALL SELECT 'same_schema', 1e0, true
 UNION ALL SELECT 'pass_rate', round(avg(CASE WHEN latitude BETWEEN -37.5 AND -28 THEN 1e0 ELSE 0e0 END), 6),
  avg(CASE WHEN latitude BETWEEN -37.5 AND -28 THEN 1e0 ELSE 0e0 END) > 0.95e0 FROM fs_clean""")
sql("parity_counts", "SELECT 'batch' AS source, count(*) AS row_count FROM st_silver UNION ALL SELECT 'feed', count(*) FROM fs_clean")
STEPS["gold_counts"] = _union(*[f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {s}" for n, s in [
    ("gold_regional", "reg_ev"), ("gold_nearest", "nearest"), ("gold_gaps", "gaps"), ("gold_smart", "smart_gold"), ("gold_hourly", "hourly"),
    ("gold_location", "loc_risk"), ("gold_hours", "hour_recs"), ("gold_routes", "route_gold"), ("gold_charging", "charge_gold"),
    ("gold_windows", "windows")]])
sql("table_counts", """SELECT * FROM gold_counts UNION ALL SELECT 'gold_absent', CAST(NULL AS BIGINT)
 UNION ALL SELECT 'total', CAST(sum(row_count) AS BIGINT) FROM gold_counts""")
sql("changes_since", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'insert' WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'update' END AS change_type
 FROM orders WHERE o_orderstatus IN ('P', 'F') OR o_orderpriority = '1-URGENT'""")

# --- primitives ---------------------------------------------------------------------------------------------------------------

sql("haversine", f"SELECT objectid, round({_km('-33.8688e0', '151.2093e0', 'latitude', 'longitude')}, 4) AS distance_km FROM st_silver")
SQL["haversine"] = SQL["haversine"].replace("least(1e0, ", "(")
sql("parse_kw", "SELECT objectid, charger_rating, round(TRY_CAST(regexp_extract(charger_rating, '(\\d+\\.?\\d*)', 1) AS DOUBLE), 3) AS kw FROM stations_raw")
sql("temporal_features", f"""SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week,
 {_map('dayofweek(ts) + 1', _DAYS, 'Unknown')} AS day_name FROM events""")
sql("composite_key", "SELECT coalesce(hazard_id, sha256(headline || location)) AS k, count(*) AS row_count FROM hazards_landing GROUP BY 1")
sql("keep_latest", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rn
 FROM events) WHERE rn = 1""")
sql("global_rank", "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, row_number() OVER (ORDER BY customer.c_acctbal DESC, c_custkey) AS rank FROM customer")
sql("stats", """SELECT o_orderstatus, round(min(o_totalprice), 2) AS min_o_totalprice, round(avg(o_totalprice), 2) AS avg_o_totalprice,
 round(max(o_totalprice), 2) AS max_o_totalprice, count(*) AS record_count FROM orders GROUP BY 1""")
sql("with_pct", "SELECT event_type, count(*) AS n, round(count(*) * 100e0 / (SELECT count(*) FROM events), 1) AS pct FROM events GROUP BY 1")
sql("share_by", """SELECT t AS sum_true, a - t AS sum_false, round(t * 100e0 / a, 1) AS pct_true, round((a - t) * 100e0 / a, 1) AS pct_false FROM
 (SELECT CAST(sum(total_hazards) AS BIGINT) AS a, CAST(coalesce(sum(total_hazards) FILTER (WHERE is_peak_hour), 0) AS BIGINT) AS t FROM hourly)""")
sql("top_n", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 10")
sql("assign_region", f"SELECT objectid, {_boxes(fixed.REGION_BOXES, fixed.REGION_DEFAULT)} AS region FROM st_silver")
sql("display_name", """SELECT objectid, coalesce(nullif(station_name, ''), nullif(trim(split_part(station_address, ',', 1)), ''), 'Station ' || objectid) AS name
 FROM st_silver""")
sql("attach_scalars", """SELECT n_nationkey, n_name, customers, round(top_balance, 2) AS top_balance FROM nation,
 (SELECT count(*) AS customers, max(c_acctbal) AS top_balance FROM customer)""")

# --- files and streams -----------------------------------------------------------------------------------------------------------

sql("read_csv_raw", """SELECT objectid, station_name, station_address, charger__type, round(kw, 3) AS charger_rating_kw, charging_speed,
 round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM st_silver""")
sql("unwrap_envelope", "SELECT stationcode, fueltype, round(price, 3) AS price FROM fuel_raw")
sql("unwrap_envelope_mixed", """SELECT stationcode, CASE WHEN tie_key % 5 <> 1 THEN fueltype END AS fueltype, round(price, 3) AS price,
 CASE WHEN tie_key % 5 = 1 THEN fueltype END AS note, CAST(NULL AS VARCHAR) AS code
 FROM fuel_raw, range(2) t(i) WHERE tie_key % 5 <> 3 AND (i = 0 OR tie_key % 5 = 4)""")
sql("flatten_geojson", """SELECT hazard_id, lower(main_category) AS hazard_type, headline, location,
 strftime(date_trunc('second', start_time_ts), '%Y-%m-%dT%H:%M:%SZ') AS start_time, strftime(date_trunc('second', end_time_ts), '%Y-%m-%dT%H:%M:%SZ') AS end_time,
 is_major, impact, main_category, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, '' AS description FROM hazards_raw""")
sql("flatten_weather", f"""SELECT station_id, 'Site ' || station_id AS station_name, round(location_lat, 4) AS location_lat, round(location_lon, 4) AS location_lon,
 {_ts('obs_ts')} AS timestamp, round(temperature_celsius, 8) AS temperature_celsius, round(CAST(wind_speed_kmh AS DOUBLE), 1) AS wind_speed_kmh,
 CAST(tie_key % 9 AS VARCHAR) AS weather_condition, CAST(NULL AS DOUBLE) AS humidity_percent FROM weather_raw""")
sql("stream_silver_hazards", _FH)
sql("stream_dedup", _FS)
sql("stream_silver_fuel", f"""SELECT stationcode, fueltype AS fuel_type, round(price, 3) AS price, fuel_category,
 {_ts('last_updated_ts')} AS price_updated_timestamp {_FF}""")
sql("stream_silver_weather", _FW)
sql("stream_with_stops", _FS)
SQL["stream_gold_regional"] = SQL["feed_regional"]
SQL["stream_rule_counts"] = SQL["expectations"]
sql("stream_landing_fields", """SELECT CASE WHEN broken THEN NULL ELSE event_id END AS event_id, CASE WHEN NOT broken THEN headline END AS headline,
 CASE WHEN broken OR is_major IS NULL THEN NULL WHEN is_major THEN 'true' ELSE 'false' END AS is_major,
 CASE WHEN NOT broken THEN round(latitude, 6) END AS latitude,
 CASE WHEN NOT broken AND event_id % 2 = 1 THEN '{"location":"' || location || '","impact":"' || CASE WHEN impact THEN 'true' ELSE 'false' END || '"}' END AS _rescued_data,
 CASE WHEN broken THEN '{"event_id": ' || event_id END AS _corrupt_record, true AS has_file
 FROM (SELECT *, event_id % 50 = 7 AS broken FROM hazards_raw)""")
sql("keyed_append", """SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (
 SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY second DESC, o_orderkey DESC) AS rn FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, 0 AS second FROM orders WHERE o_orderkey % 3 < 2
  UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 5 = 1)) WHERE rn = 1""")
sql("layout_tables", f"""SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name,
 'lake' AS source_system, strftime({NOW}, '%Y-%m-%d %H:%M:%S') AS ingestion_timestamp FROM nation""")
sql("stream_latest_weather", """SELECT station_id, strftime(max(obs_ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS obs_ts FROM weather_raw WHERE station_id IS NOT NULL GROUP BY station_id""")
