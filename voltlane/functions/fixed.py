"""Fixed values.

Everything here is a constant that results depend on: thresholds, labels, boxes, places, texts and
formats. They must keep exactly these values; the code that applies them lives elsewhere.
"""

from __future__ import annotations

EARTH_RADIUS_KM = 6371.0

# Text formats of the feeds.
FEED_TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"
KW_PATTERN = r"(\d+\.?\d*)"

# State bounds used by location flags: latitude range, longitude range.
STATE_LAT = (-37.5, -28.0)
STATE_LON = (140.0, 154.0)

# Reading ranges for weather flags.
TEMPERATURE_RANGE = (-50, 60)
HUMIDITY_RANGE = (0, 100)
MAX_PRICE_CENTS = 500

# Region boxes, first match wins: name, lat min, lat max, lon min, lon max.
REGION_BOXES = [
    ("Sydney Metro", -34.2, -33.4, 150.5, 151.3),
    ("Central Coast", -33.6, -33.1, 151.2, 151.6),
    ("Hunter", -33.1, -32.5, 151.4, 152.0),
    ("Illawarra", -35.0, -34.2, 150.6, 151.0),
    ("Southern Tablelands", -36.5, -34.5, 148.5, 150.0),
    ("Western NSW", -33.5, -28.5, 140.0, 147.0),
    ("Northern NSW", -30.5, -28.0, 152.5, 154.0),
    ("Riverina", -36.0, -33.5, 144.0, 148.5),
]
REGION_DEFAULT = "Other"

# Region boxes of the feed variant.
FEED_REGION_BOXES = [
    ("Sydney Metro", -34.1, -33.6, 150.5, 151.5),
    ("Hunter (Newcastle)", -33.0, -32.6, 151.5, 152.0),
    ("Illawarra (Wollongong)", -34.5, -34.3, 150.8, 151.0),
    ("Riverina", -36.5, -36.0, 146.8, 147.5),
    ("Mid North Coast", -31.5, -30.0, 152.5, 153.5),
    ("Northern Rivers", -29.0, -28.0, 152.8, 153.7),
    ("New England", -32.0, -30.5, 148.5, 152.0),
    ("Western NSW", -34.0, -32.0, 140.0, 148.5),
]
FEED_REGION_DEFAULT = "Other/Regional"

# Reference places: name, latitude, longitude.
REFERENCE_PLACES = [
    ("Sydney CBD", -33.8688, 151.2093),
    ("Parramatta", -33.8150, 151.0010),
    ("Newcastle", -32.9283, 151.7817),
    ("Wollongong", -34.4278, 150.8931),
    ("Blue Mountains", -33.7124, 150.3105),
    ("Central Coast", -33.4290, 151.3430),
    ("Port Macquarie", -31.4333, 152.9000),
    ("Wagga Wagga", -35.1082, 147.3598),
]

# Weather sites: id, name, latitude, longitude.
WEATHER_SITES = [
    ("SYD001", "Sydney", -33.8688, 151.2093),
    ("NEW001", "Newcastle", -32.9283, 151.7817),
    ("WOL001", "Wollongong", -34.4278, 150.8931),
    ("CEN001", "Central Coast", -33.3094, 151.3814),
    ("BLU001", "Blue Mountains", -33.7122, 150.3106),
    ("COF001", "Coffs Harbour", -30.2963, 153.1158),
    ("POR001", "Port Macquarie", -31.4331, 152.9083),
    ("BYR001", "Byron Bay", -28.6436, 153.6122),
    ("TAM001", "Tamworth", -31.0906, 150.9292),
    ("ARM001", "Armidale", -30.5139, 151.6686),
    ("ORA001", "Orange", -33.2839, 149.0995),
    ("BAT001", "Bathurst", -33.4194, 149.5781),
    ("DUB001", "Dubbo", -32.2569, 148.6011),
    ("BRO001", "Broken Hill", -31.9505, 141.4333),
    ("WAG001", "Wagga Wagga", -35.1082, 147.3598),
    ("ALB001", "Albury", -36.0737, 146.9135),
    ("BEG001", "Bega", -36.6742, 149.8414),
    ("GOU001", "Goulburn", -34.7531, 149.7181),
    ("LIS001", "Lismore", -28.8142, 153.2789),
    ("GRA001", "Grafton", -29.6886, 152.9347),
]

# Days, Sunday first (day 1).
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
WEEKEND_DAYS = [1, 7]
PEAK_HOURS = [7, 8, 9, 17, 18, 19]

# Charging speeds.
SPEEDS = ["Slow", "Fast", "Rapid", "Ultra-Rapid", "Unknown"]
STRONG_SPEEDS = ["Rapid", "Ultra-Rapid"]

# Fuel groups by cleaned type.
FUEL_GROUPS = [
    (["E10", "UNLEADED", "U91"], "Regular Unleaded"),
    (["U95", "PREMIUM 95"], "Premium 95"),
    (["U98", "PREMIUM 98"], "Premium 98"),
    (["DIESEL", "DL"], "Diesel"),
    (["LPG", "AUTOGAS"], "LPG"),
]
FEED_FUEL_PATTERNS = [
    ("%U91%", "Regular Unleaded"),
    ("%95%", "Premium 95"),
    ("%98%", "Premium 98"),
    ("%Diesel%", "Diesel"),
    ("%LPG%", "LPG"),
]

# Weather groups.
WEATHER_PATTERNS = [
    ("clear|sunny|fine", "Clear"),
    ("cloud|overcast|partly", "Cloudy"),
    ("rain|shower|drizzle", "Rain"),
    ("storm|thunder|lightning", "Storm"),
    ("snow|sleet|ice|hail", "Snow/Ice"),
    ("fog|mist|haze", "Fog"),
    ("wind|gust|gale", "Windy"),
]
FEED_WEATHER_PATTERNS = [
    ("%Clear%", "Clear"),
    ("%Cloud%", "Cloudy"),
    ("%Rain%", "Rain"),
    ("%Storm%", "Storm"),
    ("%Snow%", "Snow/Ice"),
    ("%Fog%", "Fog"),
]

# Hazard categories that are counted: output column, category label.
HAZARD_CATEGORIES = {
    "roadwork_count": "Scheduled Roadwork",
    "incident_count": "Hazard",
    "flood_count": "Flooding",
    "event_count": "Special Event",
}
SEVERITY_RANK = {"Major": 3, "Moderate": 2}

# Score floors, highest first: lowest score of the band, label.
CONGESTION_LEVELS = [(70, "Critical"), (50, "High"), (30, "Moderate"), (10, "Low")]
RISK_LEVELS = [(70, "High Risk"), (40, "Moderate Risk")]
ROUTE_RATINGS = [
    (70, "Avoid - High Risk"),
    (50, "Caution - Moderate Risk"),
    (25, "Acceptable - Low Risk"),
]
ROUTE_RATING_DEFAULT = "Recommended - Minimal Risk"
DELAY_MINUTES = {"Avoid - High Risk": 15, "Caution - Moderate Risk": 8, "Acceptable - Low Risk": 3}
GAP_LEVELS = [(70, "Critical"), (50, "High"), (30, "Moderate")]
SMART_TIERS = [(85, "Excellent"), (70, "Good"), (50, "Fair")]
FEED_SMART_TIERS = [(80, "Tier 1 - Excellent"), (60, "Tier 2 - Good"), (40, "Tier 3 - Fair")]
FEED_SMART_DEFAULT = "Tier 4 - Limited"
SPEED_POINTS = {"Ultra-Rapid": 40, "Rapid": 35, "Fast": 25, "Slow": 15}
FEED_SPEED_POINTS = {"Ultra-Rapid": 100, "Rapid": 80, "Fast": 60, "Slow": 40}
WINDOW_CATEGORIES = [(90, "Optimal"), (70, "Good"), (50, "Fair"), (30, "Poor")]
NETWORK_LEVELS = [(100, "Excellent"), (50, "Good"), (20, "Moderate")]
DELAY_FACTORS = {"Critical": 1.5, "High": 1.3, "Moderate": 1.15, "Low": 1.05}

# Hour advice: the mean congestion below which the category holds.
HOUR_CATEGORIES = [(20, "Excellent"), (40, "Good"), (60, "Fair")]
HOUR_PERIODS = [
    (0, 5, "Late Night"),
    (6, 8, "Morning Rush"),
    (9, 11, "Mid-Morning"),
    (12, 14, "Midday"),
    (15, 16, "Afternoon"),
    (17, 19, "Evening Rush"),
    (20, 22, "Evening"),
]
TRIP_PERIODS = [
    (0, 5, "Late Night"),
    (6, 9, "Morning Rush"),
    (10, 11, "Late Morning"),
    (12, 14, "Midday"),
    (15, 17, "Afternoon"),
    (18, 20, "Evening Rush"),
]
CHARGE_ADVICE = {
    "Excellent": "Ideal time to charge - minimal traffic expected",
    "Good": "Good time to charge - low traffic conditions",
    "Fair": "Acceptable charging time - moderate traffic possible",
}
CHARGE_ADVICE_DEFAULT = "Avoid if possible - high traffic expected"
TRAVEL_ADVICE = [
    (60, "Avoid travel if possible - plan alternate routes"),
    (40, "Allow extra travel time - monitor live traffic"),
    (20, "Normal travel conditions expected"),
]
TRAVEL_ADVICE_DEFAULT = "Clear roads expected - optimal travel time"
TRIP_ADVICE = {
    "Optimal": "Excellent time to travel - minimal congestion and hazards",
    "Good": "Good travel conditions - some minor delays possible",
    "Fair": "Moderate traffic expected - allow extra time",
    "Poor": "Heavy traffic likely - consider alternative time",
}
TRIP_ADVICE_DEFAULT = "Not recommended - severe congestion and/or hazards"

# Trip planning.
TRIP_DISTANCES_KM = [25, 50, 75, 100, 150, 200, 250, 300, 350, 400, 500]
EV_RANGE_KM = 350
EV_SPEED_KMH = 60
EV_BUFFER_KM = 50
CHARGE_HOURS_PER_STOP = 0.5

# Consumer query and retrieval defaults.
NEARBY_KM = 30.0
NEARBY_LIMIT = 10
NO_ADDRESS = "Address not available"
TOP_K = 5
SOURCES_SHOWN = 3
PREVIEW_CHARS = 200

# Column names of the stations feed and what they become.
STATION_FEED_NAMES = {
    "StationID": "station_id",
    "OperatorName": "operator_name",
    "AddressLine1": "address_line1",
    "Suburb": "suburb",
    "State": "state",
    "Postcode": "postcode",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "NumberOfPlugs": "number_of_plugs",
    "ChargerType": "charger_type",
    "ChargingPowerKW": "charging_power_kw",
}

# Expectation rules of the feed variant: name, SQL predicate.
STATION_RULES = {
    "valid_latitude": "latitude IS NOT NULL AND latitude BETWEEN -90 AND 90",
    "valid_longitude": "longitude IS NOT NULL AND longitude BETWEEN -180 AND 180",
    "valid_station_id": "station_id IS NOT NULL",
}
HAZARD_RULES = {
    "valid_hazard": "hazard_id IS NOT NULL OR (headline IS NOT NULL AND location IS NOT NULL)",
}
FUEL_RULES = {
    "valid_price": "price BETWEEN 0 AND 500",
    "valid_fuel_type": "fuel_type IS NOT NULL",
}
WEATHER_RULES = {
    "valid_temperature": "temperature_c BETWEEN -50 AND 60",
    "valid_humidity": "humidity_percent BETWEEN 0 AND 100",
}

# --- documents (fixed values: ids, texts and metadata that readers of the documents know) -----------------------------

STATION_DOC_ID = "ev_station_{objectid}"
STATION_TEXT = (
    "Electric Vehicle Charging Station: {station_name}. Location: {station_address}, {lganame} (Postcode: {pcode}). "
    "Operator: {operator}. Charging Type: {charger__type} with {number_of_plugs} plugs. "
    "Charging Speed: {charging_speed} ({charger_rating_kw} kW). Coordinates: Latitude {latitude}, Longitude {longitude}.")
STATION_TEXT_DEFAULTS = {
    "station_name": "Unnamed Station", "station_address": "Address not available", "lganame": "Unknown LGA", "pcode": "N/A",
    "operator": "Unknown operator", "charger__type": "Not specified", "number_of_plugs": "0", "charging_speed": "Unknown",
    "charger_rating_kw": "N/A"}
STATION_METADATA = ["objectid", "station_name", "operator", "lganame", "pcode", "latitude", "longitude", "charger_rating_kw",
                    "charging_speed"]
ROUTE_DOC_ID = "route_{place}"
ROUTE_TEXT = (
    "Route Safety Report for {location}. Overall Safety Rating: {route_safety_rating} with a risk score of {route_risk_score}. "
    "Total Hazards: {total_hazards} ({active_hazards} currently active). Hazard Breakdown: {roadwork_count} roadwork sites, "
    "{incident_count} incidents, {flood_count} flood warnings, {event_count} events. Primary Hazard Type: {primary_hazard_type}. "
    "Estimated Delay: {estimated_delay_minutes} minutes. Location Center: Latitude {center_lat}, Longitude {center_lon}.")
ROUTE_METADATA = ["location", "route_safety_rating", "route_risk_score", "total_hazards", "active_hazards", "primary_hazard_type",
                  "estimated_delay_minutes", "center_lat", "center_lon"]
