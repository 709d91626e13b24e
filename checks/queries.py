"""One callable per operator and query: (spark, data folder) -> DataFrame.

Every callable runs over whole tables. The last step only picks and rounds columns, so that the two engines
can be compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.functions import columns as C
from voltlane.functions import fixed
from voltlane.functions.sphere import haversine_km
from voltlane.operators import distance, quality, rows, shape, summaries
from voltlane.operators.storage import shared_dir
from voltlane.operators.vectors import vector_top_k
from voltlane.plans import feeds, infrastructure, reports, retrieval, silver, traffic, trips
from voltlane.sources import files
from voltlane.sources.layout import KeyedTable, Layout
from voltlane.streaming import batches, flows
from voltlane.streaming import landing as landings
from voltlane.streaming import state as states

from .views import AS_OF, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SYDNEY = (-33.8688, 151.2093)
NEWCASTLE = (-32.9283, 151.7817)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def out(df: DataFrame, *specs: str) -> DataFrame:
    """Pick columns. "name:i" int, ":l" bigint, ":3" double rounded to 3 digits, ":t" time as text, ":j" list as
    text; a bare name is taken as it is."""
    cols = []
    for spec in specs:
        name, _, kind = spec.partition(":")
        c = F.col(name)
        if kind == "i":
            c = c.cast("int")
        elif kind == "l":
            c = c.cast("bigint")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "j":
            c = F.array_join(c, ",")
        elif kind:
            c = F.round(c.cast("double"), int(kind))
        cols.append(c.alias(name))
    return df.select(*cols)


# --- inputs ------------------------------------------------------------------------------------------

def stations(spark, d):
    return silver.silver_stations(view(spark, d, "stations_raw"), AS_OF)


def fuel(spark, d):
    return silver.silver_fuel(view(spark, d, "fuel_raw"), AS_OF, ("tie_key", "price"))


def hazards(spark, d):
    return silver.silver_hazards(view(spark, d, "hazards_raw"), AS_OF, ("event_id",))


def weather(spark, d):
    return silver.silver_weather(view(spark, d, "weather_raw"), AS_OF, "obs_ts", ("tie_key",))


def smart(spark, d):
    return infrastructure.smart_recommendations(stations(spark, d), hazards(spark, d), as_of=AS_OF)


def regional(spark, d):
    return infrastructure.regional_infrastructure(stations(spark, d), fuel(spark, d), as_of=AS_OF)


def hourly(spark, d):
    return traffic.congestion_hourly(hazards(spark, d), as_of=AS_OF)


def routes(spark, d):
    return trips.trip_routes(hazards(spark, d), as_of=AS_OF)


def charging(spark, d):
    return trips.charging_requirements(trips.trip_distances(spark), stations(spark, d), as_of=AS_OF)


def feed_stations_df(spark, d):
    return feeds.feed_stations(view(spark, d, "stations_landing"), AS_OF)


def hazards_landing(spark, d):
    return view(spark, d, "hazards_landing").withColumnRenamed("end_text", "end")


def feed_hazards_df(spark, d):
    return feeds.feed_hazards(hazards_landing(spark, d), AS_OF)


# --- silver --------------------------------------------------------------------------------------------

@query
def silver_stations(spark, d):
    return out(stations(spark, d), "objectid", "station_name", "station_address", "lganame", "pcode", "operator",
               "charger__type", "number_of_plugs", "latitude:6", "longitude:6", "charger_rating_kw:3", "charging_speed",
               "has_valid_location", "has_valid_rating")


@query
def silver_fuel(spark, d):
    return out(fuel(spark, d), "stationcode", "fuel_type_clean", "fuel_category", "price_cents:3", "last_updated_ts:t",
               "has_valid_price", "has_valid_station", "has_valid_timestamp")


@query
def silver_hazards(spark, d):
    return out(hazards(spark, d), "event_id", "hazard_id", "hazard_type_clean", "main_category", "headline", "location",
               "severity", "is_active", "start_time_ts:t", "latitude:6", "longitude:6", *silver.HAZARD_FLAGS)


@query
def silver_weather(spark, d):
    return out(weather(spark, d), "station_id", "obs_ts:t", "weather_category", "temperature_celsius:8",
               "humidity_percent", *silver.WEATHER_FLAGS)


def _dq(df):
    return out(df, "check", "total:l", "hits:l", "pct:2")


@query
def dq_stations(spark, d):
    return _dq(quality.dq_report(stations(spark, d), silver.STATION_FLAGS))


@query
def dq_fuel(spark, d):
    return _dq(quality.dq_report(fuel(spark, d), silver.FUEL_FLAGS))


@query
def dq_hazards(spark, d):
    return _dq(quality.dq_report(hazards(spark, d), silver.HAZARD_FLAGS, ["is_active", "is_major"]))


@query
def dq_weather(spark, d):
    return _dq(quality.dq_report(weather(spark, d), silver.WEATHER_FLAGS))


@query
def weather_stats(spark, d):
    return out(silver.weather_stats(weather(spark, d)), "min_temp:4", "avg_temp:4", "max_temp:4", "avg_humidity:4",
               "avg_wind_speed:4")


@query
def fuel_price_stats(spark, d):
    return out(silver.fuel_price_stats(fuel(spark, d)), "fuel_category", "min_price:3", "avg_price:4", "max_price:3",
               "record_count:l")


# --- infrastructure ---------------------------------------------------------------------------------------

SPEED_COLUMNS = ["slow_chargers:l", "fast_chargers:l", "rapid_chargers:l", "ultra_rapid_chargers:l"]


@query
def regional_ev(spark, d):
    return out(infrastructure.regional_ev_metrics(stations(spark, d)), "region", "ev_station_count:l",
               "valid_locations:l", "valid_ratings:l", "total_capacity_kw:3", "avg_capacity_kw:4", "max_capacity_kw:3",
               *SPEED_COLUMNS, "unknown_speed_chargers:l")


@query
def fuel_statewide(spark, d):
    return out(infrastructure.fuel_metrics(fuel(spark, d)), "fuel_station_count_nsw:l", "valid_prices_nsw:l",
               "avg_regular_unleaded_price:4", "avg_diesel_price:4", "avg_lpg_price:4", "stations_with_unleaded_nsw:l",
               "stations_with_diesel_nsw:l", "stations_with_lpg_nsw:l")


@query
def regional_infrastructure(spark, d):
    return out(regional(spark, d), "region", "ev_station_count:l", "total_capacity_kw:3", "avg_capacity_kw:4",
               *SPEED_COLUMNS, "fuel_station_count_nsw:l", "avg_diesel_price:4", "ev_readiness_score:i", "reporting_date:t")


@query
def regional_summary(spark, d):
    return out(infrastructure.regional_summary(regional(spark, d)), "section", "label", "value:4")


@query
def regional_density(spark, d):
    metrics = infrastructure.regional_ev_metrics(stations(spark, d))
    return out(infrastructure.regional_density(metrics, infrastructure.box_areas(spark)), "region",
               "ev_station_count:l", "stations_per_1000_km2:6")


@query
def ev_fuel_ratio(spark, d):
    return out(infrastructure.ev_fuel_ratio(stations(spark, d), fuel(spark, d)), "ev_stations:l", "fuel_stations:l",
               "ev_ratio_pct:1")


@query
def nearest_chargers(spark, d):
    return out(infrastructure.nearest_chargers(stations(spark, d), as_of=AS_OF), "location_name", "rank:i",
               "station_name", "station_address", "latitude:6", "longitude:6", "distance_km:2", "operator",
               "charging_speed", "has_valid_rating")


@query
def nearest_weather_site(spark, d):
    """The weather table's sites as targets, every station as a point: the many-to-many form of nearest-k."""
    sites = view(spark, d, "weather_raw").select(
        "station_id", F.col("location_lat").alias("site_lat"), F.col("location_lon").alias("site_lon")).distinct()
    return out(infrastructure.nearest_weather(stations(spark, d), sites), "objectid", "site_id", "distance_km:4")


@query
def gap_analysis(spark, d):
    return out(infrastructure.gap_analysis(stations(spark, d), AS_OF), "lganame", "charger_count:l",
               "total_capacity_kw:3", "center_lat:6", "center_lon:6", *SPEED_COLUMNS, "gap_severity_score:i", "gap_category")


@query
def hazard_summary(spark, d):
    return out(infrastructure.hazard_summary(stations(spark, d), hazards(spark, d)), "objectid", "station_name",
               "latitude:6", "longitude:6", "nearby_hazards_count:l", "hazard_types:j", "max_hazard_severity:i")


@query
def smart_recommendations(spark, d):
    return out(smart(spark, d), "objectid", "station_name", "latitude:6", "longitude:6", "charging_speed",
               "nearby_hazards_count:l", "hazard_types:j", "max_hazard_severity:i", "accessibility_score:i",
               "recommendation_score:i", "recommendation_tier")


@query
def smart_recommendations_null_safe(spark, d):
    df = infrastructure.smart_recommendations(stations(spark, d), hazards(spark, d), null_safe=True, as_of=AS_OF)
    return out(df, "objectid", "nearby_hazards_count:l", "accessibility_score:i", "recommendation_score:i",
               "recommendation_tier")


@query
def recommendation_summary(spark, d):
    s = stations(spark, d)
    df = infrastructure.recommendation_summary(infrastructure.nearest_chargers(s, as_of=AS_OF),
                                               infrastructure.gap_analysis(s, AS_OF), smart(spark, d))
    return out(df, "section", "label", "value:4")


NEARBY = ["objectid", "name", "address", "distance_km:2", "latitude:6", "longitude:6", "operator", "number_of_plugs:l",
          "charger_type", "charging_speed", "recommendation_tier", "recommendation_score:i", "accessibility_score:i",
          "nearby_hazards:l", "hazard_types:j", "postcode:l"]


@query
def nearby_stations(spark, d):
    return out(infrastructure.nearby_stations(smart(spark, d), *SYDNEY), *NEARBY)


@query
def nearby_stations_dc(spark, d):
    return out(infrastructure.nearby_stations(smart(spark, d), *SYDNEY, max_km=60, charger_type="DC"), *NEARBY)


@query
def nearby_batch(spark, d):
    """Every supplier as a place to search around."""
    probes = table(spark, d, "supplier").selectExpr(
        "s_suppkey AS probe_id", "-34.3e0 + (s_suppkey * 7919 % 1800) / 1000e0 AS probe_lat",
        "150.4e0 + (s_suppkey * 10007 % 1700) / 1000e0 AS probe_lon")
    return out(infrastructure.nearby_batch(smart(spark, d), probes), "probe_id", "rank:i", "objectid", "distance_km:2",
               "recommendation_score:i")


@query
def corridor(spark, d):
    return out(distance.corridor(stations(spark, d), SYDNEY, NEWCASTLE, 15.0), "objectid", "route_distance_km:4")


@query
def within_km(spark, d):
    s = shape_points(stations(spark, d))
    h = hazards(spark, d).filter("is_active").select(
        "event_id", F.col("latitude").alias("hazard_lat"), F.col("longitude").alias("hazard_lon"))
    return out(distance.within_km(s, h, 5), "objectid", "event_id", "distance_km:4")


@query
def within_box(spark, d):
    s = shape_points(stations(spark, d))
    h = hazards(spark, d).filter("is_active").select(
        "event_id", F.col("latitude").alias("hazard_lat"), F.col("longitude").alias("hazard_lon"))
    return out(distance.within_box(s, h, 0.05, "left", ["objectid"]), "objectid", "event_id")


def shape_points(df):
    return df.select("objectid", "latitude", "longitude")


# --- traffic ---------------------------------------------------------------------------------------------

COUNTS = ["roadwork_count:l", "incident_count:l", "flood_count:l"]


@query
def congestion_hourly(spark, d):
    return out(hourly(spark, d), "hour_of_day:i", "day_of_week:i", "day_name", "total_hazards:l", "major_hazards:l",
               "moderate_hazards:l", "minor_hazards:l", *COUNTS, "event_count:l", "active_hazards:l",
               "congestion_score:i", "congestion_level", "is_peak_hour")


@query
def congestion_location(spark, d):
    return out(traffic.congestion_location(hazards(spark, d), as_of=AS_OF), "location", "total_hazards:l",
               "active_hazards:l", "major_hazards:l", "center_lat:6", "center_lon:6", *COUNTS, "earliest_hazard:t",
               "latest_hazard:t", "risk_score:i", "risk_level", "dominant_hazard_type")


@query
def congestion_recommendations(spark, d):
    return out(traffic.congestion_recommendations(hourly(spark, d), AS_OF), "hour_of_day:i", "avg_congestion_score:4",
               "avg_hazards:4", "total_hazards_all_days:l", "max_congestion_score:i", "recommendation_category",
               "time_period", "charging_recommendation", "travel_recommendation")


@query
def weekday_weekend(spark, d):
    return out(traffic.weekday_weekend(hourly(spark, d)), "day_type", "hour_of_day:i", "avg_hazards:4",
               "avg_congestion:4", "total_hazards:l")


@query
def day_type_peaks(spark, d):
    return out(traffic.day_type_peaks(traffic.weekday_weekend(hourly(spark, d))), "day_type", "peak_hour:i",
               "avg_hazards:4", "avg_congestion:4")


@query
def congestion_summary(spark, d):
    h = hourly(spark, d)
    df = traffic.congestion_summary(h, traffic.congestion_location(hazards(spark, d), as_of=AS_OF),
                                    traffic.congestion_recommendations(h, AS_OF))
    return out(df, "section", "label", "value:4")


# --- trips -----------------------------------------------------------------------------------------------

@query
def trip_routes(spark, d):
    return out(routes(spark, d), "location", "total_hazards:l", "active_hazards:l", "major_hazards:l",
               "moderate_hazards:l", "center_lat:6", "center_lon:6", *COUNTS, "event_count:l", "earliest_hazard_time:t",
               "latest_hazard_time:t", "route_risk_score:i", "route_safety_rating", "primary_hazard_type",
               "estimated_delay_minutes:l")


@query
def charging_requirements(spark, d):
    return out(charging(spark, d), "trip_distance_km", "charging_stops_needed:l", "base_driving_time_hours:6",
               "charging_time_hours:2", "total_trip_time_hours:6", "recommended_charger_type",
               "minimum_starting_battery_pct:l", "trip_feasibility", "total_stations:l", "total_plugs:l",
               "fast_charger_stations:l", "charger_availability_score")


@query
def trip_recommendations(spark, d):
    return out(trips.trip_recommendations(hourly(spark, d), AS_OF), "hour_of_day:i", "day_name", "congestion_score:i",
               "trip_suitability_score:i", "trip_window_category", "time_period", "trip_advice", "charging_availability",
               "congestion_delay_factor:2", "priority_rank:i")


@query
def trip_summary(spark, d):
    df = trips.trip_summary(routes(spark, d), charging(spark, d), trips.trip_recommendations(hourly(spark, d), AS_OF))
    return out(df, "section", "label", "value:4")


# --- feed variant -------------------------------------------------------------------------------------------

FEED_STATION = ["station_id", "operator_name", "address_line1", "suburb", "state", "postcode", "latitude:6", "longitude:6",
                "number_of_plugs:i", "charger_type", "charging_power_kw:3", "charging_speed", "has_valid_location",
                "has_valid_rating"]
FEED_HAZARD = ["hazard_id", "headline", "location", "created_timestamp:t", "severity", "is_active", "composite_key",
               "latitude:6", "longitude:6"]


@query
def feed_stations(spark, d):
    return out(feed_stations_df(spark, d), *FEED_STATION)


@query
def feed_hazards(spark, d):
    return out(feed_hazards_df(spark, d), *FEED_HAZARD)


@query
def feed_fuel(spark, d):
    return out(feeds.feed_fuel(view(spark, d, "fuel_raw"), AS_OF), "stationcode", "fuel_type", "price:3", "fuel_category",
               "tie_key", "last_updated_ts:t")


@query
def feed_weather(spark, d):
    return out(feeds.feed_weather(view(spark, d, "weather_landing"), AS_OF), "station_id", "weather", "weather_category",
               "temperature_c:8", "humidity_percent:2", "latitude:4", "longitude:4")


@query
def feed_regional(spark, d):
    return out(feeds.feed_regional(feed_stations_df(spark, d), AS_OF), "region", "total_stations:l", "total_plugs:l",
               "total_capacity_kw:2", "avg_capacity_kw:2", "fast_charger_count:l", "ev_readiness_score:0")


@query
def feed_smart(spark, d):
    return out(feeds.feed_smart(feed_stations_df(spark, d), feed_hazards_df(spark, d), as_of=AS_OF), "station_id",
               "charging_speed", "charger_quality_score:i", "nearby_hazards:l", "accessibility_score:i",
               "recommendation_score:2", "recommendation_tier")


# --- documents and retrieval ----------------------------------------------------------------------------------

def station_docs(spark, d):
    return retrieval.station_documents(stations(spark, d))


@query
def station_documents(spark, d):
    """Whole texts. Coordinates are rounded first, so that both engines print the same digits."""
    rounded = stations(spark, d).withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})
    meta = ("objectid bigint, station_name string, operator string, lganame string, pcode bigint, latitude double, longitude double, "
            "charger_rating_kw double, charging_speed string")
    df = retrieval.station_documents(rounded).withColumn("m", F.from_json("metadata", meta)).select("doc_id", "content", "source_table", "m.*")
    return out(df, "doc_id", "content", "source_table", "objectid", "station_name", "operator", "lganame", "pcode:l", "latitude:6",
               "longitude:6", "charger_rating_kw:3", "charging_speed")


@query
def route_documents(spark, d):
    rounded = routes(spark, d).withColumns({c: F.round(c, 6) for c in ("center_lat", "center_lon")})
    meta = ("location string, route_safety_rating string, route_risk_score int, total_hazards bigint, active_hazards bigint, "
            "primary_hazard_type string, estimated_delay_minutes int, center_lat double, center_lon double")
    df = retrieval.route_documents(rounded).withColumn("m", F.from_json("metadata", meta)).select("doc_id", "content", "source_table", "m.*")
    return out(df, "doc_id", "content", "source_table", "location", "route_safety_rating", "route_risk_score:i", "total_hazards:l",
               "active_hazards:l", "primary_hazard_type", "estimated_delay_minutes:i", "center_lat:6", "center_lon:6")


@query
def doc_stats(spark, d):
    """Text documents per source, over the documents table."""
    docs = table(spark, d, "documents").select(F.col("text").alias("content"), F.col("source").alias("source_table"))
    return out(retrieval.doc_stats(docs), "source_table", "document_count:l", "avg_content_length:4")


@query
def doc_preview(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.col("text").alias("content"), F.col("source").alias("source_table"))
    return retrieval.doc_preview(docs, 5)


@query
def built_document_keys(spark, d):
    """Ids of the built documents that are not unique: every location comes in a second spelling with a blank."""
    known = routes(spark, d)
    spelled = known.withColumn("location", F.replace("location", F.lit("_"), F.lit(" ")))
    docs = retrieval.build_documents(stations(spark, d), known.unionByName(spelled))
    return out(rows.ensure_keyed(docs, "doc_id"), "doc_id", "row_count:l")


def label_centres(spark, d):
    """One query vector per label: the mean of its vectors."""
    mean = vector_to_array(Summarizer.mean(array_to_vector("embedding")))
    return table(spark, d, "embeddings").groupBy("label").agg(mean.alias("embedding")).withColumnRenamed("label", "query_id")


HITS = ["query_id:i", "vec_id", "score:6", "rank:i"]


@query
def vector_top_k_labels(spark, d):
    return out(vector_top_k(label_centres(spark, d), table(spark, d, "embeddings"), 5, doc_id="vec_id"), *HITS)


@query
def vector_top_k_partitioned(spark, d):
    """The same question in several chunks, as batches too large to ship at once are answered."""
    centres = label_centres(spark, d)
    width = F.size(F.first("embedding"))
    chunk = 4 * (centres.agg(width).head()[0] or 1)
    hits = vector_top_k(centres, table(spark, d, "embeddings"), 5, doc_id="vec_id", max_shipped=chunk)
    return out(hits, *HITS)


@query
def vector_top_k_near_copies(spark, d):
    """Vectors against all vectors and a near-copy of each, whose id is lower and whose rounded score often ties."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    moved = F.concat(F.array(F.col("embedding")[0] + 5e-4), F.slice("embedding", 2, F.size("embedding") - 1))
    docs = vectors.unionByName(vectors.select((-1 - F.col("vec_id")).alias("vec_id"), moved.alias("embedding")))
    questions = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return out(vector_top_k(questions, docs, 5, doc_id="vec_id"), "query_id:l", "vec_id", "score:6", "rank:i")


@query
def vector_top_k_filtered(spark, d):
    """Only documents whose metadata equals a value."""
    hits = vector_top_k(label_centres(spark, d), table(spark, d, "embeddings"), 5, doc_id="vec_id", where=F.col("label") == 3)
    return out(hits, *HITS)


def label_hits(spark, d):
    """Retrieved documents with their whole text; the vectors and texts share their ids."""
    hits = vector_top_k(label_centres(spark, d), table(spark, d, "embeddings"), 5, doc_id="vec_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return hits.join(docs, "vec_id").withColumnsRenamed({"vec_id": "doc_id", "query_id": "question_id"})


@query
def prompts(spark, d):
    """A question per nation; those without hits get the fallback text."""
    questions = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("question_id"), F.concat(F.lit("What is known about "), "n_name", F.lit("?")).alias("question"))
    hits = label_hits(spark, d).withColumn("score", F.round("score", 3))
    return retrieval.assemble_prompts(questions, hits).select("question_id", "question", "prompt")


@query
def citations(spark, d):
    cited = retrieval.cite_sources(label_hits(spark, d)).select("question_id", F.inline("sources"))
    return out(cited, "question_id:i", "rank:i", "id", "score:6", "preview")


@query
def text_retrieval(spark, d):
    """All turns of all conversations against all documents, by TF-IDF over whole words."""
    questions = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return out(retrieval.retrieve(questions, docs, 5), "question_id", "doc_id:l", "score:6", "rank:i")


# --- reports ----------------------------------------------------------------------------------------------

@query
def hazard_type_distribution(spark, d):
    return out(reports.distribution(hazards(spark, d), "hazard_type_clean"), "hazard_type_clean", "row_count:l")


@query
def histogram(spark, d):
    return out(reports.histogram(smart(spark, d), "recommendation_score", 10), "bin:i", "lower_edge:4", "row_count:l")


@query
def top_operators(spark, d):
    return out(reports.top_operators(smart(spark, d), 10, "recommendation_score"), "operator", "station_count:l", "avg_score:4")


@query
def congestion_heatmap(spark, d):
    return out(reports.congestion_heatmap(hourly(spark, d)), "hour_of_day:i", *[f"{n}:0" for n in fixed.DAY_NAMES])


@query
def peak_comparison(spark, d):
    return out(reports.peak_comparison(hourly(spark, d)), "is_peak_hour", "periods:l", "avg_score:4", "avg_hazards:4",
               "total_hazards:l")


@query
def delay_by_rating(spark, d):
    return out(reports.delay_by_rating(routes(spark, d)), "route_safety_rating", "locations:l", "avg_delay:4", "max_delay:l")


@query
def hazard_type_totals(spark, d):
    return out(reports.hazard_type_totals(routes(spark, d)), "hazard_type", "total:l")


@query
def needs_by_band(spark, d):
    return out(reports.needs_by_band(charging(spark, d)), "distance_band", "trips:l", "avg_stops:4", "avg_driving_hours:4",
               "avg_charging_hours:4")


@query
def charger_mix(spark, d):
    return out(reports.charger_mix(infrastructure.regional_ev_metrics(stations(spark, d)), "region"), "region",
               "charging_speed", "chargers:l")


@query
def hourly_trend(spark, d):
    return out(reports.hourly_trend(hourly(spark, d)), "hour_of_day:i", "avg_score:4")


@query
def advice_distribution(spark, d):
    return out(reports.advice_distribution(traffic.congestion_recommendations(hourly(spark, d), AS_OF)), "time_period",
               "recommendation_category", "hours:l")


# --- quality and comparison -----------------------------------------------------------------------------------

def landed_stations(spark, d):
    return shape.rename(view(spark, d, "stations_landing"), fixed.STATION_FEED_NAMES)


@query
def expectations(spark, d):
    return out(quality.expectation_report(landed_stations(spark, d), fixed.STATION_RULES), "rule", "passed:l", "dropped:l")


@query
def expect_or_drop(spark, d):
    return out(quality.expect_all_or_drop(landed_stations(spark, d), fixed.STATION_RULES), "station_id", "address_line1")


@query
def quarantine(spark, d):
    _, bad = quality.split_quarantine(landed_stations(spark, d), fixed.STATION_RULES)
    return out(bad, "address_line1", "failed_rules:j")


@query
def flagged_sample(spark, d):
    return out(quality.flagged_sample(stations(spark, d), silver.STATION_FLAGS, ["objectid"], 10), "objectid",
               "has_valid_location", "has_valid_rating")


@query
def parity_report(spark, d):
    a = stations(spark, d).select("latitude", "longitude")
    b = feed_stations_df(spark, d).select("latitude", "longitude")
    rules = {"in_state": "latitude BETWEEN -37.5 AND -28.0"}
    return out(quality.parity_report(a, b, rules), "check", "value:6", "passed")


@query
def parity_counts(spark, d):
    return out(quality.parity_counts(stations(spark, d), feed_stations_df(spark, d)), "source", "row_count:l")


@query
def table_counts(spark, d):
    h = hourly(spark, d)
    gold = {
        "gold_regional": regional(spark, d), "gold_nearest": infrastructure.nearest_chargers(stations(spark, d)),
        "gold_gaps": infrastructure.gap_analysis(stations(spark, d)), "gold_smart": smart(spark, d),
        "gold_hourly": h, "gold_location": traffic.congestion_location(hazards(spark, d)),
        "gold_hours": traffic.congestion_recommendations(h), "gold_routes": routes(spark, d),
        "gold_charging": charging(spark, d), "gold_windows": trips.trip_recommendations(h)}
    for name, df in gold.items():
        df.createOrReplaceTempView(name)
    return quality.table_counts(spark, [*gold, "gold_absent"])


@query
def changes_since(spark, d):
    orders = table(spark, d, "orders")
    old = orders.filter("o_orderstatus <> 'P'")
    new = orders.filter("o_orderstatus <> 'F'").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return rows.changes_since(old, new, "o_orderkey")


# --- primitives ---------------------------------------------------------------------------------------------

@query
def haversine(spark, d):
    df = stations(spark, d).withColumn("distance_km", haversine_km(*SYDNEY, "latitude", "longitude"))
    return out(df, "objectid", "distance_km:4")


@query
def parse_kw(spark, d):
    return out(view(spark, d, "stations_raw").withColumn("kw", C.parse_kw("charger_rating")), "objectid", "charger_rating", "kw:3")


@query
def temporal_features(spark, d):
    return out(shape.temporal_features(table(spark, d, "events"), "ts"), "event_id", "hour_of_day:i", "day_of_week:i", "day_name")


@query
def composite_key(spark, d):
    df = view(spark, d, "hazards_landing").withColumn("k", C.composite_key())
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("row_count"))


@query
def keep_latest(spark, d):
    return out(rows.keep_latest(table(spark, d, "events"), ["user_id"], ["ts"], ("event_id",)), "user_id", "event_id", "event_type")


@query
def global_rank(spark, d):
    ranked = rows.global_rank(table(spark, d, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")])
    return out(ranked, "c_custkey", "c_acctbal:2", "rank:l")


@query
def stats(spark, d):
    return out(summaries.stats(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice"), "o_orderstatus",
               "min_o_totalprice:2", "avg_o_totalprice:2", "max_o_totalprice:2", "record_count:l")


@query
def with_pct(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return out(summaries.with_pct(counts, "n"), "event_type", "n:l", "pct:1")


@query
def share_by(spark, d):
    return out(summaries.share_by(hourly(spark, d), "is_peak_hour", "total_hazards"), "sum_true:l", "sum_false:l",
               "pct_true:1", "pct_false:1")


@query
def top_n(spark, d):
    return out(rows.top_n(table(spark, d, "orders"), "o_totalprice", 10, ["o_orderkey"]), "o_orderkey", "o_totalprice:2")


@query
def assign_region(spark, d):
    return out(shape.assign_region(stations(spark, d), fixed.REGION_BOXES), "objectid", "region")


@query
def display_name(spark, d):
    df = stations(spark, d).withColumn("name", C.display_name("station_name", "station_address", "objectid"))
    return out(df, "objectid", "name")


@query
def attach_scalars(spark, d):
    nations = table(spark, d, "nation")
    totals = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("top_balance"))
    return out(rows.attach_scalars(nations, totals), "n_nationkey:i", "n_name", "customers:l", "top_balance:2")


# --- files and streams ------------------------------------------------------------------------------------------

@query
def read_csv_raw(spark, d):
    """Stations written as CSV, read back with the fixed schema and cleaned."""
    path = shared_dir(spark)
    raw = view(spark, d, "stations_raw")
    names = [f.name for f in files.T.StructType.fromDDL(files.STATIONS_CSV)]
    files.write_csv(raw.toDF(*names), path)
    back = silver.silver_stations(files.read_csv_raw(spark, path, files.STATIONS_CSV), AS_OF)
    return out(back, "objectid", "station_name", "station_address", "charger__type", "charger_rating_kw:3", "charging_speed",
               "latitude:6", "longitude:6")


@query
def unwrap_envelope(spark, d):
    """Prices in envelopes of one record each, so that no group has to be gathered to write them."""
    path = shared_dir(spark)
    record = F.struct("stationcode", "fueltype", "price")
    view(spark, d, "fuel_raw").select(F.array(record).alias("prices")).write.json(path)
    schema = "prices array<struct<stationcode:string, fueltype:string, price:double>>"
    rows_back = files.unwrap_envelope(spark.read.schema(schema).json(path))
    return out(rows_back, "stationcode", "fueltype", "price:3")


@query
def unwrap_envelope_mixed(spark, d):
    """Documents of five kinds: one record, many, an empty preferred list, other keys, and lists of two record types."""
    path = shared_dir(spark)
    kind = F.col("tie_key") % 5
    record = F.struct("stationcode", "fueltype", "price")
    other = F.array(F.struct("stationcode", F.col("price").cast("string").alias("price"), F.col("fueltype").alias("note")))
    price_list = F.when(kind.isin(0, 2), F.array(record)).when(kind == 3, F.slice(F.array(record), 1, 0)).when(kind == 4, F.array(record, record))
    codes = F.array(F.struct(F.col("stationcode").alias("code")))
    view(spark, d, "fuel_raw").select(F.when(kind == 2, codes).when(kind == 1, F.slice(codes, 1, 0)).alias("stations"), price_list.alias("prices"),
                                      F.when(kind.isin(1, 3), other).alias("items")).write.json(path)
    schema = ("stations array<struct<code:string>>, prices array<struct<stationcode:string, fueltype:string, price:double>>, "
              "items array<struct<stationcode:string, price:string, note:string>>")
    rows_back = files.unwrap_envelope(spark.read.schema(schema).json(path))
    return out(rows_back, "stationcode", "fueltype", "price:3", "note", "code")


@query
def flatten_geojson(spark, d):
    path = shared_dir(spark)
    raw = view(spark, d, "hazards_raw")
    def ms(c):
        return F.unix_millis(F.date_trunc("second", F.col(c).cast("timestamp")))
    # Half of the features spell the key in capitals.
    key = F.map_from_arrays(F.array(F.when(F.col("event_id") % 2 == 0, "id").otherwise("ID")), F.array("hazard_id"))
    rest = F.struct("headline", "location", ms("start_time_ts").alias("start"), ms("end_time_ts").alias("end"),
                    F.when(F.col("is_major"), True).alias("isMajor"), F.col("impact").alias("impactingNetwork"),
                    F.col("main_category").alias("mainCategory"))
    properties = F.map_concat(key, F.from_json(F.to_json(rest), "map<string,string>"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    raw.select(F.lit("FeatureCollection").alias("type"),
               F.array(F.struct(properties.alias("properties"), geometry.alias("geometry"))).alias("features")).write.json(path)
    flat = files.flatten_geojson(spark.read.schema(files.HAZARDS_GEOJSON).json(path), as_of=AS_OF)
    return out(flat, "hazard_id", "hazard_type", "headline", "location", "start_time", "end_time", "is_major", "impact",
               "main_category", "latitude:6", "longitude:6", "description")


@query
def flatten_weather(spark, d):
    path = shared_dir(spark)
    raw = view(spark, d, "weather_raw")
    current = F.struct(F.date_format("obs_ts", "yyyy-MM-dd'T'HH:mm").alias("time"),
                       F.col("temperature_celsius").alias("temperature"),
                       F.col("wind_speed_kmh").cast("double").alias("windspeed"), (F.col("tie_key") % 9).cast("int").alias("weathercode"))
    raw.select("station_id", current.alias("current_weather")).write.json(path)
    sites = raw.select("station_id", F.concat(F.lit("Site "), "station_id").alias("station_name"), "location_lat",
                       "location_lon").distinct()
    flat = files.flatten_weather(spark.read.schema(files.WEATHER_RESPONSE).json(path), sites, as_of=AS_OF)
    return out(flat, "station_id", "station_name", "location_lat:4", "location_lon:4", "timestamp:t", "temperature_celsius:8",
               "wind_speed_kmh:1", "weather_condition", "humidity_percent")


def _run(spark, feed: str, landed: DataFrame) -> DataFrame:
    """Land a feed as JSON, run bronze and silver once over what is new, return the silver table."""
    base = shared_dir(spark)
    landed.write.json(f"{base}/landing")
    flows.run_bronze(spark, feed, f"{base}/landing", f"{base}/bronze", f"{base}/cp_bronze", as_of=AS_OF).awaitTermination()
    flows.run_silver(spark, feed, f"{base}/bronze", f"{base}/silver", f"{base}/cp_silver", as_of=AS_OF).awaitTermination()
    return spark.read.parquet(f"{base}/silver")


@query
def stream_silver_hazards(spark, d):
    return out(_run(spark, "hazards", hazards_landing(spark, d)), *FEED_HAZARD)


@query
def stream_dedup(spark, d):
    """Every station lands twice; one of each is left."""
    landed = view(spark, d, "stations_landing")
    return out(_run(spark, "stations", landed.unionByName(landed)), *FEED_STATION)


@query
def stream_silver_fuel(spark, d):
    landed = view(spark, d, "fuel_raw").select("stationcode", "fueltype", "price",
                                               F.date_format("last_updated_ts", fixed.FEED_TIME_FORMAT).alias("lastupdated"))
    return out(_run(spark, "fuel", landed), "stationcode", "fuel_type", "price:3", "fuel_category", "price_updated_timestamp:t")


@query
def stream_silver_weather(spark, d):
    return out(_run(spark, "weather", view(spark, d, "weather_landing")),
               "station_id", "weather", "weather_category", "temperature_c:8", "humidity_percent:2", "latitude:4", "longitude:4")


def _three_landings(spark, d, run) -> str:
    """Stations land in three parts; ``run(base, schema)`` is called after each. Returns the base folder."""
    base = shared_dir(spark)
    landed = view(spark, d, "stations_landing")
    part = F.pmod(F.xxhash64("StationID", "Latitude", "Longitude"), F.lit(3))
    for i in range(3):
        landed.filter(part == i).write.mode("append").json(f"{base}/landing")
        run(base, landed.schema)
    return base


@query
def stream_gold_regional(spark, d):
    """Regional totals folded batch by batch from the silver stream over three landings."""
    def run(base, _):
        flows.run_bronze(spark, "stations", f"{base}/landing", f"{base}/bronze", f"{base}/cp_bronze", as_of=AS_OF).awaitTermination()
        bronze = spark.readStream.schema(spark.read.parquet(f"{base}/bronze").schema).parquet(f"{base}/bronze")
        batches.start_regional(flows.silver_stations_stream(bronze, as_of=AS_OF), f"{base}/gold", f"{base}/cp_gold").awaitTermination()
    base = _three_landings(spark, d, run)
    return out(batches.read_regional(spark, f"{base}/gold", AS_OF), "region", "total_stations:l", "total_plugs:l", "total_capacity_kw:2",
               "avg_capacity_kw:2", "fast_charger_count:l", "ev_readiness_score:0")


@query
def stream_with_stops(spark, d):
    """Cleaned stations through a sink by batch id; after each landing the last batch is forgotten and comes again."""
    def run(base, schema):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{base}/landing")
        clean = feeds.feed_station_columns(stream, AS_OF)
        for _ in range(2):
            batches.start(clean, f"{base}/silver", f"{base}/cp").awaitTermination()
            last = batches._batches(spark, f"{base}/silver")[-1]
            batches._remove(spark, f"{base}/cp/commits/{last}")
    base = _three_landings(spark, d, run)
    return out(batches.read(spark, f"{base}/silver"), *FEED_STATION)


@query
def stream_rule_counts(spark, d):
    """Rule counts observed per batch, added up."""
    def run(base, schema):
        stream = shape.rename(spark.readStream.schema(schema).json(f"{base}/landing"), fixed.STATION_FEED_NAMES)
        batches.start_checked(stream, fixed.STATION_RULES, f"{base}/silver", f"{base}/counts", f"{base}/cp").awaitTermination()
    base = _three_landings(spark, d, run)
    return out(batches.rule_counts(spark, f"{base}/counts"), "rule", "passed:l", "dropped:l")


@query
def stream_landing_fields(spark, d):
    """A field that appears after the first start, a hinted type, and lines that do not parse."""
    base = shared_dir(spark)
    raw = view(spark, d, "hazards_raw")
    known = ["event_id", "headline", "is_major", "latitude"]
    def land(rows, names):
        line = F.to_json(F.struct(*names))
        broken = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))
        rows.select(F.when(F.col("event_id") % 50 == 7, broken).otherwise(line).alias("value")).write.mode("append").text(f"{base}/landing")
    for part, names in ((0, known), (1, [*known, "location", "impact"])):
        land(raw.filter(F.col("event_id") % 2 == part), names)
        schema = landings.remembered_schema(spark, f"{base}/landing", f"{base}/schema", hints="is_major string, latitude double, event_id bigint")
        flows.start(landings.landed(spark, f"{base}/landing", schema), f"{base}/bronze", f"{base}/cp").awaitTermination()
    got = spark.read.parquet(f"{base}/bronze")
    return out(got.withColumn("has_file", F.col("source_file").contains("/landing/")), "event_id", "headline", "is_major", "latitude:6",
               landings.RESCUED, landings.CORRUPT, "has_file")


@query
def keyed_append(spark, d):
    """Two overlapping appends to a keyed table, the second one twice."""
    orders = KeyedTable(shared_dir(spark), ["o_custkey"], buckets=8)
    rows_ = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    orders.append(rows_.filter("o_orderkey % 3 < 2"), ["o_orderkey"])
    for _ in range(2):
        orders.append(rows_.filter("o_orderkey % 3 > 0 and o_custkey % 5 = 1"), ["o_orderkey"])
    return out(orders.read(spark), "o_custkey:l", "o_orderkey:l", "o_totalprice:2")


@query
def layout_tables(spark, d):
    """Layer tables end to end: overwritten, appended to, skipped when empty, and read as a stream."""
    base = shared_dir(spark)
    lake = Layout(f"{base}/lake")
    nations = table(spark, d, "nation")
    lake.write(table(spark, d, "supplier"), "bronze", "places")
    lake.write(nations.filter("n_regionkey < 2"), "bronze", "places", cluster_by=["n_nationkey"])
    lake.append(nations.filter("n_regionkey >= 2"), "bronze", "places")
    lake.write(nations.limit(0), "bronze", "places", skip_empty=True)
    stream = lake.read_stream(spark, "bronze", "places").select("n_nationkey", F.initcap(F.lower("n_name")).alias("name"))
    flows.start(stream, lake.path("silver", "places"), f"{base}/cp").awaitTermination()
    return out(shape.with_ingest_meta(lake.read(spark, "silver", "places"), "lake", AS_OF), "n_nationkey:i", "name", "source_system",
               "ingestion_timestamp:t")


@query
def stream_latest_weather(spark, d):
    """The newest reading per site, over landings that repeat rows and bring old ones late."""
    base = shared_dir(spark)
    readings = view(spark, d, "weather_raw").select("station_id", F.col("obs_ts").cast("timestamp").alias("obs_ts"), "temperature_celsius")
    part = F.pmod(F.xxhash64("obs_ts"), F.lit(3))
    for i in range(3):
        readings.filter((part == i) | (part == 0)).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        stream = spark.readStream.schema(readings.schema).parquet(f"{base}/landing")
        latest = states.latest_stream(stream, ["station_id"], "obs_ts", "20000 days")
        batches.start(latest, f"{base}/out", f"{base}/cp", mode="update").awaitTermination()
    return out(states.latest_rows(batches.read(spark, f"{base}/out"), ["station_id"]), "station_id", "obs_ts:t")
