"""Landed files: CSV, JSON feeds, envelopes, GeoJSON, weather responses; and results for callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.columns import epoch_ms
from ..operators.shape import blank_nulls, small_dim, with_ingest_meta

# --- schemas (fixed values: the columns each feed delivers) -----------------------------------------

STATIONS_CSV = ("OBJECTID bigint, STATION_NAME string, STATION_ADDRESS string, LGANAME string, PCODE bigint, "
                "OPERATOR string, `Charger Type` string, NUMBER_OF_PLUGS bigint, CHARGER_RATING string, "
                "LATITUDE double, LONGITUDE double")
STATIONS_FEED = ("StationID string, OperatorName string, AddressLine1 string, Suburb string, State string, "
                 "Postcode string, Latitude double, Longitude double, NumberOfPlugs int, ChargerType string, "
                 "ChargingPowerKW double")
HAZARDS_FEED = ("hazard_id string, headline string, location string, created string, lastUpdated string, "
                "`end` string, isMajor boolean, isImpactNetwork boolean, latitude double, longitude double")
FUEL_FEED = "stationcode string, state string, fueltype string, price double, lastupdated string"
WEATHER_FEED = ("station_id string, weather string, temperature_c double, humidity_percent double, "
                "latitude double, longitude double")
FEED_SCHEMAS = {"stations": STATIONS_FEED, "hazards": HAZARDS_FEED, "fuel": FUEL_FEED, "weather": WEATHER_FEED}

# Properties are read as a map: several keys occur in two spellings that differ only in case, and map keys, unlike
# struct fields, are always told apart. Values that are not text arrive as their JSON text.
HAZARDS_GEOJSON = ("type string, features array<struct<properties:map<string,string>,"
                   "geometry:struct<type:string,coordinates:array<double>>>>")
WEATHER_RESPONSE = ("station_id string, current_weather struct<time:string,temperature:double,windspeed:double,"
                    "weathercode:int>")
OPTIONAL_HAZARD_TEXT = ["description", "advice", "location", "sub_category"]


# --- reading ---------------------------------------------------------------------------------------

def read_csv_raw(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
                 multi_line: bool = True) -> DataFrame:
    """CSV with a header, quoted fields that may hold line breaks, and `"` as escape.

    A file with ``multi_line`` cannot be split among tasks, so turn it off for large files without line breaks
    in fields. Without a schema the types are inferred, which costs a pass."""
    reader = (spark.read.option("header", True).option("multiLine", multi_line)
              .option("quote", '"').option("escape", '"'))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def stream_landing(spark: SparkSession, path: str, schema: str | T.StructType | None, fmt: str = "json",
                   max_files: int = 1000, corrupt_col: str | None = None) -> DataFrame:
    """Stream of newly landed files. ``corrupt_col`` keeps lines that do not parse, as text, in that column.
    ``schema=None`` infers it, once per start, where the session allows streaming schema inference."""
    reader = spark.readStream.format(fmt).option("maxFilesPerTrigger", max_files)
    if schema is not None:
        struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if corrupt_col:
            struct = T.StructType(struct.fields + [T.StructField(corrupt_col, T.StringType())])
            reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_col)
        reader = reader.schema(struct)
    return reader.load(path)


def unwrap_envelope(df: DataFrame, prefer: str = "prices") -> DataFrame:
    """Records of JSON documents, each by its own content: the list under ``prefer`` where the document has one, even
    if it is empty, else its first list that is not empty. A document with neither fails.

    Lists of different record types give the columns of all, by name; a column that two types hold differently comes
    as text. Documents that are lists arrive from the JSON reader as rows already and pass through; read them apart
    from documents with fields, from which their rows cannot be told."""
    lists = {f.name: f.dataType.elementType for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)
             and isinstance(f.dataType.elementType, T.StructType)}
    if not lists:
        if any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in df.schema.fields):
            raise ValueError("no list of records in the document")
        return df
    kinds: dict[str, list[T.DataType]] = {}
    for record in lists.values():
        for f in record.fields:
            kinds.setdefault(f.name, []).append(f.dataType)

    def value(record: Column, fields: T.StructType, name: str) -> Column:
        one_kind = all(k == kinds[name][0] for k in kinds[name])
        if name not in fields.fieldNames():
            return F.lit(None).cast(kinds[name][0] if one_kind else "string")
        found = record[name]
        if one_kind:
            return found
        nested = isinstance(fields[name].dataType, (T.StructType, T.ArrayType, T.MapType))
        return F.to_json(found) if nested else found.cast("string")

    def records(name: str) -> Column:
        return F.transform(F.col(f"`{name}`"), lambda r: F.struct(*[value(r, lists[name], n).alias(n) for n in kinds]))

    choices = [F.when(F.size(F.col(f"`{n}`")) > 0, records(n)) for n in lists if n != prefer]
    if prefer in lists:
        choices.insert(0, records(prefer))
    chosen = F.coalesce(*choices, F.raise_error(F.lit("no list of records in the document")))
    return df.select(F.explode(chosen).alias("_r")).select("_r.*")


def flatten_geojson(df: DataFrame, hazard_type: str | None = None, source: str = "traffic-hazards",
                    as_of=None) -> DataFrame:
    """One row per feature of a FeatureCollection, in the columns of the hazards table.

    Read the files with ``HAZARDS_GEOJSON``; documents of another type are left out."""
    p, g = "_f.properties", "_f.geometry"

    def prop(*names: str) -> Column:
        return F.coalesce(*[F.col(p)[n] for n in names])

    def flag(name: str) -> Column:
        return prop(name).try_cast("boolean")

    xy = F.col(f"{g}.coordinates")

    def coordinate(i: int) -> Column:
        return F.when(F.size(xy) >= 2, xy[i])
    kind = F.lit(hazard_type) if hazard_type else F.coalesce(F.lower(prop("mainCategory")), F.lit("unknown"))
    roads = prop("roads")
    rows = (df.filter(F.col("type") == "FeatureCollection").select(F.explode("features").alias("_f"))
            .select(F.coalesce(prop("id", "ID"), F.lit("")).alias("hazard_id"),
                    kind.alias("hazard_type"),
                    prop("headline", "Headline").alias("headline"),
                    prop("description").alias("description"),
                    F.when(~roads.isin("", "[]"), roads).alias("roads"),
                    prop("advice").alias("advice"),
                    prop("location").alias("location"),
                    epoch_ms(prop("start", "Start")).alias("start_time"),
                    epoch_ms(prop("end", "End")).alias("end_time"),
                    epoch_ms(prop("created", "Created")).alias("created"),
                    epoch_ms(prop("lastUpdated", "LastUpdated")).alias("last_updated"),
                    F.coalesce(flag("isMajor"), F.lit(False)).alias("is_major"),
                    flag("impactingNetwork").alias("impact"),
                    prop("mainCategory").alias("main_category"),
                    prop("subCategory").alias("sub_category"),
                    coordinate(1).alias("latitude"), coordinate(0).alias("longitude"),
                    F.col(f"{g}.type").alias("geometry_type")))
    return with_ingest_meta(blank_nulls(rows, OPTIONAL_HAZARD_TEXT), source, as_of)


def weather_sites(spark: SparkSession) -> DataFrame:
    return small_dim(spark, fixed.WEATHER_SITES,
                     "station_id string, station_name string, location_lat double, location_lon double")


def flatten_weather(df: DataFrame, sites: DataFrame, source: str = "open-meteo", as_of=None) -> DataFrame:
    """Current-weather responses with the site they belong to; of an unknown site only the id. The endpoint carries neither humidity nor
    precipitation, so those two stay null; the condition is the weather code as text."""
    w = "current_weather"
    rows = (df.filter(F.col(w).isNotNull()).join(sites, "station_id", "left")
            .select("station_id", "station_name", "location_lat", "location_lon",
                    F.try_to_timestamp(F.col(f"{w}.time")).alias("timestamp"),
                    F.col(f"{w}.temperature").alias("temperature_celsius"),
                    F.lit(None).cast("double").alias("humidity_percent"),
                    F.lit(None).cast("double").alias("precipitation_mm"),
                    F.col(f"{w}.windspeed").alias("wind_speed_kmh"),
                    F.col(f"{w}.weathercode").cast("string").alias("weather_condition")))
    return with_ingest_meta(rows, source, as_of)


def decode_weather(df: DataFrame, codes: DataFrame, code: str = "code", text: str = "condition") -> DataFrame:
    """Replace weather codes by their texts before cleaning; codes without a text stay as they are."""
    named = codes.select(F.col(code).cast("string").alias("weather_condition"), F.col(text).alias("_text"))
    return (df.join(named, "weather_condition", "left")
            .withColumn("weather_condition", F.coalesce("_text", "weather_condition"))
            .select(*df.columns))


def sample_hazards(spark: SparkSession) -> DataFrame:
    """Two made-up hazards in the shape of the hazards table, for trying things out without a feed."""
    schema = ("hazard_id string, hazard_type string, headline string, description string, roads string, "
              "advice string, location string, start_time string, end_time string, created string, "
              "last_updated string, is_major boolean, impact boolean, main_category string, sub_category string, "
              "latitude double, longitude double, geometry_type string")
    rows = [
        ("S1", "roadwork", "Bridge resurfacing", "Two lanes closed", "Main Rd", "Reduce speed", "Harbour crossing",
         "2024-01-10T20:00:00Z", "2024-01-20T05:00:00Z", "2024-01-08T01:00:00Z", "2024-01-11T02:30:00Z",
         False, True, "Scheduled Roadwork", "Resurfacing", -33.852, 151.211, "Point"),
        ("S2", "incident", "Car broken down", "One lane blocked", "Ring Rd", "Exercise caution", "Western ring",
         "2024-01-12T07:10:00Z", None, "2024-01-12T07:12:00Z", "2024-01-12T07:40:00Z",
         True, True, "Hazard", "Breakdown", -33.815, 151.003, "Point"),
    ]
    return small_dim(spark, rows, schema)


# --- results ---------------------------------------------------------------------------------------

def to_records(df: DataFrame, limit: int) -> list[Row]:
    """At most ``limit`` rows for a caller outside Spark; the bound is not optional."""
    return df.limit(limit).collect()


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)
