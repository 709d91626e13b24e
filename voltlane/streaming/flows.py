"""Streaming flows. The cleaning functions are the batch ones of ``plans.feeds``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..functions.columns import now_col
from ..operators.shape import rename, with_provenance
from ..plans import feeds
from ..sources.files import FEED_SCHEMAS, stream_landing

AVAILABLE_NOW = "available_now"


def bronze_stream(spark: SparkSession, feed: str, src: str, label: str = feeds.LABEL, schema=None, as_of=None,
                  max_files: int = 1000, corrupt_col: str | None = None) -> DataFrame:
    """Newly landed files of one feed with load time, file and label."""
    landed = stream_landing(spark, src, schema or FEED_SCHEMAS[feed], max_files=max_files, corrupt_col=corrupt_col)
    return with_provenance(landed, label).withColumn("ingestion_timestamp", now_col(as_of))


def silver_hazards_stream(df: DataFrame, as_of=None) -> DataFrame:
    return feeds.feed_hazards(df, as_of)


def silver_fuel_stream(df: DataFrame, as_of=None) -> DataFrame:
    return feeds.feed_fuel(df, as_of)


def silver_weather_stream(df: DataFrame, as_of=None) -> DataFrame:
    return feeds.feed_weather(df, as_of)


def silver_stations_stream(df: DataFrame, within: str | None = None, event_time: str = "ingestion_timestamp",
                           as_of=None) -> DataFrame:
    """One row per station id, the first to arrive.

    Without ``within`` the state holds every id ever seen and grows for as long as the stream runs. With it
    (for example "7 days") ids are forgotten after that span, and a copy that arrives later passes."""
    if within:
        # Only the key and event time matter for the state; rules first keep bad rows out of it.
        clean = feeds.feed_station_columns(df.withWatermark(event_time, within), as_of)
        return clean.dropDuplicatesWithinWatermark(["station_id"])
    return feeds.feed_station_columns(df, as_of).dropDuplicates(["station_id"])


SILVER: dict[str, Callable[..., DataFrame]] = {
    "stations": silver_stations_stream,
    "hazards": silver_hazards_stream,
    "fuel": silver_fuel_stream,
    "weather": silver_weather_stream,
}


def start(df: DataFrame, out: str, checkpoint: str, trigger: str = AVAILABLE_NOW, fmt: str = "parquet") -> StreamingQuery:
    """Append a stream to a table folder. ``trigger`` is "available_now" for one run over what is new, or an
    interval such as "5 minutes". The checkpoint remembers which files were read; a full refresh is a run with
    a new checkpoint and a new output folder."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger == AVAILABLE_NOW else writer.trigger(processingTime=trigger)
    return writer.start(out)


def run_bronze(spark: SparkSession, feed: str, src: str, out: str, checkpoint: str,
               trigger: str = AVAILABLE_NOW, **options) -> StreamingQuery:
    return start(bronze_stream(spark, feed, src, **options), out, checkpoint, trigger)


def run_silver(spark: SparkSession, feed: str, bronze: str, out: str, checkpoint: str,
               trigger: str = AVAILABLE_NOW, **options) -> StreamingQuery:
    """Clean what arrived in a bronze folder since the last run."""
    schema = spark.read.parquet(bronze).schema
    stream = spark.readStream.schema(schema).parquet(bronze)
    return start(SILVER[feed](stream, **options), out, checkpoint, trigger)


def run_gold(spark: SparkSession, stations: str, hazards: str, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(regional metrics, smart recommendations) over the silver folders as they are now.

    Hazards that have ended since they were written are left out."""
    s, h = spark.read.parquet(stations), spark.read.parquet(hazards)
    h = feeds.active_filter(h, as_of)
    return feeds.feed_regional(s, as_of), feeds.feed_smart(s, h, as_of=as_of)


def progress(query: StreamingQuery) -> list[dict]:
    """Per micro-batch: rows in, rates, duration, watermark, rows in state, observed rule counts."""
    out = []
    for p in query.recentProgress:
        out.append({
            "batch": p["batchId"], "rows": p["numInputRows"],
            "input_rate": p.get("inputRowsPerSecond"), "processing_rate": p.get("processedRowsPerSecond"),
            "duration_ms": p["durationMs"].get("triggerExecution"),
            "watermark": p.get("eventTime", {}).get("watermark"),
            "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"]),
            "observed": p.get("observedMetrics", {}),
        })
    return out


def station_names(df: DataFrame) -> DataFrame:
    """Feed names of station columns as the tables use them."""
    return rename(df, fixed.STATION_FEED_NAMES)
