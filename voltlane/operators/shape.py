"""Projection helpers: names, hints, metadata columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ColumnLike, as_col, hour_and_day, is_true, now_col


LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def snake_case(name: str) -> str:
    """Words in small letters with underscores between them. A word starts at a capital that follows a small letter or a
    digit, or that a small letter follows; a run of blanks and hyphens is an underscore of its own, so "Charger Type"
    becomes "charger__type"."""
    out = []
    for before, c, after in zip(" " + name, name, name[1:] + " ", strict=False):
        gap = c.isspace() or c == "-"
        if c in UPPER and out and (before in LOWER or before.isdigit() or after in LOWER):
            out.append("_")
        if not gap:
            out.append(c.lower())
        elif not out or not (before.isspace() or before == "-"):
            out.append("_")
    return "".join(out)


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def blank_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna("", subset=[c for c in cols if c in df.columns])


def stamp(df: DataFrame, name: str, as_of=None, kind: str | None = None) -> DataFrame:
    """Add a processing-time column; ``kind="date"`` gives the day."""
    col = now_col(as_of)
    return df.withColumn(name, col.cast(kind) if kind else col)


def with_ingest_meta(df: DataFrame, source: str, as_of=None) -> DataFrame:
    return df.withColumns({"ingestion_timestamp": now_col(as_of), "source_system": F.lit(source)})


def with_provenance(df: DataFrame, label: str) -> DataFrame:
    """File each row came from (works on batch and streaming file sources) and a label."""
    return df.withColumns({"source_file": F.col("_metadata.file_path"), "pipeline_source": F.lit(label)})


def small_dim(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Literal dimension with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def apply_hints(schema: T.StructType, ddl: str) -> T.StructType:
    """Force the types of the named columns; columns the schema lacks are added."""
    hints = {f.name.lower(): f for f in T.StructType.fromDDL(ddl).fields}
    merged = [hints.pop(f.name.lower(), f) for f in schema.fields]
    return T.StructType(merged + list(hints.values()))


def flag(df: DataFrame, name: str, predicate: Column) -> DataFrame:
    """Boolean quality flag that is never null."""
    return df.withColumn(name, is_true(predicate))


def temporal_features(df: DataFrame, ts: ColumnLike, tz: str | None = None) -> DataFrame:
    return df.withColumns(hour_and_day(ts, tz))


def assign_region(df: DataFrame, boxes, lat: str = "latitude", lon: str = "longitude",
                  default: str = "Other", name: str = "region") -> DataFrame:
    """First box that holds the point. Boxes are a short literal list, so this stays one CASE."""
    return df.withColumn(name, region_of(boxes, lat, lon, default))


def region_of(boxes, lat: ColumnLike, lon: ColumnLike, default: str) -> Column:
    from ..functions.columns import first_match
    la, lo = as_col(lat), as_col(lon)
    return first_match([(la.between(a, b) & lo.between(c, d), label) for label, a, b, c, d in boxes], default)
