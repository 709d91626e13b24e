"""Small column builders shared by every layer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def now_col(as_of: str | dt.datetime | Column | None = None) -> Column:
    """The instant a query treats as "now": the clock, or a fixed value for repeatable runs."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    text = as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


# --- rules -----------------------------------------------------------------------------------------

def first_match(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """CASE expression: the first predicate that is true gives the value."""
    out = None
    for predicate, value in rules:
        out = F.when(predicate, value) if out is None else out.when(predicate, value)
    return F.lit(default) if out is None else out.otherwise(default)


def classify(col: ColumnLike, rules: Sequence[tuple[Callable[[Column], Column], object]],
             default: object = None) -> Column:
    """``first_match`` over rules that are functions of one column."""
    c = as_col(col)
    return first_match([(rule(c), value) for rule, value in rules], default)


def band(col: ColumnLike, floors: Sequence[tuple[float, object]], default: object) -> Column:
    """Label of the first floor (highest first) that the value reaches."""
    c = as_col(col)
    return first_match([(c >= floor, label) for floor, label in floors], default)


def span(col: ColumnLike, spans: Sequence[tuple[int, int, object]], default: object) -> Column:
    """Label of the closed range that holds the value."""
    c = as_col(col)
    return first_match([(c.between(lo, hi), label) for lo, hi, label in spans], default)


def lookup(col: ColumnLike, table: Mapping[object, object], default: object) -> Column:
    """Value of a small fixed table."""
    c = as_col(col)
    return first_match([(c == key, value) for key, value in table.items()], default)


def is_true(predicate: Column) -> Column:
    """Three-valued logic folded to two: null counts as false."""
    return F.coalesce(predicate, F.lit(False))


def inside(lat: ColumnLike, lon: ColumnLike, lat_range: Sequence[float], lon_range: Sequence[float]) -> Column:
    return is_true(as_col(lat).between(*lat_range) & as_col(lon).between(*lon_range))


def filled(col: ColumnLike) -> Column:
    """Text that is neither null nor empty."""
    return is_true(F.length(as_col(col)) > 0)


# --- numbers ---------------------------------------------------------------------------------------

def clamp(col: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if hi is not None:
        col = F.least(F.lit(hi), col)
    return col if lo is None else F.greatest(F.lit(lo), col)


def parse_kw(col: ColumnLike) -> Column:
    """First number in a rating text: "2 x 50 kW" gives 2.0, "AC" gives null."""
    return F.regexp_extract(as_col(col), fixed.KW_PATTERN, 1).try_cast("double")


# --- aggregates with a condition -------------------------------------------------------------------

def count_where(predicate: Column) -> Column:
    return F.count_if(predicate)


def sum_where(predicate: Column, value: ColumnLike) -> Column:
    """Sum over rows that pass; rows that fail add 0, so a group without matches gives 0."""
    return F.sum(F.when(predicate, as_col(value)).otherwise(0))


def avg_where(predicate: Column, value: ColumnLike) -> Column:
    return F.avg(F.when(predicate, as_col(value)))


def centroid(lat: ColumnLike = "latitude", lon: ColumnLike = "longitude") -> list[Column]:
    return [F.avg(as_col(lat)).alias("center_lat"), F.avg(as_col(lon)).alias("center_lon")]


# --- time ------------------------------------------------------------------------------------------

def parse_ts(col: ColumnLike, fmt: str | None = None) -> Column:
    """Text to timestamp; text that does not parse gives null, which the quality flags expect."""
    c = as_col(col)
    return F.try_to_timestamp(c) if fmt is None else F.try_to_timestamp(c, F.lit(fmt))


def epoch_ms(col: ColumnLike) -> Column:
    """Epoch milliseconds as ISO text with a trailing Z; other text passes through."""
    c = as_col(col).cast("string")
    stamp = F.to_utc_timestamp(F.timestamp_millis(c.try_cast("bigint")), F.current_timezone())
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.date_format(stamp, "SSS") != "000", F.date_format(stamp, ".SSS000")).otherwise("")
    return F.when(c.try_cast("bigint").isNotNull(), F.concat(whole, fraction, F.lit("Z"))).otherwise(c)


def local_time(ts: ColumnLike, tz: str | None = None) -> Column:
    """Wall-clock time in ``tz``; without it, in the session time zone."""
    c = as_col(ts)
    if tz is None:
        return c
    return F.convert_timezone(None, F.lit(tz), c.cast("timestamp_ntz"))


def hour_and_day(ts: ColumnLike, tz: str | None = None) -> dict[str, Column]:
    """hour_of_day 0-23, day_of_week 1 (Sunday) to 7, day_name."""
    t = local_time(ts, tz)
    day = F.dayofweek(t)
    names = {i + 1: name for i, name in enumerate(fixed.DAY_NAMES)}
    return {"hour_of_day": F.hour(t), "day_of_week": day, "day_name": lookup(day, names, "Unknown")}


# --- text ------------------------------------------------------------------------------------------

def display_name(name: ColumnLike, address: ColumnLike, key: ColumnLike) -> Column:
    """Name, else the part of the address before the first comma, else "Station <id>"."""
    def text(c):
        return F.nullif(c, F.lit(""))
    return F.coalesce(
        text(as_col(name)),
        text(F.trim(F.split_part(as_col(address), F.lit(","), F.lit(1)))),
        F.concat(F.lit("Station "), as_col(key).cast("string")),
    )


def composite_key(key: ColumnLike = "hazard_id", *parts: ColumnLike) -> Column:
    """The id, else the SHA-256 of the joined parts (null when a part is null)."""
    cols = [as_col(p) for p in (parts or ("headline", "location"))]
    return F.coalesce(as_col(key), F.sha2(F.concat(*cols), 256))


def preview(col: ColumnLike, chars: int = fixed.PREVIEW_CHARS) -> Column:
    return F.substring(as_col(col), 1, chars)
