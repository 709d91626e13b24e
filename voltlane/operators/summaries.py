"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ColumnLike, as_col, sum_where


def distribution(df: DataFrame, col: str, order: str = "count") -> DataFrame:
    """Rows per value, largest first (or by value with ``order="key"``)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))
    by = [F.col(col)] if order == "key" else [F.desc("row_count"), F.col(col)]
    return counts.orderBy(*by)


def stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    c = F.col(col)
    return df.groupBy(*by).agg(F.min(c).alias(f"min_{col}"), F.avg(c).alias(f"avg_{col}"),
                               F.max(c).alias(f"max_{col}"), F.count(F.lit(1)).alias("record_count"))


def with_pct(df: DataFrame, count_col: str, name: str = "pct", digits: int = 1) -> DataFrame:
    """Share of each row in the total. The total is a scalar subquery, so no task sees all groups."""
    total = df.agg(F.sum(count_col)).scalar()
    return df.withColumn(name, F.round(F.try_divide(F.col(count_col) * 100.0, total), digits))


def share_by(df: DataFrame, flag: ColumnLike, x: ColumnLike) -> DataFrame:
    """Sum of ``x`` split by a boolean, with both shares; one row."""
    one = df.agg(sum_where(as_col(flag), x).alias("sum_true"), F.sum(as_col(x)).alias("sum_all"))
    return one.select(
        "sum_true", (F.col("sum_all") - F.col("sum_true")).alias("sum_false"),
        F.round(F.try_divide(F.col("sum_true") * 100.0, F.col("sum_all")), 1).alias("pct_true"),
        F.round(F.try_divide((F.col("sum_all") - F.col("sum_true")) * 100.0, F.col("sum_all")), 1).alias("pct_false"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and the largest value: bin (1-based), lower edge, rows.

    The largest value belongs to the last bin; empty bins are left out."""
    c = F.col(col).cast("double")
    ends = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))).scalar()
    placed = df.filter(c.isNotNull()).select(c.alias("v"), ends.alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    # When all values are equal the width is 0 and everything belongs to the first bin.
    index = F.least(F.lit(bins), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("e.lo"), width)) + 1, F.lit(1)))
    return (placed.select(index.cast("int").alias("bin"), (F.col("e.lo") + width * (index - 1)).alias("lower_edge"))
            .groupBy("bin").agg(F.min("lower_edge").alias("lower_edge"), F.count(F.lit(1)).alias("row_count")))


def top_operators(df: DataFrame, n: int = 10, score: str | None = None) -> DataFrame:
    """Operators with the most stations, or with the best mean score."""
    aggs = [F.count(F.lit(1)).alias("station_count")]
    if score:
        aggs.append(F.avg(score).alias("avg_score"))
    grouped = df.groupBy("operator").agg(*aggs)
    return grouped.orderBy(F.desc("avg_score" if score else "station_count"), "operator").limit(n)


def long_form(df: DataFrame, ids: Sequence[str], values: dict[str, str], name: str, value: str) -> DataFrame:
    """Columns to rows; ``values`` maps column to label."""
    rows = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for c, label in values.items()])
    return df.select(*ids, F.inline(rows))


def metric_rows(one_row: DataFrame, section: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A one-row result as rows (section, label, value)."""
    cols = list(columns or one_row.columns)
    rows = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("label"),
                              F.col(c).cast("double").alias("value")) for c in cols])
    return one_row.select(F.inline(rows))


def labelled(df: DataFrame, section: str, label: Column | str, value: Column | str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), as_col(label).cast("string").alias("label"),
                     as_col(value).cast("double").alias("value"))
