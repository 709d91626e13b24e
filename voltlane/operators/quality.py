"""Data quality: expectations, quarantine, reports, parity of two builds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_true


def _all(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def _rules(rules: Mapping[str, str]) -> dict[str, Column]:
    """Named predicates; a rule that evaluates to null has not passed."""
    return {name: is_true(F.expr(sql)) for name, sql in rules.items()}


def expect_all_or_drop(df: DataFrame, rules: Mapping[str, str], observe: str | Observation | None = None) -> DataFrame:
    """Keep rows for which every rule IS TRUE. ``observe`` counts passes and failures per rule on the way,
    without another pass (read it from the Observation, or from the progress of a stream)."""
    preds = _rules(rules)
    if observe is not None:
        counts = [F.count(F.lit(1)).alias("rows")]
        for name, p in preds.items():
            counts += [F.count_if(p).alias(f"{name}_passed"), F.count_if(~p).alias(f"{name}_dropped")]
        df = df.observe(observe, *counts)
    return df.filter(_all(preds.values()))


def expectation_report(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """rule, passed, dropped; one pass for all rules."""
    preds = _rules(rules)
    one = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(p).alias(n) for n, p in preds.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("passed"),
                               (F.col("_total") - F.col(n)).alias("dropped")) for n in preds])
    return one.select(F.inline(pairs))


def split_quarantine(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with the list of failed rules)."""
    preds = _rules(rules)
    failed = F.array_compact(F.array(*[F.when(~p, F.lit(n)) for n, p in preds.items()]))
    bad = df.withColumn("failed_rules", failed).filter(F.size("failed_rules") > 0)
    return expect_all_or_drop(df, rules), bad


def flagged_sample(df: DataFrame, flags: Sequence[str], key: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows, by key, that fail any flag."""
    any_failed = reduce(lambda a, b: a | b, [~is_true(F.col(f)) for f in flags])
    return df.filter(any_failed).orderBy(*key).limit(n)


def dq_report(df: DataFrame, flags: Sequence[str], shares: Sequence[str] = ()) -> DataFrame:
    """check, total, hits, pct. Flags count the rows that fail, ``shares`` the rows where the column is true.

    One aggregate feeds all rows; an empty table gives zeros."""
    hits = {f: F.count_if(~is_true(F.col(f))) for f in flags} | {s: F.count_if(is_true(F.col(s))) for s in shares}
    one = df.agg(F.count(F.lit(1)).alias("_total"), *[h.alias(n) for n, h in hits.items()])
    pct = lambda n: F.coalesce(F.round(F.try_divide(F.col(n) * 100.0, F.col("_total")), 2), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col("_total").alias("total"),
                              F.col(n).alias("hits"), pct(n).alias("pct")) for n in hits])
    return one.select(F.inline(rows))


def parity_counts(a: DataFrame, b: DataFrame, labels: Sequence[str] = ("batch", "feed")) -> DataFrame:
    """source, row_count for two builds of a table."""
    def count(df, label):
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(label).alias("source"), "row_count")
    return count(a, labels[0]).unionByName(count(b, labels[1]))


def parity_report(a: DataFrame, b: DataFrame, rules: Mapping[str, str] | None = None,
                  tolerance: float = 0.05, min_pass: float = 0.95) -> DataFrame:
    """check, value, passed: row counts within the tolerance, same columns and types, pass rate of the rules
    over ``b``."""
    same_schema = ({(f.name, f.dataType.simpleString()) for f in a.schema}
                   == {(f.name, f.dataType.simpleString()) for f in b.schema})
    good = _all(_rules(rules or {}).values())
    left = a.agg(F.count(F.lit(1)).alias("n"))
    right = b.agg(F.count(F.lit(1)).alias("rows_b"), F.count_if(good).alias("good"))
    one = right.withColumn("rows_a", left.scalar())
    drift = F.coalesce(F.abs(F.try_divide(F.col("rows_b") - F.col("rows_a"), F.col("rows_a"))),
                       F.when(F.col("rows_b") == 0, 0.0).otherwise(1.0))
    rate = F.coalesce(F.try_divide(F.col("good"), F.col("rows_b")), F.lit(1.0))
    def row(name, value, passed):
        return F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), passed.alias("passed"))
    return one.select(F.inline(F.array(
        row("row_count_drift", F.round(drift, 6), drift <= tolerance),
        row("same_schema", F.lit(1.0 if same_schema else 0.0), F.lit(same_schema)),
        row("pass_rate", F.round(rate, 6), rate > min_pass))))


def table_counts(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """table_name, row_count for the tables that exist (null for the others), and a closing total."""
    parts = []
    for name in names:
        if spark.catalog.tableExists(name):
            parts.append(spark.table(name).agg(F.count(F.lit(1)).alias("row_count")))
        else:
            parts.append(spark.range(1).select(F.lit(None).cast("bigint").alias("row_count")))
    counts = [p.select(F.lit(n).alias("table_name"), "row_count") for n, p in zip(names, parts)]
    each = reduce(lambda x, y: x.unionByName(y), counts)
    return (each.rollup("table_name").agg(F.sum("row_count").alias("row_count"))
            .select(F.coalesce("table_name", F.lit("total")).alias("table_name"), "row_count"))
