"""Row selection, ranking and comparison of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ColumnLike, as_col
from .storage import materialize


def row_hash(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return F.xxhash64(*[F.col(c) for c in (cols or df.columns)])


def keep_latest(df: DataFrame, keys: Sequence[ColumnLike], order: Sequence[str] = (),
                tiebreak: Sequence[ColumnLike] | None = None) -> DataFrame:
    """One row per key: newest by ``order`` (descending, nulls last), then lowest by ``tiebreak``.

    Without a tie-break the row hash decides, so the survivor does not depend on how the data is
    partitioned. Keys may be expressions. The rank filter lets Spark keep one row per key and map task
    before the shuffle, so a key that holds a third of the table does not reach one task whole."""
    newest = [F.col(c).desc_nulls_last() for c in order if c in df.columns]
    ties = [row_hash(df)] if tiebreak is None else [as_col(c) for c in tiebreak]
    window = Window.partitionBy(*[as_col(k) for k in keys]).orderBy(*newest, *[t.asc_nulls_last() for t in ties])
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every key, with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_n(df: DataFrame, order: str, n: int, tiebreak: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """First ``n`` rows by a score; each task keeps ``n`` rows, so nothing is sorted as a whole."""
    score = F.col(order).asc_nulls_last() if ascending else F.col(order).desc_nulls_last()
    return df.orderBy(score, *[F.col(t).asc_nulls_last() for t in tiebreak]).limit(n)


def arg_best(df: DataFrame, order: str, tiebreak: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """The single best (or, ascending, worst) row."""
    return top_n(df, order, 1, tiebreak, ascending)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", small: bool = False) -> DataFrame:
    """1-based rank over the whole table.

    ``small=True`` is for results whose size is fixed by meaning (168 hour-and-day cells) and uses one
    window. Otherwise the table is range-partitioned and sorted once, positions inside each partition are
    read off, and per-partition offsets are added; no task ever sees more than its own range. ``order``
    should end in a unique column, which also lets equal scores spread over partitions."""
    if small:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    # The id encodes (partition, position in partition). It is stored once, so both passes agree.
    numbered = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33).alias("_part")
    sizes = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sort: bounded by spark.sql.shuffle.partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (numbered.withColumn("_part", F.shiftright("_mid", 33))
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, position + F.col("_offset") + 1)
            .drop("_part", "_mid", "_offset"))


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result to every row, as a scalar subquery: no join at all, and more
    than one row is an error instead of a silent blow-up."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return (df.withColumn("_s", packed)
            .select(*df.columns, *[F.col("_s")[c].alias(c) for c in one_row.columns]))


def ensure_keyed(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that break the rule of a keyed table: used more than once, or null."""
    keys = [key] if isinstance(key, str) else list(key)
    missing = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys], F.lit(False))
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
            .filter((F.col("row_count") > 1) | missing))


def require_columns(df: DataFrame, not_null: Sequence[str]) -> DataFrame:
    """Declare columns NOT NULL. A null fails the job that reads it."""
    def checked(c: str) -> Column:
        kind = df.schema[c].dataType
        # The literal is never reached; it is what makes the column non-nullable for Spark.
        return F.coalesce(F.col(c), F.raise_error(F.lit(f"null in required column {c}")).cast(kind), F.lit(0).cast(kind))
    return df.withColumns({c: checked(c) for c in not_null})


def changes_since(old: DataFrame, new: DataFrame, key: Sequence[str] | str,
                  ignore: Sequence[str] = ()) -> DataFrame:
    """Row-level difference of two snapshots: key columns plus ``change_type`` insert, update or delete."""
    keys = [key] if isinstance(key, str) else list(key)
    values = [c for c in new.columns if c not in keys and c not in ignore]
    # Only the key and a digest travel; a struct hash keeps (null, "x") and ("x", null) apart.
    def digest(df):
        payload = F.to_json(F.struct(*values), {"ignoreNullFields": "false"}) if values else F.lit("")
        return df.select(*keys, F.sha2(payload, 256).alias("_digest"))
    o, n = digest(old).alias("o"), digest(new).alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    change = (F.when(F.col("o._digest").isNull(), "insert")
              .when(F.col("n._digest").isNull(), "delete")
              .when(F.col("o._digest") != F.col("n._digest"), "update"))
    return (o.join(n, condition, "full_outer")
            .select(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys],
                    change.alias("change_type"))
            .filter(F.col("change_type").isNotNull()))
