"""Totals of what lies around many places, without a row per pair.

Places and targets are put into cubes of a common pyramid of sizes (in 3-d, so poles and the dateline are nothing
special). Pairs of cubes are followed from sizes about as large as the radius downwards: a pair out of reach is dropped,
a pair wholly within reach is settled, and the target cube's totals count for every place of the other cube, and only
pairs on the border are divided further, as long as they still hold many pairs of points. What remains is compared
point by point. So a crowd of n places among n targets costs about n * sqrt(n) steps instead of n * n, and no cell
needs cutting because none keeps many pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_col
from ..functions.sphere import chord, haversine_km
from .distance import CUBE, FINE, FINEST, _placed, _touching
from .storage import materialize

#: Border pairs of cubes with at most this many pairs of points are compared, others divided.
FEW_PAIRS = 4096
P_CUBE = [c + "p" for c in CUBE]
T_CUBE = [c + "t" for c in CUBE]


def start_level(size: float) -> int:
    """The finest level whose cubes are at least ``size`` wide (level L has cubes of 2 ** (1 - L))."""
    level = 0
    while level < FINEST and 2.0 ** -level >= size:
        level += 1
    return level


def _at_level(fine: DataFrame, level: int, names: Sequence[str], *extra: Column) -> DataFrame:
    """Columns ``names``: the cube of this level that holds each row's finest cube."""
    return fine.withColumns({c: F.shiftright(f, FINEST - level) for c, f in zip(names, FINE)}).select(*names, *extra)


def _cubes(fine_counts: DataFrame, level: int, names: Sequence[str], n: str) -> DataFrame:
    return _at_level(fine_counts, level, names, F.col("_n")).groupBy(*names).agg(F.sum("_n").alias(n))


def _reach(level: int) -> tuple[Column, Column]:
    """Squares of the smallest and the largest distance between points of the two cubes."""
    apart = [F.abs(F.col(p) - F.col(t)) for p, t in zip(P_CUBE, T_CUBE)]
    size = 2.0 ** (1 - level)
    near = sum((F.pow(F.greatest(a - 1, F.lit(0)) * size, F.lit(2)) for a in apart), F.lit(0.0))
    far = sum((F.pow((a + 1) * size, F.lit(2)) for a in apart), F.lit(0.0))
    return near, far


def cube_pairs(places: DataFrame, targets: DataFrame, km: float, few: int = FEW_PAIRS) -> tuple[list[tuple[int, DataFrame]], list[tuple[int, DataFrame]]]:
    """([(level, pairs within reach)], [(level, pairs to compare)]) of the cubes of two placed tables (with FINE columns).

    One round per level that still has crowded border pairs, none or one in most data; each is stored."""
    size = chord(km)
    def fine(df):
        return materialize(df.groupBy(*FINE).agg(F.count(F.lit(1)).alias("_n")))
    p_fine, t_fine = fine(places), fine(targets)
    level = start_level(size)
    around = _cubes(p_fine, level, P_CUBE, "_np")
    # Cubes as wide as the radius: everything in reach is in the same or in a touching cube.
    near = _touching(around.withColumn("_level", F.lit(level)), f"{2.0 ** (1 - level)!r}D", [F.col(c) for c in P_CUBE])
    pairs = near.withColumnsRenamed(dict(zip(CUBE, T_CUBE))).join(_cubes(t_fine, level, T_CUBE, "_nt"), T_CUBE)
    within, border = [], []
    while True:
        low, high = _reach(level)
        judged = (pairs.select(*P_CUBE, *T_CUBE, "_np", "_nt", low.alias("_low"), high.alias("_high"))
                  .filter(F.col("_low") <= size ** 2))
        # A little inside the radius, so that rounding never settles a pair that the exact distance would not.
        settled = F.col("_high") <= (size * (1 - 1e-8)) ** 2
        last = level == FINEST
        state = F.when(settled, 0).when(F.lit(last) | (F.col("_np") * F.col("_nt") <= few), 1).otherwise(2)
        judged = materialize(judged.withColumn("_state", state).drop("_low", "_high"))
        for n, found in ((0, within), (1, border)):
            found.append((level, judged.filter(F.col("_state") == n).select(*P_CUBE, *T_CUBE)))
        open_ = judged.filter("_state = 2").select(*P_CUBE, *T_CUBE)
        if last or open_.isEmpty():
            return within, border
        level += 1
        up = {c: F.shiftright(c, 1) for c in (*P_CUBE, *T_CUBE)}
        def children(fine_counts, names, n):
            small = [c + "1" for c in names]
            cubes = _cubes(fine_counts, level, names, n)
            return cubes.select(*[up[c].alias(c) for c in names], *[F.col(c).alias(s) for c, s in zip(names, small)], n), small
        p, p_small = children(p_fine, P_CUBE, "_np")
        t, t_small = children(t_fine, T_CUBE, "_nt")
        pairs = (open_.join(p, P_CUBE).join(t, T_CUBE)
                 .select(*[F.col(s).alias(c) for s, c in zip(p_small + t_small, P_CUBE + T_CUBE)], "_np", "_nt"))


def totals_within_km(places: DataFrame, targets: DataFrame, km: float, by: Sequence[str], sums: Sequence[str] = (),
                     most: Sequence[str] = (), at: tuple[str, str] = ("latitude", "longitude"),
                     target_at: tuple[str, str] = ("hazard_lat", "hazard_lon"), few: int = FEW_PAIRS) -> DataFrame:
    """For every distinct place and every value of the columns ``by`` found within ``km``: the sums of ``sums`` and the
    largest values of ``most`` over the targets there. Places with nothing in reach have no row; rows without coordinates
    take no part. Columns of ``targets`` and ``at`` differ in name. Runs jobs while the plan is built.

    Equal to joining all pairs and grouping them, except that sums of doubles may be added in another order."""
    def measured(df, keys):
        if not (sums or most):
            return df.select(*keys).distinct()
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])

    spots = materialize(_placed(places.select(*at).distinct(), at))
    # Targets at one place with one value are one row, so copies cost nothing.
    goals = materialize(_placed(measured(targets, [*target_at, *by]), target_at))
    within, border = cube_pairs(spots, goals, km, few)
    parts = []
    for level, pairs in within:
        cells = measured(_at_level(goals, level, T_CUBE, *[F.col(c) for c in (*by, *sums, *most)]), [*T_CUBE, *by])
        # First per cube of places, then for its places: one row per cube, value and cube in reach is the most there is.
        there = measured(pairs.join(cells, T_CUBE), [*P_CUBE, *by])
        parts.append(_at_level(spots, level, P_CUBE, *[F.col(c) for c in at]).join(there, P_CUBE)
                     .select(*at, *by, *sums, *most))
    for level, pairs in border:
        a = _at_level(spots, level, P_CUBE, *[F.col(c) for c in at])
        b = _at_level(goals, level, T_CUBE, *[F.col(c) for c in (*target_at, *by, *sums, *most)])
        near = pairs.join(a, P_CUBE).join(b, T_CUBE).filter(haversine_km(*[as_col(c) for c in (*at, *target_at)]) <= km)
        parts.append(measured(near, [*at, *by]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return measured(out, [*at, *by])
