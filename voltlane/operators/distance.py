"""Distance joins without cross joins.

Points are placed in the cells of a grid whose cell size is the search radius, so two points within the
radius are always in the same or in touching cells. The left side is copied to its touching cells, the
join is then an ordinary equi-join on the cell, and the exact distance is the residual condition. For
kilometres the grid lives in 3-d (unit vectors), where poles and the dateline need no special case; for
degree boxes it is a plain latitude/longitude grid.

A crowded cell would put all its pairs on one task. Cells with more than ``hot_rows`` rows on a side are cut
into blocks of about that size on both sides and every pair of blocks becomes a join key of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import as_col
from ..functions.sphere import chord, haversine_km, search_box, segment_km, unit_xyz
from .rows import row_hash, top_k_per
from .storage import materialize

HOT_ROWS = 4096
# Tasks for pairs of blocks, as a multiple of spark.sql.shuffle.partitions: pairs are long in work and small in bytes.
TASKS_PER_PARTITION = 64


def crowded(hot_rows: int | None, *stored: DataFrame) -> int | None:
    """``hot_rows``, or None when no cell can be hot because the tables themselves are not larger than that. For
    stored tables the counts come from file footers."""
    if hot_rows is None or all(df.count() <= hot_rows for df in stored):
        return None
    return hot_rows


def _split_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """Add block columns (_bl, _br) to both sides: constant for ordinary cells, fragment-and-replicate for hot
    ones. A left row sits in one left block and is copied to all right blocks, and the other way round, so
    every pair still meets exactly once. None when no cell is hot."""
    def blocks(df, mine, other):
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
        return counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias(mine), F.lit(1).alias(other))

    hot = materialize(blocks(left, "_nl", "_nr").unionByName(blocks(right, "_nr", "_nl"))
                      .groupBy(*keys).agg(F.max("_nl").alias("_nl"), F.max("_nr").alias("_nr")))
    heavy = hot.agg(F.sum(F.col("_nl").cast("bigint") * F.col("_nr"))).first()[0]
    if heavy is None:
        return None
    # Pairs of blocks are small in bytes and long in work, so a partition count by size would pile them up in few
    # tasks. A count that is asked for is not merged again.
    spark = left.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(partitions, min(2 * heavy, TASKS_PER_PARTITION * partitions))

    def spread(df, own, own_n, other, other_n):
        # All hot cells are cut; their list is sent whole only where adaptive execution finds it small.
        tagged = df.join(hot, list(keys), "left")
        mine = F.pmod(row_hash(df), F.coalesce(F.col(own_n), F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce(F.col(other_n), F.lit(1)) - 1)
        copied = tagged.select(*df.columns, mine.alias(own), F.explode(copies).alias(other))
        return copied.repartition(tasks, *keys, "_bl", "_br")

    return spread(left, "_bl", "_nl", "_br", "_nr"), spread(right, "_br", "_nr", "_bl", "_nl")


def _cell_join(left: DataFrame, right: DataFrame, keys: list[str], exact: Column, hot_rows: int | None) -> DataFrame:
    split = _split_hot(left, right, keys, hot_rows) if hot_rows else None
    if split:
        left, right = split
        keys = keys + ["_bl", "_br"]
    l, r = left.alias("l"), right.alias("r")
    condition = exact
    for k in keys:
        condition = condition & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, condition, "inner")


CUBE = ["_cx", "_cy", "_cz"]

def _touching(df: DataFrame, size: str, cell: Sequence[Column]) -> DataFrame:
    """Copy each row to the up to 27 cubes around its own; ``size`` is the cube size as SQL. Cubes the unit sphere
    does not pass through hold no points and are dropped, which leaves about ten."""
    base = [c + "b" for c in CUBE]
    df = df.withColumns(dict(zip(base, cell))).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(26))))
    steps = ["_step div 9", "_step div 3 % 3", "_step % 3"]
    df = df.withColumns({c: F.expr(f"{b} + {step} - 1") for c, b, step in zip(CUBE, base, steps)})
    # Smallest and largest distance from the centre of the earth to a point of the cube, per axis and squared.
    near = " + ".join(f"pow(greatest({c}, -{c} - 1, 0L) * {size}, 2)" for c in CUBE)
    far = " + ".join(f"pow(greatest({c} + 1, -{c}) * {size}, 2)" for c in CUBE)
    return df.filter(f"{near} <= 1 + 1e-9D AND {far} >= 1 - 1e-9D").drop("_step", *base)


def within_km(left: DataFrame, right: DataFrame, km: float,
              left_at: tuple[str, str] = ("latitude", "longitude"),
              right_at: tuple[str, str] = ("hazard_lat", "hazard_lon"),
              distance: str = "distance_km", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """All pairs of rows at most ``km`` apart, with their distance. The two sides share no column names.

    Put the smaller side left: it is the one copied to touching cells. Rows without coordinates pair with
    nothing. Both sides are read twice, once to find crowded cells: pass tables that are stored, and collapse
    copies of a point before the join where the caller can (see ``hazard_summary``)."""
    size = chord(km)
    def cubes(df, at):
        df = df.filter(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())
        return df, [F.floor(v / size) for v in unit_xyz(*at)]
    l, lc = cubes(left, left_at)
    r, rc = cubes(right, right_at)
    l = _touching(l, f"{size!r}D", lc)
    r = r.withColumns(dict(zip(CUBE, rc)))
    dist = haversine_km(*[F.col(f"l.{c}") for c in left_at], *[F.col(f"r.{c}") for c in right_at])
    pairs = _cell_join(l, r, CUBE, dist <= km, hot_rows)
    return pairs.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns],
                        dist.alias(distance))


def within_box(left: DataFrame, right: DataFrame, deg: float, how: str = "inner", key: Sequence[str] = (),
               left_at: tuple[str, str] = ("latitude", "longitude"),
               right_at: tuple[str, str] = ("hazard_lat", "hazard_lon"),
               hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Pairs with ``abs(dlat) < deg and abs(dlon) < deg``. ``how="left"`` keeps left rows without a partner and
    needs ``key``, the unique non-null key of the left side."""
    def valid(df, at):
        return df.filter(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())
    size = deg * (1 + 1e-9)
    l, r = valid(left, left_at), valid(right, right_at)
    for name, at in zip(("_ca", "_co"), range(2)):
        c = F.floor(F.col(left_at[at]) / size)
        l = l.withColumn(name, F.explode(F.sequence(c - 1, c + 1)))
        r = r.withColumn(name, F.floor(F.col(right_at[at]) / size))
    exact = F.lit(True)
    for a, b in zip(left_at, right_at):
        exact = exact & (F.abs(F.col(f"l.{a}") - F.col(f"r.{b}")) < deg)
    pairs = _cell_join(l, r, ["_ca", "_co"], exact, hot_rows)
    if how == "inner":
        return pairs.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns])
    if how != "left" or not key:
        raise ValueError("how must be 'inner', or 'left' with a key")
    matched = pairs.select(*[F.col(f"l.{k}") for k in key], *[F.col(f"r.{c}") for c in right.columns])
    return left.join(matched, list(key), "left").select(*left.columns, *right.columns)


# --- nearest k -------------------------------------------------------------------------------------

# Cube sizes of the search pyramid, on the unit sphere: 2 (whole earth) down to about 20 centimetres, each four
# times smaller than the one before.
LEVELS = list(range(0, 27, 2))
FINEST = LEVELS[-1]
LEVEL_SIZE = "pow(2D, 1 - _level)"
FINE = ["_fx", "_fy", "_fz"]
UNIT = ["_px", "_py", "_pz"]
# Up to so many places of targets, every point is compared with all of them.
FEW_TARGETS = 256
# A point whose candidate cubes hold more targets than this gets smaller cubes.
ENOUGH = 512


def _placed(df: DataFrame, at: tuple[str, str]) -> DataFrame:
    """Unit vector and finest cube of each row; rows without coordinates are dropped."""
    df = df.filter(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())
    df = df.withColumns(dict(zip(UNIT, unit_xyz(*at))))
    return df.withColumns({f: F.floor(F.col(u) * 2 ** (FINEST - 1)) for f, u in zip(FINE, UNIT)})


def _lifted(df: DataFrame) -> DataFrame:
    """The cube of level ``_level`` that holds the finest cube."""
    return df.withColumns({c: F.expr(f"shiftright({f}, {FINEST} - _level)") for c, f in zip(CUBE, FINE)})


def _pyramid(df: DataFrame) -> DataFrame:
    """Each row once per level, with the cube that holds it on that level."""
    return _lifted(df.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in LEVELS]))))


def _in_reach(cubes: DataFrame, spot: Sequence[str], k: int, max_chord: float | None) -> DataFrame:
    """Drop cubes that cannot hold one of the ``k`` nearest targets of their spot.

    Taking cubes by their farthest corner until they hold ``k`` targets bounds the k-th distance; a cube whose
    nearest corner is beyond the bound is out. A spot has at most some hundred cubes at a time."""
    near = " + ".join(f"pow(greatest({c} * {LEVEL_SIZE} - {u}, {u} - ({c} + 1) * {LEVEL_SIZE}, 0D), 2)" for c, u in zip(CUBE, UNIT))
    far = " + ".join(f"pow(greatest(abs({u} - {c} * {LEVEL_SIZE}), abs(({c} + 1) * {LEVEL_SIZE} - {u})), 2)" for c, u in zip(CUBE, UNIT))
    held = F.sum("_n").over(Window.partitionBy(*spot).orderBy("_far"))
    bound = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(Window.partitionBy(*spot))
    out = (cubes.withColumns({"_near": F.expr(near), "_far": F.expr(far)}).withColumn("_held", held)
           .withColumn("_bound", F.coalesce(bound, F.lit(16.0))).filter("_near <= _bound * (1 + 1e-9D) + 1e-15D"))
    if max_chord is not None:
        out = out.filter(F.col("_near") <= max_chord ** 2)
    return out.drop("_near", "_far", "_held", "_bound")


def _first_level(fine_counts: DataFrame, k: int) -> int:
    """The finest level on which a cube that is not empty holds a quarter of ``k`` targets on average, by sketches."""
    cubes = [F.approx_count_distinct(F.struct(*[F.shiftright(f, FINEST - v) for f in FINE])).alias(f"l{v}") for v in LEVELS]
    row = fine_counts.agg(F.sum("_n").alias("n"), *cubes).head()
    return max((v for v in LEVELS if (row["n"] or 0) >= row[f"l{v}"] * max(k / 4, 1)), default=0)


def _nearest_cubes(spots: DataFrame, fine_counts: DataFrame, spot: Sequence[str], k: int, max_km: float | None,
                   enough: int) -> DataFrame:
    """For every spot, cubes that are certain to hold its ``k`` nearest targets and hold few others."""
    cell = ["_level", *CUBE]
    max_chord = None if max_km is None else chord(max_km)

    def counts(levels: DataFrame | int) -> DataFrame:
        if isinstance(levels, int):
            cubes = _lifted(fine_counts.withColumn("_level", F.lit(levels)))
        else:
            # One row per level at most.
            cubes = _pyramid(fine_counts).join(F.broadcast(levels), "_level", "left_semi")
        return cubes.groupBy(*cell).agg(F.sum("_n").alias("_n"))

    # The finest level on which the block of touching cubes around a spot holds k targets: begin where a cube holds some
    # on average, and go up with the spots whose block holds fewer.
    level, top = _first_level(fine_counts, k), 0
    if max_chord is not None:
        top = max(v for v in LEVELS if 2.0 / 2 ** v >= min(max_chord, 2.0))
        level = max(level, top)
    open_, found = spots.select(*FINE).distinct(), []
    while True:
        homes = _lifted(open_.withColumn("_level", F.lit(level)))
        home = [c + "0" for c in CUBE]
        around = homes.select("_level", *[F.col(c).alias(h) for c, h in zip(CUBE, home)]).distinct()
        blocks = (_touching(around, LEVEL_SIZE, [F.col(h) for h in home]).join(counts(level), cell)
                  .groupBy("_level", *home).agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= k)
                  .select("_level", *[F.col(h).alias(c) for c, h in zip(CUBE, home)]))
        if level <= top:
            found.append(open_.withColumn("_found", F.lit(level)))
            break
        judged = materialize(homes.join(blocks.withColumn("_full", F.lit(True)), cell, "left").select(*FINE, "_full"))
        found.append(judged.filter("_full").select(*FINE, F.lit(level).alias("_found")))
        open_ = judged.filter("_full is null").select(*FINE)
        if open_.isEmpty():
            break
        level -= LEVELS[1] - LEVELS[0]
    found = reduce(DataFrame.unionByName, found)
    # The k-th distance is at most the diagonal of that block, 2*sqrt(3) cubes: less than one cube a level up.
    start = F.greatest(F.coalesce("_found", F.lit(0)) - (LEVELS[1] - LEVELS[0]), F.lit(0))
    if max_chord is not None:
        start = F.greatest(start, F.lit(max(v for v in LEVELS if 2.0 / 2 ** v >= min(max_chord, 2.0))))
    leveled = materialize(spots.join(found, FINE, "left").withColumn("_level", start).drop("_found"))
    cells = [F.expr(f"shiftright({f}, {FINEST} - _level)") for f in FINE]
    cubes = _touching(leveled, LEVEL_SIZE, cells).drop(*FINE).join(counts(leveled.select("_level").distinct()), cell)
    cubes = materialize(_in_reach(cubes, spot, k, max_chord))

    # Where those cubes still hold many targets, look at their parts. Each round quarters the cubes, so there are
    # at most as many rounds as levels; in most data there is none or one.
    for _ in LEVELS:
        busy = (cubes.groupBy(*spot).agg(F.sum("_n").alias("_all"), F.min("_level").alias("_top"))
                .filter((F.col("_all") > enough) & (F.col("_top") < FINEST)).select(*spot))
        busy = materialize(busy)
        if busy.isEmpty():
            break
        step = LEVELS[1] - LEVELS[0]
        parents = (cubes.join(busy, list(spot), "left_semi").drop("_n").withColumn("_level", F.col("_level") + step)
                   .withColumnsRenamed({c: c + "0" for c in CUBE}))
        home = [c + "0" for c in CUBE]
        parts = counts(parents.select("_level").distinct()).withColumns({h: F.shiftright(c, step) for h, c in zip(home, CUBE)})
        smaller = parents.join(parts, ["_level", *home]).select(*cubes.columns)
        cubes = materialize(cubes.join(busy, list(spot), "left_anti").unionByName(_in_reach(smaller, spot, k, max_chord)))
    return cubes


def _within_kth(pairs: DataFrame, key: str, distance: str, k: int) -> DataFrame:
    """Drop rows that are certainly not among the ``k`` nearest of their point.

    A first pass counts rows per point and distance step (steps grow by a fifth, so there are some hundred per
    point); the upper end of the step that completes ``k`` bounds the k-th distance. The sort of the ranking then
    sees little more than ``k`` rows per point instead of every row once per point."""
    growth = 1.2
    step = F.when(F.col(distance) <= 1e-3, 0).otherwise(F.ceil(F.log(F.col(distance) * 1e3) / math.log(growth)) + 1)
    counts = pairs.groupBy(key, step.cast("int").alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy("_step"))
    first = (counts.withColumn("_upto", upto).filter(F.col("_upto") >= k).groupBy(key).agg(F.min("_step").alias("_step")))
    end = F.pow(F.lit(growth), F.col("_step")) * 1e-3
    # One entry per literal point: the map is as short as the list of points.
    ends = first.agg(F.map_from_entries(F.collect_list(F.struct(key, end.alias("_end"))))).scalar()
    bound = F.coalesce(ends[F.col(key)], F.lit(float("inf")))
    return pairs.filter(F.col(distance) <= bound)


def nearest_k(points: DataFrame | Sequence[tuple], targets: DataFrame, k: int,
              point_key: str = "location_name", point_at: tuple[str, str] = ("ref_lat", "ref_lon"),
              target_at: tuple[str, str] = ("latitude", "longitude"), tiebreak: Sequence[str] = ("objectid",),
              distance: str = "distance_km", max_km: float | None = None,
              hot_rows: int | None = HOT_ROWS, enough: int = ENOUGH) -> DataFrame:
    """The ``k`` nearest targets of every point, with distance and rank; targets without coordinates never
    count. ``max_km`` leaves out targets farther away.

    ``points`` as a short Python list of (key, lat, lon) is folded into the scan of the targets; a first pass over
    their coordinates bounds the k-th distance, so hardly more than ``k`` rows per point are sorted. As a DataFrame,
    cube counts on a pyramid of sizes narrow the search of each place down to cubes that hold its ``k`` nearest and
    few others (``enough``, more only where targets crowd inside 20 centimetres); only targets in them are compared, by
    coordinates alone. Jobs run while this form is built."""
    order = [F.col(distance), *[as_col(t) for t in tiebreak]]
    targets = targets.filter(F.col(target_at[0]).isNotNull() & F.col(target_at[1]).isNotNull())
    if isinstance(points, (list, tuple)):
        rows = F.array(*[F.struct(F.lit(key).alias(point_key), F.lit(float(la)).alias(point_at[0]),
                                  F.lit(float(lo)).alias(point_at[1])) for key, la, lo in points])
        pairs = targets.select(F.inline(rows), *targets.columns)
        pairs = pairs.withColumn(distance, haversine_km(*point_at, *target_at)).filter(F.col(distance).isNotNull())
        if max_km is not None:
            pairs = pairs.filter(F.col(distance) <= max_km)
        return top_k_per(_within_kth(pairs, point_key, distance, k), [point_key], order, k)

    # Points at one place share one search; of the targets at one place only k can be among anyone's k nearest. The search
    # knows coordinates only: what else targets have joins the winners last.
    spot, goal = list(point_at), list(target_at)
    spots = materialize(_placed(points.select(*spot).distinct(), point_at))
    places = top_k_per(targets, goal, [as_col(t) for t in tiebreak], k, "_copy").drop("_copy")
    stored = materialize(_placed(targets.groupBy(*goal).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_n")), target_at))
    dist = haversine_km(*[F.col(f"l.{c}") for c in point_at], *[F.col(f"r.{c}") for c in target_at])
    few = stored.limit(FEW_TARGETS + 1).select(*goal).collect()
    if len(few) <= FEW_TARGETS:
        pairs = _among_few(spots.select(*spot), [tuple(map(float, r)) for r in few], spot, goal, distance, k)
        pairs = pairs if max_km is None else pairs.filter(F.col(distance) <= max_km)
    else:
        fine_counts = materialize(stored.groupBy(*FINE).agg(F.sum("_n").alias("_n")))
        probes = _nearest_cubes(spots, fine_counts, spot, k, max_km, enough).drop("_n", *UNIT)
        # At most one row per level, so broadcasting it is safe; targets are copied only to levels in use.
        levels_used = F.broadcast(probes.select("_level").distinct())
        shelves = _pyramid(stored.drop("_n", *UNIT)).join(levels_used, "_level", "left_semi").drop(*FINE)
        limit = F.lit(True) if max_km is None else dist <= max_km
        pairs = _cell_join(probes, shelves, ["_level", *CUBE], limit, crowded(hot_rows, probes, stored))
        pairs = pairs.select(*[F.col(f"l.{c}") for c in spot], *[F.col(f"r.{c}") for c in goal], dist.alias(distance))
    # Places at one distance stay together until their ties can be told.
    nearest = Window.partitionBy(*spot).orderBy(distance)
    winners = pairs.withColumn("_rank", F.rank().over(nearest)).filter(F.col("_rank") <= k).drop("_rank")
    full = winners.join(places, goal).select(*spot, *targets.columns, distance)
    return points.join(top_k_per(full, spot, order, k), spot)


def _among_few(spots: DataFrame, places: list[tuple[float, float]], spot: Sequence[str], goal: Sequence[str], distance: str, k: int) -> DataFrame:
    """Each spot with the ``k`` nearest of a few places, and those as far as the k-th; no shuffle."""
    if not places:
        return spots.limit(0).select(*spot, *[F.lit(0.0).alias(g) for g in goal], F.lit(0.0).alias(distance))
    listed = F.array(*[F.struct(F.lit(a).alias(goal[0]), F.lit(b).alias(goal[1])) for a, b in places])
    far = F.transform(listed, lambda p: F.struct(haversine_km(*spot, p[goal[0]], p[goal[1]]).alias(distance), *[p[g].alias(g) for g in goal]))
    # The lists are columns of their own, so that they are not computed again for each of their elements.
    ranked = spots.withColumn("_all", F.array_sort(far))
    kth = F.get(F.col("_all"), F.lit(min(k, len(places)) - 1))[distance]
    return (ranked.select(*spot, F.posexplode("_all").alias("_i", "_p"), kth.alias("_kth")).filter(F.col(f"_p.{distance}") <= F.col("_kth"))
            .select(*spot, *[F.col(f"_p.{g}") for g in goal], F.col(f"_p.{distance}")))


# --- one place ---------------------------------------------------------------------------------------

def nearby(df: DataFrame, lat: float, lon: float, km: float, at: tuple[str, str] = ("latitude", "longitude"),
           distance: str = "distance_km") -> DataFrame:
    """Rows within ``km`` of a place. A latitude/longitude box goes first: it is made of plain comparisons, so it
    reaches the file scan and skips row groups."""
    (south, north), lons = search_box(lat, lon, km)
    in_lon = F.lit(False)
    for west, east in lons:
        in_lon = in_lon | F.col(at[1]).between(west, east)
    boxed = df.filter(F.col(at[0]).between(south, north) & in_lon)
    return boxed.withColumn(distance, haversine_km(lat, lon, *at)).filter(F.col(distance) <= km)


def corridor(df: DataFrame, start: tuple[float, float], end: tuple[float, float], km: float,
             at: tuple[str, str] = ("latitude", "longitude"), distance: str = "route_distance_km") -> DataFrame:
    """Rows within ``km`` of the great-circle segment from ``start`` to ``end``.

    Every such row lies within half the length plus ``km`` of the midpoint, which gives the box for the scan."""
    p = [[math.cos(math.radians(a)) * math.cos(math.radians(b)), math.cos(math.radians(a)) * math.sin(math.radians(b)),
          math.sin(math.radians(a))] for a, b in (start, end)]
    mid = [a + b for a, b in zip(*p)]
    norm = math.sqrt(sum(v * v for v in mid))
    out = df
    if norm > 1e-9:
        mid = [v / norm for v in mid]
        half = math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(p[0], mid))))) * fixed.EARTH_RADIUS_KM
        m_lat, m_lon = math.degrees(math.asin(mid[2])), math.degrees(math.atan2(mid[1], mid[0]))
        out = nearby(df, m_lat, m_lon, half * (1 + 1e-9) + km + 1e-6, at, "_mid_km").drop("_mid_km")
    return out.withColumn(distance, segment_km(*at, start, end)).filter(F.col(distance) <= km)
