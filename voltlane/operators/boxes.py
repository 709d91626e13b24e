"""How many different keys lie in a box around many places, without a row per pair and without distinct counts.

A key is counted at a place if any of its marks is less than ``deg`` away in both directions, that is if the place lies in
the union of the boxes around the key's marks. Each union is cut into rectangles that do not overlap, so adding up the
rectangles over a place counts every key once. Equal rectangles of different keys become one with a weight. Rectangles
are then followed down a grid of places: a cell wholly inside one is settled, and only cells on a border that hold many
places are divided.

Ends of boxes are moved to the very doubles at which the comparison ``abs(a - b) < deg`` changes, so cutting and adding
up give what comparing every pair gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: The finest grid of places: a tile divided this many times.
FINEST = 20
#: Border cells with at most this many places are compared, others divided.
FEW_PLACES = 64
EDGES = ["_south", "_north", "_west", "_east"]
TILE = ["_ty", "_tx"]
RECTANGLES = ", ".join(f"{c} double" for c in EDGES)


def tile_width(deg: float) -> float:
    """A little less than a box, so that a box reaches an edge of every tile it meets."""
    return 2 * deg * (1 - 1e-9)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order, and back (the map is its own inverse on their bits)."""
    bits = x.view(np.int64)
    return np.where(bits < 0, np.int64(-2**63) - bits, bits)


def _first(yes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first double between where ``yes`` holds; it holds at ``high``, and from some double on."""
    a, b = _ordered(low), _ordered(high)
    for _ in range(64):
        mid = (a >> 1) + (b >> 1) + (a & b & 1)
        hit = yes(_ordered(mid.view(np.float64)).view(np.float64))
        a, b = np.where(hit, a, mid), np.where(hit, mid, b)
    return _ordered(b.view(np.float64)).view(np.float64)


def box_edges(centre: np.ndarray, deg: float) -> tuple[np.ndarray, np.ndarray]:
    """For each c the first double p with abs(c - p) < deg, and the first one above it without."""
    c = np.asarray(centre, dtype=np.float64)
    around = 8 * np.spacing(np.abs(c) + deg)
    low = _first(lambda p: c - p < deg, c - deg - around, c - deg + around)
    high = _first(lambda p: p - c >= deg, c + deg - around, c + deg + around)
    return low, high


def corner_union(boxes: np.ndarray, tile: tuple[float, float, float, float]) -> np.ndarray:
    """Disjoint rectangles (south, north, west, east) that cover what ``boxes`` cover of a tile.

    Every box, cut to the tile, reaches its southern or northern and its western or eastern edge. So on any height the
    union is a stretch from the west, up to the farthest reach of the boxes there, and one from the east."""
    south, north, west, east = tile
    b = np.clip(boxes, [south, south, west, west], [north, north, east, east])
    b = b[(b[:, 0] < b[:, 1]) & (b[:, 2] < b[:, 3])]
    if len(b) < 2:
        return b
    cuts = np.unique(b[:, :2])
    if len(cuts) < 2:
        return np.empty((0, 4))
    base = cuts[:-1]
    from_west, from_east = np.full(len(base), west), np.full(len(base), east)
    for side, reach, best in ((2, 3, from_west), (3, 2, from_east)):
        edge = west if side == 2 else east
        ahead = np.maximum if side == 2 else np.minimum
        here = b[b[:, side] == edge]
        for low, own in ((True, here[here[:, 0] == south]), (False, here[here[:, 0] != south])):
            if not len(own):
                continue
            # Boxes from the south are there below their northern end, others from their southern end on.
            end = own[:, 1] if low else own[:, 0]
            order = np.argsort(end, kind="stable")
            end, far = end[order], own[order, reach]
            if low:
                running = ahead.accumulate(far[::-1])[::-1]
                at = np.searchsorted(end, base, side="right")
                hit = at < len(end)
            else:
                running = ahead.accumulate(far)
                at = np.searchsorted(end, base, side="right") - 1
                hit = at >= 0
            best[hit] = ahead(best[hit], running[at[hit]])
    whole = from_west >= from_east
    strips = [np.column_stack([base, cuts[1:], np.full(len(base), west), np.where(whole, east, from_west)])]
    rest = ~whole
    strips.append(np.column_stack([base, cuts[1:], from_east, np.full(len(base), east)])[rest])
    out = np.concatenate(strips)
    return out[out[:, 2] < out[:, 3]]


def _edges(marks: DataFrame, deg: float, at: tuple[str, str]) -> DataFrame:
    """Add the ends of the box around each row."""
    ends = "low double, high double"

    @F.pandas_udf(ends)
    def box(centre: pd.Series) -> pd.DataFrame:
        low, high = box_edges(centre.to_numpy(), deg)
        return pd.DataFrame({"low": low, "high": high})

    return (marks.withColumns({"_y": box(F.col(at[0])), "_x": box(F.col(at[1]))})
            .withColumns(dict(zip(EDGES, (F.col("_y.low"), F.col("_y.high"), F.col("_x.low"), F.col("_x.high"))))).drop("_y", "_x"))


def _overlapped(df: DataFrame, width: float) -> DataFrame:
    """Each rectangle once per tile it may meet."""
    for name, low, high in ((TILE[0], *EDGES[:2]), (TILE[1], *EDGES[2:])):
        df = df.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return df


def disjoint_rectangles(marks: DataFrame, deg: float, key: str, at: tuple[str, str]) -> DataFrame:
    """EDGES and ``_w``: rectangles that cover each key's boxes without overlap; equal ones added up in ``_w``.

    A mark without others of its key nearby is its box. The boxes of others are cut by tiles and united tile by tile, so a group is what one
    key has in one tile; marks on one line of latitude count by the outermost of them at each edge."""
    width = tile_width(deg)
    here = materialize(marks.filter(" and ".join(f"{c} is not null" for c in (key, *at))).select(
        F.col(key).alias("_key"), *[F.col(c).cast("double").alias(n) for c, n in zip(at, ("_lat", "_lon"))]).distinct())
    several = here.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    counted = here.join(several, "_key")
    tiled = materialize(_overlapped(_edges(counted.filter("_n > 1").select("_key", "_lat", "_lon"), deg, ("_lat", "_lon")), width))
    # A mark that shares no tile with another of its key overlaps none of them: its box stays whole.
    crowd = tiled.groupBy("_key", *TILE).agg(F.count(F.lit(1)).alias("_here"))
    near = tiled.join(crowd.filter("_here > 1"), ["_key", *TILE], "left_semi").select("_key", "_lat", "_lon").distinct()
    alone = tiled.join(near, ["_key", "_lat", "_lon"], "left_anti").select("_key", "_lat", "_lon").distinct()
    whole = counted.filter("_n = 1").select("_lat", "_lon").unionByName(alone.select("_lat", "_lon"))
    single = _edges(whole.groupBy("_lat", "_lon").agg(F.count(F.lit(1)).alias("_w")), deg, ("_lat", "_lon")).select(*EDGES, "_w")
    clipped = tiled.join(near, ["_key", "_lat", "_lon"], "left_semi").drop("_lat", "_lon")
    # Of boxes at one height that reach the western edge only the one that goes farthest counts, and the same in the east.
    west = F.col("_west") <= F.col("_tx") * width
    outer = (clipped.groupBy("_key", *TILE, *EDGES[:2], west.alias("_from_west"))
             .agg(F.min("_west").alias("_west0"), F.max("_west").alias("_west1"), F.min("_east").alias("_east0"), F.max("_east").alias("_east1"))
             .select("_key", *TILE, *EDGES[:2], F.when(F.col("_from_west"), F.col("_west1")).otherwise(F.col("_west0")).alias("_west"),
                     F.when(F.col("_from_west"), F.col("_east1")).otherwise(F.col("_east0")).alias("_east")))

    def unite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (held[["_key", *TILE]] == held[["_key", *TILE]].iloc[-1]).all(axis=1).to_numpy() if len(held) else np.empty(0, bool)
            done, held = held[~last], held[last]
            yield from united(done)
        if held is not None:
            yield from united(held)

    def united(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        tiles, edges = rows[TILE].to_numpy(), rows[EDGES].to_numpy()
        name = rows["_key"].to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (tiles[1:] != tiles[:-1]).any(axis=1)]))
        found = [corner_union(edges[i:j], (y * width, (y + 1) * width, x * width, (x + 1) * width))
                 for i, j, (y, x) in zip(new, np.append(new[1:], len(rows)), tiles[new], strict=True)]
        yield pd.DataFrame(np.concatenate(found), columns=EDGES)

    parts = (outer.repartition("_key", *TILE).sortWithinPartitions("_key", *TILE).select("_key", *TILE, *EDGES)
             .mapInPandas(unite, RECTANGLES).withColumn("_w", F.lit(1).cast("bigint")))
    return single.unionByName(parts).groupBy(*EDGES).agg(F.sum("_w").alias("_w"))


def _cell(level: int, axis: int, width: float) -> tuple[Column, Column]:
    """Ends of a cell of this level along one axis."""
    size = width / 2 ** level
    return F.col(TILE[axis]) * size, (F.col(TILE[axis]) + 1) * size


def weight_at(places: DataFrame, rectangles: DataFrame, width: float, at: tuple[str, str], few: int = FEW_PLACES) -> DataFrame:
    """``at`` and ``_w``: the added weights of the rectangles over each distinct place; places under none have no row."""
    fine = ["_fy", "_fx"]
    spots = places.filter(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull()).select(*at).distinct()
    spots = materialize(spots.withColumns({f: F.floor(F.col(c) / (width / 2 ** FINEST)) for f, c in zip(fine, at)}))
    counts = materialize(spots.groupBy(*fine).agg(F.count(F.lit(1)).alias("_n")))

    def lifted(df, level, *extra):
        return df.select(*[F.shiftright(f, FINEST - level).alias(t) for f, t in zip(fine, TILE)], *extra)

    def cells(level):
        return lifted(counts, level, "_n").groupBy(*TILE).agg(F.sum("_n").alias("_n"))

    level, parts = 0, []
    pairs = _overlapped(rectangles, width).join(cells(0), TILE)
    slack = width * 1e-9
    while True:
        (south, north), (west, east) = (_cell(level, axis, width) for axis in (0, 1))
        # Cell ends carry rounding: a cell counts as inside, or as outside, only with a margin.
        inside = ((F.col("_south") <= south - slack) & (F.col("_north") >= north + slack)
                  & (F.col("_west") <= west - slack) & (F.col("_east") >= east + slack))
        meets = ((F.col("_south") <= north + slack) & (F.col("_north") >= south - slack)
                 & (F.col("_west") <= east + slack) & (F.col("_east") >= west - slack))
        state = F.when(inside, 0).when(F.lit(level == FINEST) | (F.col("_n") <= few), 1).otherwise(2)
        judged = materialize(pairs.filter(meets).select(*EDGES, "_w", *TILE, state.alias("_state")))
        here = lifted(spots, level, *at)
        settled = judged.filter("_state = 0").groupBy(*TILE).agg(F.sum("_w").alias("_w"))
        parts.append(here.join(settled, TILE).select(*at, "_w"))
        y, x = at
        over = ((F.col(y) >= F.col("_south")) & (F.col(y) < F.col("_north")) & (F.col(x) >= F.col("_west")) & (F.col(x) < F.col("_east")))
        parts.append(here.join(judged.filter("_state = 1"), TILE).filter(over).groupBy(*at).agg(F.sum("_w").alias("_w")))
        open_ = judged.filter("_state = 2").drop("_state")
        if level == FINEST or open_.isEmpty():
            break
        level += 1
        below = cells(level).select(*[F.shiftright(t, 1).alias(t) for t in TILE], *[F.col(t).alias(t + "1") for t in TILE], "_n")
        pairs = open_.join(below, TILE).select(*EDGES, "_w", *[F.col(t + "1").alias(t) for t in TILE], "_n")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*at).agg(F.sum("_w").alias("_w"))


def keys_in_box(places: DataFrame, marks: DataFrame, deg: float, key: str, at: tuple[str, str] = ("latitude", "longitude"),
                mark_at: tuple[str, str] = ("latitude", "longitude"), name: str = "n_keys", few: int = FEW_PLACES) -> DataFrame:
    """``at`` and ``name``: for every distinct place, how many different keys have a mark with abs(dlat) < deg and
    abs(dlon) < deg. Places without any have no row; rows without coordinates or key take no part. Runs jobs while the
    plan is built."""
    rectangles = disjoint_rectangles(marks, deg, key, mark_at)
    return weight_at(places, rectangles, tile_width(deg), at, few).withColumnRenamed("_w", name)
