"""Distance joins against brute force, with poles, dateline, copies and crowded cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlane.functions import fixed
from voltlane.functions.sphere import haversine_km, search_box
from voltlane.operators import distance as D
from voltlane.operators.boxes import box_edges, corner_union, keys_in_box
from voltlane.operators.reach import P_CUBE, T_CUBE, _at_level, cube_pairs, totals_within_km
from voltlane.plans import feeds, infrastructure


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * fixed.EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


def places(seed, n):
    """Scattered, clustered, polar and dateline points, with copies and missing coordinates."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.35:
            p = (r.gauss(-33.8, 0.05), r.gauss(151.2, 0.05))
        elif kind < 0.5:
            p = (r.uniform(89.8, 90.0), r.uniform(-180, 180))
        elif kind < 0.7:
            lon = r.gauss(180, 0.05)
            p = (r.gauss(-17, 0.05), lon - 360 if lon > 180 else lon)
        elif kind < 0.8 and out:
            p = r.choice(out)
        elif kind < 0.83:
            p = (None, 10.0)
        else:
            p = (r.uniform(-90, 90), r.uniform(-180, 180))
        out.append(p)
    return out


@pytest.fixture(scope="module")
def sides(spark):
    a, b = places(1, 400), places(2, 500)
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "lid int, latitude double, longitude double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "rid int, hazard_lat double, hazard_lon double")
    return a, b, left, right


@pytest.mark.parametrize("radius", [0.5, 5, 800, 30000])
@pytest.mark.parametrize("hot", [None, 7])
def test_within_km(sides, radius, hot):
    a, b, left, right = sides
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if None not in p + q and km(p, q) <= radius}
    got = [(r["lid"], r["rid"]) for r in D.within_km(left, right, radius, hot_rows=hot).select("lid", "rid").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("hot", [None, 7])
def test_within_box(sides, hot):
    a, b, left, right = sides
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b)
            if None not in p + q and abs(p[0] - q[0]) < 0.05 and abs(p[1] - q[1]) < 0.05}
    got = [(r["lid"], r["rid"]) for r in D.within_box(left, right, 0.05, hot_rows=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    outer = [(r["lid"], r["rid"]) for r in D.within_box(left, right, 0.05, "left", ["lid"], hot_rows=hot).collect()]
    lonely = {i for i in range(len(a))} - {i for i, _ in want}
    assert sorted(outer, key=str) == sorted(list(want) + [(i, None) for i in lonely], key=str)


def test_within_box_arguments(sides):
    with pytest.raises(ValueError):
        D.within_box(sides[2], sides[3], 0.05, "left")


def nearest(a, b, k, max_km=None):
    out = {}
    for i, p in enumerate(a):
        if None in p:
            continue
        ranked = sorted((round(km(p, q), 9), j) for j, q in enumerate(b) if None not in q)
        out[i] = [d for d, _ in ranked if max_km is None or d <= max_km][:k]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("k,max_km,hot,enough", [(1, None, None, 512), (5, None, 9, 40), (3, 50.0, None, 10), (600, None, None, 512)])
def test_nearest_k_table(spark, sides, k, max_km, hot, enough):
    a, b, left, right = sides
    points = left.withColumnsRenamed({"latitude": "ref_lat", "longitude": "ref_lon"})
    got = {}
    rows = D.nearest_k(points, right, k, "lid", target_at=("hazard_lat", "hazard_lon"), tiebreak=("rid",), max_km=max_km, hot_rows=hot, enough=enough)
    for r in rows.orderBy("lid", "rank").collect():
        got.setdefault(r["lid"], []).append(round(r["distance_km"], 9))
    want = nearest(a, b, k, max_km)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-6)


def test_nearest_k_list(spark, sides):
    _, b, _, right = sides
    points = [("p", -33.8, 151.2), ("pole", 90.0, 0.0)]
    rows = D.nearest_k(points, right, 4, target_at=("hazard_lat", "hazard_lon"), tiebreak=("rid",)).orderBy("location_name", "rank").collect()
    want = nearest([p[1:] for p in points], b, 4)
    assert [r["distance_km"] for r in rows] == pytest.approx(want[0] + want[1], abs=1e-6)
    assert [r["rank"] for r in rows] == [1, 2, 3, 4] * 2


def test_many_copies_of_one_target(spark):
    """A third of the targets at one place: the list of nearest is still right, ties by id."""
    targets = spark.range(3000).select(F.col("id").alias("objectid"),
                                       F.when(F.col("id") < 1000, -33.0).otherwise(-33 - F.col("id") / 1e4).alias("latitude"),
                                       F.lit(151.0).alias("longitude"))
    points = spark.createDataFrame([("a", -33.0, 151.0)], "location_name string, ref_lat double, ref_lon double")
    assert [r["objectid"] for r in D.nearest_k(points, targets, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_crowd_beside_a_sparse_point(spark):
    """A dense block near a point with few neighbours: the search must not compare the whole block."""
    crowd = spark.range(20000).select(F.col("id").alias("objectid"), (-33.0 + (F.col("id") % 200) / 1e6).alias("latitude"),
                                      (151.0 + F.floor(F.col("id") / 200) / 1e6).alias("longitude"))
    few = spark.createDataFrame([(-1, -33.0, 150.98), (-2, -33.0, 150.97), (-3, -33.03, 150.98)], "objectid bigint, latitude double, longitude double")
    targets = few.unionByName(crowd)
    points = spark.createDataFrame([("edge", -33.0, 150.981), ("inside", -33.00005, 151.00005)], "location_name string, ref_lat double, ref_lon double")
    rows = D.nearest_k(points, targets, 3, enough=64)
    got = {}
    for r in rows.orderBy("location_name", "rank").collect():
        got.setdefault(r["location_name"], []).append(r["objectid"])
    want = {}
    for p in points.collect():
        ranked = targets.withColumn("d", haversine_km(F.lit(p[1]), F.lit(p[2]), "latitude", "longitude")).orderBy("d", "objectid").limit(3)
        want[p[0]] = [r["objectid"] for r in ranked.collect()]
    assert got == want
    spots = D._placed(points.select("ref_lat", "ref_lon"), ("ref_lat", "ref_lon"))
    fine = D._placed(targets, ("latitude", "longitude")).groupBy(*D.FINE).agg(F.count(F.lit(1)).alias("_n"))
    held = D._nearest_cubes(spots, fine, ["ref_lat", "ref_lon"], 3, None, 64).groupBy("ref_lon").agg(F.sum("_n").alias("n"))
    assert max(r["n"] for r in held.collect()) < 1000


@pytest.mark.parametrize("centre", [(-33.8, 151.2), (89.95, 10.0), (-17.0, 179.99), (-17.0, -179.99)])
def test_nearby(sides, centre):
    a, _, left, _ = sides
    want = {i for i, p in enumerate(a) if None not in p and km(centre, p) <= 30}
    assert {r["lid"] for r in D.nearby(left, *centre, 30).collect()} == want


def test_nearby_pushes_the_box(spark, sides, tmp_path):
    path = str(tmp_path / "p")
    sides[2].write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    plan = D.nearby(spark.read.parquet(path), -33.8, 151.2, 30)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(latitude" in plan and "LessThanOrEqual(longitude" in plan


def test_corridor(spark):
    start, end = (-33.8688, 151.2093), (-32.9283, 151.7817)
    r = random.Random(3)
    pts = [(r.uniform(-34.2, -32.6), r.uniform(150.8, 152.2)) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i int, latitude double, longitude double")
    steps = [(start[0] + (end[0] - start[0]) * t / 4000, start[1] + (end[1] - start[1]) * t / 4000) for t in range(4001)]
    near = {i: min(km(p, s) for s in steps) for i, p in enumerate(pts)}
    got = {r["i"]: r["route_distance_km"] for r in D.corridor(df, start, end, 15).collect()}
    for i, d in near.items():
        if abs(d - 15) > 0.2:
            assert (i in got) == (d < 15)
        if i in got:
            assert got[i] == pytest.approx(d, abs=0.2)


def test_haversine_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0), (1.0, 2.0, 1.0, 2.0), (None, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km("a", "b", "c", "d")).collect()]
    half = math.pi * fixed.EARTH_RADIUS_KM
    assert got[0] == pytest.approx(half) and got[1] == pytest.approx(half) and got[2] == 0.0 and got[3] is None


def test_search_box_wraps():
    assert search_box(0, 179.9, 50)[1][1][0] == -180.0 and search_box(0, -179.9, 50)[1][0][0] == -180.0
    assert search_box(89.9, 0, 50)[1] == [(-180.0, 180.0)]


def test_no_cartesian_product(sides):
    _, _, left, right = sides
    for df in (D.within_km(left, right, 5), D.within_box(left, right, 0.05)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# --- scores over the joins ------------------------------------------------------------------------------

def station_rows(spark, rows):
    return spark.createDataFrame(rows, "objectid int, station_name string, latitude double, longitude double, charging_speed string")


def hazard_rows(spark, rows):
    return spark.createDataFrame(rows, "hazard_id string, latitude double, longitude double, main_category string, severity string, is_active boolean")


@pytest.mark.parametrize("few", [4096, 1])
def test_smart_counts_lists_and_scores(spark, few):
    stations = station_rows(spark, [(1, "a", -33.0, 151.0, "Ultra-Rapid"), (2, None, -33.0, 151.0, "Rapid"), (3, "c", -30.0, 151.0, "Slow"),
                                    (4, "d", None, 151.0, "Unknown"), (5, "e", -33.001, 151.0, "Fast")])
    near = [(f"h{i}", -33.0 - (i % 3) / 1000, 151.0, "Hazard" if i % 2 else "Flooding", "Minor", True) for i in range(11)]
    hazards = hazard_rows(spark, near + [("m", -33.0, 151.0, None, "Major", True), ("x", -33.0, 151.0, "Hazard", "Minor", False)])
    got = {r["objectid"]: r for r in infrastructure.smart_recommendations(stations, hazards, few=few).collect()}
    a = got[1]
    assert a["nearby_hazards_count"] == 12 and a["max_hazard_severity"] == 3
    assert a["hazard_types"] == ["Flooding"] * 6 + ["Hazard"] * 5
    assert a["accessibility_score"] == 100 - 120 - 30 and a["recommendation_score"] == int(40 - 30.0) and a["recommendation_tier"] == "Limited"
    assert (got[2]["nearby_hazards_count"], got[2]["accessibility_score"], got[2]["recommendation_score"]) == (0, 100, 95)
    assert got[3]["recommendation_score"] == 75 and got[3]["hazard_types"] is None and got[4]["recommendation_score"] == 70
    assert got[5]["nearby_hazards_count"] == 12
    safe = {r["objectid"]: r for r in infrastructure.smart_recommendations(stations, hazards, null_safe=True, few=few).collect()}
    assert safe[2]["nearby_hazards_count"] == 12
    summary = infrastructure.hazard_summary(stations, hazards, few=few)
    assert sorted(r["objectid"] for r in summary.collect()) == [1, 2, 5]


@pytest.mark.parametrize("n,access", [(0, 100), (1, 80), (2, 80), (3, 60), (5, 60), (6, 40)])
def test_feed_smart_steps(spark, n, access):
    stations = spark.createDataFrame([("s", "Rapid", True, -33.0, 151.0)], "station_id string, charging_speed string, has_valid_location boolean, latitude double, longitude double").withColumns(
        {c: F.lit(None).cast("string") for c in ("operator_name", "address_line1", "suburb", "postcode", "charger_type")} | {"number_of_plugs": F.lit(1), "charging_power_kw": F.lit(50.0)})
    rows = [(f"k{i}", -33.0 + 0.04, 151.0 - 0.04, True) for i in range(n)] * 2 + [("far", -33.0501, 151.0, True), ("off", -33.0, 151.0, False), (None, -33.0, 151.0, True)]
    hazards = spark.createDataFrame(rows, "composite_key string, latitude double, longitude double, is_active boolean")
    r = feeds.feed_smart(stations, hazards).first()
    assert (r["nearby_hazards"], r["accessibility_score"]) == (n, access)
    assert r["recommendation_score"] == pytest.approx(80 * 0.4 + access * 0.6)


@pytest.mark.parametrize("radius", [0.5, 5, 800, 30000])
@pytest.mark.parametrize("few", [4096, 1])
def test_totals_within_km(spark, sides, radius, few):
    a, b, left, right = sides
    tagged = right.withColumn("kind", F.when(F.col("rid") % 5 > 0, F.col("rid") % 5)).withColumns({"n": F.col("rid") + 1, "worst": F.col("rid") % 17})
    want = {}
    for p in {p for p in a if None not in p}:
        for i, q in enumerate(b):
            if None not in q and km(p, q) <= radius:
                n, worst = want.get((*p, i % 5 or None), (0, -1))
                want[(*p, i % 5 or None)] = (n + i + 1, max(worst, i % 17))
    got = totals_within_km(left, tagged, radius, ["kind"], ["n"], ["worst"], few=few).collect()
    assert len(got) == len(want)
    assert {(r["latitude"], r["longitude"], r["kind"]): (r["n"], r["worst"]) for r in got} == want


def test_totals_of_empty_tables(spark, sides):
    _, _, left, right = sides
    assert totals_within_km(left.limit(0), right, 5, [], most=["rid"]).count() == 0
    assert totals_within_km(left, right.limit(0), 5, [], most=["rid"]).count() == 0


def test_work_in_a_crowd_grows_like_its_border(spark):
    """Within a crowd four times as large, pairs of cubes to compare grow far less than the pairs of points."""
    def compared(side):
        grid = spark.range(side * side).select((-33.0 + (F.col("id") % side) * 0.1 / side).alias("latitude"),
                                               (151.0 + F.floor(F.col("id") / side) * 0.1 / side).alias("longitude"))
        placed = D._placed(grid, ("latitude", "longitude"))
        within, border = cube_pairs(placed, placed, 4, few=64)
        points = {}
        for level, pairs in border:
            n = _at_level(placed, level, P_CUBE).groupBy(*P_CUBE).count()
            both = pairs.join(n, P_CUBE).join(n.toDF(*T_CUBE, "other"), T_CUBE)
            points[level] = both.agg(F.sum(F.col("count") * F.col("other"))).first()[0] or 0
        return sum(points.values())
    small, large = compared(24), compared(48)
    assert large < 11 * small                 # all pairs: 16 times
    assert large < 0.5 * 48 ** 4


def test_crowd_of_places_and_targets(spark):
    """A third of all rows in one small area, totals against sums over all pairs."""
    r = random.Random(9)
    spots = [(-33.0 + r.random() * 0.05, 151.0 + r.random() * 0.05) for _ in range(300)] + [(r.uniform(-80, 80), r.uniform(-179, 179)) for _ in range(600)]
    df = spark.createDataFrame(spots, "latitude double, longitude double")
    other = df.select(F.col("latitude").alias("hazard_lat"), F.col("longitude").alias("hazard_lon"), F.lit(1).cast("bigint").alias("n"))
    got = {(x["latitude"], x["longitude"]): x["n"] for x in totals_within_km(df, other, 2, [], ["n"], few=16).collect()}
    assert got == {p: sum(km(p, q) <= 2 for q in spots) for p in spots}


@pytest.mark.parametrize("few", [64, 1])
def test_keys_in_box(spark, few):
    """Keys with one mark and with many, copies, and marks whose distance is the limit up to rounding."""
    r = random.Random(4)
    def spot():
        return (round(-33.5 + r.randrange(400) / 1000, 3), round(151 + r.randrange(400) / 1000, 3))
    marks = [(f"k{r.randrange(40)}", *spot()) for _ in range(300)] + [(f"one{i}", *spot()) for i in range(60)] + [(None, *spot()), ("gone", None, 151.1)]
    marks += marks[:20] + [("twin", *marks[0][1:])]
    spots = [spot() for _ in range(250)] + [(None, 151.0), (80.0, 0.0)]
    want = {}
    for p in spots:
        if None not in p:
            n = len({k for k, *m in marks if k and None not in m and abs(p[0] - m[0]) < 0.05 and abs(p[1] - m[1]) < 0.05})
            if n:
                want[p] = n
    got = keys_in_box(spark.createDataFrame(spots, "latitude double, longitude double"),
                      spark.createDataFrame(marks, "name string, latitude double, longitude double"), 0.05, "name", few=few).collect()
    assert {(x["latitude"], x["longitude"]): x["n_keys"] for x in got} == want and len(got) == len(want)


def test_edges_of_boxes_are_where_the_comparison_changes():
    r = np.random.default_rng(2)
    c = np.concatenate([np.round(r.uniform(-180, 180, 3000), 3), [0.0, 0.05, -0.05, 180.0]])
    low, high = box_edges(c, 0.05)
    def near(p):
        return np.abs(c - p) < 0.05
    assert near(low).all() and not near(np.nextafter(low, -np.inf)).any()
    assert not near(high).any() and near(np.nextafter(high, -np.inf)).all()


def test_corner_union_is_disjoint_and_whole():
    r = np.random.default_rng(3)
    for _ in range(40):
        centre = r.uniform(-1, 2, (r.integers(1, 9), 2))
        boxes = np.column_stack([centre[:, 0] - 0.51, centre[:, 0] + 0.51, centre[:, 1] - 0.51, centre[:, 1] + 0.51])
        found = corner_union(boxes, (0.0, 1.0, 0.0, 1.0))
        p = r.uniform(0, 1, (400, 2))
        def over(b):
            return ((p[:, :1] >= b[:, 0]) & (p[:, :1] < b[:, 1]) & (p[:, 1:] >= b[:, 2]) & (p[:, 1:] < b[:, 3])).sum(axis=1)
        assert (over(found) == (over(boxes) > 0)).all()


def test_keys_in_box_of_empty_tables(spark):
    some = spark.createDataFrame([("a", -33.0, 151.0), ("a", -33.01, 151.0)], "name string, latitude double, longitude double")
    assert keys_in_box(some, some.limit(0), 0.05, "name").count() == 0
    assert keys_in_box(some.limit(0), some, 0.05, "name").count() == 0
    assert [x["n_keys"] for x in keys_in_box(some, some, 0.05, "name").collect()] == [1, 1]
