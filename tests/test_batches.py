"""Sinks by batch id, folded totals, rule counts, remembered schemas, keyed tables and keyed state."""

import json
import os

import pytest
from pyspark.sql import functions as F

from voltlane.plans import feeds
from voltlane.sources.layout import KeyedTable
from voltlane.streaming import batches, landing, state

NOW = "2024-01-15 00:00:00"
STATION = "station_id string, latitude double, longitude double, number_of_plugs int, charging_power_kw double, charging_speed string, has_valid_location boolean"


def stations(spark, ids):
    return spark.createDataFrame([(f"s{i}", -33.0 - i % 5, 151.0, 2, 50.0 + i if i % 3 else None, "Rapid" if i % 2 else "Slow", True) for i in ids], STATION).coalesce(1)


def test_folded_totals_equal_a_recount_with_a_stop(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "gold", "cp"))
    def run():
        batches.start_regional(spark.readStream.schema(STATION).option("maxFilesPerTrigger", 1).parquet(src), out, cp).awaitTermination()
    for ids in (range(10), range(10, 25), range(25, 31)):
        stations(spark, ids).write.mode("append").parquet(src)
        run()
    batches._remove(spark, f"{cp}/commits/{batches._batches(spark, out)[-1]}")
    run()                                   # the last batch comes again
    assert len(batches._batches(spark, out)) == 2
    got = sorted(map(tuple, batches.read_regional(spark, out, NOW).collect()))
    assert got == sorted(map(tuple, feeds.feed_regional(stations(spark, range(31)), NOW).collect())) and len(got) > 1


def test_a_batch_that_was_written_in_part_is_written_anew(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    stations(spark, range(5)).write.parquet(src)
    stations(spark, range(90, 95)).write.parquet(f"{out}/batch=0")      # left by a run that stopped
    batches.start(spark.readStream.schema(STATION).parquet(src), out, cp).awaitTermination()
    assert sorted(r["station_id"] for r in batches.read(spark, out).collect()) == [f"s{i}" for i in range(5)]


def test_rule_counts_add_up(spark, tmp_path):
    src, out, counts, cp = (str(tmp_path / n) for n in ("src", "out", "counts", "cp"))
    rules = {"rated": "charging_power_kw > 0", "known": "station_id <> 's3'"}
    for ids in (range(4), range(4, 9)):
        stations(spark, ids).write.mode("append").parquet(src)
        batches.start_checked(spark.readStream.schema(STATION).parquet(src), rules, out, counts, cp).awaitTermination()
    got = {r["rule"]: (r["passed"], r["dropped"]) for r in batches.rule_counts(spark, counts).collect()}
    assert got == {"rated": (6, 3), "known": (8, 1)} and batches.read(spark, out).count() == 6


def test_schema_is_remembered(spark, tmp_path):
    src, store = tmp_path / "land", str(tmp_path / "schema")
    src.mkdir()
    def land(name, *lines):
        (src / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    land("a.json", {"id": 1, "v": 2}, "{broken", "")
    schema = landing.remembered_schema(spark, str(src), store, hints="v string, w double")
    assert schema.simpleString() == "struct<id:bigint,v:string,w:double>"
    land("b.json", {"id": 2, "v": "x", "extra": {"a": [1]}, "more": None}, {"id": "text"})
    assert landing.remembered_schema(spark, str(src), store) == schema
    files = spark.read.text(str(src)).select("value", F.col("_metadata.file_path").alias("source_file")).filter("trim(value) <> ''")
    got = {(r["id"], r["v"], r[landing.RESCUED], r[landing.CORRUPT], os.path.basename(r["source_file"])) for r in landing.parse_lines(files, schema).collect()}
    rescued = {json.loads(g[2])["extra"] for g in got if g[2]}
    assert rescued == {'{"a":[1]}'}
    assert {(g[0], g[1], g[2] is not None, *g[3:]) for g in got} == {
        (1, "2", False, None, "a.json"), (None, None, False, "{broken", "a.json"),
        (None, None, False, '{"id": "text"}', "b.json"), (2, "x", True, None, "b.json")}
    wider = landing.remembered_schema(spark, str(src), store, add="extra string, id int")
    assert wider.fieldNames() == ["id", "v", "w", "extra"] and landing.stored_schema(spark, store) == wider


def test_keyed_table_rewrites_only_what_it_must(spark, tmp_path):
    t = KeyedTable(str(tmp_path / "t"), ["k"], buckets=16)
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("o"))
    t.append(rows.unionByName(rows.withColumn("v", F.lit("b")).withColumn("o", F.lit(0))), ["o"])
    def files():
        return {os.path.join(p, f) for p, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")}
    before = files()
    change = spark.createDataFrame([(3, "c", 1), (500, "d", 1)], "k bigint, v string, o int")
    assert t.append(change) <= 2 and t.append(change) <= 2
    assert len(before & files()) >= 14 - 2
    got = {r["k"]: r["v"] for r in t.read(spark).collect()}
    assert len(got) == 201 == t.read(spark).count() and got[3] == "c" and got[500] == "d" and got[4] == "a"
    with pytest.raises(Exception, match="null in the key"):
        t.append(spark.createDataFrame([(None, "x", 1)], "k bigint, v string, o int"))


def test_latest_row_state_shrinks(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    schema = "k string, t timestamp, v int"
    sizes = []
    def run(*rows):
        spark.createDataFrame(list(rows), "k string, t string, v int").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(src)
        query = batches.start(state.latest_stream(spark.readStream.schema(schema).parquet(src), ["k"], "t", "2 days"), out, cp, mode="update")
        query.awaitTermination()
        sizes.append(max((p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]), default=0))
    run(*[(f"k{i}", "2024-01-01 00:00:00", i) for i in range(50)], (None, "2024-01-01 00:00:00", 1), ("k1", None, 2))
    run(("k1", "2024-01-02 00:00:00", 100), ("k1", "2024-01-01 12:00:00", 99), ("k2", "2023-12-31 00:00:00", 98), ("k3", "2024-01-01 00:00:00", 3))
    run(("z", "2024-02-01 00:00:00", 1))
    run(("z", "2024-02-02 00:00:00", 2))
    got = {r["k"]: r["v"] for r in state.latest_rows(batches.read(spark, out), ["k"]).collect()}
    assert got == {f"k{i}": i for i in range(50)} | {"k1": 100, "z": 2}
    assert sizes[1] >= 50 and sizes[-1] < 10
