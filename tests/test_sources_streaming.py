import json

import pytest
from pyspark.sql import functions as F

from voltlane.operators.shape import with_ingest_meta
from voltlane.plans import feeds, silver
from voltlane.sources import files
from voltlane.sources.layout import Layout
from voltlane.streaming import flows

NOW = "2024-01-15 00:00:00"


def land(folder, name, docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))


def test_csv_with_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "s.csv").write_text('OBJECTID,STATION_NAME,"Charger Type"\n1,"two\nlines","AC"\n2,"say ""hi""",\n')
    rows = files.read_csv_raw(spark, str(tmp_path / "s.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines", "AC"), (2, 'say "hi"', None)]
    typed = files.read_csv_raw(spark, str(tmp_path / "s.csv"), "id bigint, name string, kind string")
    assert typed.schema.simpleString() == "struct<id:bigint,name:string,kind:string>" and typed.count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(files.read_csv_raw(spark, str(tmp_path / "out"), "id int, t string").collect()) == sorted(df.collect())


def test_envelopes(spark, tmp_path):
    record = {"stationcode": "1", "price": 2.5}
    cases = {"prices": [{"stations": [{"code": "x"}], "prices": [record]}], "list": ['[{"stationcode": "1", "price": 2.5}]'],
             "other": [{"meta": "m", "empty": [], "items": [record]}]}
    for name, docs in cases.items():
        land(tmp_path / name, "a.json", docs)
        rows = files.unwrap_envelope(spark.read.json(str(tmp_path / name))).select("stationcode", "price").collect()
        assert [tuple(r) for r in rows] == [("1", 2.5)], name
    land(tmp_path / "none", "a.json", [{"error": {"code": 1}}])
    with pytest.raises(ValueError):
        files.unwrap_envelope(spark.read.json(str(tmp_path / "none")))


def test_envelopes_are_judged_one_by_one(spark, tmp_path):
    docs = [{"prices": [{"code": "a", "p": 1.5}, {"code": "b", "p": 2.5}]}, {"first": [], "second": [{"code": "c", "p": "x", "k": {"z": 1}}]},
            {"prices": [], "second": [{"code": "d"}]}, {"first": [{"other": 3}]}]
    schema = ("first array<struct<other:int>>, prices array<struct<code:string,p:double>>, second array<struct<code:string,p:string,k:struct<z:int>>>")
    land(tmp_path / "mixed", "a.json", docs)
    rows = files.unwrap_envelope(spark.read.schema(schema).json(str(tmp_path / "mixed"))).select("code", "p", "k.z", "other").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("a", "1.5", None, None), ("b", "2.5", None, None), ("c", "x", 1, None), (None, None, None, 3)]))
    land(tmp_path / "one_without", "a.json", [*docs, {"first": []}])
    with pytest.raises(Exception, match="no list of records"):
        files.unwrap_envelope(spark.read.schema(schema).json(str(tmp_path / "one_without"))).collect()


def test_geojson(spark, tmp_path):
    def feature(props, xy):
        return {"properties": props, "geometry": {"type": "Point", "coordinates": xy}}
    doc = {"type": "FeatureCollection", "features": [
        feature({"id": 7, "headline": "h", "mainCategory": "Flooding", "start": 1704067200000, "isMajor": True, "roads": [{"n": "A1"}]}, [151.1, -33.2]),
        feature({"ID": "8", "Headline": "H", "End": "later", "impactingNetwork": False, "roads": []}, [151.0])]}
    land(tmp_path / "g", "a.json", [doc, {"type": "Feature", "features": [feature({"id": 9}, [1, 2])]}])
    raw = spark.read.schema(files.HAZARDS_GEOJSON).json(str(tmp_path / "g"))
    a, b = files.flatten_geojson(raw, as_of=NOW).orderBy("hazard_id").collect()
    assert (a["hazard_id"], a["hazard_type"], a["start_time"], a["is_major"], a["longitude"], a["latitude"]) == ("7", "flooding", "2024-01-01T00:00:00Z", True, 151.1, -33.2)
    assert json.loads(a["roads"]) == [{"n": "A1"}] and a["description"] == "" and a["impact"] is None and a["geometry_type"] == "Point"
    assert (b["hazard_id"], b["hazard_type"], b["headline"], b["end_time"], b["is_major"], b["impact"], b["latitude"], b["roads"]) == ("8", "unknown", "H", "later", False, False, None, None)
    assert {r["hazard_type"] for r in files.flatten_geojson(raw, "roadwork").collect()} == {"roadwork"}
    cleaned = silver.silver_hazards(files.flatten_geojson(raw, as_of=NOW), NOW).filter("hazard_id = '7'").first()
    assert cleaned["is_active"] and cleaned["severity"] == "Major" and str(cleaned["start_time_ts"]) == "2024-01-01 00:00:00"


def test_weather_responses_and_codes(spark, tmp_path):
    land(tmp_path / "w", "a.json", [{"station_id": "SYD001", "current_weather": {"time": "2024-01-14T10:00", "temperature": 25.5, "windspeed": 10.0, "weathercode": 61}},
                                    {"station_id": "NEW001"}, {"station_id": "nowhere", "current_weather": {"time": "x"}}])
    flat = files.flatten_weather(spark.read.schema(files.WEATHER_RESPONSE).json(str(tmp_path / "w")), files.weather_sites(spark), as_of=NOW)
    got = {r["station_id"]: r for r in flat.collect()}
    assert set(got) == {"SYD001", "nowhere"} and got["nowhere"]["station_name"] is None
    r = got["SYD001"]
    assert (r["station_name"], r["weather_condition"], r["humidity_percent"]) == ("Sydney", "61", None)
    assert silver.silver_weather(flat, NOW).first()["weather_category"] == "Other"
    codes = spark.createDataFrame([(61, "Slight rain")], "code int, condition string")
    assert silver.silver_weather(files.decode_weather(flat, codes), NOW).first()["weather_category"] == "Rain"


def test_samples_and_records(spark):
    df = with_ingest_meta(files.sample_hazards(spark), "sample", NOW)
    assert silver.silver_hazards(df, NOW).filter("is_active").count() == 2
    assert len(files.to_records(df, 1)) == 1


def test_layout_by_path_and_catalog(spark, tmp_path):
    by_path = Layout(str(tmp_path / "lake"))
    assert by_path.write(spark.range(5), "silver", "t", cluster_by=["id"])
    by_path.append(spark.range(5, 7), "silver", "t")
    assert by_path.read(spark, "silver", "t").count() == 7
    assert not by_path.write(spark.range(0), "silver", "t", skip_empty=True) and by_path.read(spark, "silver", "t").count() == 7
    by_path.write(spark.range(2).withColumn("x", F.lit("new")), "silver", "t")
    assert by_path.read(spark, "silver", "t").columns == ["id", "x"]
    assert by_path.read_stream(spark, "silver", "t").isStreaming
    named = Layout()
    named.create_schemas(spark)
    named.write(spark.range(3), "gold", "voltlane_t")
    assert named.read(spark, "gold", "voltlane_t").count() == 3 and named.read_stream(spark, "gold", "voltlane_t").isStreaming
    spark.sql("DROP TABLE gold.voltlane_t")


# --- streams ---------------------------------------------------------------------------------------------

def hazard(i, **kw):
    return {"hazard_id": f"h{i}", "headline": "x", "location": "l", "created": "01/01/2024 08:00:00", "isMajor": i % 2 == 0, "latitude": -33.0, "longitude": 151.0} | kw


def test_hazard_stream_equals_batch_and_restarts(spark, tmp_path):
    src, base = tmp_path / "landing", str(tmp_path)
    run = lambda: (flows.run_bronze(spark, "hazards", str(src), f"{base}/bronze", f"{base}/cpb", as_of=NOW).awaitTermination(),
                   flows.run_silver(spark, "hazards", f"{base}/bronze", f"{base}/silver", f"{base}/cps", as_of=NOW).awaitTermination())
    land(src, "a.json", [hazard(1), hazard(2, end="01/01/2024 00:00:00"), hazard(3, hazard_id=None), hazard(4, hazard_id=None, headline=None)])
    run()
    assert spark.read.parquet(f"{base}/silver").count() == 2
    land(src, "b.json", [hazard(5), hazard(6, end="01/02/2024 00:00:00")])
    run()
    run()  # nothing new
    stored = spark.read.parquet(f"{base}/silver")
    batch = feeds.feed_hazards(spark.read.schema(files.HAZARDS_FEED).json(str(src)), NOW)
    cols = ["hazard_id", "severity", "composite_key", "created_timestamp"]
    assert sorted(stored.select(cols).collect(), key=str) == sorted(batch.select(cols).collect(), key=str) and stored.count() == 4
    bronze = spark.read.parquet(f"{base}/bronze")
    assert {r["source_file"].rsplit("/", 1)[1] for r in bronze.select("source_file").collect()} == {"a.json", "b.json"}
    assert {r["pipeline_source"] for r in bronze.collect()} == {"feed"}


def station(i, **kw):
    return {"StationID": f"s{i}", "Latitude": -33.9, "Longitude": 151.0, "NumberOfPlugs": 2, "ChargingPowerKW": 50.0} | kw


def test_station_stream_keeps_one_row_per_id_over_runs(spark, tmp_path):
    src, base = tmp_path / "landing", str(tmp_path)
    def run():
        flows.run_bronze(spark, "stations", str(src), f"{base}/bronze", f"{base}/cpb", as_of=NOW).awaitTermination()
        query = flows.run_silver(spark, "stations", f"{base}/bronze", f"{base}/silver", f"{base}/cps", as_of=NOW)
        query.awaitTermination()
        return flows.progress(query)
    land(src, "a.json", [station(1), station(1), station(2), station(3, Latitude=95.0), station(4, StationID=None)])
    run()
    land(src, "b.json", [station(1, OperatorName="late"), station(5)])
    seen = run()
    ids = sorted(r["station_id"] for r in spark.read.parquet(f"{base}/silver").collect())
    assert ids == ["s1", "s2", "s5"]
    assert seen[0]["rows"] == 2 and seen[-1]["state_rows"] == 3
    land(tmp_path / "hz", "h.json", [hazard(1), hazard(2)])
    hz = feeds.feed_hazards(spark.read.schema(files.HAZARDS_FEED).json(str(tmp_path / "hz")), NOW)
    hz.write.parquet(f"{base}/hazards")
    regional, smart = flows.run_gold(spark, f"{base}/silver", f"{base}/hazards", NOW)
    assert regional.first()["total_stations"] == 3 and regional.first()["region"] == "Sydney Metro" and smart.count() == 3


def test_bounded_state(spark, tmp_path):
    src, base = tmp_path / "events", str(tmp_path)
    rows = lambda ids, t: spark.createDataFrame([(f"s{i}", -33.0, 151.0, 50.0, t) for i in ids], "StationID string, Latitude double, Longitude double, ChargingPowerKW double, t string").withColumn(
        "ingestion_timestamp", F.to_timestamp("t")).drop("t").coalesce(1)
    def run(ids, t):
        rows(ids, t).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(rows([], t).schema).parquet(str(src))
        flows.start(flows.silver_stations_stream(stream, within="1 day", as_of=NOW), f"{base}/out", f"{base}/cp").awaitTermination()
    run([1, 1, 2], "2024-01-01 00:00:00")
    run([1], "2024-01-01 12:00:00")
    run([3], "2024-01-10 00:00:00")
    run([1], "2024-01-11 00:00:00")  # forgotten by now, so it passes
    assert sorted(r["station_id"] for r in spark.read.parquet(f"{base}/out").collect()) == ["s1", "s1", "s2", "s3"]


def test_corrupt_lines_are_kept(spark, tmp_path):
    land(tmp_path / "l", "a.json", [hazard(1), '{"hazard_id": "broken'])
    stream = flows.bronze_stream(spark, "hazards", str(tmp_path / "l"), corrupt_col="_corrupt_record")
    flows.start(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = {(r["hazard_id"], r["_corrupt_record"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {("h1", None), (None, '{"hazard_id": "broken')}
