"""Readers, sinks, the stream and the stage runner."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from confluo.plans import stages
from confluo.operators import sm2rain
from confluo.sources import readers, sinks, views
from confluo.streaming.daily import complete_days


def dbf(rows, fields, encoding="utf-8"):
    size = 1 + sum(w for _, w in fields)
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r"
    data = b"".join(flag + b"".join(v.encode(encoding).ljust(w) for v, (_, w) in zip(r, fields)) for flag, r in rows)
    return b"\3" + b"\0" * 3 + struct.pack("<IHH", len(rows), 32 + len(head), size) + b"\0" * 20 + head + data


def shp(polygons):
    body = b""
    for k, rings in enumerate(polygons, 1):
        pts = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
        content = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", k, len(content) // 2) + content
    return b"\0" * 100 + body


def test_basins_from_files(spark, tmp_path):
    shell = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    (tmp_path / "b.shp").write_bytes(shp([[shell, hole], [shell]]))
    (tmp_path / "b.dbf").write_bytes(dbf([(b" ", ("101", "한강")), (b" ", ("102", ""))], [("SBSN_CD", 6), ("NAME", 8)]))
    got = {r.code: r.rings for r in readers.read_basins(spark, str(tmp_path / "b")).collect()}
    assert [r.is_hole for r in got["101"]] == [False, True] and len(got["101"][0].pts) == 4 and len(got["102"]) == 1
    names = [r.fields["NAME"] for r in readers.read_dbf(spark, str(tmp_path / "b.dbf")).orderBy("record").collect()]
    assert names == ["한강", ""]
    (tmp_path / "c.dbf").write_bytes(dbf([(b" ", ("101", "한강"))], [("SBSN_CD", 6), ("NAME", 8)], "cp949"))
    assert readers.read_dbf(spark, str(tmp_path / "c.dbf"), "cp949").first().fields["NAME"] == "한강"


def test_holes_belong_to_the_smallest_shell_around_them(spark, tmp_path):
    box = lambda a, b, turn: [(a, a), (a, b), (b, b), (b, a), (a, a)][::turn]
    (tmp_path / "h.shp").write_bytes(shp([[box(0.0, 9.0, 1), box(1.0, 8.0, -1), box(2.0, 7.0, 1), box(3.0, 4.0, -1), box(20.0, 21.0, -1), [(5.0, 5.0), (5.0, 5.0), (5.0, 5.0)]]]))
    rings = readers.read_polygons(spark, str(tmp_path / "h.shp")).first().rings
    assert [(r.is_hole, r.shell) for r in rings] == [(False, 0), (True, 0), (False, 2), (True, 2), (False, 4)]
    index = b"\0" * 100 + struct.pack(">2i", 50, 64) + struct.pack(">2i", 118, 40)
    assert readers.shx_offsets(index) == [(100, 128), (236, 80)]


def test_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date,1001,1002,1003\n2024-01-01,1.5,,2\n2024-01-02,,3.25,\n")
    path = str(tmp_path / "w.csv")
    assert readers.csv_columns(spark, path) == ["date", "1001", "1002", "1003"]
    got = {(str(r.date), r.code): r.v for r in readers.wide_csv(spark, path, keep=["1001", "1002"]).collect()}
    assert got == {("2024-01-01", "1001"): 1.5, ("2024-01-01", "1002"): None, ("2024-01-02", "1001"): None, ("2024-01-02", "1002"): 3.25}


def test_years_and_stations(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2022, 12, 30), 1.0), (dt.date(2022, 12, 31), 2.0), (dt.date(2023, 5, 1), 3.0), (dt.date(2024, 1, 1), 4.0)], "day date, v double")
    sinks.write_cube(df, str(tmp_path / "cube"))
    assert sorted(r.v for r in readers.by_year(spark, str(tmp_path / "cube"), [2023], day_before=True).collect()) == [2.0, 3.0]
    sinks.write_station_csv(df.selectExpr("'ASOS' AS network", "90 AS station", "day", "v"), str(tmp_path / "s"))
    assert (tmp_path / "s" / "network=ASOS" / "station=90").is_dir()
    daily, meta = spark.createDataFrame([(90, 1.0), (91, 2.0)], "station int, v double"), spark.createDataFrame([(90, 127.0, 36.0)], "station int, lon double, lat double")
    assert {r.station: r.lon for r in readers.with_stations(daily, meta).collect()} == {90: 127.0, 91: None}
    assert df.select(sinks.day_name(F.col("day")).alias("d")).orderBy("d").first().d == "2022-12-30"


def test_gauge_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("ts,station,lat,lon,rain\n2024-01-01 01:00:00,90,37,127,1.5\nnever,90,37,127,\n", encoding="cp949")
    got = readers.gauges(spark, str(tmp_path / "g.csv")).orderBy("rain").collect()
    assert got[0].ts is None and got[0].rain is None and got[1].ts == dt.datetime(2024, 1, 1, 1)
    two = readers.gauges(spark, str(tmp_path / "g.csv")).select("station", "rain", "ts")
    assert readers.first_by_key(two, ["station"], ["ts"]).count() == 1


def test_other_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name\n한강\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes("name\n금강,\n".encode("utf-8"))
    names = readers.csv(spark, str(tmp_path), "name string", "iso-8859-1").select(readers.recode(F.col("name")).alias("n"))
    assert "한강" in {r.n for r in names.collect()}


def test_start_time_in_name(spark):
    r = spark.createDataFrame([("x/3B.20240102-S013000.nc",)], "p string").select(readers.start_of_file(F.col("p")).alias("t")).first()
    assert r.t == dt.datetime(2024, 1, 2, 1, 30)


def test_wide_and_back(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1.234), (dt.date(2024, 1, 1), "b", None), (dt.date(2025, 1, 2), "a", 2.0)], "day date, c string, v double")
    w = sinks.wide(df, "day", "c", "v")
    assert w.columns == ["day", "a", "b"] and sinks.long(w, "day", "c", "v").where("v is not null").count() == 2
    sinks.write_cube(df, str(tmp_path / "cube"))
    assert {r.year for r in readers.by_year(spark, str(tmp_path / "cube"), [2024]).collect()} == {2024}


def test_stream_gives_complete_days(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(hours=h), 1.0) for h in range(24)] + [(1, start + dt.timedelta(hours=h), 1.0) for h in range(24, 47)] + [(1, start + dt.timedelta(days=9), 1.0)]
    spark.createDataFrame(rows, "cell int, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = complete_days(stream, ["cell"], "ts", "v").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.day, r.total, r.hours) for r in spark.table("days").collect()] == [(dt.date(2024, 1, 1), 24.0, 24)]


def test_stage_names_and_runs(spark, sf_dir, tmp_path):
    assert stages.resolve("tca").name == "tca" and stages.resolve("eva").name == "evaluate" and stages.resolve("rain").name == "sm2rain"
    with pytest.raises(ValueError):
        stages.resolve("nothing")
    assert [s.name for s in stages.select([], "basin")] == ["basin", "evaluate", "export"]
    assert stages.run(spark, sf_dir, str(tmp_path), [stages.resolve("tca")], dry=True) == ["tca_weights", "tca_merge"]
    assert stages.missing_inputs(stages.resolve("tca"), stages._exists(spark, sf_dir)) == [] and stages.missing_inputs(stages.resolve("tca"), stages._exists(spark, str(tmp_path))) == ["events"]
    assert stages.run(spark, str(tmp_path / "none"), str(tmp_path), [stages.resolve("tca")]) == []


def test_view_is_made_again_when_its_inputs_or_plan_change(spark, tmp_path):
    source, path, made = str(tmp_path / "in"), str(tmp_path / "view"), []
    spark.range(5).write.parquet(source)

    def build(least=0):
        made.append(least)
        return spark.read.parquet(source).where(F.col("id") >= least).groupBy((F.col("id") % 2).alias("k")).agg(F.sum("id").alias("s"))

    def table(**more):
        before = views.stamp(spark, path)
        rows = sorted(map(tuple, views.view(spark, path, lambda: build(**more)).collect()))
        return rows, views.stamp(spark, path) != before

    assert table() == ([(0, 6), (1, 4)], True)
    assert table() == ([(0, 6), (1, 4)], False)
    assert table(least=2) == ([(0, 6), (1, 3)], True)
    assert table(least=2) == ([(0, 6), (1, 3)], False)
    spark.range(5, 8).write.mode("append").parquet(source)
    assert table(least=2) == ([(0, 12), (1, 15)], True)
    (tmp_path / "view" / views.STAMP).unlink()
    assert table(least=2) == ([(0, 12), (1, 15)], True)


def test_saved_parameters_then_fallback_then_calibration(spark, tmp_path):
    grid = spark.createDataFrame([(0, 0), (0, 1)], "i int, j int")
    params = lambda z: grid.selectExpr("i", "j", f"{z}D AS z")
    first, second, calls = str(tmp_path / "first"), str(tmp_path / "second"), []

    def calibrate():
        calls.append(1)
        return params(3)

    params(2).write.parquet(second)
    params(1).where("j = 0").write.parquet(first)  # another grid's
    assert {r.z for r in sm2rain.saved_or_calibrated(grid, [first, second], calibrate).collect()} == {2.0} and not calls
    assert {r.z for r in sm2rain.saved_or_calibrated(grid, [first], calibrate).collect()} == {3.0} and len(calls) == 1
    assert {r.z for r in sm2rain.saved_or_calibrated(grid, [first, second], calibrate).collect()} == {3.0} and len(calls) == 1


def test_attributes_survive_parquet(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 0, 1.5)], "day date, i int, v double")
    more = {"v": {"units": "mm d-1", "long_name": "rain"}, "i": {"axis": "Y"}}
    df = sinks.attributed(df, **more)
    sinks.write_cube(df, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert sinks.attributes(back) == more and back.schema["v"].dataType.simpleString() == "float"
    assert sinks.attributes(sinks.attributed(back, v={"units": "mm"}).select("v")) == {"v": {"units": "mm", "long_name": "rain"}}
    with pytest.raises(ValueError, match="no such"):
        sinks.attributed(df, w={"units": "mm"})
