"""File readers and sinks on literal fixtures."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from airshed.operators import clean
from airshed.sources import readers, sinks

HEADER = ",".join(f'"{c}"' for c in readers.GSOD_TEXT_COLUMNS)


def _row(vals):
    return ",".join(f'"{v}"' for v in vals)


def test_gsod_csv_reader(spark):
    d = tempfile.mkdtemp(prefix="airshed-test-")
    base = {c: "" for c in readers.GSOD_TEXT_COLUMNS}
    r1 = dict(base, STATION="A5125600451", DATE="2025-01-01", LATITUDE="36.6985", LONGITUDE="-93.4022",
              ELEVATION="411.2", TEMP="  34.8", TEMP_ATTRIBUTES=" 24", DEWP="  22.6", SLP="9999.9", STP=" 976.8",
              VISIB="  9.8", WDSP="  6.3", MXSPD="999.9", GUST="999.9", MAX="  42.8", MIN="  30.2", PRCP=" 0.00",
              SNDP="999.9", FRSHTT="000000")
    r2 = dict(r1, STATION="54511099999", DATE="2025-08-23", TEMP="  72.5", PRCP=" 0.15", STP="999.9", FRSHTT="010000",
              TEMP_ATTRIBUTES="n/a")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write(HEADER + "\n" + _row([r1[c] for c in readers.GSOD_TEXT_COLUMNS]) + "\n"
                + _row([r2[c] for c in readers.GSOD_TEXT_COLUMNS]) + "\n")
    df = readers.read_gsod_csv(spark, d)
    rows = {r.STATION: r for r in df.collect()}
    assert rows["A5125600451"].TEMP == 34.8 and rows["A5125600451"].TEMP_ATTRIBUTES == 24
    assert rows["54511099999"].TEMP_ATTRIBUTES is None
    assert rows["54511099999"].FRSHTT == "010000"          # stays text
    out = {r.station_id: r for r in clean.clean_gsod(df).collect()}
    assert round(out["A5125600451"].temp_avg_c, 4) == 1.5556
    assert out["A5125600451"].station_pressure_hpa == 976.8
    assert out["54511099999"].station_pressure_hpa is None
    assert round(out["54511099999"].precip_mm, 4) == 3.81


def test_measurement_json_and_flatten(spark):
    d = tempfile.mkdtemp(prefix="airshed-test-")
    recs = [{"value": 0.043, "parameter": {"id": 10, "name": "o3", "units": "ppm"},
             "period": {"datetimeFrom": {"utc": "2016-03-06T19:00:00Z", "local": "2016-03-06T12:00:00-07:00"}}},
            {"value": None, "parameter": {"id": 10, "name": "o3", "units": "ppm"},
             "period": {"datetimeFrom": {"utc": "2016-03-07T19:00:00Z"}}},
            {"value": 1.0, "parameter": {"id": 10, "name": "o3", "units": "ppm"}}]
    with open(os.path.join(d, "m.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))
    df = readers.read_measurements_json(spark, d)
    rows = readers.measurement_rows(df).collect()
    assert len(rows) == 1 and str(rows[0].date) == "2016-03-06" and rows[0].value == 0.043
    flat = readers.flatten(df)
    assert "period_datetimeFrom_utc" in flat.columns and "parameter_units" in flat.columns


def test_sensors_first_match(spark):
    loc = spark.createDataFrame(
        [(1, [(11, "a", (2, "pm25")), (12, "b", (2, "pm25")), (13, "c", (10, "o3"))])],
        "id long, sensors array<struct<id:long,name:string,parameter:struct<id:int,name:string>>>")
    pid = spark.createDataFrame([("pm25", 2), ("o3", 10), ("no2", 7)], "parameter string, parameter_id int")
    got = {(r.parameter, r.sensor_id) for r in readers.sensors_for(loc, pid).collect()}
    assert got == {("pm25", 11), ("o3", 13)}


def test_city_year_sink_roundtrip(spark):
    import datetime as dt
    df = spark.createDataFrame([("NATION 1", dt.date(1998, 1, 1), 1.005, 1998), ("A/B", dt.date(1999, 1, 1), 2.675, 1999)],
                               "city_name string, date date, temp_avg_c double, year int")
    path = tempfile.mkdtemp(prefix="airshed-test-") + "/out"
    sinks.write_city_year(df, path)
    back = spark.read.parquet(path)
    assert sorted(r.city_part for r in back.collect()) == ["A_B", "NATION_1"]
    assert sorted(r.temp_avg_c for r in back.collect()) == [1.0, 2.68]   # scaled rint: 267.5 -> 268 (NumPy)
    rep = sinks.quality_report(df, ["temp_avg_c"]).first()
    assert rep["count"] == 2 and rep["coverage_pct"] == 100.0


def test_archive_partition_tree(spark):
    """Hourly csv.gz files below locationid=/year=/month=: partitions from the path, pruned by a filter, unreadable files skipped."""
    import gzip

    d = tempfile.mkdtemp(prefix="airshed-archive-")
    header = "location_id,sensors_id,location,datetime,lat,lon,parameter,units,value\n"
    for loc in (1, 2):
        for year, month in ((2023, "12"), (2024, "01")):
            at = os.path.join(d, f"locationid={loc}", f"year={year}", f"month={month}")
            os.makedirs(at)
            with gzip.open(os.path.join(at, f"location-{loc}-{year}{month}.csv.gz"), "wt") as f:
                f.write(header + "".join(f"{loc},9,x,{year}-{month}-0{k}T00:00:00+00:00,1,2,{p},µg/m³,{v}\n" for k, (p, v) in enumerate((("pm25", "5.5"), ("pm10", " 7 "), ("pm25", "n/a")), 1)))
    with open(os.path.join(d, "locationid=2", "year=2024", "month=01", "broken.csv.gz"), "wb") as f:
        f.write(b"\x1f\x8b not a gzip file")
    df = readers.read_openaq_archive(spark, d)
    assert df.count() == 12
    got = sorted((r.locationid, r.year, r.month, r.value_num) for r in readers.read_openaq_archive(spark, d, "pm25").collect() if r.value_num is not None)
    assert got == [(1, 2023, 12, 5.5), (1, 2024, 1, 5.5), (2, 2023, 12, 5.5), (2, 2024, 1, 5.5)]
    pruned = df.where("year = 2024 AND locationid = 1")
    assert pruned.count() == 3
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()
