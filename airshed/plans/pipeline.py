"""The city ETL (weather + air -> merged city-day table) as one lazy plan.

``CityPipeline`` only wires operators together; every method returns a lazy
DataFrame over the Parquet scans, so a caller that needs one column still gets
a pruned scan.  Parameters default to the reference pipeline's settings.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airshed.constants import COVERAGE_MIN
from airshed.operators import clean, merge, stations
from airshed.session import checkpoint_dir
from airshed.sources import domain

# bump when the ETL semantics change so stored tables are rebuilt
ETL_VERSION = "merged-v3"


@dataclass
class CityPipeline:
    spark: SparkSession
    sf_dir: str
    year: int = 2022                 # "now" for the station activity rule
    weather_radius_km: float = 50.0
    weather_max_stations: int = 5
    air_radius_km: float = 50.0
    air_max_stations: int = 20
    min_coverage: float = COVERAGE_MIN

    # ---------------------------------------------------------------- dims
    def cities(self) -> DataFrame:
        return domain.cities(self.spark, self.sf_dir)

    def stations(self) -> DataFrame:
        return stations.active_stations(domain.stations(self.spark, self.sf_dir), self.year)

    # ------------------------------------------------------------- weather
    def gsod_clean(self) -> DataFrame:
        return clean.clean_gsod(domain.gsod_raw(self.spark, self.sf_dir))

    def weather_candidates(self) -> DataFrame:
        """Stored: with its size known, the map is broadcast to the feed where it is small, so that
        the feed is not shuffled to meet it."""
        return stored(self, "weather-map", lambda: stations.nearest_stations(
            self.cities(), self.stations(), self.weather_radius_km, self.weather_max_stations))

    def weather_station_days(self) -> DataFrame:
        """Station-days of the stations that serve a city: one pass over the raw feed, stored once;
        coverage and weighting both read the stored table.  Other stations' rows go before the
        aggregate, so they are never shuffled."""
        def build() -> DataFrame:
            raw = domain.gsod_raw(self.spark, self.sf_dir)
            raw = raw.join(self.weather_candidates(), F.col("STATION") == F.col("station_id"), "left_semi")
            return merge.weather_station_days(clean.clean_gsod(raw), self.stations())
        return stored(self, "station-days", build)

    def weather_map(self, coverage: bool = True) -> DataFrame:
        m = self.weather_candidates()
        if coverage:
            m = clean.coverage_filter(self.weather_station_days(), m, self.min_coverage)
        return m

    def weather_city_days(self) -> DataFrame:
        return merge.idw_weather(self.weather_station_days(), self.weather_map())

    # ----------------------------------------------------------------- air
    def air_parsed(self) -> DataFrame:
        return clean.outlier_air(clean.parse_air(domain.openaq_raw(self.spark, self.sf_dir)))

    def air_location_days(self) -> DataFrame:
        return merge.air_location_days(self.air_parsed())

    def air_map(self) -> DataFrame:
        return stored(self, "air-map", lambda: stations.nearest_stations(
            self.cities(), self.stations(), self.air_radius_km, self.air_max_stations))

    def air_served(self) -> DataFrame:
        """Raw measurements of the locations that serve a city, in one pass over the raw feed.  Their time hangs on the
        joined map, so that the other locations' rows are neither parsed (a filter on the parsed time would go below
        the join) nor, where the map is broadcast, shuffled."""
        raw = domain.openaq_raw(self.spark, self.sf_dir)
        met = raw.join(self.air_map().select("station_id").distinct(), F.col("location_id") == F.col("station_id"))
        return met.withColumn("datetime", F.when(F.col("station_id").isNotNull(), F.col("datetime"))).select(*raw.columns)

    def air_city_days(self) -> DataFrame:
        days = merge.air_location_days(clean.outlier_air(clean.parse_air(self.air_served())))
        return merge.idw_air(days, self.air_map())

    # -------------------------------------------------------------- merged
    def merged(self) -> DataFrame:
        return merge.merge_daily(self.weather_city_days(), self.air_city_days(), self.cities())


def hourly_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = domain.hourly(spark, sf_dir)
    return h.select("location_id", "ts", F.to_date("ts").alias("date"), "pm25", "event_id")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_files(spark: SparkSession, path: str) -> list[str]:
    """name:length:time of every file below ``path``, as the Hadoop FileSystem lists them (any store that Spark reads)."""
    p, fs = _fs(spark, path)
    found = fs.listFiles(p, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return sorted(out)


def table_key(p: CityPipeline, tables=("lineitem", "supplier", "nation")) -> str:
    settings = {f.name: getattr(p, f.name) for f in fields(p) if f.name not in ("spark", "sf_dir")}
    files = [x for t in tables for x in input_files(p.spark, f"{p.sf_dir}/{t}.parquet")]
    return hashlib.sha1("|".join([ETL_VERSION, repr(sorted(settings.items())), *files]).encode()).hexdigest()[:16]


def _ready(spark: SparkSession, marker: str) -> str | None:
    """The folder that a marker file names, once some writer has published one."""
    p, fs = _fs(spark, marker)
    if not fs.exists(p):
        return None
    reader = fs.open(p)
    try:
        return reader.readUTF()
    finally:
        reader.close()


def stored(p: CityPipeline, name: str, build, *partitions: str) -> DataFrame:
    """A table of the ETL in the shared folder of ``spark.checkpoint.dir``, written once for each set
    of input files (name, length, time) and parameters.  Every writer has a folder of its own; the
    first to finish creates the marker file that names its folder, so nothing is renamed and no
    reader sees an unfinished write."""
    spark = p.spark
    root = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{table_key(p)}"
    at = _ready(spark, f"{root}/READY")
    if at is None:
        at = f"{root}/{uuid.uuid4().hex}"
        table = build()
        if partitions:  # one file per partition value instead of one per (task, value)
            table.repartition(*partitions).write.partitionBy(*partitions).parquet(at)
        else:
            table.write.parquet(at)
        marker, fs = _fs(spark, f"{root}/READY")
        try:
            writer = fs.create(marker, False)
            writer.writeUTF(at)
            writer.close()
        except Exception:  # another writer was first (its table is the same): use that one
            if (first := _ready(spark, f"{root}/READY")) is None:
                raise
            mine, _ = _fs(spark, at)
            fs.delete(mine, True)
            at = first
    return spark.read.parquet(at)


def stored_merged(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    """The merged city-day table as the ETL writes it: Parquet partitioned by city_name and year,
    so every reader is a pruned scan."""
    p = CityPipeline(spark, sf_dir, **params)
    return stored(p, "merged", p.merged, "city_name", "year")
