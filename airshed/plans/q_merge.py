"""Registered queries: stations, multi-station merge, pollutant pivot, joins, spine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from airshed.constants import POLLUTANTS, WEATHER_COLS
from airshed.functions import aqi as A
from airshed.operators import merge, stations
from airshed.plans.oracle_views import with_views as V
from airshed.plans.oracle_views import _near
from airshed.plans.pipeline import CityPipeline, stored_merged
from airshed.plans.registry import query
from airshed.plans.sqlgen import aqi_sql, category_sql, greatest_sql
from airshed.sources import domain

_WOUT = ([c for c in WEATHER_COLS] + [f"{c}_source_count" for c in WEATHER_COLS]
         + [f"{c}_is_outlier" for c in WEATHER_COLS if c != "dewpoint_c"])


@query("nearest_stations", V("near_w") + "SELECT city_id, station_id, distance_km, CAST(rank AS INTEGER) AS rank FROM near_w",
       ["distance_km"])
def nearest_stations(spark, d):
    """Up to 5 stations per city with haversine distance < 50 km (grid-bucketed range join)."""
    p = CityPipeline(spark, d)
    return p.weather_map(coverage=False).select("city_id", "station_id", "distance_km", "rank")


@query("nearest_station", V("city", "active_station", extra=[("n1", _near(100.0, 1))]) +
       "SELECT city_id, station_id, distance_km FROM n1", ["distance_km"])
def nearest_station(spark, d):
    """J3 nearest-1 variant (100 km)."""
    p = CityPipeline(spark, d)
    return stations.nearest_stations(p.cities(), p.stations(), 100.0, 1).select("city_id", "station_id", "distance_km")


@query("stations_in_radius", V("city", "active_station", extra=[("n", _near(25.0, 20))]) +
       "SELECT city_id, station_id, distance_km * 1000e0 AS distance_m FROM n", ["distance_m"])
def stations_in_radius(spark, d):
    """Locations within 25 000 m of each city, at most 20, nearest first."""
    p = CityPipeline(spark, d)
    m = stations.nearest_stations(p.cities(), p.stations(), 25.0, 20)
    return m.select("city_id", "station_id", (F.col("distance_km") * F.lit(1000.0)).alias("distance_m"))


@query("stations_in_bbox", V("city", "active_station") + """
SELECT c.city_id, s.station_id FROM city c JOIN active_station s
  ON s.lat BETWEEN c.lat - 0.3e0 AND c.lat + 0.3e0 AND s.lon BETWEEN c.lng - 0.3e0 AND c.lng + 0.3e0""")
def stations_in_bbox(spark, d):
    """J4 bounding-box variant: station inside city +- 0.3 degrees (grid-bucketed, exact post-filter)."""
    p = CityPipeline(spark, d)
    half = 0.3
    dg = half
    c = stations.search_cells(p.cities().select("city_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng")),
                              0.0, dg, lat="c_lat", lon="c_lng")
    s = stations.station_cells(p.stations().select("station_id", F.col("lat").alias("s_lat"),
                                                   F.col("lon").alias("s_lon")), dg, lat="s_lat", lon="s_lon")
    j = c.join(s, ["cell_lat", "cell_lon"])
    return j.where(F.col("s_lat").between(F.col("c_lat") - half, F.col("c_lat") + half)
                   & F.col("s_lon").between(F.col("c_lng") - half, F.col("c_lng") + half)) \
        .select("city_id", "station_id")


@query("coverage_filter", V("wmap") + "SELECT city_id, station_id, distance_km, CAST(rank AS INTEGER) AS rank FROM wmap",
       ["distance_km"])
def coverage_filter(spark, d):
    """Stations whose core-column coverage >= 0.3 (single-station cities always kept)."""
    return CityPipeline(spark, d).weather_map().select("city_id", "station_id", "distance_km", "rank")


@query("idw_weather", V("weather_city") + "SELECT city_id, date, " + ", ".join(_WOUT) + " FROM weather_city",
       WEATHER_COLS)
def idw_weather(spark, d):
    """Inverse-distance-weighted city-day weather, NULLs skipped, weights renormalised."""
    return CityPipeline(spark, d).weather_city_days().select("city_id", "date", *_WOUT)


@query("merge_provenance", V("weather_city") + "SELECT city_id, date, station_count, data_source, data_quality_score "
       "FROM weather_city", ["data_quality_score"])
def merge_provenance(spark, d):
    """station_count, data_source, data_quality_score per city-day."""
    return CityPipeline(spark, d).weather_city_days().select("city_id", "date", "station_count", "data_source",
                                                             "data_quality_score")


@query("first_location", V("weather_city") + "SELECT city_id, date, lat, lon, elev_m FROM weather_city",
       ["lat", "lon", "elev_m"])
def first_location(spark, d):
    """Coordinates of the nearest contributing station with a location."""
    return CityPipeline(spark, d).weather_city_days().select("city_id", "date", "lat", "lon", "elev_m")


_AOUT = POLLUTANTS + [f"{p}_source_count" for p in POLLUTANTS] + [f"{p}_is_outlier" for p in POLLUTANTS]


@query("idw_air", V("air_city") + "SELECT city_id, date, " + ", ".join(_AOUT) +
       ", station_count, data_source, data_quality_score FROM air_city", POLLUTANTS + ["data_quality_score"])
def idw_air(spark, d):
    """Air-quality IDW (w = 1 / max(m, 100)) with provenance."""
    return CityPipeline(spark, d).air_city_days().select("city_id", "date", *_AOUT, "station_count", "data_source",
                                                         "data_quality_score")


_PIV = ", ".join(f"avg(CASE WHEN parameter = '{p}' THEN value END) AS {p}" for p in POLLUTANTS)


@query("merge_pollutants", V("air_parsed") + f"SELECT location_id, date, {_PIV} FROM air_parsed "
       "GROUP BY location_id, date", POLLUTANTS)
def merge_pollutants(spark, d):
    """Per-pollutant daily tables combined per (location, day) -- a pivot in one shuffle
    instead of a chain of outer joins."""
    return CityPipeline(spark, d).air_location_days().select("location_id", "date", *POLLUTANTS)


@query("merge_daily", V("merged") + "SELECT * FROM merged", WEATHER_COLS + POLLUTANTS)
def merge_daily(spark, d):
    """Weather LEFT JOIN air on (city, date); names normalised, bookkeeping dropped."""
    return CityPipeline(spark, d).merged()


_AQI6 = ", ".join(f"{aqi_sql(p, p)} AS {p}_aqi" for p in POLLUTANTS)


@query("merged_aqi", V("merged", extra=[("ma", f"SELECT city_name, date, temp_avg_c, pm25, {_AQI6} FROM merged")]) +
       f"SELECT city_name, date, temp_avg_c, pm25, aqi, {category_sql('aqi')} AS category FROM ("
       f"SELECT *, {greatest_sql([p + '_aqi' for p in POLLUTANTS])} AS aqi FROM ma) x", ["temp_avg_c", "pm25"])
def merged_aqi(spark, d):
    """Flagship: merged city-day table with overall AQI and category."""
    m = CityPipeline(spark, d).merged()
    a = A.aqi_columns(m.select("city_name", "date", "temp_avg_c", *POLLUTANTS))
    o = a.select("city_name", "date", "temp_avg_c", "pm25",
                 A.overall_aqi([f"{p}_aqi" for p in POLLUTANTS]).alias("aqi"))
    return o.select("*", A.category("aqi").alias("category"))


@query("city_metadata_join", V("merged") + """
SELECT m.city_name, m.date, m.pm25, c.lat, c.lng, c.population
FROM merged m JOIN (SELECT replace(city_name, '_', ' ') AS city_name, lat, lng, population FROM city) c
  ON m.city_name = c.city_name""", ["pm25", "lat", "lng"])
def city_metadata_join(spark, d):
    """Static city attributes joined to the fact table (bounded dimension, broadcast)."""
    m = stored_merged(spark, d).select("city_name", "date", "pm25")
    c = domain.cities(spark, d).select(merge.normalise_city_name(F.col("city_name")).alias("city_name"),
                                       "lat", "lng", "population")
    return m.join(c, "city_name")


@query("fill_missing_dates", V("merged") + """
SELECT s.city_name, s.date, m.pm25, m.temp_avg_c, m.date IS NULL AS is_filled FROM (
  SELECT city_name, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
  FROM merged GROUP BY city_name) s
LEFT JOIN merged m ON s.city_name = m.city_name AND s.date = m.date""", ["pm25", "temp_avg_c"])
def fill_missing_dates(spark, d):
    """Per-city calendar spine (min..max) LEFT JOIN data."""
    m = stored_merged(spark, d).select("city_name", "date", "pm25", "temp_avg_c",
                                               F.lit(True).alias("_present"))
    out = merge.fill_missing_dates(m, "city_name", "date")
    return out.select("city_name", "date", "pm25", "temp_avg_c", F.col("_present").isNull().alias("is_filled"))


@query("fill_missing_dates_all", V("air_city", "city") + """
SELECT s.city_id, s.date, a.pm25, coalesce(a.data_source, md.data_source) AS data_source FROM (
  SELECT city_id, unnest(generate_series(DATE '1998-01-01', DATE '1999-12-31', INTERVAL 1 DAY))::DATE AS date
  FROM (SELECT DISTINCT city_id FROM air_city) k) s
LEFT JOIN air_city a ON s.city_id = a.city_id AND s.date = a.date
LEFT JOIN (SELECT city_id, mode() WITHIN GROUP (ORDER BY data_source) AS data_source FROM air_city GROUP BY city_id) md
  ON s.city_id = md.city_id""", ["pm25"])
def fill_missing_dates_all(spark, d):
    """Fixed two-year spine per city; metadata filled with the city's most frequent value."""
    a = CityPipeline(spark, d).air_city_days().select("city_id", "date", "pm25", "data_source")
    out = merge.fill_missing_dates(a, "city_id", "date", start="1998-01-01", end="1999-12-31",
                                   mode_cols=["data_source"])
    return out.select("city_id", "date", "pm25", "data_source")


@query("load_city_year", V("merged") + "SELECT * FROM merged WHERE city_name = 'NATION 7' AND year = 1999",
       WEATHER_COLS + POLLUTANTS)
def load_city_year(spark, d):
    """One city-year slice (a partition filter on the city/year partitioned table)."""
    return stored_merged(spark, d).where((F.col("city_name") == "NATION 7") & (F.col("year") == 1999))


@query("load_all", V("merged") + "SELECT * FROM merged WHERE city_name IN ('NATION 1', 'NATION 2', 'NATION 3')",
       WEATHER_COLS + POLLUTANTS)
def load_all(spark, d):
    """Selected cities, all years (isin filter, no sort until a sink)."""
    return stored_merged(spark, d).where(F.col("city_name").isin("NATION 1", "NATION 2", "NATION 3"))


@query("filter_window", V("air_parsed") + """
SELECT location_id, parameter, ts_utc, value FROM air_parsed
WHERE ts_utc >= TIMESTAMP '1998-03-01 00:00:00' AND ts_utc < DATE '1998-03-31' + INTERVAL 1 DAY""", ["value"])
def filter_window(spark, d):
    """Date window, start inclusive, end day inclusive up to 23:59:59."""
    p = CityPipeline(spark, d).air_parsed()
    end = F.date_add(F.lit("1998-03-31").cast("date"), 1).cast("timestamp")
    return p.where((F.col("ts_utc") >= F.lit("1998-03-01 00:00:00").cast("timestamp")) & (F.col("ts_utc") < end)) \
        .select("location_id", "parameter", "ts_utc", "value")


@query("union_sources", V("weather_city", "air_city") + """
SELECT city_id, date, temp_avg_c, NULL::DOUBLE AS pm25, 'weather' AS source FROM weather_city
UNION ALL
SELECT city_id, date, NULL::DOUBLE AS temp_avg_c, pm25, 'air' AS source FROM air_city""", ["temp_avg_c", "pm25"])
def union_sources(spark, d):
    """UNION ALL by name of heterogeneous frames, missing columns NULL."""
    p = CityPipeline(spark, d)
    w = p.weather_city_days().select("city_id", "date", "temp_avg_c", F.lit("weather").alias("source"))
    a = p.air_city_days().select("city_id", "date", "pm25", F.lit("air").alias("source"))
    return w.unionByName(a, allowMissingColumns=True)


_CATALOGUE_SQL = """
  SELECT city_id AS id, city_name AS city_ascii, lat, lng, 'country_' || iso2 AS country, iso2, population FROM city
  UNION ALL
  SELECT 100000 + s_suppkey AS id, c.city_name AS city_ascii, c.lat, c.lng, 'country_' || c.iso2 AS country, c.iso2,
         CAST(((s_suppkey * 31) % 5000) * 100 AS BIGINT) AS population
  FROM supplier s JOIN city c ON s.s_nationkey = c.city_id"""


def worldcities(spark, d):
    c = domain.cities(spark, d)
    s = domain.table(spark, d, "supplier")
    base = c.select(F.col("city_id").cast("long").alias("id"), F.col("city_name").alias("city_ascii"), "lat", "lng",
                    F.concat(F.lit("country_"), F.col("iso2")).alias("country"), "iso2", "population")
    towns = s.join(c, s.s_nationkey == c.city_id).select(
        (F.lit(100000) + F.col("s_suppkey")).alias("id"), F.col("city_name").alias("city_ascii"), "lat", "lng",
        F.concat(F.lit("country_"), F.col("iso2")).alias("country"), "iso2",
        (((F.col("s_suppkey") * 31) % 5000) * 100).cast("long").alias("population"))
    return base.unionByName(towns)


@query("city_lookup", V("city", extra=[("wc", _CATALOGUE_SQL)]) + """
SELECT query_id, match_id, match_population FROM (
  SELECT q.query_id, w.id AS match_id, w.population AS match_population,
         row_number() OVER (PARTITION BY q.query_id ORDER BY w.population DESC, w.id) AS r
  FROM (SELECT c_custkey AS query_id, lower(trim(' ' || n_name || ' ')) AS qn, upper('c' || CAST(n_regionkey AS VARCHAR)) AS qc
        FROM customer JOIN nation ON c_nationkey = n_nationkey) q
  JOIN wc w ON lower(trim(w.city_ascii)) = q.qn AND upper(w.iso2) = q.qc) x WHERE r = 1""")
def city_lookup(spark, d):
    """Normalised (name, country) lookup; duplicates resolved by largest population."""
    cu = domain.table(spark, d, "customer")
    n = domain.table(spark, d, "nation")
    q = cu.join(n, cu.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("query_id"), F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("query_name"),
        F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("query_iso2"))
    return stations.city_lookup(q, worldcities(spark, d)).select("query_id", "match_id", "match_population")


@query("city_search", V("city", extra=[("wc", _CATALOGUE_SQL)]) + """
SELECT id, city_ascii, country FROM wc
WHERE regexp_matches(lower(city_ascii), 'nation_1') OR regexp_matches(lower(country), 'nation_1')
ORDER BY id LIMIT 10""")
def city_search(spark, d):
    """Case-insensitive regex over city or country, first 10 by id (top-k is the feature)."""
    return stations.city_search(worldcities(spark, d), "nation_1", 10).select("id", "city_ascii", "country")


@query("best_station", V("air_parsed", "near_a") + """
SELECT city_id, parameter, station_id, n FROM (
  SELECT m.city_id, a.parameter, m.station_id, count(a.value) AS n,
         row_number() OVER (PARTITION BY m.city_id, a.parameter ORDER BY count(a.value) DESC, m.station_id) AS r
  FROM air_parsed a JOIN near_a m ON a.location_id = m.station_id
  GROUP BY m.city_id, a.parameter, m.station_id) x WHERE r = 1""")
def best_station(spark, d):
    """Representative station per (city, pollutant) = most records (fallback is automatic:
    a station without that pollutant never ranks for it)."""
    p = CityPipeline(spark, d)
    m = p.air_map().select("city_id", F.col("station_id").alias("location_id"))
    counts = p.air_parsed().join(m, "location_id").groupBy("city_id", "parameter", "location_id") \
        .agg(F.count("value").alias("n"))
    w = Window.partitionBy("city_id", "parameter").orderBy(F.col("n").desc(), F.col("location_id"))
    return counts.select("*", F.row_number().over(w).alias("r")).where("r = 1") \
        .select("city_id", "parameter", F.col("location_id").alias("station_id"), "n")
