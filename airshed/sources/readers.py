"""File readers for the raw feeds (explicit schemas, no inference).

* ``read_gsod_csv``      daily station CSVs, all columns read as text then ``try_cast``
                          (numbers are quoted and space padded; FRSHTT must stay text)
* ``read_openaq_archive`` hourly ``csv.gz`` files under ``locationid=/year=/month=``;
                          partition columns come from the path (partition pruning)
* ``read_measurements_json`` API measurement records (nested structs)
* ``read_locations_json``    location records with a ``sensors`` array
* ``flatten``             nested struct -> ``a_b_c`` columns (json_normalize style)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airshed.operators.clean import numeric

GSOD_TEXT_COLUMNS = ["STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME", "TEMP", "TEMP_ATTRIBUTES",
                     "DEWP", "DEWP_ATTRIBUTES", "SLP", "SLP_ATTRIBUTES", "STP", "STP_ATTRIBUTES", "VISIB",
                     "VISIB_ATTRIBUTES", "WDSP", "WDSP_ATTRIBUTES", "MXSPD", "GUST", "MAX", "MAX_ATTRIBUTES", "MIN",
                     "MIN_ATTRIBUTES", "PRCP", "PRCP_ATTRIBUTES", "SNDP", "FRSHTT"]
GSOD_NUMERIC = ["LATITUDE", "LONGITUDE", "ELEVATION", "TEMP", "DEWP", "SLP", "STP", "VISIB", "WDSP", "MXSPD",
                "GUST", "MAX", "MIN", "PRCP", "SNDP"]
GSOD_COUNTS = ["TEMP_ATTRIBUTES", "DEWP_ATTRIBUTES", "SLP_ATTRIBUTES", "STP_ATTRIBUTES", "VISIB_ATTRIBUTES",
               "WDSP_ATTRIBUTES"]


def read_gsod_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in GSOD_TEXT_COLUMNS])
    raw = spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True) \
        .option("ignoreTrailingWhiteSpace", True).csv(path)
    cols: list[Column] = []
    for c in GSOD_TEXT_COLUMNS:
        x = F.trim(F.col(c))
        if c in GSOD_NUMERIC:
            cols.append(numeric(x).alias(c))
        elif c in GSOD_COUNTS:
            cols.append(x.try_cast("int").alias(c))
        elif c == "DATE":
            cols.append(F.to_date(x).alias(c))
        else:
            cols.append(x.alias(c))
    return raw.select(*cols)


OPENAQ_ARCHIVE_SCHEMA = T.StructType([
    T.StructField("location_id", T.StringType()), T.StructField("sensors_id", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("datetime", T.StringType()),
    T.StructField("lat", T.StringType()), T.StructField("lon", T.StringType()),
    T.StructField("parameter", T.StringType()), T.StructField("units", T.StringType()),
    T.StructField("value", T.StringType()),
])


def read_openaq_archive(spark: SparkSession, root: str, parameter: str | None = None) -> DataFrame:
    """Partition discovery gives ``locationid/year/month``; unreadable files are skipped."""
    df = spark.read.schema(OPENAQ_ARCHIVE_SCHEMA).option("header", True) \
        .option("ignoreCorruptFiles", True).option("recursiveFileLookup", False).csv(root)
    df = df.select("*", numeric(F.col("value")).alias("value_num"))
    if parameter is not None:
        df = df.where(F.col("parameter") == parameter)
    return df


MEASUREMENT_SCHEMA = T.StructType([
    T.StructField("value", T.DoubleType()),
    T.StructField("flagInfo", T.StructType([T.StructField("hasFlags", T.BooleanType())])),
    T.StructField("parameter", T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
        T.StructField("units", T.StringType()), T.StructField("displayName", T.StringType())])),
    T.StructField("period", T.StructType([
        T.StructField("label", T.StringType()), T.StructField("interval", T.StringType()),
        T.StructField("datetimeFrom", T.StructType([T.StructField("utc", T.StringType()),
                                                    T.StructField("local", T.StringType())])),
        T.StructField("datetimeTo", T.StructType([T.StructField("utc", T.StringType()),
                                                  T.StructField("local", T.StringType())]))])),
    T.StructField("coordinates", T.StructType([T.StructField("latitude", T.DoubleType()),
                                               T.StructField("longitude", T.DoubleType())])),
])

LOCATION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("locality", T.StringType()), T.StructField("timezone", T.StringType()),
    T.StructField("sensors", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("parameter", T.StructType([
            T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
            T.StructField("units", T.StringType()), T.StructField("displayName", T.StringType())]))]))),
])


def read_measurements_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASUREMENT_SCHEMA).json(path)


def read_locations_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCATION_SCHEMA).json(path)


def measurement_rows(df: DataFrame) -> DataFrame:
    """date = first 10 characters of period.datetimeFrom.utc; rows without date or value dropped."""
    out = df.select(F.substring(F.col("period.datetimeFrom.utc"), 1, 10).alias("date_text"),
                    F.col("value"), F.col("parameter.name").alias("parameter"),
                    F.col("parameter.units").alias("units"))
    return out.where(F.col("date_text").isNotNull() & F.col("value").isNotNull()) \
        .select(F.to_date("date_text").alias("date"), "value", "parameter", "units")


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs -> flat ``a_b_c`` columns (arrays are kept as they are)."""
    def walk(dtype: T.DataType, path: list[str]) -> list[Column]:
        if isinstance(dtype, T.StructType):
            cols = []
            for f in dtype.fields:
                cols += walk(f.dataType, path + [f.name])
            return cols
        return [F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))]

    out: list[Column] = []
    for f in df.schema.fields:
        out += walk(f.dataType, [f.name])
    return df.select(*out)


def sensors_for(locations: DataFrame, parameter_ids: DataFrame) -> DataFrame:
    """Sensors of each location measuring each parameter; the first sensor (array order) wins."""
    ex = locations.select(F.col("id").alias("location_id"), F.posexplode("sensors").alias("pos", "s"))
    j = ex.join(F.broadcast(parameter_ids), F.col("s.parameter.id") == F.col("parameter_id"))
    from pyspark.sql import Window
    w = Window.partitionBy("location_id", "parameter").orderBy("pos")
    return j.select("location_id", "parameter", F.col("s.id").alias("sensor_id"), F.row_number().over(w).alias("_r")) \
        .where("_r = 1").drop("_r")
