"""Schemas of position reports and of ships."""

from pyspark.sql import types as T

REPORTS = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("course", T.DoubleType()),
        T.StructField("ship_type", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)
SHIPS = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("ship_type", T.StringType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
    ]
)
