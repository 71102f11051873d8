"""Schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

VERSION_ID = T.DecimalType(20, 0)

VERSIONS = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("snap", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("version_id", VERSION_ID),
    T.StructField("created", T.TimestampType()),
    T.StructField("size", T.LongType()),
    T.StructField("referenced", T.LongType()),
    T.StructField("is_head", T.BooleanType()),
])

CHANGES = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("off", T.LongType(), False),
    T.StructField("len", T.LongType(), False),
])

LOG_LINES = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("line", T.StringType()),
])

IMAGES = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("bytes", T.BinaryType()),
])

CELL_VERSIONS = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("cell", T.LongType(), False),
    T.StructField("payload", T.BinaryType()),
])

FINGERPRINTS = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("snap", T.StringType(), False),
    T.StructField("ord", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("cell_size", T.LongType()),
    T.StructField("lanes", T.IntegerType()),
    T.StructField("algo", T.StringType()),
    T.StructField("acc", T.BinaryType()),
    T.StructField("version_id", VERSION_ID),
    T.StructField("complete", T.BooleanType()),
])

PROPERTIES = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("property", T.StringType(), False),
    T.StructField("value", T.StringType()),
    T.StructField("source", T.StringType()),
])

HOLDS = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("snap", T.StringType(), False),
    T.StructField("tag", T.StringType(), False),
    T.StructField("ts", T.TimestampType()),
])
