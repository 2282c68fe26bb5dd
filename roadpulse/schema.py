"""Schemas of the source files, the stored measurement table and the load manifest."""

from __future__ import annotations

from pyspark.sql import types as T

# Source columns in the order the monthly CSV files carry them.
DATE_TIME = "DATE_TIME"
LATITUDE = "LATITUDE"
LONGITUDE = "LONGITUDE"
GEOHASH = "GEOHASH"
MINIMUM_SPEED = "MINIMUM_SPEED"
MAXIMUM_SPEED = "MAXIMUM_SPEED"
AVERAGE_SPEED = "AVERAGE_SPEED"
NUMBER_OF_VEHICLES = "NUMBER_OF_VEHICLES"

RAW_SCHEMA = T.StructType(
    [
        T.StructField(DATE_TIME, T.TimestampNTZType(), True),
        T.StructField(LATITUDE, T.DoubleType(), True),
        T.StructField(LONGITUDE, T.DoubleType(), True),
        T.StructField(GEOHASH, T.StringType(), True),
        T.StructField(MINIMUM_SPEED, T.IntegerType(), True),
        T.StructField(MAXIMUM_SPEED, T.IntegerType(), True),
        T.StructField(AVERAGE_SPEED, T.IntegerType(), True),
        T.StructField(NUMBER_OF_VEHICLES, T.IntegerType(), True),
    ]
)
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

# Calendar columns materialised at load time.
CALENDAR_SCHEMA = T.StructType(
    [
        T.StructField("year", T.IntegerType(), True),
        T.StructField("month", T.IntegerType(), True),
        T.StructField("hour", T.IntegerType(), True),
        T.StructField("dow", T.IntegerType(), True),
        T.StructField("month_ts", T.TimestampNTZType(), True),
        T.StructField("day_ts", T.TimestampNTZType(), True),
    ]
)
CALENDAR_COLUMNS = [f.name for f in CALENDAR_SCHEMA.fields]

TRAFFIC_SCHEMA = T.StructType(RAW_SCHEMA.fields + CALENDAR_SCHEMA.fields)
TRAFFIC_COLUMNS = [f.name for f in TRAFFIC_SCHEMA.fields]

# What the store keeps: the traffic columns, the name of the file each row came from,
# and the load of that file, which is a partition column, so the rows of one file lie in
# folders of their own. No report returns the last two.
SOURCE_FILE = "source_file"
LOAD = "load"
PARTITION_COLUMNS = ["year", "month"]
STORE_PARTITIONS = PARTITION_COLUMNS + [LOAD]
# Column metadata key set on ``year``/``month`` of frames that scan the
# partitioned store, so a range filter adds the partition bound only where it
# prunes folders (on derived columns it would only cost per-row work).
PARTITION_MARK = "roadpulse.partition"
LOAD_FIELD = T.StructField(LOAD, T.StringType(), True)
STORED_SCHEMA = T.StructType(
    RAW_SCHEMA.fields
    + [f for f in CALENDAR_SCHEMA.fields if f.name not in PARTITION_COLUMNS]
    + [T.StructField(SOURCE_FILE, T.StringType(), True)]
    + [f for f in CALENDAR_SCHEMA.fields if f.name in PARTITION_COLUMNS]
    + [LOAD_FIELD]
)
STORED_COLUMNS = [f.name for f in STORED_SCHEMA.fields]
# What a load is made of: the stored columns before the store names the load.
LOADED_COLUMNS = [c for c in STORED_COLUMNS if c != LOAD]

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("filename", T.StringType(), True),
        T.StructField("state", T.StringType(), True),
        T.StructField("load", T.StringType(), True),
        T.StructField("version", T.LongType(), True),
    ]
)


def mark_partitions(columns: list[str]):
    """Select ``columns``, tagging the partition columns with ``PARTITION_MARK``."""
    from pyspark.sql import functions as F

    return [F.col(c).alias(c, metadata={PARTITION_MARK: True}) if c in PARTITION_COLUMNS else F.col(c) for c in columns]


def is_partitioned(schema: T.StructType) -> bool:
    """Whether ``year`` and ``month`` carry the partition mark."""
    names = set(schema.fieldNames())
    return all(c in names and schema[c].metadata.get(PARTITION_MARK, False) for c in PARTITION_COLUMNS)

