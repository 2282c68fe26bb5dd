"""Measurement rows derived from the driver's ``lineitem`` table.

The driver only provides TPC-H-like tables, so the reports run on a traffic
frame computed from ``lineitem`` with the same expressions the oracle uses
(see FIXTURES.md). It is a projection of one scan: no shuffle, and the row
count grows with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import with_calendar
from ..schema import RAW_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """The eight source columns, one row per line item."""
    segment = F.expr("l_partkey div 3")
    q2 = F.col("l_quantity") * F.lit(2)
    cols = {
        "DATE_TIME": F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (F.col("l_orderkey") % 24).cast("int")),
        "LATITUDE": F.lit(40.8) + (segment % 400) * F.lit(0.001),
        "LONGITUDE": F.lit(28.5) + (segment % 900) * F.lit(0.001),
        "GEOHASH": F.concat(F.lit("sx"), F.lpad(segment.cast("string"), 6, "0")),
        "MINIMUM_SPEED": F.greatest(q2 - F.lit(10), F.lit(0.0)).cast("int"),
        "MAXIMUM_SPEED": (q2 + F.lit(5) + F.col("l_linenumber")).cast("int"),
        "AVERAGE_SPEED": q2.cast("int"),
        "NUMBER_OF_VEHICLES": (F.col("l_suppkey") % 97 + F.col("l_linenumber")).cast("int"),
    }
    out = lineitem.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])
    return out


def traffic_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Source columns plus the calendar columns, as the store holds them."""
    return with_calendar(raw_from_lineitem(lineitem))


def traffic_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic_from_lineitem(read_table(spark, sf_dir, "lineitem"))
