"""Unit sequences kept as a table: node, units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.sources.catalog import exists


def write_units(units: DataFrame, folder: str) -> None:
    units.select("node", "units").write.mode("overwrite").parquet(folder)


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("node string, units array<int>").parquet(folder)


def units_or_make(spark: SparkSession, folder: str, expected: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The sequences of a folder; made and written first if they are not ``expected`` ones.

    They are not counted again after that: words without frames have none.
    """
    if not exists(spark, folder) or read_units(spark, folder).count() != expected:
        write_units(make(), folder)
    return read_units(spark, folder)
