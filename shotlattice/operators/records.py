"""Nested records, one per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def measure(n: Column, mean: Column, variance: Column, median: Column) -> Column:
    """Struct of a statistic, null if nothing was measured."""
    return F.when(n > 0, F.struct(mean.alias("mean"), F.sqrt(variance).alias("sd"), median.alias("median"), n.alias("n")))


def timeline(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """The rows of an item as one ordered array of structs: an item's segments, a bounded list."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("timeline"))


def sized(df: DataFrame, record: Column, inputs: Column) -> DataFrame:
    """Compact JSON of a record, its bytes and the share saved against its inputs."""
    return df.withColumn("json", F.to_json(record)).withColumn("bytes", F.octet_length("json")).withColumn("saved", 1 - F.try_divide(F.col("bytes"), inputs))
