"""The motion store as tables: latest versions, best attempts, done filters, set relations, update by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_versions(versions: DataFrame, key: str, version: str, keep: int = 3) -> DataFrame:
    """The ``keep`` newest versions of each key, with rank 1 for the newest."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(version).desc()))
    return versions.withColumn("rank", rank).filter(F.col("rank") <= keep)


def swapped(versions: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """(key, version, value) with the values of each key's newest two versions exchanged."""
    order = W.partitionBy(key).orderBy(F.col(version).desc())
    rank, older, newer = F.row_number().over(order), F.lead(value).over(order), F.lag(value).over(order)
    both = F.count(F.lit(1)).over(W.partitionBy(key)) > 1
    return versions.select(key, version, F.when(both & (rank == 1), older).when(both & (rank == 2), newer).otherwise(F.col(value)).alias(value))


def best_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """(key, attempt, drift): the first attempt with the least drift."""
    return attempts.groupBy(key).agg(F.min(F.struct("drift", "attempt")).alias("m")).select(key, F.col("m.attempt").alias("attempt"), F.col("m.drift").alias("drift"))


def missing(required: DataFrame, there: DataFrame, on: list[str]) -> DataFrame:
    """Required rows that aren't there."""
    return required.join(there.select(*on).distinct(), on, "left_anti")
