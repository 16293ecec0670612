"""Capability and requirement queries: (feature, target) -> status and reason, unknown kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses in order of precedence, and routes in order of preference.
EVIDENCE_ORDER = ("PRESENT", "ABSENT", "UNRESOLVED")
ROUTE_ORDER = ("DIRECT", "REWRITE", "HELPER", "EMULATE", "RUNTIME")


def lookup(table: DataFrame, feature: str, target: str) -> DataFrame:
    """Status and reason of one feature for one target; an empty result means it is not in the table."""
    return table.filter((F.col("feature") == feature) & (F.col("target") == target)).select("feature", "target", "status", "reason")


def matrix(table: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """The features by targets grid; pairs without a row are UNKNOWN."""
    spark = table.sparkSession
    f = spark.createDataFrame([(x,) for x in features], "feature string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    grid = F.broadcast(f).crossJoin(F.broadcast(t))  # both lists are given by the caller
    return grid.join(table.select("feature", "target", "status"), ["feature", "target"], "left").withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))


def combine_evidence(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One status per key: PRESENT beats ABSENT beats UNRESOLVED; with the number of rows behind each."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, EVIDENCE_ORDER)), F.col("status")), F.lit(0))
    best = rows.withColumn("__r", F.when(rank > 0, rank).otherwise(len(EVIDENCE_ORDER)))
    agg = best.groupBy(*keys).agg(F.min("__r").alias("__m"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in EVIDENCE_ORDER])
    return agg.withColumn("status", F.element_at(F.array(*map(F.lit, EVIDENCE_ORDER)), F.col("__m").cast("int"))).drop("__m")


def preferred_route(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most direct route of each key; ERROR where none is known."""
    order = F.array(*map(F.lit, ROUTE_ORDER))
    rank = F.array_position(order, F.col("mode"))
    got = rows.groupBy(*keys).agg(F.min(F.when(rank > 0, rank)).alias("__m"))
    return got.select(*keys, F.coalesce(F.try_element_at(order, F.col("__m").cast("int")), F.lit("ERROR")).alias("mode"))
