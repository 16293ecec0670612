"""Registries of primitives and their lowering, from CSV files given by path: loaded, validated and queried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.files import read_csv


def load_primitives(spark: SparkSession, path: str) -> DataFrame:
    """(table_index, name, kernel, arity, readiness): a registry with one row per primitive; cells that are no number are null."""
    x = read_csv(spark, path)
    number = lambda c, kind: F.trim(F.col(c)).try_cast(kind).alias(c)
    return x.select(number("table_index", "int"), "name", "kernel", number("arity", "int"), F.col("baseline_readiness").try_cast("double").alias("readiness"))


def primitive_faults(primitives: DataFrame) -> DataFrame:
    """(name, fault): names without index or arity, out of range, or held twice; an empty result is a valid registry."""
    p = primitives
    fault = F.when(F.col("table_index").isNull() | (F.col("table_index") < 0), "index").when(F.col("arity").isNull() | (F.col("arity") < -1), "arity").when(~F.col("readiness").between(0, 1), "readiness")
    own = p.select("name", fault.alias("fault")).filter("fault IS NOT NULL")
    twice = p.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.lit("duplicate").alias("fault"))
    return own.unionByName(twice)


def load_micro_map(spark: SparkSession, path: str) -> DataFrame:
    """(micro_operation, atomic_operation): the pairs that are required, each once."""
    return read_csv(spark, path).filter(F.trim("required").isin("1", "true")).select("micro_operation", "atomic_operation").distinct()


def lowering_routes(primitives: DataFrame, kernel_micro: DataFrame, micro_map: DataFrame) -> DataFrame:
    """(name, n_micro, n_atomic): what a primitive's kernel is lowered to; 0 where nothing is known.

    kernel_micro(kernel, micro_operation).
    """
    x = primitives.select("name", "kernel").join(kernel_micro, "kernel", "left").join(micro_map, "micro_operation", "left")
    return x.groupBy("name").agg(F.countDistinct("micro_operation").alias("n_micro"), F.countDistinct("atomic_operation").alias("n_atomic"))


def implementation_matrix(rows: DataFrame, operation: str, stage: str, status: str, stages: list[str]) -> DataFrame:
    """One row per operation with the status of each stage; ``UNKNOWN`` where a pair has no row, the least of several."""
    wide = rows.groupBy(operation).pivot(stage, stages).agg(F.min(status))
    return wide.select(operation, *[F.coalesce(F.col(s), F.lit("UNKNOWN")).alias(s) for s in stages])
