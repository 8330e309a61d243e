"""Totals, reconciliation and embedding diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(df: DataFrame, entity: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(entity) if approximate else F.count_distinct(entity)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("vessels"))


def per_cohort(df: DataFrame) -> DataFrame:
    """Rows and distinct vessels per cohort, largest first."""
    return df.groupBy("superclass_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("vessel_id_int").alias("vessels"),
    ).orderBy(F.desc("n_rows"), "superclass_id")


def sample_ids(df: DataFrame, cohort: int, size: int = 20) -> DataFrame:
    """The first distinct vessels of a cohort."""
    ids = df.where(F.col("superclass_id") == cohort).select("vessel_id_int").distinct()
    return ids.orderBy("vessel_id_int").limit(size)


def reconcile(shards: DataFrame, registry: DataFrame) -> DataFrame:
    """Shard rows against registry rows, and shard rows with no registry entry."""
    keys = ["embedding_id", "superclass_id"]
    n = F.count(F.lit(1))
    missing = shards.select(*keys).join(registry.select(*keys), keys, "left_anti")
    both = (
        shards.agg(n.alias("n")).select(F.lit("shard_rows").alias("item"), "n")
        .unionByName(registry.agg(n.alias("n")).select(F.lit("registry_rows").alias("item"), "n"))
        .unionByName(missing.agg(n.alias("n")).select(F.lit("missing_rows").alias("item"), "n"))
    )
    return both
