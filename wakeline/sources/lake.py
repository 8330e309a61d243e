"""Partitioned feature lake, embedding shards, ledgers and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["year", "month", "vessel_bucket"]
SHARD_ROWS = 50_000


def with_partitions(df: DataFrame, ts: str = "datetime", bucket: str = "vessel_bucket_id") -> DataFrame:
    """Each row goes to the year and month of its own time."""
    return df.withColumns({
        "year": F.year(ts), "month": F.month(ts), "vessel_bucket": F.col(bucket).cast("int")})


def write_lake(df: DataFrame, path: str, files_per_partition: int = 1) -> None:
    """Hive layout; only the partitions present in ``df`` are replaced.

    Rows are spread over (partition, salt), so a hot bucket is written by
    ``files_per_partition`` tasks instead of one, and every task writes into few
    directories.
    """
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in PARTITIONS]), F.lit(files_per_partition))
    (
        df.withColumn("_salt", salt).repartition(*PARTITIONS, "_salt").drop("_salt")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS).parquet(path)
    )


def up_to(year: int, month: int, first_year: int = 0) -> Column:
    """Partition filter: from ``first_year`` up to a month, inclusive."""
    y, m = F.col("year"), F.col("month")
    return (y >= first_year) & ((y < year) | ((y == year) & (m <= month)))


def months(year: int, wanted: Sequence[int]) -> Column:
    return (F.col("year") == year) & F.col("month").isin(list(wanted))


def read_lake(spark: SparkSession, path: str, partitions: Column | None = None,
              columns: Sequence[str] = ()) -> DataFrame:
    """Scan with partition pruning and column pruning."""
    df = spark.read.parquet(path)
    if partitions is not None:
        df = df.where(partitions)
    return df.select(*columns) if columns else df


def read_moving(spark: SparkSession, *paths: str) -> DataFrame:
    """Many files as one lazy scan; the speed filter is pushed into Parquet."""
    return spark.read.parquet(*paths).where(F.col("speed_raw") > 0.5)


def read_slice(df: DataFrame, start: int, size: int, sequence: str = "global_lsn") -> DataFrame:
    """Rows [start, start+size) by the stored sequence number: a pushed-down range filter."""
    return df.where(F.col(sequence).between(start, start + size - 1))


def read_tolerant(spark: SparkSession, schema, *paths: str) -> DataFrame:
    """Scan that skips unreadable files."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*paths)


def append_embeddings(df: DataFrame, path: str, dimension: int, shard_rows: int = SHARD_ROWS) -> None:
    """Append float32 vectors in snappy shards; a vector of another length fails the write."""
    vector = F.when(F.size("embedding") == dimension, F.col("embedding").cast("array<float>")).otherwise(
        F.raise_error(F.lit(f"embedding must have {dimension} values")))
    (
        df.withColumn("embedding", vector)
        .write.mode("append").option("compression", "snappy")
        .option("maxRecordsPerFile", shard_rows).parquet(path)
    )


def save_ledger(ledger: DataFrame, path: str) -> None:
    ledger.coalesce(1).write.mode("overwrite").parquet(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Small final reports as a single JSON or CSV file."""
    writer = df.coalesce(1).write.mode("overwrite")
    if kind == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.json(path)


def shard_leaks(df: DataFrame, ts: str, cutoff: int) -> DataFrame:
    """Files that hold rows at or after a cutoff."""
    per_file = df.groupBy(F.input_file_name().alias("file")).agg(F.max(ts).alias("max_ts"))
    return per_file.where(F.col("max_ts") >= cutoff)


def partition_inventory(df: DataFrame) -> DataFrame:
    """Number of files per year and month (apply a partition filter first)."""
    files = df.select("year", "month", F.col("_metadata.file_path").alias("file")).distinct()
    return files.groupBy("year", "month").agg(F.count(F.lit(1)).alias("files"))
