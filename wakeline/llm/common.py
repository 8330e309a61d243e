"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.session import shared_folder

#: A run of the six ASCII white space characters; words are what lies between.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
#: Whether the shuffle files of a query go as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for an empty text."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, however often later expressions read it.

    The optimizer may copy a projected expression into every lambda that mentions it,
    which repeats the work for each array element.  It never copies a generator's output.
    """
    return df.withColumn(name, F.explode(F.array(value)))


KNOWN = ("doc_id", "text", "source", "n_chars")


def sealed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, source, n_chars`` and all other columns in one, so that no name clashes."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in KNOWN]
    return docs.select(*KNOWN, F.struct(*(rest or [F.lit(0).alias("none")])).alias("_extra"))


def unsealed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of the documents again, in their order."""
    return df.select(*(F.col(c) if c in KNOWN else F.col("_extra").getField(c).alias(c) for c in columns))


def kept(df: DataFrame, purpose: str, cleanup: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Later steps scan only the columns they need, and a lost executor costs no rework.
    The shuffles of the write have no reader after it; with ``cleanup`` their files go at its
    end, where the driver would keep them until it happens to collect its own garbage.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    if cleanup:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if cleanup and before is None:
            spark.conf.unset(CLEANUP)
        elif cleanup:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ordered_key(column: Column) -> Column:
    """A string that sorts as the column by code point, nulls last; never null."""
    return F.coalesce(F.concat(F.lit("0"), column.cast("string")), F.lit("1"))


def running_start(df: DataFrame, group: Sequence[str], cut: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group, in order (``cut``, ``order``).

    ``cut`` divides each group into slices that one task can sort; only one row a slice
    is ever gathered by group, so a group may hold any share of the rows.
    """
    inside = Window.partitionBy(*group, cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        df.groupBy(*group, cut).agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    local = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    keys = [*group, cut]
    joined = local.join(slices.select(*(F.col(k).alias(f"_{k}_s") for k in keys), "_before"),
                        [F.col(k).eqNullSafe(F.col(f"_{k}_s")) for k in keys])
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside", *(f"_{k}_s" for k in keys))
