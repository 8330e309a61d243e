"""Exact percentiles of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one
buffer.  Here a mergeable sketch first brackets each wanted rank; then one pass
counts the values below the bracket and the distinct values inside it, both
combined before the shuffle; the rank is found among the few values inside.
The result is exact and follows the linear rule between neighbouring ranks.
Brackets of a few fixed groups (cohorts, features, labels) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from wakeline.session import stored

ACCURACY = 20_000
#: Values inside a bracket are ranked in so many strips at most, shifted by the strips' totals.
STRIPS = 1_024


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
                      accuracy: int = ACCURACY, few_groups: bool = True) -> DataFrame:
    """One row per group: ``n`` and ``q``, the array of percentiles in the order of ``probs``.

    Null and NaN values are left out.  A bracket spans 8/accuracy of the group,
    so about that share of the rows is sorted.  Should a sketch ever miss its
    bracket the job fails rather than return a wrong value.  Any bracket that
    holds the rank gives the same answer, so recomputed tasks agree.  With
    ``few_groups=False`` (one group per vessel, say) brackets join by shuffle.
    """
    groups = list(groups)
    x = F.col(value).cast("double")
    rows = df.select(*groups, x.alias("_x")).where(x.isNotNull() & ~F.isnan(x))
    margin = 4.0 / accuracy
    lows = [max(p - margin, 0.0) for p in probs]
    highs = [min(p + margin, 1.0) for p in probs]
    brackets = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.percentile_approx("_x", lows, accuracy).alias("_lo"),
        F.percentile_approx("_x", highs, accuracy).alias("_hi"),
    )
    small = F.col("n") <= accuracy
    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        wanted.append(F.struct(
            F.lit(i).alias("i"),
            F.when(small | F.lit(lows[i] == 0.0), F.col("_min")).otherwise(F.col("_lo")[i]).alias("lo"),
            F.when(small | F.lit(highs[i] == 1.0), F.col("_max")).otherwise(F.col("_hi")[i]).alias("hi"),
            F.floor(at).cast("bigint").alias("k"), (at - F.floor(at)).alias("frac"),
        ))
    brackets = brackets.select(*groups, "n", F.array(*wanted).alias("_want"))

    if groups:
        tagged = rows.join(F.broadcast(brackets) if few_groups else brackets, groups)
    else:
        tagged = rows.withColumn("_b", brackets.select(F.struct("n", "_want")).scalar()).select(
            "_x", "_b.n", "_b._want")
    reach = F.filter("_want", lambda w: F.col("_x") <= w["hi"])
    # a bracket is cut into even strips of values; -1 holds what lies below it
    strip = F.when(F.col("_x") < F.col("_w.lo"), F.lit(-1)).otherwise(F.coalesce(F.floor(
        F.try_divide(F.col("_x") - F.col("_w.lo"), F.col("_w.hi") - F.col("_w.lo")) * STRIPS), F.lit(0))).cast("int")
    counted = (
        tagged.withColumn("_w", F.explode(reach))
        .groupBy(*groups, "n", "_w.i", "_w.k", "_w.frac", strip.alias("_strip"),
                 F.when(F.col("_x") >= F.col("_w.lo"), F.col("_x")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return _at_ranks(counted, groups, len(probs))


def _at_ranks(counted: DataFrame, groups: list[str], wanted: int) -> DataFrame:
    """Percentiles from ``counted``: groups, n, i (which percentile), k and frac (its rank), _strip, _v and _c.

    Strip -1 holds how many values lie below the bracket, the others its values with their counts.
    """
    strips = counted.groupBy(*groups, "i", "_strip").agg(F.sum("_c").alias("_in_strip"))
    below = Window.partitionBy(*groups, "i").orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.withColumn("_below", F.coalesce(F.sum("_in_strip").over(below), F.lit(0))).drop("_in_strip")
    upto = Window.partitionBy(*groups, "i", "_strip").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_to", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*groups, "i", "_strip"]
    strips = strips.select(*[F.col(k).alias(f"_at_{k}") for k in keys], "_below")
    ranked = ranked.join(strips, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]).withColumn(
        "_to", F.col("_to") + F.col("_below"))
    holds = lambda k: (F.col("_to") - F.col("_c") <= k) & (k < F.col("_to"))
    picked = ranked.groupBy(*groups, "n", "i", "frac").agg(
        F.max(F.when(holds(F.col("k")), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(F.col("k") + 1), F.col("_v"))).alias("_b"),
    )
    missed = F.col("_a").isNull() | ((F.col("frac") > 0) & F.col("_b").isNull())
    result = F.when(missed, F.raise_error(F.lit("percentile bracket missed, raise accuracy"))).when(
        F.col("frac") > 0, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("frac")).otherwise(F.col("_a"))
    picked = picked.withColumn("_q", result.cast("double"))
    return picked.groupBy(*groups, "n").agg(
        F.array(*[F.max(F.when(F.col("i") == i, F.col("_q"))) for i in range(wanted)]).alias("q"))


#: Brackets of wide tables: so far from the wanted rank, as a share of the group.
WIDE_MARGIN = 0.001
#: Their sketches are off by a quarter of that at most; a sketch a column and group is shuffled, so finer ones cost.
WIDE_ACCURACY = 4_000


def wide_percentiles(df: DataFrame, group: str, features: Sequence[str], probs: Sequence[float],
                     accuracy: int = WIDE_ACCURACY) -> DataFrame:
    """``group, feature, n, q``: exact percentiles of many columns for a few groups.

    ``group`` may be an array: the row then counts in each of its groups, and is read once for all.
    Rows stay wide: one sketch a column and group brackets all its ranks.  Then batches of rows count
    what lies below the brackets, and only distinct values inside a bracket become rows of their own
    (a five-hundredth of a large group for each percentile, all of a small one).  Null and NaN
    are left out; a column without values in a group has no row.  The brackets, two numbers a group,
    column and percentile, are sent to the tasks.
    """
    features, last = list(dict.fromkeys(features)), len(probs)
    value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
    several = F.col(group) if isinstance(df.schema[group].dataType, ArrayType) else F.array(group)
    rows = df.select(several.alias(group), *[value(f).alias(f"_f{j}") for j, f in enumerate(features)])
    shares = [max(p - WIDE_MARGIN, 0.0) for p in probs] + [min(p + WIDE_MARGIN, 1.0) for p in probs]
    each_group = rows.withColumn(group, F.explode(group)).where(F.col(group).isNotNull())
    sketches = stored(each_group.groupBy(group).agg(*[F.struct(
        F.count(f"_f{j}").alias("n"), F.min(f"_f{j}").alias("lo"), F.max(f"_f{j}").alias("hi"),
        F.percentile_approx(f"_f{j}", shares, accuracy).alias("q")).alias(f"_s{j}") for j in range(len(features))]), "sketches")
    # a bracket reaches two ranks to either side in groups of this size
    small = lambda s: s["n"] <= F.lit(int(4 / WIDE_MARGIN))

    def bracket(j: int, i: int):
        s = F.col(f"_s{j}")
        return F.array(
            F.when(small(s) | F.lit(shares[i] == 0.0), s["lo"]).otherwise(s["q"][i]),
            F.when(small(s) | F.lit(shares[last + i] == 1.0), s["hi"]).otherwise(s["q"][last + i]))

    brackets = sketches.select(group, F.array(*[F.array(*[bracket(j, i) for i in range(last)]) for j in range(len(features))]).alias("b"))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = sketches.select(group, F.explode(F.array(*[
        F.struct(F.lit(j).alias("_j"), F.col(f"_s{j}.n").alias("n")) for j in range(len(features))])).alias("e")).select(
        group, "e._j", "e.n").where("n > 0").select(group, "_j", "n", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.floor(a).cast("bigint").alias("k"), (a - F.floor(a)).alias("frac")) for i, a in enumerate(at)])).alias("e")).select(
        group, "_j", "n", "e.i", "e.k", "e.frac")

    held = brackets.collect()  # a row a group
    bounds = np.asarray([r["b"] for r in held], dtype=float).reshape(len(held), len(features), last, 2)  # absent: NaN
    kind = rows.schema[group].dataType.elementType.simpleString()
    found = rows.mapInArrow(_bracketed(group, [r[group] for r in held], bounds), f"{group} {kind}, _j int, i int, _strip int, _v double, _c bigint")
    found = found.groupBy(group, "_j", "i", "_strip", "_v").agg(F.sum("_c").alias("_c"))
    counted = ranks.join(found, [group, "_j", "i"])
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_j") + 1)
    return _at_ranks(counted, [group, "_j"], last).select(group, names.alias("feature"), "n", "q")


def _bracketed(group: str, groups: list, bounds: np.ndarray):
    """Counts below each bracket of ``bounds`` (group, column, percentile, end), and of each value inside it."""
    low, high = bounds[..., 0], bounds[..., 1]
    point = low == high
    shape = low.shape

    def rows(codes: np.ndarray, kind: pa.DataType, strip: np.ndarray, value: pa.Array, count: np.ndarray) -> pa.RecordBatch:
        g, j, i = np.unravel_index(codes, shape)
        return pa.RecordBatch.from_arrays(
            [pa.array(groups, kind).take(pa.array(g)), pa.array(j.astype(np.int32)), pa.array(i.astype(np.int32)),
             pa.array(strip.astype(np.int32)), value, pa.array(count)], [group, "_j", "i", "_strip", "_v", "_c"])

    def inside(codes: np.ndarray, x: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        order = np.lexsort((x, codes))
        codes, x = codes[order], x[order]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (x[1:] != x[:-1])))
        count = np.diff(np.append(first, len(x)))
        codes, x = codes[first], x[first]
        lo, hi = low.ravel()[codes], high.ravel()[codes]
        with np.errstate(all="ignore"):
            strip = np.nan_to_num(np.floor((x - lo) / (hi - lo) * STRIPS), nan=0.0, posinf=0.0, neginf=0.0)
        return rows(codes, kind, strip, pa.array(x), count)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, equal, kind = np.zeros(shape, np.int64), np.zeros(shape, np.int64), None
        for batch in batches:
            lists = batch.column(group)
            kind = lists.type.value_type
            members = lists.flatten()
            code = np.asarray(pc.index_in(members, value_set=pa.array(groups, kind)).fill_null(-1))
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])  # absent: NaN
            codes, values = [], []
            for g in np.unique(code[code >= 0]).tolist():
                of = x[owner[code == g]][:, :, None]
                below[g] += (of < low[g]).sum(0)
                within = (of >= low[g]) & (of <= high[g])
                equal[g] += np.where(point[g], within.sum(0), 0)
                r, j, i = np.nonzero(within & ~point[g])
                codes.append(np.ravel_multi_index((np.full(len(r), g), j, i), shape))
                values.append(of[r, j, 0])
            if sum(map(len, codes)):
                yield inside(np.concatenate(codes), np.concatenate(values), kind)
        if kind is not None:
            for total, strip, value in ((below, -1, None), (equal, 0, low)):
                codes = np.flatnonzero(total)
                if len(codes):
                    at = pa.nulls(len(codes), pa.float64()) if value is None else pa.array(value.ravel()[codes])
                    yield rows(codes, kind, np.full(len(codes), strip), at, total.ravel()[codes])

    return count
