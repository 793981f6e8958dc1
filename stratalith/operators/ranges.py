"""Places and running sums within groups that may hold any share of the rows.

A window over a group sorts it in one task. Here the rows of all groups are first cut into
ranges of their order, at keys drawn from a bounded sample; windows then run within (group,
range), and the counts or sums of the ranges before are added from a table with a row for each
(group, range). The cuts only decide how work is dealt: places and sums do not depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a range, about, the most ranges, and the keys that are drawn to cut them.
RANGE_ROWS, MOST_RANGES, DRAWN = 200_000, 256, 20_000


def ranges(rows: DataFrame, keys: list[Column], range_rows: int | None = None) -> Column:
    """The number of the range that a row's keys lie in; ranges are in the order of the keys."""
    total = rows.count()
    wanted = min(MOST_RANGES, -(-total // (range_rows or RANGE_ROWS)))
    if wanted < 2:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    drawn = rows.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)))
    kinds = drawn.schema
    got = drawn.sample(min(1.0, DRAWN / total), 7).orderBy(*(F.col(n).asc_nulls_first() for n in names)).collect()  # about DRAWN rows
    cuts = sorted({len(got) * i // wanted for i in range(1, wanted)} - {0})
    key = F.struct(*(k.alias(n) for k, n in zip(keys, names, strict=True)))
    bounds = [F.struct(*(F.lit(got[c][n]).cast(kinds[n].dataType).alias(n) for n in names)) for c in cuts]

    def among(low: int, high: int) -> Column:
        """A binary search as an expression."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(bounds))


def running(rows: DataFrame, group: list[str], keys: list[Column], value: Column, out: str, range_rows: int | None = None) -> DataFrame:
    """Rows with the sum of ``value`` over their group's rows up to them, in the order of keys (ascending, nulls first, all distinct)."""
    cut = rows.withColumns({"_range": ranges(rows, keys, range_rows), "_value": value})
    within = Window.partitionBy(*group, "_range").orderBy(*(k.asc_nulls_first() for k in keys)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    sums = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), "_before")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return cut.withColumn("_here", F.sum("_value").over(within)).join(sums, [*same, F.col("_range") == F.col("_r")]).withColumn(out, F.col("_here") + F.col("_before")).select(*rows.columns, out)


def place(rows: DataFrame, group: list[str], keys: list[Column], out: str, range_rows: int | None = None) -> DataFrame:
    """Rows with their place within the group, from 1, in the order of keys."""
    return running(rows, group, keys, F.lit(1).cast("long"), out, range_rows)


def dense(rows: DataFrame, group: list[str], column: str, out: str, range_rows: int | None = None) -> DataFrame:
    """Rows with the dense rank of a column within the group, from 1, nulls last."""
    values = rows.select(*group, column).distinct()
    ranked = place(values, group, [F.col(column).isNull(), F.col(column)], out, range_rows)
    told = ranked.select(*(F.col(g).alias(f"_d{i}") for i, g in enumerate(group)), F.col(column).alias("_dc"), out)
    same = [F.col(g).eqNullSafe(F.col(f"_d{i}")) for i, g in enumerate(group)] + [F.col(column).eqNullSafe(F.col("_dc"))]
    return rows.join(told, same).select(*rows.columns, out)
