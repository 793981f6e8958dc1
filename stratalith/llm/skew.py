"""Joins of large tables on keys of which few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import storage

#: Rows of a key from which on it is dealt over several tasks, and the most such keys (their list is sent to all tasks).
HOT_ROWS, HOT_KEYS = 1_000, 20_000
#: Rows that any one task can take, whatever their keys.
FEW_ROWS = 50_000


def join(rows: DataFrame, other: DataFrame, keys: dict[str, str], how: str = "inner", total: int | None = None) -> DataFrame:
    """rows join other on rows[k] = other[v], without the keys' columns of ``other``; ``rows`` (of which there are ``total``, if known) should be a stored table.

    Keys that hold more than HOT_ROWS of ``rows`` (or a share of 1 in HOT_KEYS, if that is more)
    are salted: their rows are dealt over as many salts as they hold such loads, and the rows of
    ``other`` are repeated for each. So no key has a task of its own, and a list of at most
    HOT_KEYS hot keys is all that is sent. No column of either table may begin with an underscore
    and "hot".
    """
    names = [f"_hot_k{i}" for i in range(len(keys))]
    other = other.withColumnsRenamed({v: n for n, v in zip(names, keys.values(), strict=True)})
    total = rows.count() if total is None else total
    if total <= FEW_ROWS:
        return _without(rows.join(other, _equal(keys, names), how), names, how)
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = rows.groupBy(*keys).count().where(F.col("count") > least)
    hot = storage.store(hot.select(*(F.col(k).alias(f"_hot_h{i}") for i, k in enumerate(keys)), F.ceil(F.col("count") / least).cast("int").alias("_hot_n")), "hot")
    if not hot.limit(1).count():
        return _without(rows.join(other, _equal(keys, names), how), names, how)

    def told(table: DataFrame, columns: list[str]) -> DataFrame:
        same = [F.col(c) == F.col(f"_hot_h{i}") for i, c in enumerate(columns)]
        return table.join(F.broadcast(hot), same, "left").drop(*(f"_hot_h{i}" for i in range(len(columns))))

    salted = told(rows, list(keys)).withColumn("_hot_s", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_hot_n", F.lit(1))).cast("int")).drop("_hot_n")
    spread = told(other, names).withColumn("_hot_t", F.explode(F.sequence(F.lit(0), F.coalesce("_hot_n", F.lit(1)) - 1))).drop("_hot_n")
    on = [*(F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)), F.col("_hot_s") == F.col("_hot_t")]
    return _without(salted.join(spread, on, how), [*names, "_hot_t"], how).drop("_hot_s")


def _equal(keys: dict[str, str], names: list[str]) -> list:
    return [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)]


def _without(joined: DataFrame, names: list[str], how: str) -> DataFrame:
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names)
