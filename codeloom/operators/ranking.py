"""First, last and top rows: per key, per group and with totals.

First and last per key are aggregates (min_by, max_by), which combine before the shuffle; only what needs ranks uses a window, and
a bound on the rank is pushed below the shuffle by Spark (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _one_per_key(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(pick(F.struct(*[F.col(c) for c in rest]), _order(order)).alias("__row")).select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def dedupe_first(df: DataFrame, keys: list[str], order: list[str], drop_empty: bool = False) -> DataFrame:
    """The first row of each key. drop_empty: rows whose key is null or empty go."""
    if drop_empty:
        for k in keys:
            df = df.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return _one_per_key(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _one_per_key(df, keys, order, F.max_by)


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows, of each group if by is given, with their rank from 1."""
    if by is None:
        ordered = df.orderBy(*order).limit(k)  # TakeOrderedAndProject: no full sort
        return ordered.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def top_k_with_total(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None, rank: str = "rank", total: str = "total") -> DataFrame:
    """top_k with the number of rows that the k were taken from. The total is an aggregate of its own, joined to k rows."""
    top = top_k(df, k, order, by, rank)
    if by is None:
        return top.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(total))))  # one row
    return top.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias(total)), by)


def best_tier(df: DataFrame, by: list[str], tier: str) -> DataFrame:
    """Rows of each group's smallest tier: a ladder of matches whose first rung that holds anything counts."""
    least = df.groupBy(*by).agg(F.min(tier).alias("__tier"))
    return df.join(least, by).where(F.col(tier) == F.col("__tier")).drop("__tier")


def inverted_index(df: DataFrame, key: str, value: str, order: list[str], separator: str = ",") -> DataFrame:
    """key, n, values: of every key that is neither null nor empty its rows' values, in order."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(items, lambda x: x["__v"]), separator).alias("values"))
