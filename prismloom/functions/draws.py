"""Deterministic draws: a key's md5 decides, so results don't depend on partitions, order or the number of workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(op: str, *parts) -> Column:
    """The md5 text of op and the parts (columns or names), joined by |."""
    return F.md5(F.concat_ws("|", F.lit(op), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]))


def uniform(op: str, *parts) -> Column:
    """A number from 0 up to 1."""
    return F.conv(F.substring(key(op, *parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick(values: Column, op: str, *parts) -> Column:
    """One element of an array, null from an empty one."""
    return F.when(F.size(values) > 0, F.element_at(values, (F.floor(uniform(op, *parts) * F.size(values)) + 1).cast("int")))


def shuffled(values: Column, op: str, *parts) -> Column:
    """The elements in the order of their own keys."""
    seed = key(op, *parts)
    return F.transform(F.array_sort(F.transform(values, lambda x: F.struct(F.md5(F.concat_ws("|", seed, x.cast("string"))).alias("k"), x.alias("x")))), lambda s: s["x"])


def some(values: Column, n: int, op: str, *parts) -> Column:
    """All distinct elements if at most n, else n of them."""
    return F.slice(shuffled(F.array_distinct(values), op, *parts), 1, n)


def sample_groups(df: DataFrame, by: list[str], n: int, op: str, order: list[str], weight: Column | None = None, exactly: bool = False) -> DataFrame:
    """At most n rows of each group, without replacement, uniformly or with chances in proportion to weight.

    Weighted draws order by -ln(u) / weight. With `exactly`, groups of fewer than n rows give none. A group's window
    orders row keys only; the rows themselves are as narrow as df is.
    """
    u = F.greatest(uniform(op, *by, *order), F.lit(1e-12))
    place = F.row_number().over(Window.partitionBy(*by).orderBy((-F.log(u) / weight) if weight is not None else key(op, *by, *order), *order))
    out = df.withColumn("__place", place).where(F.col("__place") <= n)
    if exactly:
        out = out.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("__n") == n).drop("__n")
    return out.drop("__place")


def sample_rows(df: DataFrame, n: int, op: str, order: list[str]) -> DataFrame:
    """n rows of the whole, a distributed top-n of row keys."""
    return df.withColumn("__key", key(op, *order)).orderBy("__key", *order).limit(n).drop("__key")


def to_size(df: DataFrame, n: int, total: int, op: str, order: list[str]) -> DataFrame:
    """n rows of df, which has `total`: whole repeats first, then a draw of the rest."""
    if total == 0:
        return df.limit(0)
    whole = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(n // total)))).drop("__copy") if n >= total else df.limit(0)
    return whole.unionByName(sample_rows(df, n % total, op, order)) if n % total else whole
