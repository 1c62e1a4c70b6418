"""Uniform draws of image tuples by unranking.

All tuples of n different images that share a group are never listed: a group of m images has C(m, n) of them, prefix sums
of these numbers give every tuple of the corpus a rank, n_sample ranks are drawn without replacement, and each is turned
back into its group and the n numbers of its images. The work follows n_sample and the index of images, not the tuples,
and every tuple has the same chance.

Groups' totals are ordered in ranges (multi.running), draws find their group in slices of the rank space, and images are
numbered in the drawn order of multi.ranked, so no task sees all groups, all draws or a whole group.
"""

from __future__ import annotations

from decimal import Decimal
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismloom.functions import draws
from prismloom.operators.multi import ranked, running
from prismloom.plans.shipping import ship

WIDE = "decimal(38,0)"


def combination(rank: int, n: int) -> list[int]:
    """The rank-th choice of n different numbers, in ascending order: the last is the largest c with C(c, n) <= rank, and so on."""
    out = []
    for k in range(n, 0, -1):
        low, high = k - 1, k
        while comb(high, k) <= rank:
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if comb(middle, k) <= rank else (low, middle)
        out.append(low)
        rank -= comb(low, k)
    return out[::-1]


def _unranked(n: int):
    @F.arrow_udf("array<long>")
    def places(rank: pa.Array) -> pa.Array:
        return pa.array([None if r is None else combination(int(r), n) for r in rank.to_pylist()], pa.list_(pa.int64()))

    return places


def _tuples_of(m: Column, n: int) -> Column:
    """C(m, n), which must fit 38 digits. One number a group, so Python's whole numbers may count: Spark's div ends at 64 bits."""

    @F.arrow_udf(WIDE)
    def counted(sizes: pa.Array) -> pa.Array:
        return pa.array([Decimal(comb(x, n)) for x in sizes.to_pylist()], pa.decimal128(38, 0))

    return counted(m.cast("long"))


def _whole(n: int) -> Column:
    """A whole number of up to 38 digits; a literal of Python's ends at 64 bits."""
    return F.lit(str(n)).cast(WIDE)


def _drawn_rank(op: str, k: Column, total: Column) -> Column:
    """A number from 0 up to total: 96 bits of a key, modulo total."""
    key = draws.key(op, k)
    part = lambda at: F.conv(F.substring(key, at, 12), 16, 10).cast(WIDE)
    return F.pmod((part(1) * F.lit(1 << 48).cast("decimal(19,0)")).cast(WIDE) + part(13), total).cast(WIDE)


def drawn_ranks(df: DataFrame, total: int, n_sample: int, op: str) -> DataFrame:
    """no (0 up to n_sample) and rank: different numbers below total, all if there are no more. df is of the session to use."""
    spark = df.sparkSession
    wanted = min(n_sample, total)
    if total <= 2 * n_sample:  # most of them: all ranks, in a drawn order
        keyed = spark.range(total).select(F.col("id").cast(WIDE).alias("rank"), draws.key(op, "id").alias("k"))
        kept = keyed.orderBy("k", "rank").limit(wanted)
        return ranked(kept.withColumn("image_id", F.col("rank")), [], F.col("k")).select("no", "rank")
    # at most every second number is taken, so a fresh draw succeeds at least every second time
    tries = spark.range(4 * n_sample + 200).select("id", _drawn_rank(op, F.col("id"), _whole(total)).alias("rank"))
    first = tries.groupBy("rank").agg(F.min("id").alias("k")).orderBy("k").limit(wanted)
    return ranked(first.withColumn("image_id", F.col("k")), [], draws.key(f"{op}|no", "k")).select("no", "rank")


def uniform_tuples(index: DataFrame, by: list[str], n: int, n_sample: int, op: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """n_sample of all tuples of n images in one group of index(by, image_id, carry), each tuple with the same chance, none twice.

    Columns: no, by, and <c>_0 ... <c>_{n-1} for image_id and carry; a tuple's images are in the drawn order of their group.
    (by, image_id) must be unique. Groups with less than n images have no tuples.
    """
    ship(index.sparkSession)
    sizes = index.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).withColumn("tuples", _tuples_of(F.col("m"), n)).where("tuples > 0")
    total = int(sizes.agg(F.sum("tuples")).first()[0] or 0)
    if total == 0:
        empty = index.limit(0).select(F.lit(0).cast("long").alias("no"), *by, *[F.col(c).alias(f"{c}_{k}") for k in range(n) for c in ("image_id", *carry)])
        return empty
    keyed = sizes.withColumn("key", draws.key(op, *by)).withColumn("part", F.substring("key", 1, 3))
    ends = running(keyed, [], "part", ["key", *by], F.col("tuples"), "end").select(*by, "tuples", (F.col("end") - F.col("tuples")).cast(WIDE).alias("start"))
    slices = max(1, min(n_sample, total))
    width = -(-total // slices)
    slice_of = lambda c: F.call_function("div", c.cast(WIDE), _whole(width))
    groups = ends.withColumn("slice", F.explode(F.sequence(slice_of(F.col("start")), slice_of(F.col("start") + F.col("tuples") - 1))))
    chosen = drawn_ranks(index, total, n_sample, op).withColumn("slice", slice_of(F.col("rank")))
    found = chosen.join(groups, "slice").where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("tuples")))
    placed = found.select("no", *by, F.posexplode(_unranked(n)((F.col("rank") - F.col("start")).cast(WIDE))).alias("position", "place"))
    images = ranked(index.select(*by, "image_id", *carry), by, draws.key(f"{op}|image", *by, "image_id"), "place")
    met = placed.join(images, [*by, "place"])
    at = [F.max(F.when(F.col("position") == k, F.col(c))).alias(f"{c}_{k}") for k in range(n) for c in ("image_id", *carry)]
    return met.groupBy("no", *by).agg(*at)
