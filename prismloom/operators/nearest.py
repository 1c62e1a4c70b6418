"""Nearest categories by dot product: matrix products over a vocabulary that fits, an inverted file over one that doesn't.

A vocabulary of at most `MOST_BYTES` of numbers goes to every task as one matrix, and each batch of rows is one product:
exact, without a shuffle and without a row for each pair. A larger one gets an index:

1. Dot products become distances: every category gets one more number, the root of (the largest squared length less its
   own), every row a zero. The category nearest in this space is the one with the largest dot product.
2. Centroids are fitted by k-means on at most `SAMPLE` categories, by the smallest keys.
3. Each category belongs to the cell of its nearest centroid, each row asks the cells of its nearest `probes` centroids.
   Both sides are cut into blocks of a cell, blocks meet by the cell, and scores are exact products of whole vectors.

Ties go to the larger name. A cell of any size is cut into blocks, so none is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from prismloom.functions import draws
from prismloom.plans.shipping import ship

MOST_BYTES = 64_000_000
SAMPLE = 50_000
BLOCK = 1024


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix; all must have one length."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of each row's k largest, ties by the larger name; names are in ascending order."""
    n = scores.shape[1]
    order = np.argsort(-scores[:, ::-1], axis=1, kind="stable")[:, :k]
    at = n - 1 - order
    return at, np.take_along_axis(scores, at, axis=1)


def exact(left: DataFrame, right: DataFrame, key: str, name: str, k: int) -> DataFrame:
    """key, name, score and place of the k categories of the largest products; right is small enough to be sent to every task."""
    spark = left.sparkSession
    rows = right.select(name, "vector").where("vector is not null").orderBy(name).toArrow()  # its size has been checked
    shared = spark.sparkContext.broadcast((rows.column(name).combine_chunks(), matrix(rows.column("vector").combine_chunks())))
    key_type, name_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((left, key), (right, name)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                if len(names) == 0:
                    continue
                at, scores = _best(matrix(batch.column("vector")) @ vectors.T, names, k)
                n = at.shape[1]
                keys = batch.column(key).take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
                yield pa.RecordBatch.from_arrays([keys.cast(key_type), names.take(pa.array(at.ravel())).cast(name_type), pa.array(scores.ravel()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), batch.num_rows))], names=[key, name, "score", "place"])

    given = left.where("vector is not null").select(key, "vector")
    return given.mapInArrow(run, f"{key} {left.schema[key].dataType.simpleString()}, {name} {right.schema[name].dataType.simpleString()}, score double, place int")


def fitted_centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows of the sample; a cell that loses all its rows keeps its place."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(centroids**2).sum(axis=1) - 2 * part @ centroids.T for part in np.array_split(sample, max(1, len(sample) // 4096))]).argmin(axis=1)
        count = np.bincount(nearest, minlength=cells)
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, sample)
        some = count > 0
        centroids[some] = total[some] / count[some, None]
    return centroids


def _cells(df: DataFrame, id_: str, centroids, largest: float | None, probes: int) -> DataFrame:
    """id, vector and cell, a row for each of the nearest `probes` cells. largest: squared length that categories are filled up to, None for rows."""
    id_type = to_arrow_type(df.schema[id_].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = centroids.value
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                vectors = matrix(batch.column("vector"))
                more = np.sqrt(np.maximum(largest - (vectors**2).sum(axis=1), 0)) if largest is not None else np.zeros(len(vectors))
                far = (places**2).sum(axis=1) - 2 * np.column_stack((vectors, more)) @ places.T
                cells = np.argsort(far, axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(len(vectors)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(id_).take(rows).cast(id_type), batch.column("vector").take(rows), pa.array(cells.ravel().astype(np.int32))], names=[id_, "vector", "cell"])

    given = df.where("vector is not null").select(id_, F.col("vector").cast("array<double>").alias("vector"))
    return given.mapInArrow(run, f"{id_} {df.schema[id_].dataType.simpleString()}, vector array<double>, cell int")


def _blocks(df: DataFrame, id_: str, rows: str) -> DataFrame:
    """cell, and lists of about BLOCK rows of it."""
    sizes = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = df.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(id_), F.col("blocks")))
    return dealt.groupBy("cell", "block").agg(F.collect_list(F.struct(id_, "vector")).alias(rows)).select("cell", rows)


def indexed(left: DataFrame, right: DataFrame, key: str, name: str, k: int, cells: int | None = None, probes: int = 8, sample: int = SAMPLE) -> DataFrame:
    """As exact, by an inverted file of `cells` cells (by default the root of the number of categories), of which each row asks `probes`."""
    spark = left.sparkSession
    known = right.where("vector is not null")
    n, largest = known.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))).first()
    if not n:
        return exact(left, right, key, name, k)
    drawn = known.select("vector", draws.key("centroids", name).alias("k")).orderBy("k").limit(sample).select("vector").toArrow()  # a bounded sample
    vectors = matrix(drawn.column("vector").combine_chunks())
    filled = np.column_stack((vectors, np.sqrt(np.maximum(largest - (vectors**2).sum(axis=1), 0))))
    centroids = spark.sparkContext.broadcast(fitted_centroids(filled, min(cells or max(1, int(n**0.5)), len(filled))))
    asked, held = _cells(left, key, centroids, None, probes), _cells(right, name, centroids, largest, 1)
    met = _blocks(asked, key, "rows").join(_blocks(held, name, "categories"), "cell").select("rows", "categories")
    key_type, name_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((left, key), (right, name)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                sides = []
                for column, id_ in (("rows", key), ("categories", name)):
                    each = batch.column(column).slice(at, 1).flatten()
                    sides.append((each.field(id_), matrix(each.field("vector"))))
                (keys, a), (names, b) = sides
                by_name = pc.sort_indices(names)
                names, b = names.take(by_name), b[by_name.to_numpy()]
                best, scores = _best(a @ b.T, names, k)
                m = best.shape[1]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(a)), m))).cast(key_type), names.take(pa.array(best.ravel())).cast(name_type), pa.array(scores.ravel())], names=[key, name, "score"])

    scored = met.mapInArrow(run, f"{key} {left.schema[key].dataType.simpleString()}, {name} {right.schema[name].dataType.simpleString()}, score double")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(name).desc()))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def nearest(left: DataFrame, right: DataFrame, key: str, name: str, k: int = 1, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The k categories of right(name, vector) with the largest dot product with each left(key, vector), by their size in one of the two ways.

    k = 1 gives key, name and score; more give place too. Rows and categories without a vector take no part.
    """
    ship(left.sparkSession)
    size = right.agg(F.sum(F.size("vector").cast("long") * 8)).first()[0] or 0
    found = exact(left, right, key, name, k) if size <= most_bytes else indexed(left, right, key, name, k)
    return found.drop("place") if k == 1 else found
