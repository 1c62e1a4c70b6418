"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prismloom.plans.shipping import ship

#: A word: a run of anything but ASCII white space. Java and Python's `regex` read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="prismloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def write_table(df: DataFrame, name: str, compression: str | None = None) -> str:
    """Write df as Parquet in the shared folder; the new table's path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return path


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, compression))


def delete_table(spark: SparkSession, path: str) -> None:
    """A table of write_table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow, where the executors have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as it takes to clash with none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_chunks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[list[dict]]:
    """Rows of the batches in lists of about so many bytes of a text or binary column: memory follows neither the batch nor the number of rows."""
    rows: list[dict] = []
    held = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths + 64, dtype=np.int64)  # a row isn't free even where its text is empty
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size - held, "right")))
            rows += batch.slice(start, stop - start).to_pylist()
            held += int(ends[stop - 1]) - before
            start = stop
            if held >= size or start < batch.num_rows:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def text_chunks(batches: Iterator[pa.RecordBatch], size: int = 500_000) -> Iterator[list[dict]]:
    return row_chunks(batches, "text", size)
