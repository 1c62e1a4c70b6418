"""Runs of a model over a table, of which nothing is asked twice.

An input's answer is kept in a table under the hash of the input's content, so equal inputs are asked once, a run that was
interrupted goes on where it stopped, and a second run over old rows costs a join. Each batch is one append to that table:
what a lost executor or driver costs is the batch it was at. Inputs on which the model fails are kept with the error and
the number of tries, and are asked again until `tries` are used up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prismloom.plans.shipping import ship
from prismloom.sources.sinks import existing

#: A model: a list of inputs as dicts to a list of as many answers as dicts.
Model = Callable[[list[dict]], list[dict]]


def content_key(inputs: list[str]) -> Column:
    """The SHA-256 of the inputs' names and values."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(inputs)]), {"ignoreNullFields": "false"}), 256)


def _asked(model: Model, answer: StructType, inputs: list[str], at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(StructType().add("key", "string").add("attempt", "integer").add("error", "string").add("answer", answer))

        def answers(rows: list[dict]) -> list[tuple[dict | None, str | None]]:
            try:
                found = model([{c: r[c] for c in inputs} for r in rows])
                if len(found) != len(rows):
                    raise ValueError(f"{len(found)} answers to {len(rows)} inputs")
                return [(a, None) for a in found]
            except Exception as e:  # noqa: BLE001  the model's failures are data here
                return [(None, f"{type(e).__name__}: {e}")] if len(rows) == 1 else [x for r in rows for x in answers([r])]

        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                rows = batch.slice(start, at_once).to_pylist()
                yield pa.RecordBatch.from_pylist([{"key": r["key"], "attempt": r["attempt"] + 1, "error": e, "answer": a} for r, (a, e) in zip(rows, answers(rows), strict=True)], schema=schema)

    return run


def open_inputs(rows: DataFrame, inputs: list[str], cache: str, tries: int = 3) -> DataFrame:
    """key, attempt (tries so far) and the inputs of rows that have no answer in the cache and tries left; each distinct input once."""
    asked = rows.select(content_key(inputs).alias("key"), *inputs).dropDuplicates(["key"])
    done = existing(rows.sparkSession, cache)
    if done is None:
        return asked.withColumn("attempt", F.lit(0))
    state = done.groupBy("key").agg(F.max("attempt").alias("attempt"), F.max(F.col("error").isNull()).alias("answered"))
    left = asked.join(state, "key", "left").where(~F.coalesce("answered", F.lit(False)) & (F.coalesce("attempt", F.lit(0)) < tries))
    return left.select("key", *inputs, F.coalesce("attempt", F.lit(0)).alias("attempt"))


def run_batches(rows: DataFrame, inputs: list[str], model: Model, answer: StructType, cache: str, batches: int = 16, at_once: int = 100, tries: int = 3) -> Iterator[int]:
    """Ask what is open, one batch of inputs by their key after the other, and yield each batch's number when its answers are kept."""
    ship(rows.sparkSession)
    schema = StructType().add("key", "string").add("attempt", "integer").add("error", "string").add("answer", answer)
    for k in range(batches):
        # what is open is looked up for each batch: a batch that another run has kept isn't asked again
        part = open_inputs(rows.where(F.pmod(F.xxhash64(content_key(inputs)), F.lit(batches)) == k), inputs, cache, tries)
        part.mapInArrow(_asked(model, answer, inputs, at_once), schema).write.mode("append").parquet(cache)
        yield k


def answered(rows: DataFrame, inputs: list[str], cache: str) -> DataFrame:
    """rows with answer, error and attempts: the answer kept for equal inputs, else the last error, else nothing."""
    kept = existing(rows.sparkSession, cache)
    keyed = rows.withColumn("key", content_key(inputs))
    if kept is None:
        return keyed.drop("key").withColumn("error", F.lit(None).cast("string")).withColumn("attempts", F.lit(0))
    last = kept.groupBy("key").agg(F.max_by(F.struct("answer", "error"), F.struct(F.col("error").isNull(), "attempt")).alias("last"), F.max("attempt").alias("attempts"))
    return keyed.join(last, "key", "left").select(*rows.columns, "last.answer", "last.error", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def asked(rows: DataFrame, inputs: list[str], model: Model, answer: StructType, cache: str, batches: int = 16, at_once: int = 100, tries: int = 3) -> DataFrame:
    """All open inputs asked, failures again until `tries` are used up, and rows with their answers."""
    for _ in range(tries):
        for _batch in run_batches(rows, inputs, model, answer, cache, batches, at_once, tries):
            pass
        if not open_inputs(rows, inputs, cache, tries).take(1):
            break
    return answered(rows, inputs, cache)


def retry_table(spark: SparkSession, cache: str) -> DataFrame:
    """key, attempts and last error of the inputs without an answer."""
    kept = spark.read.parquet(cache)
    state = kept.groupBy("key").agg(F.max("attempt").alias("attempts"), F.max_by("error", "attempt").alias("error"), F.max(F.col("error").isNull()).alias("answered"))
    return state.where(~F.col("answered")).drop("answered")
