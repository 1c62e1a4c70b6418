"""New images arrive, are turned into questions and appended; and running metadata counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def generate_stream(images: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str], time: str | None = None, kept: str = "1 day") -> StreamingQuery:
    """Run generate on each micro-batch of images, those whose keys came before left out, and write its rows to path/batch=<number>.

    Which keys came before is the stream's own state, partitioned by key, so a batch costs by its own size and not by what
    path holds. With time, the name of an event-time column, a key is kept for `kept` behind the newest time and then
    forgotten, so the state is bounded by what arrives in that while; without, it grows with the keys. A batch that is run
    again after a failure replaces what it wrote. Generators of single images need no state.
    """

    def write(batch: DataFrame, number: int) -> None:
        generate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    new = images.withWatermark(time, kept).dropDuplicatesWithinWatermark(keys) if time else images.dropDuplicates(keys)
    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """kind, value, cnt of a stream, for output mode "complete" or "update"."""
    return rows.groupBy(F.lit(kind).alias("kind"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(rows: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window of event time; rows later than `late` behind the newest are left out."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("window.start").alias("start"), "value", "cnt")
