"""One large JSON object, read by many tasks and written by many.

A JSON object on one line has no place where a reader may start: a byte's meaning depends on all quotes and brackets
before it. But a range of bytes only needs to know two things of what stands before, whether a string is open and how
many brackets are, and can say beforehand how it changes both:

1. Spark reads the file in splits at closing brackets, and each range of about `RANGE` bytes becomes a row with its text,
   whether it turns an open string into a closed one (an odd number of quotes), and how many brackets it leaves open, if a
   string was open at its start and if none was.
2. These narrow rows are combined from the front: every range gets its state.
3. With its state a range finds the commas between the object's entries and cuts itself there. Pieces of an entry that
   reaches over ranges are joined by the number of the entry.

Defined results: white space around the object and all behind its end is ignored; an entry's text is everything between
two such commas, its value is not looked at; an empty object has no entries; a key that stands twice is two entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.plans.shipping import ship
from prismloom.sources.scratch import scratch

RANGE = 1 << 20
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_OPEN = np.zeros(256, np.int64)
_OPEN[[ord("{"), ord("[")]] = 1
_OPEN[[ord("}"), ord("]")]] = -1


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text, and for each the number of quotes up to it; what a backslash escapes counts as nothing."""
    data = np.frombuffer(_ESCAPED.sub(b"__", text), np.uint8)
    return data, np.cumsum(data == ord('"'))


def summary(text: bytes) -> tuple[int, int, int]:
    """Quotes, and brackets left open where no string is open before, and where one is."""
    data, quotes = _marks(text)
    steps, inside = _OPEN[data], quotes % 2 == 1
    return int(quotes[-1]) if len(quotes) else 0, int(steps[~inside].sum()), int(steps[inside].sum())


def pieces(text: bytes, in_string: bool, depth: int) -> list[str]:
    """The text cut at the commas between entries, without the brackets around the object."""
    data, quotes = _marks(text)
    outside = (quotes % 2 == 1) == in_string
    steps = np.where(outside, _OPEN[data], 0)
    after = depth + np.cumsum(steps)
    before = after - steps
    end = np.flatnonzero((before == 1) & (after == 0))
    stop = int(end[0]) if len(end) else len(data) if depth or (after > 0).any() else 0
    start = np.flatnonzero((before == 0) & (after == 1))
    first = 0 if depth > 0 else int(start[0]) + 1 if len(start) else stop
    commas = np.flatnonzero(outside & (data == ord(",")) & (after == 1))
    cuts = [first - 1, *[c for c in commas.tolist() if first <= c < stop], stop]
    return [text[a + 1 : b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]


def _ranges(spark: SparkSession, path: str, separator: str, range_bytes: int) -> DataFrame:
    """file, start, no, text, quotes, closed and open of all ranges of a path's files, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, no, held, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            text = "".join(held)
            quotes, closed, open_ = summary(text.encode())
            return pa.RecordBatch.from_pydict({"file": [place[0]], "start": pa.array([place[1]], pa.int64()), "no": pa.array([no], pa.int64()), "text": [text], "quotes": [quotes], "closed": [closed], "open": [open_]})

        for batch in batches:
            for value, *here in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start")), strict=True):
                if here != place or size >= range_bytes:
                    if held:
                        yield row()
                    place, no, held, size = here, 0 if here != place else no + 1, [], 0
                held.append(value + separator)
                size += len(value) + 1
        if held:
            yield row()

    lines = spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = lines.mapInArrow(run, "file string, start long, no long, text string, quotes long, closed long, open long")
    table = scratch(spark)
    found.write.parquet(table)
    return spark.read.schema(found.schema).parquet(table)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            cut = pieces(r["text"].encode(), r["in_string"], r["depth"])
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("document", "file", "start", "no")} | {"pieces": cut}], schema=_CUT)


_CUT = pa.schema([("document", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("no", pa.int64()), ("pieces", pa.list_(pa.string()))])


def entries(spark: SparkSession, path: str, range_bytes: int = RANGE, parts: bool = False) -> DataFrame:
    """document, row_idx (an entry's place) and entry (its text, `"key": value`) of the JSON objects in a path's files.

    Each file is a document; with parts, all files together in the order of their names are one, cut at any line ends, as
    write_document leaves them.
    """
    ship(spark)
    found = _ranges(spark, path, "\n" if parts else "}", range_bytes)
    place = ["file", "start", "no"]
    narrow = found.select(F.lit(path).alias("document") if parts else F.col("file").alias("document"), *place, "quotes", "closed", "open")
    before = Window.partitionBy("document").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)  # a narrow row for each range
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    opened = narrow.withColumn("in_string", sum_before("quotes") % 2 == 1)
    states = opened.withColumn("depth", sum_before(F.when(F.col("in_string"), F.col("open")).otherwise(F.col("closed")))).select("document", *place, "in_string", "depth")
    cut = found.select(*place, "text").join(states, place).mapInArrow(_cut, "document string, file string, start long, no long, pieces array<string>")
    table = scratch(spark)
    cut.write.parquet(table)
    cut = spark.read.schema(cut.schema).parquet(table)
    counts = cut.select("document", *place, (F.size("pieces") - 1).alias("cuts"))
    firsts = counts.withColumn("first", sum_before("cuts")).select(*place, "first", "cuts")
    each = cut.join(firsts, place).select("document", *place, "cuts", "first", F.posexplode("pieces").alias("at", "entry")).withColumn("row_idx", F.col("first") + F.col("at"))
    rim = (F.col("at") == 0) | (F.col("at") == F.col("cuts"))
    whole = each.where(~rim).select("document", "row_idx", "entry")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*place, "entry"))), lambda x: x["entry"]), "")
    over = each.where(rim).groupBy("document", "row_idx").agg(joined.alias("entry"))
    return whole.unionByName(over).where(F.trim(F.regexp_replace("entry", r"\s+", " ")) != "")


def write_document(rows: DataFrame, path: str, key: str, value: str, files: int | None = None) -> None:
    """rows as one JSON object in parts: the files one after the other are the object, an entry a line, by key. value is a column of JSON text.

    No task sees more than its part. With files=1 the single part is the document.
    """
    keyed = rows.select(F.col(key).alias("key"), F.col(value).alias("value"))
    ends = keyed.agg(F.min("key").alias("first"), F.max("key").alias("last")).first()
    if ends["first"] is None:
        rows.sparkSession.createDataFrame([("{}",)], "value string").coalesce(1).write.text(path)
        return
    line = F.concat(F.when(F.col("key") == ends["first"], "{").otherwise(","), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(":"), "value", F.when(F.col("key") == ends["last"], "}").otherwise(""))
    ordered = keyed.repartitionByRange(files, "key") if files else keyed.repartitionByRange("key")
    ordered.sortWithinPartitions("key").select(line.alias("value")).write.text(path)
