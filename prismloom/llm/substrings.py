"""Substring dedup: remove every word in a window of `LENGTH` words whose sequence also starts anywhere else.

The corpus is its own reference here, so the suffix automata of its shards would have to be broadcast to all documents,
work that grows with the square of the corpus (figures in the README). Matching statistics above the length threshold
are found by shuffles instead, which gives the same spans:

1. Each window has an anchor, the smallest hash of the `ANCHOR`-word sequences in it. Equal windows have equal anchors,
   and neighbours share them, so there are few. Anchors are counted over the corpus, together with whether all their
   surroundings (all words any window around the anchor can hold) are equal.
2. Where an anchor repeats with equal surroundings, all windows around it repeat. Where surroundings differ, the windows
   of that anchor are counted by a 128-bit hash.
3. Documents get the windows found in them by a hash of their text and lose the words these cover.

Counts combine before they are sent, joins can be split by Spark, and no group of equal texts, anchors or windows is
ever gathered.

Defined results: a null text has no words; fewer than LENGTH words are never removed; equal texts get equal results;
repeated rows remove each other where long enough; very long texts are read whole; of anchors that tie in a window the
first counts, in each copy of the window alike; an empty table gives no rows; a row whose doc_id is null takes part like
any other. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, materialize, text_chunks

LENGTH = 35
ANCHOR = 10
#: Odd multipliers of the two rolling hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64, kept for texts of usual length."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 14)
        known = np.empty(size, np.uint64)
        known[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            known[filled : filled + step] = known[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        if n <= 1 << 20:
            _powers[base] = known
    return known[:n]


class Sequences:
    """Rolling hashes of a text's words."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n)
        self.sums: dict[int, np.ndarray] = {}

    def _sum(self, which: int) -> np.ndarray:
        if which not in self.sums:
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.codes * _power(INVERSES[which], self.n), out=total[1:])
            self.sums[which] = total
        return self.sums[which]

    def spans(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash of the words from each start to before each end."""
        total = self._sum(which)
        x = (total[end] - total[start]) * _power(BASES[which], self.n + 1)[start]
        x ^= x >> np.uint64(32)
        return x * np.uint64(BASES[1 - which])

    def runs(self, length: int, which: int) -> np.ndarray:
        at = np.arange(self.n - length + 1)
        return self.spans(at, at + length, which)

    def anchor_of_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, the position of its anchor; and the hash of the anchor candidate at each position."""
        short = self.runs(ANCHOR, 0)
        each = LENGTH - ANCHOR + 1
        return np.arange(self.n - LENGTH + 1) + sliding_window_view(short, each).argmin(axis=1), short


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


_ANCHORS = pa.schema([("key", pa.binary()), ("positions", pa.list_(pa.int32())), ("anchors", pa.list_(pa.int64())), ("regions", pa.list_(pa.int64()))])


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reach = LENGTH - ANCHOR
    for rows in text_chunks(batches):
        keys, positions, anchors, regions, ends = [], [], [], [], [0]
        for r in rows:
            words = _words(r["text"])
            if len(words) < LENGTH:
                continue
            seq = Sequences(words)
            at_window, short = seq.anchor_of_windows()
            at = np.unique(at_window)
            start, end = np.maximum(at - reach, 0), np.minimum(at + LENGTH, seq.n)
            clipped = (at - start).astype(np.uint64) * np.uint64(64) + (end - at).astype(np.uint64)
            keys.append(r["key"])
            positions.append(at.astype(np.int32))
            anchors.append(short[at])
            regions.append((seq.spans(start, end, 1) ^ clipped) * np.uint64(BASES[0]))
            ends.append(ends[-1] + len(at))
        if keys:
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(np.concatenate(positions)), _signed(np.concatenate(anchors)), _signed(np.concatenate(regions)))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *lists], schema=_ANCHORS)


def _find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose anchor is at one of `positions`: key, start and 128-bit hash."""
    for rows in text_chunks(batches):
        for r in rows:
            seq = Sequences(_words(r["text"]))
            at_window, _ = seq.anchor_of_windows()
            start = np.flatnonzero(np.isin(at_window, r["positions"]))
            if len(start):
                hashes = [_signed(seq.spans(start, start + LENGTH, k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(start), pa.binary()), pa.array(start.astype(np.int32)), *hashes], names=["key", "start", "h1", "h2"])


def covered_words(n: int, marks: list[int] | None) -> np.ndarray:
    """Which of n words are covered. A mark is 2 * start of one window, or 2 * position + 1 of an anchor all of whose windows count."""
    change = np.zeros(n + 1, np.int64)
    if marks:
        at, whole = np.divmod(np.asarray(marks, np.int64), 2)
        first = np.where(whole == 1, np.maximum(at - (LENGTH - ANCHOR), 0), at)
        last = np.minimum(at, n - LENGTH) + LENGTH
        np.add.at(change, first, 1)
        np.add.at(change, last, -1)
    return np.cumsum(change[:-1]) > 0


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in text_chunks(batches):
        out: list[tuple] = []
        for r in rows:
            words = _words(r["text"])
            gone = covered_words(len(words), r["marks"])
            kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]) if r["marks"] else b" ".join(words)
            out.append((r["doc_id"], len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        doc_id, n, removed, digest = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def marks(texts: DataFrame) -> DataFrame:
    """key -> marks (see covered_words) of every text with something to remove. texts: key, text."""
    found = materialize(texts.transform(mapped, _find_anchors, "key binary, positions array<int>, anchors array<long>, regions array<long>"), "op7-anchors")
    each = found.select("key", F.explode(F.arrays_zip("positions", "anchors", "regions")).alias("a")).select("key", F.col("a.positions").alias("position"), F.col("a.anchors").alias("anchor"), F.col("a.regions").alias("region"))
    counted = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("least"), F.max("region").alias("most")).where("n > 1")
    # counts are written first: a join of two plain shuffles is one whose hot keys Spark can split
    counted = materialize(counted.select("anchor", (F.col("least") == F.col("most")).alias("equal")), "op7-counted")
    repeated = materialize(each.drop("region").join(counted, "anchor").select("key", "position", "equal"), "op7-repeated")
    unequal = materialize(repeated.where("not equal").groupBy("key").agg(F.collect_set("position").alias("positions")), "op7-unequal")
    windows = materialize(texts.join(unequal, "key").transform(mapped, _find_windows, "key binary, start int, h1 long, h2 long"), "op7-windows")
    twice = materialize(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "op7-twice")
    single = windows.join(twice, ["h1", "h2"]).select("key", (F.col("start") * 2).alias("mark"))
    whole = repeated.where("equal").select("key", (F.col("position") * 2 + 1).alias("mark"))
    return materialize(single.unionByName(whole).groupBy("key").agg(F.collect_set("mark").alias("marks")), "op7-marks")


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    own = _keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return own.join(marks(_keyed(docs)), "key", "left").select("doc_id", "text", "marks").transform(mapped, _strip, "doc_id long, n_words long, n_removed long, kept_sha256 string")
