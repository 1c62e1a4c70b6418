"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording is a WAV file of 8, 16, 24 or 32 bits in a binary column, resampled to one rate. Its spectrum is folded into twelve pitch classes a frame; sums over
rectangles of frames and pitch classes come from an integral image, and sixteen filters that compare such sums give two
bits each, so every position of a 16-frame window gives one packed 32-bit integer.

Recordings with equal fingerprints form a class, and only one of a class is aligned. Query recordings meet the others on
equal integers, up to four bits, of windows with sound (silence is alike everywhere and says nothing); the offset with the most meetings aligns a pair, and the share of differing bits over the overlap at
that offset judges it.

Defined results: a null, unreadable or too short recording has no integers, forms a class with its like and matches
nothing; repeated rows are one class; an empty table gives no rows; ties of offsets go to the smallest offset by size,
then to the negative one, ties of matches to the smallest id; long recordings are read whole, recordings without any
sound match nothing. Columns other than the id and the media are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, materialize, row_chunks

RATE = 4096
FRAME, HOP = 512, 256
WINDOW = 16
LOWEST, HIGHEST = 100.0, 1800.0
MIN_OVERLAP = 16
MAX_BIT_ERROR = 0.1
#: Index keys: an integer without four of its bits. One key alone (all 32 bits) finds 74 % of the links, these together over 90 %.
KEYS = tuple(0xFFFFFFFF ^ (0xF << k) for k in (0, 8, 16, 24))
QUERY_EVERY = 50
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width in frames) of the sixteen filters, by rule: four kinds at four shapes."""
    return [(kind, (3 * kind + 5 * shape) % (12 - height + 1), height, width) for kind in range(4) for shape, (height, width) in enumerate(((4, 16), (6, 8), (8, 12), (12, 16)))]


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Mono, 16 bits, from samples between -1 and 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _samples(frames: bytes, width: int) -> np.ndarray | None:
    """Samples between -1 and 1 of whole numbers of 8 (without sign), 16, 24 or 32 bits; None of other widths."""
    if width == 1:
        return np.frombuffer(frames, np.uint8).astype(np.float32) / 128 - 1
    if width == 3:
        whole = np.zeros((len(frames) // 3, 4), np.uint8)
        whole[:, 1:] = np.frombuffer(frames, np.uint8)[: len(frames) // 3 * 3].reshape(-1, 3)
        return whole.view("<i4")[:, 0].astype(np.float32) / 2147483648
    if width in (2, 4):
        return np.frombuffer(frames[: len(frames) // width * width], f"<i{width}").astype(np.float32) / (32768 if width == 2 else 2147483648)
    return None


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples at RATE: each is the mean of what lies in its share of time, so higher tones don't fold into lower ones much."""
    if rate == RATE or not len(samples):
        return samples
    ends = np.arange(int(len(samples) * RATE / rate) + 1) * (rate / RATE)
    total = np.concatenate(([0.0], np.cumsum(samples, dtype=np.float64)))
    return (np.diff(np.interp(ends, np.arange(len(total)), total)) * (RATE / rate)).astype(np.float32)


def read_wav(media: bytes | None) -> tuple[np.ndarray, int]:
    """Samples of the channels' mean at RATE, and RATE; no samples where media isn't a WAV file of whole numbers, or its header makes no sense."""
    return _heard(media), RATE


def _heard(media: bytes | None) -> np.ndarray:
    try:
        with wave.open(io.BytesIO(media or b""), "rb") as f:
            rate, channels = f.getframerate(), f.getnchannels()
            data = _samples(f.readframes(f.getnframes()), f.getsampwidth())
            if data is None or rate <= 0 or channels <= 0:
                return np.zeros(0, np.float32)
            data = data[: len(data) // channels * channels].reshape(-1, channels)
            return resampled(data.mean(axis=1, dtype=np.float32), rate)
    except (wave.Error, EOFError, ValueError, MemoryError, OverflowError, ZeroDivisionError):
        return np.zeros(0, np.float32)


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Spectrum bins x pitch classes."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hertz), 12), np.float32)
    for k in np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST)):
        fold[k, round(12 * np.log2(hertz[k] / 440)) % 12] = 1
    return fold


def chroma(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames x 12 shares of energy, and which frames have any."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32), np.zeros(0, bool)
    frames = sliding_window_view(samples, FRAME)[::HOP]
    energy = np.empty((len(frames), 12), np.float32)
    for k in range(0, len(frames), 4096):  # a long recording's spectrum isn't held whole
        block = frames[k : k + 4096] * np.hanning(FRAME).astype(np.float32)
        energy[k : k + 4096] = (np.abs(np.fft.rfft(block, axis=1)).astype(np.float32) ** 2) @ _folding()
    whole = energy.sum(axis=1, keepdims=True)
    return energy / np.maximum(whole, 1e-9), whole[:, 0] > 1e-9


def fingerprint(media: bytes | None) -> np.ndarray:
    """A packed integer for each full window of frames."""
    return heard(media)[0]


def heard(media: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint, and which of its windows have sound."""
    image, loud = chroma(read_wav(media)[0])
    n = len(image) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def area(frame: int, frames: int, pitch: int, pitches: int) -> np.ndarray:
        a, b = total[frame : frame + n], total[frame + frames : frame + frames + n]
        return b[:, pitch + pitches] - b[:, pitch] - a[:, pitch + pitches] + a[:, pitch]

    out = np.zeros(n, np.uint32)
    for k, (kind, pitch, height, width) in enumerate(filters()):
        half, mid, third = height // 2, width // 2, width // 4
        whole = area(0, width, pitch, height)
        part = {
            0: lambda: area(0, width, pitch, half),
            1: lambda: area(0, mid, pitch, height),
            2: lambda: area(0, mid, pitch, half) + area(mid, width - mid, pitch + half, height - half),
            3: lambda: area(third, width - 2 * third, pitch, height),
        }[kind]()
        lean = np.log1p(part) - np.log1p(whole - part)
        out |= _GRAY[np.digitize(lean, (-0.5, 0.0, 0.5))] << np.uint32(2 * k)
    return out, sliding_window_view(loud, WINDOW).any(axis=1)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in row_chunks(batches, "media", 4_000_000):
        prints = [heard(r["media"]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["rec_id"] for r in rows], pa.int64()),
                pa.array([items.astype(np.int64) for items, _ in prints], pa.list_(pa.int64())),
                pa.array([loud for _, loud in prints], pa.list_(pa.bool_())),
                pa.array([hashlib.sha256(items.astype("<u4").tobytes()).hexdigest() for items, _ in prints], pa.string()),
            ],
            names=["rec_id", "items", "loud", "digest"],
        )


def fingerprints(recordings: DataFrame) -> DataFrame:
    """rec_id, items, loud (which of them have sound) and digest of recordings(rec_id, media)."""
    return recordings.select(F.col("rec_id").cast("long"), "media").transform(mapped, _fingerprints, "rec_id long, items array<long>, loud array<boolean>, digest string")


def align(recordings: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """rec_id, n_items, digest, class_id of every row; n_links, match_id, match_offset and bit_error for queries (ids divisible by `every`).

    class_id is the smallest id with the same fingerprint. Links are to other classes, at most MAX_BIT_ERROR of the bits
    apart over MIN_OVERLAP integers or more; match_id is the class with the fewest errors, then the smallest.
    """
    found = materialize(fingerprints(recordings), "op6-fingerprints")
    classes = found.groupBy("digest").agg(F.min("rec_id").alias("class_id"), F.first("items").alias("items"), F.max("loud").alias("loud"), F.max((F.col("rec_id") % every == 0).cast("int")).alias("asked"))
    classes = materialize(classes.where("class_id is not null"), "op6-classes")
    keys = F.array(*[F.struct(F.lit(k).alias("which"), F.col("item").bitwiseAND(F.lit(mask)).alias("part")) for k, mask in enumerate(KEYS)])
    places = classes.select("class_id", "asked", F.posexplode(F.arrays_zip("items", "loud")).alias("at", "window")).where("window.loud").select("class_id", "asked", "at", F.col("window.items").alias("item"))
    places = places.select("class_id", "asked", "at", F.explode(keys).alias("key"))
    asked = places.where("asked = 1").select(F.col("class_id").alias("query_id"), F.col("at").alias("query_at"), F.col("key").alias("query_key"))
    met = asked.join(places.select("class_id", "at", "key"), (F.col("key") == F.col("query_key")) & (F.col("query_id") != F.col("class_id")))
    votes = met.groupBy("query_id", "class_id", (F.col("at") - F.col("query_at")).alias("offset")).count()
    order = F.struct(F.col("count"), -F.abs("offset"), -F.col("offset"))
    # written before the joins, so that Spark can split what a frequent class or query meets
    best = materialize(votes.groupBy("query_id", "class_id").agg(F.max_by("offset", order).alias("offset")), "op6-offsets")
    theirs = classes.select("class_id", F.col("items").alias("their_items"))
    ours = classes.select(F.col("class_id").alias("query_id"), F.col("items").alias("our_items"))
    judged = best.join(theirs, "class_id").join(ours, "query_id")
    overlap = F.arrays_zip(F.slice("our_items", F.greatest(-F.col("offset"), F.lit(0)) + 1, F.size("our_items")).alias("a"), F.slice("their_items", F.greatest(F.col("offset"), F.lit(0)) + 1, F.size("their_items")).alias("b"))
    both = F.filter(overlap, lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    errors = F.aggregate(both, F.lit(0), lambda n, x: n + F.bit_count(x["a"].bitwiseXOR(x["b"])))
    judged = judged.select("query_id", "class_id", "offset", F.size(both).alias("n"), errors.alias("errors")).where(f"n >= {MIN_OVERLAP} and errors <= {MAX_BIT_ERROR} * 32 * n")
    share = F.col("errors") / (32 * F.col("n"))
    links = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct(share.alias("bit_error"), F.col("class_id").alias("match_id"), "offset")).alias("best"))
    query = (F.col("rec_id") % every == 0) & F.col("class_id").isNotNull()
    named = found.join(classes.select("digest", "class_id"), "digest", "left").join(links, F.col("class_id") == F.col("query_id"), "left")
    return named.select(
        "rec_id",
        F.size("items").cast("long").alias("n_items"),
        "digest",
        "class_id",
        F.when(query, F.coalesce("n_links", F.lit(0))).alias("n_links"),
        *[F.when(query, F.col(f"best.{c}")).alias(name) for c, name in (("match_id", "match_id"), ("offset", "match_offset"), ("bit_error", "bit_error"))],
    )


def tune(vector: list[float] | None) -> bytes | None:
    """A recording of a vector: a note of HOP samples for each number, a semitone for each 1/24 around 440 Hz, at most an octave away."""
    if vector is None or any(x is None or not np.isfinite(x) for x in vector):
        return None
    hertz = 440 * 2 ** (np.clip(np.asarray(vector, np.float64) * 2, -1, 1))
    phase = np.cumsum(np.repeat(2 * np.pi * hertz / RATE, HOP))
    return write_wav(0.8 * np.sin(phase))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            rows = batch.slice(start, 64).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["rec_id"] for r in rows], pa.int64()), pa.array([tune(r["vector"]) for r in rows], pa.binary())], names=["rec_id", "media"])


def vector_recordings(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """recordings(rec_id, media): each vector as a tune."""
    return vectors.select(F.col(key).cast("long").alias("rec_id"), F.col(column).alias("vector")).transform(mapped, _render, "rec_id long, media binary")
