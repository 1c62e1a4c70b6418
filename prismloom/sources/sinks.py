"""Where results go: JSON lines, resumable Parquet, upserts by id, metric tables, mask images."""

from __future__ import annotations

import io
import itertools
import pickle
import pickletools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from prismloom.functions import masks
from prismloom.plans.shipping import ship
from prismloom.sources.files import SparseMatrix


def write_records(df: DataFrame, path: str, mode: str = "error") -> None:
    """Instruction records as JSON lines."""
    df.write.mode(mode).json(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def missing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows of df whose keys the table at path doesn't hold yet."""
    done = existing(df.sparkSession, path)
    return df if done is None else df.join(done.select(*keys), keys, "left_anti")


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Resume: compute and append only what isn't there."""
    missing(df, path, keys).write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def complete_ids(df: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """Rows of ids that have as many rows as most ids (or as expected)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.lit(expected) if expected is not None else F.col("usual")
    usual = counts.agg(F.mode("n", True).alias("usual"))  # one row
    return df.join(counts.crossJoin(usual).where(F.col("n") == wanted).select(key), key, "left_semi")


def png(grey: np.ndarray) -> bytes:
    """An 8-bit grey image."""
    height, width = grey.shape
    rows = np.zeros((height, width + 1), np.uint8)  # a row's first byte says that it's stored as it is
    rows[:, 1:] = grey
    raw = rows.tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def mask_images(pixels: DataFrame, first: int = 30, step: int = 20) -> DataFrame:
    """image_id and a PNG of its label mask, mask k in grey first + k * step (modulo 256). pixels: image_id, y, x, obj_idx."""
    points = pixels.groupBy("image_id").agg(F.collect_list(F.struct("y", "x", "obj_idx")).alias("points"))  # an image's pixels

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = []
            for points_ in frame["points"]:
                p = np.array([(r["y"], r["x"], -1 if r["obj_idx"] is None or r["obj_idx"] != r["obj_idx"] else r["obj_idx"]) for r in points_], int)
                grey = np.zeros(p[:, :2].max(axis=0) + 1, np.uint8)
                inside = p[p[:, 2] >= 0]
                grey[inside[:, 0], inside[:, 1]] = (first + step * inside[:, 2]) % 256
                images.append(png(grey))
            yield pd.DataFrame({"image_id": frame["image_id"], "png": images})

    return points.mapInPandas(run, f"image_id {pixels.schema['image_id'].dataType.simpleString()}, png binary")


def mask_pngs(layers: DataFrame, first: int = 30, step: int = 20) -> DataFrame:
    """image_id and a PNG of the list of run-length masks in `masks`, mask k in grey first + k * step (modulo 256), later ones on top."""
    ship(layers.sparkSession)

    @F.arrow_udf("binary")
    def drawn(column: pa.Array) -> pa.Array:
        out = []
        for each in masks.lists_of(column):
            shape = next((m for m in each or [] if m is not None), None)
            if shape is None:
                out.append(None)
                continue
            canvas = np.zeros(shape["width"] * shape["height"], np.uint8)
            for k, m in enumerate(each):
                if m is not None:
                    masks.painted(canvas, m, (first + k * step) % 256)
            out.append(png(canvas.reshape(shape["height"], shape["width"])))
        return pa.array(out, pa.binary())

    return layers.select("image_id", drawn("masks").alias("png"))


def grey_of(content: bytes) -> np.ndarray:
    """The pixels of an image written by png()."""
    at, parts, shape = 8, [], (0, 0)
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        shape = struct.unpack(">II", data[:8])[::-1] if kind == b"IHDR" else shape
        parts += [data] if kind == b"IDAT" else []
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[0], shape[1] + 1)[:, 1:]


class _MatrixWriter:
    """Writes lists of SparseMatrix under the name that readers of sparse matrices know."""

    def __init__(self, stream: io.IOBase, protocol: int):
        self.stream, self.protocol = stream, min(protocol, 3)  # the last that names classes by a line of text outside of frames

    def dump(self, matrices: list[SparseMatrix]) -> None:
        own = f"c{SparseMatrix.__module__}\n{SparseMatrix.__qualname__}\n".encode()
        # the class is named once, before anything else of the first matrix
        self.stream.write(pickle.dumps(matrices, self.protocol).replace(own, b"cscipy.sparse._csr\ncsr_matrix\n", 1))


def _kept(written: bytes, at: int) -> bytes:
    """Steps of a pickle that make a value, keep it under a number and take it from the stack."""
    return written + b"q" + bytes([at]) + b"0"


def _plain(value) -> bytes:
    return pickletools.optimize(pickle.dumps(value, 3))[2:-1]  # without its header and end, and what it keeps for itself


_NAMES = ("_shape", "maxprint", "indptr", "indices", "data", "_has_sorted_indices", "_has_canonical_format")
#: What all matrices of a list share: the class, how an array begins, the two kinds of numbers and the names of fields.
_SHARED = [b"cscipy.sparse._csr\ncsr_matrix\n", _plain(np.zeros(0, np.int32).__reduce__()[0]), _plain((np.ndarray, (0,), b"b")), _plain(np.dtype(np.int32)), _plain(np.dtype(bool)), *map(_plain, _NAMES)]
_HEAD = b"\x80\x03" + b"".join(_kept(x, k) for k, x in enumerate(_SHARED)) + b"]("
_CLASS, _MAKE, _EMPTY, _INT, _BOOL, *_FIELDS = (b"h" + bytes([k]) for k in range(len(_SHARED)))
_SHAPE, _MOST, _INDPTR, _INDICES, _DATA, _SORTED, _CANONICAL = _FIELDS
_NEW = _CLASS + b")\x81}(" + _MOST + b"K2" + _SORTED + b"\x88" + _CANONICAL + b"\x88" + _SHAPE + b"J%bJ%b\x86"
_ARRAY = _MAKE + _EMPTY + b"R(K\x01J%b\x85" + b"%b\x89B%b"
_MATRIX = _NEW + _INDPTR + _ARRAY + b"%btb" + _INDICES + _ARRAY + b"%btb" + _DATA + _ARRAY + b"%btbub"


def csr_pickles(column: pa.Array) -> list[bytes]:
    """Each mask of a column without nulls as the steps of a pickle that make a sparse matrix of booleans, see _HEAD."""
    number = struct.Struct("<i").pack
    out = []
    for indptr, indices, (height, width) in masks.csr_of(column):
        rows, n, wide = number(height + 1), number(len(indices)), number(4 * len(indices))
        out.append(_MATRIX % (number(height), number(width), rows, _INT, number(4 * height + 4), indptr.tobytes(), n, _INT, wide, indices.tobytes(), n, _BOOL, n, b"\x01" * len(indices)))
    return out


def csr_list(each: list[dict]) -> bytes:
    """Masks as a pickled list of sparse matrices of booleans."""
    return _HEAD + b"".join(csr_pickles(pa.array(each, masks._ARROW))) + b"e."


def mask_csr_lists(layers: DataFrame) -> DataFrame:
    """image_id and the pickled list of sparse matrices of the run-length masks in `masks`."""
    ship(layers.sparkSession)

    @F.arrow_udf("binary")
    def written(column: pa.Array) -> pa.Array:
        there = column.flatten().is_valid()
        each = csr_pickles(column.flatten().drop_null())
        ends = masks.ends_of(there.to_numpy(zero_copy_only=False))[masks.ends_of(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))].tolist()
        known = column.is_valid().to_pylist()
        return pa.array([b"".join((_HEAD, *each[a:b], b"e.")) if k else None for k, (a, b) in zip(known, itertools.pairwise(ends), strict=True)], pa.binary())

    return layers.select("image_id", written("masks").alias("content"))
