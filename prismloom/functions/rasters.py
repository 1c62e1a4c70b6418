"""Depth and label maps packed into one binary an image, and probes of single places in them.

A map is a column of width, height and data: one byte a pixel, or two or four, little-endian, row by row. A place is read
by its offset, so a question that needs twenty places costs twenty, whatever the size of the image.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from prismloom.functions import masks

MAP = "struct<width:int,height:int,data:binary>"
MAP_TYPE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("data", BinaryType())])
_MAP = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])
_OBJECT = pa.struct([("obj_idx", pa.int32()), ("mask", masks._ARROW)])
_TYPES = {1: np.dtype("u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _ints(*names: str) -> StructType:
    return StructType([StructField(n, IntegerType()) for n in names])


def packed(values: Column, width, height) -> Column:
    """An array of numbers from 0 to 255 as a map of one byte a pixel."""
    data = F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return F.struct(F.lit(width).cast("int").alias("width"), F.lit(height).cast("int").alias("height"), data.alias("data"))


def value_at(name: str, at: Column) -> Column:
    """The value at an offset (y * width + x) of a map of one byte a pixel."""
    return F.conv(F.hex(F.col(name)["data"].substr((at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def values(name: str) -> Column:
    """x, y and value of each pixel of a map of one byte a pixel, as an array: for small maps."""
    m = F.col(name)
    at = F.sequence(F.lit(0), m["width"] * m["height"] - 1)
    return F.transform(at, lambda i: F.struct((i % m["width"]).cast("int").alias("x"), F.floor(i / m["width"]).cast("int").alias("y"), value_at(name, i).alias("value")))


def array_of(raster: dict) -> np.ndarray:
    """A map as an array of rows."""
    pixels = raster["width"] * raster["height"]
    return np.frombuffer(raster["data"], _TYPES[len(raster["data"]) // pixels if pixels else 1]).reshape(raster["height"], raster["width"])


def _bytes_for(most: int) -> int:
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def map_of(array: np.ndarray) -> dict:
    """Rows of whole numbers as a map of as few bytes a pixel as they need."""
    kind = _TYPES[_bytes_for(int(array.max(initial=0)))]
    return {"width": array.shape[1], "height": array.shape[0], "data": np.ascontiguousarray(array.astype(kind)).tobytes()}


@F.arrow_udf(MAP_TYPE)
def cropped(raster: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    """The part of a map in a box, ends exclusive, cut to the map."""
    out = []
    for m, *box in zip(raster.to_pylist(), *(c.to_pylist() for c in (x1, y1, x2, y2)), strict=True):
        if m is None or None in box:
            out.append(None)
            continue
        whole = array_of(m)
        a, b, c, d = (max(v, 0) for v in box)
        part = whole[b:d, a:c]
        out.append({"width": part.shape[1], "height": part.shape[0], "data": np.ascontiguousarray(part).tobytes()})
    return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())]))


@F.arrow_udf(ArrayType(_ints("obj_idx", "depth")))
def object_depths(depth: pa.Array, labels: pa.Array) -> pa.Array:
    """The most frequent depth of each object's pixels, the smallest of equals. Label 0 is no object, label k the object k - 1."""
    out = []
    for d, m in zip(depth.to_pylist(), labels.to_pylist(), strict=True):
        if d is None or m is None:
            out.append(None)
            continue
        values_, of = array_of(d).ravel().astype(np.int64), array_of(m).ravel().astype(np.int64)
        inside = of > 0
        pairs, n = np.unique(of[inside] << 32 | values_[inside], return_counts=True)
        order = np.lexsort((pairs & 0xFFFFFFFF, -n, pairs >> 32))
        first = order[np.unique(pairs[order] >> 32, return_index=True)[1]]
        out.append([{"obj_idx": int(p >> 32) - 1, "depth": int(p & 0xFFFFFFFF)} for p in pairs[first].tolist()])
    return pa.array(out, pa.list_(pa.struct([("obj_idx", pa.int32()), ("depth", pa.int32())])))


def _plain_parts(labels: pa.Array):
    """Sizes of successive maps with their pixels, image by image, and where each begins; about masks.PIXELS at once. Unknown maps have no pixels."""
    known = labels.is_valid().to_numpy(zero_copy_only=False)
    width, height = (np.where(known, pc.fill_null(pc.struct_field(labels, c), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64) for c in ("width", "height"))
    data = pc.struct_field(labels, "data")
    for a, b in masks.in_parts(width * height, masks.PIXELS):
        each = [np.frombuffer(d, _TYPES[len(d) // n]) for d, n in zip(data[a:b].to_pylist(), (width * height)[a:b].tolist(), strict=True) if n]
        yield width[a:b], height[a:b], np.concatenate(each) if each else np.zeros(0, np.uint8), masks.ends_of(width[a:b] * height[a:b])


@F.arrow_udf(ArrayType(StructType([StructField("obj_idx", IntegerType()), StructField("mask", masks.MASK_TYPE)])))
def object_masks(labels: pa.Array) -> pa.Array:
    """The run-length mask of each object of a label map. Label 0 is no object, label k the object k - 1."""
    parts, counts = [pa.array([], _OBJECT)], [np.zeros(0, np.int64)]
    for width, height, pixels, ends in _plain_parts(labels):
        begins = np.ones(len(pixels), bool)
        np.not_equal(pixels[1:], pixels[:-1], out=begins[1:])
        rows = np.repeat(np.arange(len(height)), height)
        begins[(ends[rows] + (np.arange(len(rows)) - masks.ends_of(height)[rows]) * width[rows])[width[rows] > 0]] = True
        start = np.flatnonzero(begins)
        label, length = pixels[start].astype(np.int64), np.diff(np.append(start, len(pixels)))
        start, label, length = (x[label > 0] for x in (start, label, length))
        image = np.searchsorted(ends, start, "right") - 1
        order = np.argsort(image << 32 | label, kind="stable")
        start, label, length, image = (x[order] for x in (start, label, length, image))
        new = np.ones(len(start), bool)
        new[1:] = (image[1:] != image[:-1]) | (label[1:] != label[:-1])
        found = masks.of_runs(width[image[new]], height[image[new]], np.cumsum(new) - 1, start - ends[image], length)
        parts.append(pa.StructArray.from_arrays([pa.array((label[new] - 1).astype(np.int32)), found], fields=list(_OBJECT)))
        counts.append(np.bincount(image[new], minlength=len(width)))
    ends = pa.array(masks.ends_of(np.concatenate(counts)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.concat_arrays(parts), mask=pc.is_null(labels))


@F.arrow_udf(MAP_TYPE)
def label_map(layers: pa.Array) -> pa.Array:
    """The label map of a list of masks: of several over a pixel the last one counts. Mask k has label k + 1."""
    each, count = layers.flatten(), pc.fill_null(pc.list_value_length(layers), 0).to_numpy(zero_copy_only=False)
    there = each.is_valid().to_numpy(zero_copy_only=False)
    ends, of = masks.ends_of(count), np.repeat(np.arange(len(count)), count)
    label = (np.arange(len(of)) - ends[of] + 1)[there]
    each, of = each.filter(pa.array(there)), of[there]
    known, first = np.unique(of, return_index=True)  # an image is as large as its first mask
    size = np.zeros((2, len(count)), np.int64)
    for k, c in enumerate(("width", "height")):
        size[k, known] = pc.struct_field(each, c).to_numpy(zero_copy_only=False)[first]
    pixels, data = size[0] * size[1], [pa.array([], pa.binary())]
    for a, b in masks.in_parts(pixels, masks.PIXELS):
        here = slice(*np.searchsorted(of, (a, b)).tolist())
        data.append(_painted(each[here], of[here] - a, label[here], pixels[a:b]))
    sizes = [pa.array(x.astype(np.int32)) for x in size]
    return pa.StructArray.from_arrays([*sizes, pa.concat_arrays(data)], fields=list(_MAP), mask=pa.array(~np.isin(np.arange(len(count)), known)))


def _painted(each: pa.Array, of: np.ndarray, label: np.ndarray, pixels: np.ndarray) -> pa.Array:
    """The pixels of images, of as few bytes as their labels need; the greatest label counts."""
    ends = masks.ends_of(pixels)
    kind = _TYPES[_bytes_for(int(label.max(initial=0)))]
    canvas = np.zeros(ends[-1], kind)
    parent = pc.list_parent_indices(pc.struct_field(each, "starts")).to_numpy(zero_copy_only=False)
    start, length = (pc.list_flatten(pc.struct_field(each, c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("starts", "lengths"))
    if (start + length > pixels[of[parent]]).any():
        raise IndexError("a mask reaches out of its image")
    start += ends[of[parent]]
    np.maximum.at(canvas, np.repeat(start - masks.ends_of(length)[:-1], length) + np.arange(int(length.sum())), np.repeat(label[parent].astype(kind), length))
    if kind.itemsize == 1:
        return pa.Array.from_buffers(pa.binary(), len(pixels), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(canvas)])
    planes = [canvas[a:b] for a, b in itertools.pairwise(ends.tolist())]
    return pa.array([x.astype(_TYPES[_bytes_for(int(x.max(initial=0)))]).tobytes() for x in planes], pa.binary())


def _uniform(key: str) -> float:
    """The number from 0 up to 1 that functions.draws gives this key."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 4294967296.0


def drawn_offsets(prefix: str, width: int, height: int, n: int, only: np.ndarray | None = None) -> list[int]:
    """The first n offsets in the order of md5(prefix|y|x), of all pixels or of some."""
    offsets = range(width * height) if only is None else only.tolist()
    return heapq.nsmallest(n, offsets, key=lambda i: (hashlib.md5(f"{prefix}|{i // width}|{i % width}".encode()).digest(), i))


def ring_point(labels: np.ndarray, own: int, anchor: tuple[int, int], distance: float) -> tuple[int, int] | None:
    """The pixel (x, y) outside `own` whose distance from the anchor is nearest to the wanted one; of ties (to six digits) the first by x and y.

    Rings around the wanted distance widen until one holds a pixel outside, so an image is seldom looked at as a whole.
    """
    height, width = labels.shape
    x0, y0 = anchor
    far = float(np.hypot(max(x0, width - 1 - x0), max(y0, height - 1 - y0)))
    room = 1.0
    while True:
        least, most = max(distance - room, 0.0), distance + room
        y = np.arange(max(0, int(np.floor(y0 - most))), min(height - 1, int(np.ceil(y0 + most))) + 1)
        outer = np.sqrt(np.maximum(most**2 - (y - y0) ** 2, 0))
        inner = np.sqrt(np.maximum(least**2 - (y - y0) ** 2, 0))
        # of each row the pixels between the inner and the outer circle, on both sides; one more on each end, for rounding
        left, right = np.maximum(x0 - np.ceil(outer) - 1, 0).astype(int), np.minimum(x0 + np.ceil(outer) + 1, width - 1).astype(int)
        hole_left, hole_right = (x0 - np.floor(inner) + 1).astype(int), (x0 + np.floor(inner) - 1).astype(int)
        spans = [(left, np.where(hole_left < hole_right, np.minimum(hole_left, right), right), y), (np.maximum(np.where(hole_left < hole_right, hole_right, right + 1), left), right, y)]
        xs, ys = [], []
        for a, b, rows in spans:
            n = np.maximum(b - a + 1, 0)
            xs.append(np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
            ys.append(np.repeat(rows, n))
        x, y = np.concatenate(xs), np.concatenate(ys)
        off = np.round(np.abs(np.hypot(x - x0, y - y0) - distance), 6)
        good = (labels[y, x] != own) & (off <= room)
        if good.any():
            x, y, off = x[good], y[good], off[good]
            best = np.lexsort((y, x, off))[0]
            return int(x[best]), int(y[best])
        if room > far + distance:
            return None
        room *= 2


_SEGMENT = ArrayType(StructType([StructField("obj_idx", IntegerType()), *[StructField(c, _ints("x", "y")) for c in ("anchor_point", "same_point", "diff_point")]]))
_XY = pa.struct([("x", pa.int32()), ("y", pa.int32())])
_SEGMENT_ARROW = pa.list_(pa.struct([("obj_idx", pa.int32()), ("anchor_point", _XY), ("same_point", _XY), ("diff_point", _XY)]))


def _segment_points(labels: pa.Array, chosen) -> pa.Array:
    """For each object of two pixels or more: two of its points and one outside. chosen(row, label, its offsets, width) gives the offsets of the two."""
    out = []
    for row, m in enumerate(labels.to_pylist()):
        found = []
        if m is not None:
            array = array_of(m)
            flat = array.ravel()
            order = np.argsort(flat, kind="stable")
            sizes = np.bincount(flat)
            ends = np.cumsum(sizes)
            for own in np.flatnonzero(sizes > 1).tolist():
                if own == 0:
                    continue
                points = [divmod(i, m["width"])[::-1] for i in chosen(row, own, order[ends[own] - sizes[own] : ends[own]], m["width"])]
                other = ring_point(array, own, points[0], float(np.hypot(points[0][0] - points[1][0], points[0][1] - points[1][1])))
                if other is not None:
                    found.append({"obj_idx": own - 1} | {k: {"x": p[0], "y": p[1]} for k, p in zip(("anchor_point", "same_point", "diff_point"), (*points, other), strict=True)})
        out.append(found)
    return pa.array(out, _SEGMENT_ARROW)


@F.arrow_udf(_SEGMENT)
def keyed_segment_points(labels: pa.Array, prefix: pa.Array) -> pa.Array:
    """The points of an object whose keys md5(prefix|object|y|x) are first and last."""
    names = prefix.to_pylist()

    def chosen(row: int, own: int, offsets: np.ndarray, width: int) -> tuple[int, int]:
        keys = [(hashlib.md5(f"{names[row]}|{own - 1}|{i // width}|{i % width}".encode()).digest(), i % width, i // width, i) for i in offsets.tolist()]
        return min(keys)[-1], max(keys)[-1]

    return _segment_points(labels, chosen)


@F.arrow_udf(_SEGMENT)
def drawn_segment_points(labels: pa.Array, prefix: pa.Array) -> pa.Array:
    """Two different points of an object by drawn ranks in the order of rows and columns; two keys an object, however large it is."""
    names = prefix.to_pylist()

    def chosen(row: int, own: int, offsets: np.ndarray, width: int) -> tuple[int, int]:
        u = [_uniform(f"{names[row]}|{own - 1}|{k}") for k in (0, 1)]
        first, second = int(u[0] * len(offsets)), int(u[1] * (len(offsets) - 1))
        return int(offsets[first]), int(offsets[second + (second >= first)])

    return _segment_points(labels, chosen)


def _read_points(raster: pa.Array, chosen) -> pa.Array:
    """x, y and value at the offsets that chosen(row, width, height) gives."""
    out = []
    for row, m in enumerate(raster.to_pylist()):
        if m is None:
            out.append(None)
            continue
        flat = array_of(m).ravel()
        out.append([{"x": i % m["width"], "y": i // m["width"], "value": int(flat[i])} for i in chosen(row, m["width"], m["height"])])
    return pa.array(out, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("value", pa.int32())])))


@F.arrow_udf(ArrayType(_ints("x", "y", "value")))
def keyed_points(raster: pa.Array, prefix: pa.Array, n: pa.Array) -> pa.Array:
    """The first n pixels of a map in the order of md5(prefix|y|x), with their values."""
    names, most = prefix.to_pylist(), n.to_pylist()
    return _read_points(raster, lambda row, width, height: drawn_offsets(names[row], width, height, most[row]))


@F.arrow_udf(ArrayType(_ints("x", "y", "value")))
def drawn_points(raster: pa.Array, prefix: pa.Array, n: pa.Array) -> pa.Array:
    """n pixels of a map at offsets drawn by md5(prefix|k), with their values: n keys, whatever the size of the map."""
    names, most = prefix.to_pylist(), n.to_pylist()
    return _read_points(raster, lambda row, width, height: [int(_uniform(f"{names[row]}|{k}") * width * height) for k in range(most[row] if width * height else 0)])
