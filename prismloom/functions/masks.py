"""Masks as run lengths: a column of width, height and the sorted runs of an image's pixels, counted row by row.

A run is a start (y * width + x) and a length. Runs are canonical: sorted, not empty, none reaches over the end of a row
and no two of a row touch. So a mask costs about two numbers for each row of pixels it crosses, however large it is, and
the same pixels are always the same value. Single masks are read by array expressions; two masks meet in a sweep over
the runs of a whole Arrow batch.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

MASK = "struct<width:int,height:int,starts:array<int>,lengths:array<int>>"
MASK_TYPE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("starts", ArrayType(IntegerType())), StructField("lengths", ArrayType(IntegerType()))])
_ARROW = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])


class Runs(NamedTuple):
    """The runs of several masks: the mask's number, first pixel and the one after the last, with one pixel of room after each row."""

    of: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Shapes(NamedTuple):
    width: np.ndarray
    height: np.ndarray
    known: np.ndarray

    @property
    def room(self) -> int:
        """More than the pixels of any of the images, with their room."""
        return int(((self.width + 1) * self.height).max(initial=0)) + 1


def _read(masks: pa.Array) -> tuple[Shapes, Runs]:
    """Shapes and runs; runs that reach over row ends are cut there."""
    known = pc.is_valid(masks).to_numpy(zero_copy_only=False)
    size = [pc.fill_null(pc.struct_field(masks, c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "height")]
    starts, lengths = (pc.struct_field(masks, c) for c in ("starts", "lengths"))
    of = pc.list_parent_indices(starts).to_numpy(zero_copy_only=False).astype(np.int64)
    start, length = (pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, lengths))
    some = length > 0
    of, start, length = of[some], start[some], length[some]
    width = size[0][of]
    first, last = start // np.maximum(width, 1), (start + length - 1) // np.maximum(width, 1)
    n = last - first + 1
    row = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    at = np.repeat(np.arange(len(of)), n)
    w = width[at]
    from_x, to_x = np.maximum(start[at], row * w) - row * w, np.minimum((start + length)[at], (row + 1) * w) - row * w
    return Shapes(*size, known), Runs(of[at], row * (w + 1) + from_x, row * (w + 1) + to_x)


def _written(shapes: Shapes, runs: Runs) -> pa.Array:
    """The mask column of canonical runs, in the order of their masks; null where a shape isn't known."""
    w = shapes.width[runs.of]
    return _column(shapes, runs.of, runs.start // (w + 1) * w + runs.start % (w + 1), runs.end - runs.start)


def _column(shapes: Shapes, of: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = pa.array(ends_of(np.bincount(of, minlength=len(shapes.width))), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (starts, lengths)]
    sizes = [pa.array(x.astype(np.int32)) for x in (shapes.width, shapes.height)]
    return pa.StructArray.from_arrays([*sizes, *lists], fields=list(_ARROW), mask=pa.array(~shapes.known))


def of_runs(width: np.ndarray, height: np.ndarray, of: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The mask column of canonical runs, in the order of their masks (`of`)."""
    return _column(Shapes(width, height, np.ones(len(width), bool)), of, starts, lengths)


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sum: where parts of these sizes begin and end."""
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def in_parts(sizes: np.ndarray, most: int):
    """Ranges (first, end) of successive items whose sizes add up to about `most`, so that what is made of a range is bounded."""
    ends, first = ends_of(sizes), 0
    while first < len(sizes):
        end = max(int(np.searchsorted(ends, ends[first] + most, "right")) - 1, first + 1)
        yield first, end
        first = end


def of_spans(width: np.ndarray, height: np.ndarray, of: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Array:
    """The mask column of spans left <= x < right of rows, cut to the images; at most one a row, by mask (`of`) and row."""
    w = width[of]
    left, right = np.maximum(left, 0), np.minimum(right, w)
    some = (left < right) & (y >= 0) & (y < height[of])
    return of_runs(width, height, of[some], (y * w + left)[some], (right - left)[some])


def _swept(a: Runs, b: Runs, room: int, want) -> Runs:
    """Canonical runs of the pixels for which want(in a, in b) holds; want(False, False) must not."""
    n, m = len(a.of), len(b.of)
    place = np.concatenate((a.of * room + a.start, a.of * room + a.end, b.of * room + b.start, b.of * room + b.end))
    step_a = np.concatenate((np.ones(n, np.int64), -np.ones(n, np.int64), np.zeros(2 * m, np.int64)))
    step_b = np.concatenate((np.zeros(2 * n, np.int64), np.ones(m, np.int64), -np.ones(m, np.int64)))
    order = np.argsort(place, kind="stable")
    place = place[order]
    last = np.flatnonzero(np.append(place[1:] != place[:-1], True)) if len(place) else np.zeros(0, np.int64)
    inside = want(np.cumsum(step_a[order])[last] > 0, np.cumsum(step_b[order])[last] > 0)
    before = np.concatenate(([False], inside[:-1]))[: len(inside)]
    place = place[last]
    start, end = place[inside & ~before], place[~inside & before]
    return Runs(start // room, start % room, end % room)


_WANT = {"union": np.logical_or, "intersection": np.logical_and, "difference": lambda a, b: a & ~b}
_NONE = Runs(*[np.zeros(0, np.int64)] * 3)


def combine(a: pa.Array, b: pa.Array, how: str) -> pa.Array:
    """Masks of two columns combined row by row; null where either is, or where their sizes differ."""
    (shape, x), (other, y) = _read(a), _read(b)
    same = shape.known & other.known & (shape.width == other.width) & (shape.height == other.height)
    x, y = (Runs(*[c[same[r.of]] for c in r]) for r in (x, y))
    return _written(shape._replace(known=same), _swept(x, y, shape.room, _WANT[how]))


def tidied(masks: pa.Array) -> pa.Array:
    """Canonical masks of runs in any order, which may overlap or reach over row ends."""
    shapes, runs = _read(masks)
    return _written(shapes, _swept(runs, _NONE, shapes.room, np.logical_or))


def _of_two(how: str):
    @F.arrow_udf(MASK_TYPE)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return combine(a, b, how)

    return two


union, intersection, difference = (_of_two(how) for how in ("union", "intersection", "difference"))
union.__doc__, intersection.__doc__, difference.__doc__ = "Pixels of either mask.", "Pixels of both masks.", "Pixels of the first mask that aren't of the second."


@F.arrow_udf(MASK_TYPE)
def canonical(mask: pa.Array) -> pa.Array:
    """The mask with canonical runs."""
    return tidied(mask)


@F.arrow_udf(LongType())
def intersection_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Pixels that two masks share; null where either is, or where their sizes differ."""
    (shape, x), (other, y) = _read(a), _read(b)
    same = shape.known & other.known & (shape.width == other.width) & (shape.height == other.height)
    x, y = (Runs(*[c[same[r.of]] for c in r]) for r in (x, y))
    both = _swept(x, y, shape.room, np.logical_and)
    return pa.array(np.bincount(both.of, weights=both.end - both.start, minlength=len(same)).astype(np.int64), mask=~same)


intersection_area = intersection_area.asNondeterministic()  # else Spark computes it for a filter and once more for the column


@F.arrow_udf(ArrayType(MASK_TYPE))
def visible(layers: pa.Array) -> pa.Array:
    """What is seen of the masks of a list laid over each other, the last on top; null masks stay null and cover nothing."""
    offsets = layers.offsets.to_numpy()
    values, count = layers.values.cast(_ARROW), np.diff(offsets)
    there = pc.is_valid(values).to_numpy(zero_copy_only=False)
    covered, places, seen = pa.nulls(len(count), values.type), [], []
    for k in range(int(count.max(initial=0))):
        rows = np.flatnonzero(count > k)
        at = offsets[1:][rows] - 1 - k
        top, under = values.take(pa.array(at)), covered.take(pa.array(rows))
        bare = pc.is_null(under).to_numpy(zero_copy_only=False)
        pick = lambda new: pa.concat_arrays([new, top]).take(pa.array(np.arange(len(at)) + len(at) * bare))  # noqa: B023, E731  nothing above it: as it is
        places.append(at)
        seen.append(pick(combine(top, under, "difference")))
        grown = pick(combine(top, under, "union"))
        source = np.arange(len(count))
        some = there[at]
        source[rows[some]] = len(count) + np.flatnonzero(some)
        covered = pa.concat_arrays([covered, grown]).take(pa.array(source))
    if not seen:
        return layers
    flat = pa.concat_arrays(seen).take(pa.array(np.argsort(np.concatenate(places), kind="stable")))
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), flat)


def area(mask: str | Column) -> Column:
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.aggregate(m["lengths"], F.lit(0).cast("long"), lambda total, n: total + n)


@F.arrow_udf(StructType([StructField("area", LongType()), StructField("offsets", LongType())]))
def sums(mask: pa.Array) -> pa.Array:
    """The pixels of a mask and the sum of their offsets, which tells masks of the same area apart."""
    known = pc.is_valid(mask).to_numpy(zero_copy_only=False)
    starts, lengths = (pc.struct_field(mask, c) for c in ("starts", "lengths"))
    of = pc.list_parent_indices(starts).to_numpy(zero_copy_only=False)
    first, n = (pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, lengths))
    totals = []
    for each in (n, first * n + n * (n - 1) // 2):
        ends = ends_of(each)[ends_of(np.bincount(of, minlength=len(mask)))]
        totals.append(pa.array(np.diff(ends), pa.int64()))
    return pa.StructArray.from_arrays(totals, names=["area", "offsets"], mask=pa.array(~known))


sums = sums.asNondeterministic()  # as intersection_area


def bounds(mask: str | Column) -> Column:
    """The box around a mask, ends exclusive; null for an empty one."""
    m = F.col(mask) if isinstance(mask, str) else mask
    w = m["width"]
    right = F.array_max(F.zip_with(m["starts"], m["lengths"], lambda s, n: s % w + n))
    rows = F.transform(m["starts"], lambda s: F.floor(s / w).cast("int"))
    box = F.struct(F.array_min(F.transform(m["starts"], lambda s: s % w)).alias("x1"), F.array_min(rows).alias("y1"), right.alias("x2"), (F.array_max(rows) + 1).alias("y2"))
    return F.when(F.size(m["starts"]) > 0, box)


def contains(mask: str | Column, x: Column, y: Column) -> Column:
    """Whether a pixel is of a mask; never outside the image."""
    m = F.col(mask) if isinstance(mask, str) else mask
    at = y * m["width"] + x
    inside = (x >= 0) & (y >= 0) & (x < m["width"]) & (y < m["height"])
    return inside & F.exists(F.zip_with(m["starts"], m["lengths"], lambda s, n: (s <= at) & (at < s + n)), lambda hit: hit)


def from_rows(width: Column, height: Column, y1: Column, y2: Column, left, right) -> Column:
    """The mask of pixels y1 <= y < y2, left(y) <= x < right(y), cut to the image."""
    low, high = F.greatest(y1, F.lit(0)), F.least(y2, height)
    rows = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(rows, lambda y: F.struct((y * width + F.greatest(left(y), F.lit(0))).cast("int").alias("start"), (F.least(right(y), width) - F.greatest(left(y), F.lit(0))).cast("int").alias("length")))
    runs = F.filter(runs, lambda r: r["length"] > 0)
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), runs["start"].alias("starts"), runs["length"].alias("lengths"))


def from_box(width: Column, height: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box, ends exclusive, as a mask."""
    return from_rows(width, height, y1, y2, lambda y: x1, lambda y: x2)


def box_border(width: Column, height: Column, x1: Column, y1: Column, x2: Column, y2: Column, thick: int) -> Column:
    """The rim of a box, `thick` pixels on each side of its edge."""
    outer = from_box(width, height, x1 - thick, y1 - thick, x2 + thick, y2 + thick)
    return difference(outer, from_box(width, height, x1 + thick, y1 + thick, x2 - thick, y2 - thick))


def union_of_groups(df: DataFrame, by: list[str], mask: str = "mask") -> DataFrame:
    """by and the union of each group's masks. Runs are gathered as they are and swept once; a group is the masks of one image or so."""
    runs = F.flatten(F.collect_list(F.arrays_zip(f"{mask}.starts", f"{mask}.lengths")))
    grouped = df.where(F.col(mask).isNotNull()).groupBy(*by).agg(F.max(f"{mask}.width").alias("width"), F.max(f"{mask}.height").alias("height"), runs.alias("runs"))
    return grouped.select(*by, canonical(F.struct("width", "height", F.col("runs.starts").alias("starts"), F.col("runs.lengths").alias("lengths"))).alias(mask))


#: Pixels (and rows) that are spread out at once where the runs of many masks become places or back.
PIXELS = 1 << 21


def from_csr(indptr: np.ndarray, indices: np.ndarray, shape: tuple[int, int]) -> dict:
    """A sparse matrix's rows and columns as a mask; columns may stand in any order and repeat."""
    return of_csr([indptr], [indices], [None], [shape])[0].as_py()


def of_csr(indptr: list[np.ndarray], indices: list[np.ndarray], data: list[np.ndarray | None], shapes: list[tuple[int, int]]) -> pa.Array:
    """The mask column of the rows and columns of sparse matrices. Columns may stand in any order and repeat, and what is stored as zero is none."""
    parts = []
    for a, b in in_parts(np.array([len(x) + len(p) for x, p in zip(indices, indptr, strict=True)], np.int64), PIXELS):
        parts.append(_of_csr(indptr[a:b], indices[a:b], data[a:b], np.array(shapes[a:b], np.int64)))
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64, copy=False) if parts else np.zeros(0, np.int64)


def _of_csr(indptr: list[np.ndarray], indices: list[np.ndarray], data: list[np.ndarray | None], shapes: np.ndarray) -> pa.Array:
    height, width = shapes.T
    if [len(p) for p in indptr] != (height + 1).tolist():
        raise ValueError("a sparse matrix's rows are not those of its shape")
    until, ends = _joined(indptr), ends_of(height + 1)
    first, last, n = until[ends[:-1]], until[ends[1:] - 1], np.array([len(x) for x in indices], np.int64)
    if first.any() or (last != n).any():  # room before the first row or after the last one
        indices, data = ([None if x is None else x[a:b] for x, a, b in zip(xs, first.tolist(), last.tolist(), strict=True)] for xs in (indices, data))
    rows = np.delete(np.diff(until), ends[1:-1] - 1)  # not from the last row of a matrix to the next matrix
    y, x = np.repeat(np.arange(len(rows)), rows), _joined(indices)
    if any(d is not None for d in data):
        kept = np.concatenate([np.ones(len(i), bool) if d is None else d for d, i in zip(data, indices, strict=True)]).astype(bool)
        y, x = y[kept], x[kept]
    of = np.repeat(np.arange(len(height)), height)
    if ((x < 0) | (x >= width[of[y]])).any():
        raise ValueError("a sparse matrix has a column outside of its shape")
    room = int(width.max(initial=0)) + 1
    at = y * room + x
    if not (at[1:] > at[:-1]).all():
        at = np.unique(at)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1))) if len(at) else np.zeros(0, np.int64)
    y, x = np.divmod(at[first], room)
    return of_runs(width, height, of[y], (y - ends_of(height)[of[y]]) * width[of[y]] + x, np.diff(np.append(first, len(at))))


def from_array(plane: np.ndarray) -> dict:
    """The pixels of a two-dimensional array that aren't zero."""
    y, x = np.nonzero(plane)
    return from_csr(np.concatenate(([0], np.cumsum(np.bincount(y, minlength=plane.shape[0])))), x, plane.shape)


def to_csr(mask: dict) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """indptr, indices and shape."""
    return next(csr_of(pa.array([mask], _ARROW)))


def csr_of(column: pa.Array):
    """indptr, indices (of four bytes each) and shape of each mask of a column without nulls."""
    sizes = pc.list_value_length(pc.struct_field(column, "starts")).to_numpy(zero_copy_only=False)
    ends = ends_of(sizes)
    area = np.diff(ends_of(pc.list_flatten(pc.struct_field(column, "lengths")).to_numpy(zero_copy_only=False))[ends])
    for a, b in in_parts(area + pc.struct_field(column, "height").to_numpy(zero_copy_only=False), PIXELS):
        shapes, runs = _read(column[a:b])
        y, x = np.divmod(runs.start, shapes.width[runs.of] + 1)
        n = runs.end - runs.start
        indices = (np.repeat(x - ends_of(n)[:-1], n) + np.arange(int(n.sum()))).astype(np.int32)
        first = ends_of(shapes.height + 1)
        until = np.cumsum(np.bincount(first[runs.of] + y + 1, weights=n, minlength=first[-1]).astype(np.int64))
        indptr = (until - np.repeat(until[first[:-1]], shapes.height + 1)).astype(np.int32)
        place = [*until[first[:-1]].tolist(), len(indices)]
        rows = first.tolist()
        for k, shape in enumerate(zip(shapes.height.tolist(), shapes.width.tolist(), strict=True)):
            yield indptr[rows[k] : rows[k + 1]], indices[place[k] : place[k + 1]], shape


def lists_of(column: pa.Array) -> list[list[dict | None] | None]:
    """What to_pylist gives of a column of lists of masks, but with starts and lengths as parts of one numpy array each."""
    values = column.flatten()
    known = pc.is_valid(values).to_pylist()
    sizes = [pc.struct_field(values, c).to_pylist() for c in ("width", "height")]
    runs = []
    for c in ("starts", "lengths"):
        part = pc.struct_field(values, c)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)).tolist()
        flat = pc.list_flatten(part).to_numpy(zero_copy_only=False)
        runs.append([flat[a:b] for a, b in itertools.pairwise([0, *ends])])
    each = [{"width": w, "height": h, "starts": a, "lengths": n} if there else None for there, w, h, a, n in zip(known, *sizes, *runs, strict=True)]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [each[a:b] if there else None for there, (a, b) in zip(pc.is_valid(column).to_pylist(), itertools.pairwise([0, *ends]), strict=True)]


def painted(canvas: np.ndarray, mask: dict, value: int) -> None:
    """Give the mask's pixels of a flat canvas a value."""
    starts, lengths = np.asarray(mask["starts"], np.int64), np.asarray(mask["lengths"], np.int64)
    canvas[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = value
