"""Run-length masks and packed maps beside plain arrays of pixels."""

import io
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismloom.functions import masks, rasters
from prismloom.operators import single
from prismloom.sources import files, sinks

WIDTH, HEIGHT = 9, 7


def planes(n, seed, width=WIDTH, height=HEIGHT):
    draw = np.random.default_rng(seed)
    return [draw.random((height, width)) < draw.choice([0, 0.2, 0.6, 1]) for _ in range(n)]


def column(arrays):
    return pa.array([None if a is None else masks.from_array(a) for a in arrays], masks._ARROW)


def back(mask):
    if mask is None:
        return None
    canvas = np.zeros(mask["width"] * mask["height"], bool)
    masks.painted(canvas, mask, True)
    return canvas.reshape(mask["height"], mask["width"])


def same(found, want):
    return len(found) == len(want) and all((f is None and w is None) or np.array_equal(back(f), w) for f, w in zip(found, want, strict=True))


def test_arrays_become_canonical_runs_and_back():
    full = masks.from_array(np.ones((2, 3)))
    assert full["starts"] == [0, 3] and full["lengths"] == [3, 3]  # no run reaches over a row end
    for a in planes(40, 1):
        m = masks.from_array(a)
        assert np.array_equal(back(m), a)
        assert masks.from_csr(*masks.to_csr(m)) == m
    assert masks.from_array(np.zeros((3, 0))) == {"width": 0, "height": 3, "starts": [], "lengths": []}


@pytest.mark.parametrize(("how", "plain"), [("union", np.logical_or), ("intersection", np.logical_and), ("difference", lambda a, b: a & ~b)])
def test_two_masks_in_a_sweep(how, plain):
    a, b = [*planes(60, 2), *planes(9, 3, 1, 1), None, planes(1, 4)[0], planes(1, 5)[0]], [*planes(60, 6), *planes(9, 7, 1, 1), planes(1, 8)[0], None, planes(1, 9, 3, 3)[0]]
    found = masks.combine(column(a), column(b), how)
    want = [None if x is None or y is None or x.shape != y.shape else plain(x, y) for x, y in zip(a, b, strict=True)]
    assert same(found.to_pylist(), want)
    assert found.to_pylist() == column(want).to_pylist()  # the same pixels are the same runs
    assert same(masks.combine(column(a)[5:], column(b)[5:], how).to_pylist(), want[5:])  # slices of columns too
    assert len(masks.combine(column([]), column([]), how)) == 0


def test_runs_in_any_order_are_tidied():
    odd = pa.array([{"width": 4, "height": 3, "starts": [6, 2, 2, 5, 11], "lengths": [3, 4, 1, 1, 0]}, None], masks._ARROW)
    assert masks.tidied(odd).to_pylist() == [{"width": 4, "height": 3, "starts": [2, 4, 8], "lengths": [2, 4, 1]}, None]


def test_mask_columns(spark):
    a, b = planes(50, 10), planes(50, 11)
    rows = [(k, masks.from_array(x), masks.from_array(y)) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, f"id long, a {masks.MASK}, b {masks.MASK}").repartition(3)
    df = df.select("id", masks.area("a").alias("area"), masks.bounds("a").alias("box"), masks.intersection_area("a", "b").alias("shared"), masks.union("a", "b").alias("u"), masks.difference("a", "b").alias("d"), masks.contains("a", F.lit(3), F.lit(2)).alias("hit"), masks.contains("a", F.lit(-1), F.lit(3)).alias("off"))
    for r in df.collect():
        x, y = a[r.id], b[r.id]
        ys, xs = np.nonzero(x)
        box = (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(xs) else None
        assert (r.area, r.box and tuple(r.box), r.shared, r.hit, r.off) == (x.sum(), box, (x & y).sum(), x[2, 3], False)
        assert np.array_equal(back(r.u.asDict()), x | y) and np.array_equal(back(r.d.asDict()), x & ~y)


def test_boxes_and_rims(spark):
    boxes = [(0, 1, 1, 4, 3), (1, -5, -5, 50, 50), (2, 3, 3, 3, 5), (3, 8, 6, 20, 20), (4, -9, -9, -1, -1)]
    df = spark.createDataFrame(boxes, "id int, x1 int, y1 int, x2 int, y2 int")
    size = F.lit(WIDTH), F.lit(HEIGHT)
    sides = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    for r in df.select("*", masks.from_box(*size, *sides).alias("m"), masks.box_border(*size, *sides, 1).alias("rim")).collect():
        inside = lambda t: np.array([[r.x1 - t <= x < r.x2 + t and r.y1 - t <= y < r.y2 + t for x in range(WIDTH)] for y in range(HEIGHT)])  # noqa: B023, E731
        assert np.array_equal(back(r.m.asDict()), inside(0)) and np.array_equal(back(r.rim.asDict()), inside(1) & ~inside(-1))


def test_groups_and_layers(spark):
    each = planes(24, 12)
    rows = [(k // 6, k % 6, masks.from_array(a)) for k, a in enumerate(each)] + [(9, 0, None), (2, 6, None)]
    df = spark.createDataFrame(rows, f"image_id long, no int, mask {masks.MASK}")
    unions = {r.image_id: back(r.mask.asDict()) for r in masks.union_of_groups(df, ["image_id"]).collect()}
    assert set(unions) == {0, 1, 2, 3} and all(np.array_equal(unions[g], np.any(each[6 * g : 6 * g + 6], axis=0)) for g in unions)
    lists = df.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("no", "mask"))).alias("l")).select("image_id", F.col("l.mask").alias("masks"))
    lists = lists.unionByName(spark.createDataFrame([(10, []), (11, None)], f"image_id long, masks array<{masks.MASK}>"))
    for r in lists.select("image_id", masks.visible("masks").alias("seen"), rasters.label_map("masks").alias("map")).collect():
        if r.image_id > 3:
            assert not r.seen or r.seen == [None]
            assert r.map is None
            continue
        top = np.zeros((HEIGHT, WIDTH), int)
        for k in range(6):
            top[each[6 * r.image_id + k]] = k + 1
        for k in range(6):
            assert np.array_equal(back(r.seen[k].asDict()), top == k + 1)
        assert np.array_equal(rasters.array_of(r.map.asDict()), top)


def test_sparse_matrix_files(spark, tmp_path):
    each = planes(5, 13)
    (tmp_path / "one.pkl").write_bytes(sinks.csr_list([masks.from_array(a) for a in each]))
    np.save(tmp_path / "two.npy", np.array(each[:2]))
    found = {(r.image_id, r.mask_no): back(r.mask.asDict()) for r in files.mask_lists(spark, str(tmp_path)).collect()}
    assert len(found) == 7 and all(np.array_equal(found["one", k], a) for k, a in enumerate(each)) and all(np.array_equal(found["two", k], a) for k, a in enumerate(each[:2]))


class Evil:
    def __reduce__(self):
        return (print, ("run",))


def test_pickles_of_anything_else_are_refused():
    with pytest.raises(pickle.UnpicklingError, match="isn't read"):
        files._csr_lists(pickle.dumps([Evil()]))
    with pytest.raises(pickle.UnpicklingError, match="isn't read"):
        files._csr_lists(b"cos\nsystem\n(S'true'\ntR.")


@pytest.mark.parametrize("protocol", [2, 4, 5])
def test_matrices_with_explicit_zeros_and_unsorted_columns(protocol):
    matrix = files.SparseMatrix()
    matrix.__setstate__({"_shape": (2, 4), "indptr": np.array([0, 3, 4], np.int32), "indices": np.array([3, 0, 1, 2], np.int32), "data": np.array([True, True, False, True])})
    stream = io.BytesIO()
    sinks._MatrixWriter(stream, max(protocol, 4)).dump([matrix])
    assert files._csr_lists(stream.getvalue()) == [masks.from_array(np.array([[1, 0, 0, 1], [0, 0, 1, 0]]))]


def test_images_of_masks(spark):
    each = planes(3, 14)
    df = spark.createDataFrame([(1, [masks.from_array(a) for a in each])], f"image_id long, masks array<{masks.MASK}>")
    grey = np.zeros((HEIGHT, WIDTH), int)
    for k, a in enumerate(each):
        grey[a] = 30 + 20 * k
    assert np.array_equal(sinks.grey_of(bytes(sinks.mask_pngs(df).first().png)), grey)


def test_layers_as_arrays():
    one, none = masks.from_array(np.eye(3, dtype=int)), masks.from_array(np.zeros((2, 2), int))
    rows = [[one, None, none], None, [], [none, one]]
    column = pa.array(rows, pa.list_(masks._ARROW))
    plain = lambda lists: [None if r is None else [None if m is None else {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in m.items()} for m in r] for r in lists]
    assert plain(masks.lists_of(column)) == rows and plain(masks.lists_of(column[2:])) == rows[2:] and plain(masks.lists_of(column[:1])) == rows[:1]


def test_lists_are_not_pickled_in_python():
    each = [masks.from_array(a) for a in planes(4, 15)]
    content = sinks.csr_list(each)
    assert not issubclass(sinks._MatrixWriter, pickle._Pickler)
    assert b"SparseMatrix" not in content and content.count(b"scipy.sparse._csr\ncsr_matrix") == 1
    assert files._csr_lists(content) == each and files._csr_lists(sinks.csr_list([])) == []


def test_maps_of_files(spark, tmp_path):
    depth = np.arange(12, dtype=float).reshape(3, 4) * 2.5 - 4
    np.save(tmp_path / "d.npy", depth)
    found = rasters.array_of(files.array_maps(spark, str(tmp_path), scaled=True).first()["map"].asDict())
    assert np.array_equal(found, ((depth - depth.min()) / (depth.max() - depth.min()) * 255).astype(np.uint8))
    wide = np.array([[0, 70_000], [300, 1]])
    assert np.array_equal(rasters.array_of(rasters.map_of(wide)), wide)


def test_ring_points_are_the_nearest_of_all():
    draw = np.random.default_rng(15)
    for _ in range(300):
        labels = draw.choice(3, (draw.integers(1, 14), draw.integers(1, 14)), p=[0.1, 0.85, 0.05])
        anchor = int(draw.integers(labels.shape[1])), int(draw.integers(labels.shape[0]))
        distance = float(draw.random() * 18)
        y, x = np.nonzero(labels != 1)
        off = np.round(np.abs(np.hypot(x - anchor[0], y - anchor[1]) - distance), 6)
        best = np.lexsort((y, x, off))[:1]
        want = (int(x[best][0]), int(y[best][0])) if len(best) else None
        assert rasters.ring_point(labels, 1, anchor, distance) == want


def test_large_images_are_probed(spark):
    draw = np.random.default_rng(16)
    depth = draw.integers(0, 256, (1000, 1500))
    labels = np.zeros((1000, 1500), int)
    labels[100:900, 200:1300] = 1
    row = (1, rasters.map_of(depth), rasters.map_of(labels))
    maps = spark.createDataFrame([row, (2, None, None)], f"image_id long, depth {rasters.MAP}, labels {rasters.MAP}")
    found = single.depth_probes(maps).collect()
    assert [r.image_id for r in found] == [1]
    near, far = (depth[p.y, p.x] for p in (found[0].closer, found[0].farther))
    assert near - far >= single.DEPTH_GAP
    points = single.segment_points(maps, by_rank=True).collect()[0]
    assert labels[points.anchor_point.y, points.anchor_point.x] == labels[points.same_point.y, points.same_point.x] == 1 and labels[points.diff_point.y, points.diff_point.x] == 0


def test_masks_of_an_image_meet_without_being_shuffled(spark, small):
    import re

    from prismloom.plans import pixel_queries  # noqa: F401  registers its queries
    from prismloom.plans.queries import QUERIES

    for name in ("sg18c_merged_by_masks_0", "j12_shared_pixels"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet [l_orderkey") == 2, name  # once for each side
        by = {re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)}
        assert by <= {"image_id", "l_partkey", "p_partkey", "image_id, region_id"}, name


def test_lists_of_matrices_are_read_in_parts(monkeypatch):
    each = [*planes(40, 17), *planes(5, 18, 1, 4), np.zeros((0, 3), bool)]
    column_ = column(each)
    for most in (1, 30, 1 << 21):
        monkeypatch.setattr(masks, "PIXELS", most)
        matrices = list(masks.csr_of(column_))
        assert [m[2] for m in matrices] == [a.shape for a in each]
        assert masks.of_csr(*(list(x) for x in zip(*((p, i, None, s) for p, i, s in matrices), strict=True))).equals(column_)
        assert masks.sums.func(column_).to_pylist() == [{"area": int(a.sum()), "offsets": int(np.flatnonzero(a).sum())} for a in each]
    indptr, indices, data = np.array([0, 1, 2]), np.array([2, 0, 9, 9]), np.array([1, 0, 1, 1])
    assert masks.of_csr([indptr], [indices], [data], [(2, 3)]).to_pylist() == [masks.from_array(np.array([[0, 0, 1], [0, 0, 0]]))]  # room after the last row
    with pytest.raises(ValueError, match="outside of its shape"):
        masks.from_csr(np.array([0, 1]), np.array([5]), (1, 3))


def test_masks_of_layers_are_those_of_diamonds(spark, small):
    from prismloom.plans.pixel_queries import diamonds, layers
    from prismloom.plans.scene import driver_scene

    scene = driver_scene(spark, small)
    found = {(r.image_id, k): m for r in layers(scene).collect() for k, m in enumerate(r.masks)}
    assert found == {(r.image_id, r.obj_idx): r.mask for r in diamonds(scene).collect()}


def test_lists_are_drawn_written_and_read_in_one_step_of_python(spark, small):
    from prismloom.plans import pixel_queries  # noqa: F401  registers its queries
    from prismloom.plans.queries import QUERIES

    plan = QUERIES["k5b_sparse_mask_lists"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "read(written(drawn(" in plan and plan.count("ArrowEvalPython [") == 2  # and one that sums up masks
    assert "aggregate(" not in plan and "Exchange hashpartitioning(image_id" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_lists_become_maps_and_masks_again_in_parts(spark, small, monkeypatch):
    from prismloom.plans import pixel_queries  # noqa: F401  registers its queries
    from prismloom.plans.queries import QUERIES

    draw = np.random.default_rng(19)
    lists = [[*planes(5, 20)], None, [], [None, *planes(2, 21, 3, 2)], [None], [np.zeros((0, 4), bool)], [draw.random((6, 70)) < 0.5 for _ in range(300)], planes(1, 22)]
    rows = pa.array([None if x is None else [None if a is None else masks.from_array(a) for a in x] for x in lists], pa.list_(masks._ARROW))
    tops = []
    for x in lists:
        shape = next((a.shape for a in x or [] if a is not None), None)
        tops.append(None if shape is None else np.zeros(shape, int))
        for k, a in enumerate(x or []):
            if a is not None:
                tops[-1][a] = k + 1
    want = [None if t is None else rasters.map_of(t) for t in tops]
    objects = [None if t is None else [{"obj_idx": k - 1, "mask": masks.from_array(t == k)} for k in np.unique(t).tolist() if k] for t in tops]
    assert tops[6].max() == 300
    for most in (1, 50, 1 << 21):
        monkeypatch.setattr(masks, "PIXELS", most)
        maps = rasters.label_map.func(rows)
        assert maps.to_pylist() == want and rasters.label_map.func(rows[3:]).to_pylist() == want[3:]
        assert rasters.object_masks.func(maps).to_pylist() == objects and rasters.object_masks.func(maps[3:]).to_pylist() == objects[3:]
    assert rasters.label_map.func(rows[:0]).to_pylist() == [] == rasters.object_masks.func(maps[:0]).to_pylist()
    large = [masks.from_array(np.ones((2, 2))), masks.from_array(np.ones((3, 3)))]
    with pytest.raises(IndexError):
        rasters.label_map.func(pa.array([large, large], pa.list_(masks._ARROW)))
    plan = QUERIES["s4b_packed_label_map"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "object_masks(label_map(drawn(" in plan and "aggregate(" not in plan
