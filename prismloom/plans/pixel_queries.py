"""Queries of run-length masks and packed maps, each beside SQL on rows of pixels. Importing registers them.

An object's mask is a diamond in its box, on a grid of 64 x 64 cells: each row is shorter the farther it is from the
middle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from prismloom.functions import masks, rasters
from prismloom.operators import parse, single
from prismloom.plans.coverage_queries import _PX
from prismloom.plans.queries import embedding_maps, scene_query, table_query, uniform_sql
from prismloom.plans.scene import Scene
from prismloom.sources import files, sinks

GRID = 64
CELLS_SQL = f"""diamonds as (select image_id, obj_idx, label, x1 // 16 as gx1, (x2 + 15) // 16 as gx2, y1 // 16 as gy1, (y2 + 15) // 16 as gy2 from objects),
lines as (select *, unnest(range(gy1, gy2)) as y from diamonds),
cells as (select image_id, obj_idx, label, y, unnest(range(gx1 + abs(2 * y - gy1 - gy2 + 1) // 4, gx2 - abs(2 * y - gy1 - gy2 + 1) // 4)) as x from lines),
tops as (select image_id, y, x, max(obj_idx) as obj_idx from cells group by all)"""


def boxed(s: Scene) -> DataFrame:
    """image_id, obj_idx and the grid's box of each object."""
    cell = lambda c, up: F.floor((F.col(c) + up) / 16).cast("int")
    return s.objects.select("image_id", "obj_idx", cell("x1", 0).alias("gx1"), cell("x2", 15).alias("gx2"), cell("y1", 0).alias("gy1"), cell("y2", 15).alias("gy2"))


def diamonds(s: Scene) -> DataFrame:
    """image_id, obj_idx, the grid's box and mask of each object."""
    cut = lambda y: F.floor(F.abs(2 * y - F.col("gy1") - F.col("gy2") + 1) / 4).cast("int")
    grid = F.lit(GRID)
    mask = masks.from_rows(grid, grid, F.col("gy1"), F.col("gy2"), lambda y: F.col("gx1") + cut(y), lambda y: F.col("gx2") - cut(y))
    # a condition that Spark can't foresee keeps it from drawing the mask anew wherever it is read
    return boxed(s).withColumn("mask", F.when(F.monotonically_increasing_id() >= 0, mask))


def layers(s: Scene) -> DataFrame:
    """image_id and the list of its objects' masks, by index: the masks of diamonds(), drawn for a whole Arrow batch after boxes were grouped."""

    @F.arrow_udf(ArrayType(masks.MASK_TYPE))
    def drawn(column: pa.Array) -> pa.Array:
        each = column.flatten()
        sides = [pc.struct_field(each, c) for c in ("gx1", "gy1", "gx2", "gy2")]
        known = reduce(pc.and_, (pc.is_valid(c) for c in sides)).to_numpy(zero_copy_only=False)
        left, top, right, bottom = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in sides)
        low = np.maximum(top, 0)
        rows = np.where(known, np.maximum(np.minimum(bottom, GRID) - low, 0), 0)
        of = np.repeat(np.arange(len(rows)), rows)
        y = np.repeat(low - masks.ends_of(rows)[:-1], rows) + np.arange(len(of))
        cut = np.abs(2 * y - top[of] - bottom[of] + 1) // 4
        size = np.full(len(rows), GRID)
        found = masks.of_spans(size, size, of, y, left[of] + cut, right[of] - cut)
        return pa.ListArray.from_arrays(pa.array(masks.ends_of(pc.list_value_length(column).to_numpy(zero_copy_only=False)), pa.int32()), found)

    each = boxed(s).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("obj_idx", "gx1", "gy1", "gx2", "gy2"))).alias("l"))
    return each.select("image_id", drawn("l").alias("masks"))


# Masks


@scene_query("p12_mask_boxes", "select image_id, obj_idx, min(x)::int as x1, min(y)::int as y1, (max(x) + 1)::int as x2, (max(y) + 1)::int as y2, count(*) as area from cells group by image_id, obj_idx", CELLS_SQL)
def p12(s: Scene) -> DataFrame:
    return diamonds(s).where(F.size("mask.starts") > 0).select("image_id", "obj_idx", masks.bounds("mask").alias("b"), masks.area("mask").alias("area")).select("image_id", "obj_idx", "b.*", "area")


@scene_query(
    "p14_box_rasters",
    f"""select image_id, obj_idx, count(*) as area, sum(y * {GRID} + x)::bigint as offsets, sum(case when y < gy1 + 1 or y >= gy2 - 1 or x < gx1 + 1 or x >= gx2 - 1 then 1 else 0 end)::bigint as rim
    from (select *, unnest(range(greatest(gx1 - 1, 0), least(gx2 + 1, {GRID}))) as x from (select *, unnest(range(greatest(gy1 - 1, 0), least(gy2 + 1, {GRID}))) as y from diamonds)) group by image_id, obj_idx""",
    CELLS_SQL,
)
def p14(s: Scene) -> DataFrame:
    sides = [F.col(c) for c in ("gx1", "gy1", "gx2", "gy2")]
    grid = F.lit(GRID)
    each = diamonds(s).withColumn("whole", masks.from_box(grid, grid, sides[0] - 1, sides[1] - 1, sides[2] + 1, sides[3] + 1)).withColumn("rim", masks.box_border(grid, grid, *sides, 1))
    return each.select("image_id", "obj_idx", masks.sums("whole").alias("s"), masks.area("rim").alias("rim")).select("image_id", "obj_idx", "s.*", "rim")


@scene_query(
    "p14b_points_in_masks",
    "select d.image_id, d.obj_idx, count(c.obj_idx) as hits from diamonds d left join cells c on c.image_id = d.image_id and c.x = (d.gx1 + d.gx2) // 2 and c.y = (d.gy1 + d.gy2) // 2 group by d.image_id, d.obj_idx",
    CELLS_SQL,
)
def p14b(s: Scene) -> DataFrame:
    middle = lambda axis: F.floor((F.col(f"g{axis}1") + F.col(f"g{axis}2")) / 2).cast("int").alias(axis)
    points = diamonds(s).select("image_id", "obj_idx", middle("x"), middle("y"))
    hit = points.join(diamonds(s).select("image_id", "mask"), "image_id").withColumn("hit", masks.contains("mask", F.col("x"), F.col("y")).cast("long"))
    return hit.groupBy("image_id", "obj_idx").agg(F.sum("hit").alias("hits"))


_PAIRS = "select a.image_id, a.obj_idx as first_id, b.obj_idx as region_id, count(*) as shared from cells a join cells b on a.image_id = b.image_id and a.x = b.x and a.y = b.y"


@scene_query("j12_shared_pixels", f"{_PAIRS} and a.obj_idx < b.obj_idx group by all", CELLS_SQL)
def j12(s: Scene) -> DataFrame:
    each = diamonds(s).select("image_id", "obj_idx", "mask")
    return parse.mask_overlaps(each.withColumnRenamed("obj_idx", "first_id"), each.withColumnRenamed("obj_idx", "region_id"), ordered=True)


@scene_query("s4_label_map", f"select image_id, obj_idx, count(*) as area, sum(y * {GRID} + x)::bigint as offsets from tops group by all", CELLS_SQL)
def s4(s: Scene) -> DataFrame:
    seen = layers(s).select("image_id", F.posexplode(masks.visible("masks")).alias("obj_idx", "mask"))
    return seen.select("image_id", "obj_idx", masks.sums("mask").alias("s")).select("image_id", "obj_idx", "s.*").where("area > 0")


@scene_query("s4b_packed_label_map", "select t.image_id, t.obj_idx, count(*) as area from tops t group by all", CELLS_SQL)
def s4b(s: Scene) -> DataFrame:
    maps = layers(s).select("image_id", rasters.label_map("masks").alias("labels"))
    each = maps.select("image_id", rasters.object_masks("labels").alias("found")).select("image_id", F.inline("found"))
    return each.select("image_id", "obj_idx", masks.sums("mask")["area"].alias("area"))


@scene_query("u9_mask_unions", f"select image_id, count(*) as area, sum(y * {GRID} + x)::bigint as offsets from tops group by image_id", CELLS_SQL)
def u9(s: Scene) -> DataFrame:
    whole = masks.union_of_groups(diamonds(s).select("image_id", "mask"), ["image_id"])
    return whole.select("image_id", masks.sums("mask").alias("s")).select("image_id", "s.*").where("area > 0")


_AREAS = "areas as (select image_id, obj_idx, count(c.x) as area from diamonds d left join cells c using (image_id, obj_idx) group by all)"


def _merged_sql(take: str) -> str:
    return f"""select s.image_id, s.obj_idx as region_id from (select * from areas where obj_idx % 2 = 1) s
    left join (select p.image_id, p.region_id, max(shared / a.area) as overlap, max(shared / (a.area + f.area - shared)) as iou from ({_PAIRS} where a.obj_idx % 2 = 0 and b.obj_idx % 2 = 1 group by all) p
      join areas a on a.image_id = p.image_id and a.obj_idx = p.region_id join areas f on f.image_id = p.image_id and f.obj_idx = p.first_id group by all) o on o.image_id = s.image_id and o.region_id = s.obj_idx
    left join (select image_id, quantile_cont(area, 0.5) as med from areas where obj_idx % 2 = 0 group by 1) m on m.image_id = s.image_id
    join (select image_id, quantile_cont(area, 0.75) as q from areas where obj_idx % 2 = 1 group by 1) q on q.image_id = s.image_id
    where coalesce(iou, 0) <= 0.7 and ({take})"""


for _mode, _take in enumerate(("free or medium or large", "free", "medium", "medium and free", "large and free")):
    _sql = _take.replace("free", "coalesce(overlap, 0) < 0.6").replace("medium", "s.area > coalesce(med, 0)").replace("large", "s.area > q.q")

    @scene_query(f"sg18c_merged_by_masks_{_mode}", _merged_sql(_sql), f"{CELLS_SQL}, {_AREAS}")
    def sg18c(s: Scene, mode=_mode) -> DataFrame:
        each = diamonds(s).select("image_id", "obj_idx", "mask")
        return parse.merged_by_masks(each.where("obj_idx % 2 = 0").withColumnRenamed("obj_idx", "first_id"), each.where("obj_idx % 2 = 1").withColumnRenamed("obj_idx", "region_id"), mode)


@scene_query("k5_mask_images", "select image_id, sum((30 + 20 * obj_idx) % 256)::bigint as grey, count(*) as painted from tops where (30 + 20 * obj_idx) % 256 > 0 group by image_id", CELLS_SQL)
def k5(s: Scene) -> DataFrame:
    @F.arrow_udf("struct<grey:long,painted:long>")
    def read_back(png: pa.Array) -> pa.Array:
        planes = [sinks.grey_of(p) for p in png.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([int(x.sum(dtype="int64")) for x in planes], pa.int64()), pa.array([int((x > 0).sum()) for x in planes], pa.int64())], names=["grey", "painted"])

    return sinks.mask_pngs(layers(s)).select("image_id", read_back("png").alias("p")).select("image_id", "p.*").where("painted > 0")


@scene_query("k5b_sparse_mask_lists", f"select image_id, obj_idx as mask_no, count(*) as area, sum(y * {GRID} + x)::bigint as offsets from cells group by all", CELLS_SQL)
def k5b(s: Scene) -> DataFrame:
    read = files.csr_masks(sinks.mask_csr_lists(layers(s)))
    return read.select("image_id", "mask_no", masks.sums("mask").alias("s")).select("image_id", "mask_no", "s.*").where("area > 0")


# Probes of packed maps


_PROBES = f"""{_PX}, v as (select vec_id as image_id, unnest(range(10)) as k from embeddings),
    places as (select image_id, k, floor({uniform_sql('depth_probes', 'image_id', '2 * k')} * 64)::int as a, floor({uniform_sql('depth_probes', 'image_id', '2 * k + 1')} * 64)::int as b from v),
    met as (select p.image_id, k, a.x, a.y, a.depth, b.x as x2, b.y as y2, b.depth as depth2 from places p join px a on a.image_id = p.image_id and a.y * 8 + a.x = p.a join px b on b.image_id = p.image_id and b.y * 8 + b.x = p.b),
    f as (select * from (select *, row_number() over (partition by image_id order by k) as r from met where abs(depth - depth2) >= 50) where r = 1)"""


@table_query("g14b_closer_probe", f"with {_PROBES} select image_id, case when depth > depth2 then x else x2 end::int as x, case when depth > depth2 then y else y2 end::int as y, case when depth > depth2 then x2 else x end::int as far_x, case when depth > depth2 then y2 else y end::int as far_y from f")
def g14b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.depth_probes(embedding_maps(spark, sf_dir)).select("image_id", "closer.x", "closer.y", F.col("farther.x").alias("far_x"), F.col("farther.y").alias("far_y"))


@table_query("g15b_farther_probe", f"with {_PROBES} select image_id, case when depth > depth2 then x2 else x end::int as x, case when depth > depth2 then y2 else y end::int as y from f")
def g15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.depth_probes(embedding_maps(spark, sf_dir), farther=True).select("image_id", "answer.x", "answer.y")


for _no, _name, _x, _y in ((20, "same_object_by_rank", "bx", "cy"), (21, "diff_object_by_rank", "dx", "dy")):

    @table_query(
        f"g{_no}b_{_name}",
        f"""with {_PX}, n as (select *, count(*) over (partition by image_id, obj_idx) as n, row_number() over (partition by image_id, obj_idx order by y, x) - 1 as r from px where obj_idx is not null),
        t as (select *, floor({uniform_sql('segment_points', 'image_id', 'obj_idx', '0')} * n)::int as first, floor({uniform_sql('segment_points', 'image_id', 'obj_idx', '1')} * (n - 1))::int as second from n where n > 1),
        o as (select image_id, obj_idx, max(x) filter (r = first) as ax, max(y) filter (r = first) as ay, max(x) filter (r = second + (second >= first)::int) as bx, max(y) filter (r = second + (second >= first)::int) as cy from t group by 1, 2),
        d as (select o.*, p.x as dx, p.y as dy, row_number() over (partition by o.image_id, o.obj_idx order by round(abs(sqrt((ax - p.x) ** 2 + (ay - p.y) ** 2) - sqrt((ax - bx) ** 2 + (ay - cy) ** 2)), 6), p.x, p.y) as r from o join px p on p.image_id = o.image_id and p.obj_idx is distinct from o.obj_idx)
        select image_id, obj_idx::int as obj_idx, ax::int as x, ay::int as y, {_x}::int as answer_x, {_y}::int as answer_y from d where r = 1""",
    )
    def g20b(spark: SparkSession, sf_dir: str, different=_no == 21) -> DataFrame:
        return single.segment_points(embedding_maps(spark, sf_dir), different, by_rank=True).select("image_id", "obj_idx", "anchor_point.x", "anchor_point.y", F.col("answer.x").alias("answer_x"), F.col("answer.y").alias("answer_y"))
