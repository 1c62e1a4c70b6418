"""The queries over the driver tables, each with the same question in DuckDB's SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.functions import boxes, draws, grammar, masks, rasters, words
from prismloom.operators import graph, metrics, multi, nearest, parse, records, single
from prismloom.plans.scene import SCENE_SQL, Scene, disjoint_sql, driver_scene
from prismloom.plans.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def scene_query(name: str, sql: str | None = None, more: str = ""):
    """Register a query of a Scene. sql is what follows the scene's CTEs; more are further CTEs."""

    def add(f: Callable[[Scene], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(driver_scene(spark, sf_dir))
        if sql:
            ORACLES[name] = f"with {SCENE_SQL}{',' + more if more else ''} {sql}"
        return f

    return add


def table_query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def joined(*columns: str) -> list:
    return [F.array_join(F.col(c).cast("array<string>"), "|").alias(c) for c in columns]


# The same draws in SQL.


def key_sql(op: str, *parts: str) -> str:
    return "md5(" + " || '|' || ".join([f"'{op}'", *[f"coalesce(cast({p} as varchar), '')" for p in parts]]) + ")"


def uniform_sql(op: str, *parts: str) -> str:
    return f"(cast('0x' || substr({key_sql(op, *parts)}, 1, 8) as bigint) / 4294967296.0)"


def pick_sql(values: str, op: str, *parts: str) -> str:
    return f"{values}[cast(floor({uniform_sql(op, *parts)} * len({values})) as int) + 1]"


def some_sql(values: str, n: int, op: str, *parts: str) -> str:
    return f"list_transform(list_sort(list_transform({values}, lambda x: {{'k': md5({key_sql(op, *parts)} || '|' || x), 'x': x}})), lambda s: s.x)[1:{n}]"


def ratio_sql(x: str) -> str:
    """A coordinate as a share of 1024 in text, as boxes.number_text writes it."""
    return f"regexp_replace(printf('%.2f', round_even({x} / 1024.0, 2)), '(\\.\\d)0$', '\\1')"


def box_sql(p: str) -> str:
    return "'(' || " + " || ', ' || ".join(ratio_sql(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")) + " || ')'"


CHOICES_SQL = "case when cnt = 1 then '1|2|3|4' else concat_ws('|', cnt, cnt - 1, cnt + 1, cnt + 2) end"

# Objects


@scene_query(
    "g1_exists_object",
    f"select image_id, case when cnt > 1 then label || 's' else label end as name, case when cnt > 1 then 'are' else 'is' end as be, cnt as answer, {CHOICES_SQL} as candidates from (select image_id, label, count(*) as cnt from countable_objects group by all)",
)
def g1(s: Scene) -> DataFrame:
    return single.exists_object(s).select("image_id", "name", "be", "answer", *joined("candidates"))


for _most in (True, False):
    _op, _best, _cmp, _tie = ("most_object", "max", "<", "cnt desc") if _most else ("least_object", "min", ">", "cnt")

    @scene_query(
        f"{'g2' if _most else 'g3'}_{_op}",
        f"""select image_id, answer, best, array_to_string(list_prepend(answer, {some_sql('others', 3, _op, 'image_id')}), '|') as candidates
        from (select image_id, answer, best, list_sort(list(label) filter (cnt {_cmp} best)) as others from
              (select *, {_best}(cnt) over (partition by image_id) as best, first_value(label) over (partition by image_id order by {_tie}, first_idx) as answer from counts) group by all)
        where len(others) > 0""",
        "counts as (select o.image_id, o.label, count(*) as cnt, min(o.obj_idx) as first_idx from countable_objects o join non_including n on n.image_id = o.image_id and n.obj_idx = o.obj_idx group by all)",
    )
    def g2(s: Scene, most=_most) -> DataFrame:
        return (single.most_object(s) if most else single.least_object(s)).select("image_id", "answer", "best", *joined("candidates"))


for _no, _side, _axis, _c, _sign in ((4, "left", "x", "x1", "<="), (5, "right", "x", "x2", ">="), (6, "top", "y", "y1", "<="), (7, "bottom", "y", "y2", ">=")):

    @scene_query(
        f"g{_no}_{_side}most",
        f"""select image_id, a_obj_idx, b_obj_idx, c_obj_idx, a_label || '|' || b_label || '|' || c_label as candidates,
        case when a_{_c} {_sign} b_{_c} and a_{_c} {_sign} c_{_c} then a_label when b_{_c} {_sign} c_{_c} then b_label else c_label end as answer from triples""",
        disjoint_sql(_axis),
    )
    def g4(s: Scene, side=_side) -> DataFrame:
        return single.outermost_object(s, side).select("image_id", "a_obj_idx", "b_obj_idx", "c_obj_idx", "answer", *joined("candidates"))


@scene_query("j3_disjoint_pairs", "select image_id, a_obj_idx, a_label, b_obj_idx, b_label from pairs", disjoint_sql("both"))
def j3(s: Scene) -> DataFrame:
    return s.disjoint_pairs().select("image_id", "a_obj_idx", "a_label", "b_obj_idx", "b_label")


@scene_query("j4_disjoint_triples", "select image_id, a_label, b_label, c_label from triples", disjoint_sql("both"))
def j4(s: Scene) -> DataFrame:
    return s.disjoint_triples().select("image_id", "a_label", "b_label", "c_label")


@scene_query("f4_non_including", "select image_id, obj_idx, label from non_including")
def f4(s: Scene) -> DataFrame:
    return s.non_including().select("image_id", "obj_idx", "label")


@scene_query(
    "f5_non_overlapping",
    "select image_id, obj_idx, label from non_including a where not exists (select 1 from non_including b where a.image_id = b.image_id and a.obj_idx <> b.obj_idx and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2)",
)
def f5(s: Scene) -> DataFrame:
    return s.non_overlapping().select("image_id", "obj_idx", "label")


@scene_query("f3_small_boxes", "select image_id, obj_idx from objects where (x2 - x1) * (y2 - y1) < 0.02 * 1024 * 1024")
def f3(s: Scene) -> DataFrame:
    return s.small(0.02).select("image_id", "obj_idx")


@scene_query("f6_attributed", "select image_id, obj_idx, attr as attributes from objects")
def f6(s: Scene) -> DataFrame:
    return s.objects.where(F.size("attributes") > 0).select("image_id", "obj_idx", *joined("attributes"))


@scene_query("f7_countable", "select o.label, coalesce(max(countable), 0) as countable, count(*) as n from objects o left join object_vocab v on v.object = o.label group by o.label")
def f7(s: Scene) -> DataFrame:
    known = s.objects.join(s.object_vocab, F.col("label") == F.col("object"), "left")
    return known.groupBy("label").agg(F.coalesce(F.max("countable"), F.lit(0)).alias("countable"), F.count(F.lit(1)).alias("n"))


@scene_query("p3_ratio_boxes", f"select image_id, obj_idx, {box_sql('')} as bbox from objects")
def p3(s: Scene) -> DataFrame:
    return s.objects.join(s.images, "image_id").select("image_id", "obj_idx", boxes.box_ratio_text("", F.col("width"), F.col("height")).alias("bbox"))


@scene_query("p10_box_text", "select image_id, obj_idx, '[' || concat_ws(', ', x1 * 1000 // 1024, y1 * 1000 // 1024, x2 * 1000 // 1024, y2 * 1000 // 1024) || ']' as bbox from objects")
def p10(s: Scene) -> DataFrame:
    return s.objects.join(s.images, "image_id").select("image_id", "obj_idx", boxes.box_thousandths("", F.col("width"), F.col("height")).alias("bbox"))


@scene_query(
    "p11_square_padded",
    """select image_id, obj_idx, x1 - dx // 2 as x1, y1 - dy // 2 as y1, x2 + dx - dx // 2 as x2, y2 + dy - dy // 2 as y2
    from (select *, greatest((y2 - y1) - (x2 - x1), 0) as dx, greatest((x2 - x1) - (y2 - y1), 0) as dy from objects)""",
)
def p11(s: Scene) -> DataFrame:
    return s.objects.select("image_id", "obj_idx", boxes.square_padded(*boxes.sides("")).alias("b")).select("image_id", "obj_idx", *[F.col(f"b.{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


# Attributes


@scene_query(
    "g8_exists_attribute",
    f"select image_id, attr || ' ' || label || case when cnt > 1 then 's' else '' end as name, case when cnt > 1 then 'are' else 'is' end as be, cnt as answer, {CHOICES_SQL} as candidates from (select image_id, attr, label, count(*) as cnt from objects group by all)",
)
def g8(s: Scene) -> DataFrame:
    return single.exists_attribute(s).select("image_id", "name", "be", "answer", *joined("candidates"))


@scene_query(
    "g9_attribute_of_box",
    f"""select image_id, obj_idx, label as name, {box_sql('')} as bbox, attr as answer,
    array_to_string(list_prepend(attr, {some_sql('others', 3, 'attribute_of_box', 'image_id', 'obj_idx')}), '|') as candidates
    from (select o.*, v.others from objects o join (select a.attribute, list(b.attribute) as others from attribute_vocab a join attribute_vocab b on a.attribute <> b.attribute group by 1) v on v.attribute = o.attr)""",
)
def g9(s: Scene) -> DataFrame:
    return single.attribute_of_box(s).select("image_id", "obj_idx", "name", "bbox", "answer", *joined("candidates"))


@scene_query(
    "g10_typed_attribute",
    f"""select image_id, obj_idx, category as attribute_type, label as name, {box_sql('')} as bbox, attr as answer,
    array_to_string(list_prepend(attr, {some_sql('others', 3, 'typed_attribute_of_box', 'image_id', 'obj_idx', 'category')}), '|') as candidates
    from (select o.*, v.category, v.others from objects o join (select a.attribute, a.category, list(b.attribute) as others from attribute_vocab a
          join attribute_vocab b on a.attribute <> b.attribute and a.category = b.category where a.category <> 'other' group by 1, 2) v on v.attribute = o.attr)""",
)
def g10(s: Scene) -> DataFrame:
    return single.typed_attribute_of_box(s).select("image_id", "obj_idx", "attribute_type", "name", "bbox", "answer", *joined("candidates"))


# Relations

def rels_sql(op: str) -> str:
    """One row with all relation names in the order drawn for op."""
    return f"rels as (select list(rel order by {key_sql(op + '|names', 'rel')}, rel) as vocab from (select distinct rel from relations))"


def others_sql(op: str, *parts: str) -> str:
    """The first 3 names of vocab that aren't in own, from a drawn place on and round to it."""
    start = f"cast(floor({uniform_sql(op + '|start', *parts)} * len(vocab)) as int)"
    return f"list_filter(list_concat(vocab[{start} + 1:], vocab[:{start}]), lambda v: not list_contains(own, v))[1:3]"


@scene_query(
    "g11_exists_relation",
    f"""select image_id, object1, object2, 'is' as be, {pick_sql('own', 'exists_relation', 'image_id', 'object1', 'object2')} as answer,
    array_to_string(list_prepend({pick_sql('own', 'exists_relation', 'image_id', 'object1', 'object2')}, {others_sql('exists_relation', 'image_id', 'object1', 'object2')}), '|') as candidates
    from (select image_id, head_label as object1, target_label as object2, list_sort(list(distinct rel)) as own from unique_edges group by 1, 2, 3), rels""",
    rels_sql("exists_relation"),
)
def g11(s: Scene) -> DataFrame:
    return single.exists_relation(s).select("image_id", "object1", "object2", "be", "answer", *joined("candidates"))


@scene_query(
    "g12_relation_of_boxes",
    f"""select image_id, head, target, bbox1, bbox2, {pick_sql('own', 'relation_of_boxes', 'image_id', 'head', 'target')} as answer,
    array_to_string(list_prepend({pick_sql('own', 'relation_of_boxes', 'image_id', 'head', 'target')}, {others_sql('relation_of_boxes', 'image_id', 'head', 'target')}), '|') as candidates
    from (select r.image_id, r.head, r.target, {box_sql('h.')} as bbox1, {box_sql('t.')} as bbox2, r.own, vocab
          from (select image_id, head, target, list_sort(list(rel)) as own from relations group by all) r
          join objects h on h.image_id = r.image_id and h.obj_idx = r.head join objects t on t.image_id = r.image_id and t.obj_idx = r.target, rels)""",
    rels_sql("relation_of_boxes"),
)
def g12(s: Scene) -> DataFrame:
    return single.relation_of_boxes(s).select("image_id", "head", "target", "bbox1", "bbox2", "answer", *joined("candidates"))


@scene_query(
    "g13_head_of_relation",
    f"""select image_id, object2, relation, answer, array_to_string(list_prepend(answer, {some_sql('others', 3, 'head_of_relation', 'image_id', 'object2', 'relation', 'answer')}), '|') as candidates
    from (select image_id, object2, relation, unnest(heads) as answer, others from
          (select h.*, list_filter(l.labels, lambda v: not list_contains(h.heads, v) and v <> h.object2) as others from
           (select image_id, target_label as object2, rel as relation, list_sort(list(distinct head_label)) as heads from edges group by 1, 2, 3) h
           join (select image_id, list_sort(list(distinct label)) as labels from objects group by 1) l using (image_id)) where len(others) > 0)""",
)
def g13(s: Scene) -> DataFrame:
    return single.head_of_relation(s).select("image_id", "object2", "relation", "answer", *joined("candidates"))


@scene_query("p2_relations", "select image_id, head, rel, target from relations where rel <> 'of'")
def p2(s: Scene) -> DataFrame:
    return s.relations.where("rel <> 'of'").select("image_id", "head", "rel", "target")


@scene_query("j2_edges", "select image_id, head_label, rel, target_label, count(*) as n from edges group by all")
def j2(s: Scene) -> DataFrame:
    return s.edges().groupBy("image_id", "head_label", "rel", "target_label").agg(F.count(F.lit(1)).alias("n"))


# Indexes over images


@scene_query("a1_label_histogram", "select image_id, label, count(*) as cnt, min(obj_idx) as first_idx from objects group by all")
def a1(s: Scene) -> DataFrame:
    return s.label_counts()


@scene_query("a7_object_index", "select label, count(*) as n_images, sum(cnt)::bigint as n_objects from (select label, image_id, count(*) as cnt from objects group by all) group by label")
def a7(s: Scene) -> DataFrame:
    return s.object_index().groupBy("label").agg(F.count(F.lit(1)).alias("n_images"), F.sum("cnt").alias("n_objects"))


@scene_query("a8_frequent_objects", "select label, count(distinct image_id) as n from objects group by label having count(distinct image_id) >= 2")
def a8(s: Scene) -> DataFrame:
    return s.object_index().groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@scene_query("a9_images_by_count", "select label, cnt, count(*) as n_images from (select label, image_id, count(*) as cnt from objects group by all) group by all")
def a9(s: Scene) -> DataFrame:
    return s.object_index().groupBy("label", "cnt").agg(F.count(F.lit(1)).alias("n_images"))


@scene_query("a10_relation_index", "select head_label, rel, target_label, count(distinct image_id) as n_images from edges group by all")
def a10(s: Scene) -> DataFrame:
    return s.relation_index().groupBy("head_label", "rel", "target_label").agg(F.count(F.lit(1)).alias("n_images"))


@scene_query("a11_frequent_pairs", "select head_label, target_label, count(distinct image_id) as n_images from edges group by all having count(distinct image_id) >= 2")
def a11(s: Scene) -> DataFrame:
    return s.relation_index().groupBy("head_label", "target_label").agg(F.count_distinct("image_id").alias("n_images")).where("n_images >= 2")


@scene_query("j6_images_with", "select image_id from images where image_id in (select image_id from objects where label = 'gear')")
def j6(s: Scene) -> DataFrame:
    return s.images.select("image_id").join(s.objects.where("label = 'gear'").select("image_id"), "image_id", "left_semi")


@scene_query("j7_images_without", "select image_id from images where image_id not in (select image_id from objects where label = 'gear')")
def j7(s: Scene) -> DataFrame:
    return s.images.select("image_id").join(s.objects.where("label = 'gear'").select("image_id"), "image_id", "left_anti")


@scene_query(
    "j8_pairs_without_relation",
    """select i.head_label, i.target_label, n.rel, count(*) as n_images from (select distinct head_label, target_label, image_id from edges) i
    join (select distinct head_label, target_label, rel from edges) n using (head_label, target_label)
    where not exists (select 1 from edges e where e.image_id = i.image_id and e.head_label = i.head_label and e.target_label = i.target_label and e.rel = n.rel) group by all""",
)
def j8(s: Scene) -> DataFrame:
    """Images of a label pair, less those that show it with the relation: counts say how many lack it."""
    index, pair = s.relation_index(), ["head_label", "target_label"]
    shown = index.groupBy(*pair, "rel").agg(F.count(F.lit(1)).alias("n_with"))
    images = index.select(*pair, "image_id").distinct().groupBy(*pair).agg(F.count(F.lit(1)).alias("n_all"))
    return shown.join(images, pair).where("n_all > n_with").select(*pair, "rel", (F.col("n_all") - F.col("n_with")).alias("n_images"))


@scene_query(
    "a12_metadata_counts",
    "select 'object' as kind, label as value, count(*) as cnt from objects group by label union all select 'attribute', attr, count(*) from objects group by attr union all select 'relation', rel, count(*) from relations group by rel",
)
def a12(s: Scene) -> DataFrame:
    objects = records.metadata_counts(s.objects, {"object": F.array("label"), "attribute": F.col("attributes")})
    return objects.unionByName(records.metadata_counts(s.relations, {"relation": F.array("rel")}))


@scene_query(
    "a19_repeated_objects",
    "select image_id, obj_idx, label, cast(row_number() over (partition by image_id, label, attr order by obj_idx) as int) as no from (select *, count(*) over (partition by image_id, label, attr) as n from objects) where n > 1",
)
def a19(s: Scene) -> DataFrame:
    alike = Window.partitionBy("image_id", "label", F.array_join("attributes", ","))
    return s.objects.withColumn("n", F.count(F.lit(1)).over(alike)).where("n > 1").select("image_id", "obj_idx", "label", F.row_number().over(alike.orderBy("obj_idx")).alias("no"))


# Several images


def pairs_sql(source: str, by: list[str], op: str, carry: list[str]) -> str:
    """Successive images of a group in drawn order, as multi.neighbours."""
    order = f"over ({'partition by ' + ', '.join(by) if by else ''} order by {key_sql(op, *by, 'image_id')}, image_id)"
    cols = ", ".join(f"{c} as {c}_0, lead({c}) {order} as {c}_1" for c in ("image_id", *carry))
    return f"(select * from (select {', '.join([*by, cols])} from {source}) where image_id_1 is not null)"


CONTENTS_SQL = "contents as (select image_id, list_sort(list(distinct label)) as labels from objects group by image_id)"
ATTRIBUTES_SQL = "owned as (select label, image_id, list_sort(list(distinct attr)) as attributes, count(*) as cnt from objects group by all)"
COUNTED_SQL = "counted as (select label, image_id, count(*) as cnt from countable_objects group by all)"
ONLY_SQL = "list_sort(list_concat(list_filter(attributes_0, lambda v: not list_contains(attributes_1, v)), list_filter(attributes_1, lambda v: not list_contains(attributes_0, v))))"
ONLY_LABELS_SQL = ONLY_SQL.replace("attributes_", "labels_")


@scene_query(
    "m1_has_object",
    f"""select image_id_0, image_id_1, object, case when list_contains(labels_0, object) then 0 else 1 end as answer
    from (select *, {pick_sql('only_one', 'has_object', 'image_id_0', 'image_id_1')} as object from (select *, {ONLY_LABELS_SQL} as only_one from {pairs_sql('contents', [], 'has_object', ['labels'])}) where len(only_one) > 0)""",
    CONTENTS_SQL,
)
def m1(s: Scene) -> DataFrame:
    return multi.has_object(s)


for _no, _name, _negated in ((2, "has_attributed_object", False), (4, "has_not_attributed_object", True)):

    @scene_query(
        f"m{_no}_{_name}",
        f"""select object, attribute, image_id_0, image_id_1, case when list_contains(attributes_0, attribute) then {int(_negated)} else {1 - int(_negated)} end as answer
        from (select *, label as object, {pick_sql('only_one', _name, 'label', 'image_id_0', 'image_id_1')} as attribute from (select *, {ONLY_SQL} as only_one from {pairs_sql('owned', ['label'], _name, ['attributes'])}) where len(only_one) > 0)""",
        ATTRIBUTES_SQL,
    )
    def m2(s: Scene, negated=_negated) -> DataFrame:
        return multi.has_attributed_object(s, negated=negated)


def place_sql(source: str, by: list[str], op: str, side: str, drawn_by: list[str] | None = None) -> str:
    drawn = key_sql(op + "|" + side, *(by if drawn_by is None else drawn_by), "image_id")
    return f"(select {', '.join(by)}, image_id as {side}, row_number() over (partition by {', '.join(by)} order by {drawn}, image_id) as no from {source})"


@scene_query(
    "m3_has_not_object",
    f"select label as object, with_id, without_id from {place_sql('having_it', ['label'], 'has_not_object', 'with_id')} join {place_sql('lacking_it', ['label'], 'has_not_object', 'without_id', [])} using (label, no)",
    """having_it as (select distinct label, image_id from objects),
    lacking_it as (select v.object as label, i.image_id from images i, object_vocab v where not exists (select 1 from having_it h where h.label = v.object and h.image_id = i.image_id))""",
)
def m3(s: Scene) -> DataFrame:
    return multi.has_not_object(s)


for _no, _negated in ((5, False), (6, True)):
    _op = "has_not_relation" if _negated else "has_relation"

    @scene_query(
        f"m{_no}_{_op}",
        f"""select head_label as object1, rel as relation, target_label as object2, with_id, without_id, {str(_negated).lower()} as negated
        from {place_sql('having_it', ['head_label', 'target_label', 'rel'], _op, 'with_id')} join {place_sql('lacking_it', ['head_label', 'target_label', 'rel'], _op, 'without_id', ['head_label', 'target_label'])} using (head_label, target_label, rel, no)""",
        """having_it as (select distinct head_label, target_label, rel, image_id from edges),
        lacking_it as (select i.head_label, i.target_label, n.rel, i.image_id from (select distinct head_label, target_label, image_id from edges) i join (select distinct head_label, target_label, rel from edges) n using (head_label, target_label)
                       where not exists (select 1 from having_it h where h.head_label = i.head_label and h.target_label = i.target_label and h.rel = n.rel and h.image_id = i.image_id))""",
    )
    def m5(s: Scene, negated=_negated) -> DataFrame:
        return multi.has_relation(s, negated=negated)


for _no, _least in ((7, False), (8, True)):
    _op = "has_least_object" if _least else "has_most_object"

    @scene_query(
        f"m{_no}_{_op}",
        f"select label as object, image_id_0, image_id_1, cnt_0, cnt_1, case when cnt_0 {'<' if _least else '>'} cnt_1 then 0 else 1 end as answer from {pairs_sql('counted', ['label'], _op, ['cnt'])} where cnt_0 <> cnt_1",
        COUNTED_SQL,
    )
    def m7(s: Scene, least=_least) -> DataFrame:
        return multi.has_most_object(s, least=least)


@scene_query(
    "m9_count_object",
    f"select label as object, image_id_0, image_id_1, cnt as answer, {CHOICES_SQL} as candidates from (select *, cnt_0 + cnt_1 as cnt from {pairs_sql('counted', ['label'], 'count_object', ['cnt'])})",
    COUNTED_SQL,
)
def m9(s: Scene) -> DataFrame:
    return multi.count_object(s).select("object", "image_id_0", "image_id_1", "answer", *joined("candidates"))


@scene_query(
    "m10_count_attribute_object",
    f"select label as object, attr as attribute, image_id_0, image_id_1, cnt as answer, {CHOICES_SQL} as candidates from (select *, cnt_0 + cnt_1 as cnt from {pairs_sql('each_kind', ['label', 'attr'], 'count_attribute_object', ['cnt'])}) where cnt > 1",
    "each_kind as (select label, attr, image_id, count(*) as cnt from countable_objects group by all)",
)
def m10(s: Scene) -> DataFrame:
    return multi.count_attribute_object(s).select("object", "attribute", "image_id_0", "image_id_1", "answer", *joined("candidates"))


_SHARED = "array_to_string(list_filter({0}_0, lambda v: list_contains({0}_1, v)), '|') as answer"


@scene_query(
    "m11_common_object",
    f"select * from (select image_id_0, image_id_1, {_SHARED.format('labels')}, array_to_string({ONLY_LABELS_SQL}, '|') as distractors from {pairs_sql('contents', [], 'common_object', ['labels'])}) where answer <> '' and distractors <> ''",
    CONTENTS_SQL,
)
def m11(s: Scene) -> DataFrame:
    return multi.common_object(s).select("image_id_0", "image_id_1", *joined("answer", "distractors"))


@scene_query(
    "m12_common_attribute",
    f"select * from (select label as object, image_id_0, image_id_1, {_SHARED.format('attributes')}, array_to_string({ONLY_SQL}, '|') as distractors from {pairs_sql('owned', ['label'], 'common_attribute', ['attributes'])}) where answer <> '' and distractors <> ''",
    ATTRIBUTES_SQL,
)
def m12(s: Scene) -> DataFrame:
    return multi.common_attribute(s).select("object", "image_id_0", "image_id_1", *joined("answer", "distractors"))


@scene_query(
    "m13_compare_attribute",
    f"""select label as object, image_id_0, image_id_1, label || ' is ' || attributes_0[1] || ' in Image 0, ' || attributes_1[1] || ' in Image 1.' as answer,
    label || ' is ' || attributes_1[1] || ' in Image 0, ' || attributes_0[1] || ' in Image 1.' as distractor from {pairs_sql('lone', ['label'], 'compare_attribute', ['attributes'])} where attributes_0 <> attributes_1""",
    f"{ATTRIBUTES_SQL}, lone as (select * from owned where cnt = 1)",
)
def m13(s: Scene) -> DataFrame:
    return multi.compare_attribute(s)


_ANDED = "case len({0}) when 1 then {0}[1] when 2 then {0}[1] || ' and ' || {0}[2] else array_to_string({0}[1:len({0}) - 1], ', ') || ', and ' || {0}[len({0})] end"


@scene_query(
    "m14_compare_relation",
    f"""select head_label as object1, target_label as object2, image_id_0, image_id_1,
    head_label || ' is ' || {_ANDED.format('rels_0')} || ' ' || target_label || ' in Image 0, ' || {_ANDED.format('rels_1')} || ' ' || target_label || ' in Image 1.' as answer,
    head_label || ' is ' || {_ANDED.format('rels_1')} || ' ' || target_label || ' in Image 0, ' || {_ANDED.format('rels_0')} || ' ' || target_label || ' in Image 1.' as distractor
    from {pairs_sql('own_rels', ['head_label', 'target_label'], 'compare_relation', ['rels'])} where rels_0 <> rels_1""",
    "own_rels as (select head_label, target_label, image_id, list_sort(list(distinct rel)) as rels from unique_edges group by 1, 2, 3)",
)
def m14(s: Scene) -> DataFrame:
    return multi.compare_relation(s)


# Records


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ExistsObject from scene to instruction record."""
    s = driver_scene(spark, sf_dir)
    keys = ["image_id", "label"]
    asked = single.exists_object(s)
    slots = {"name": F.col("name"), "count": F.col("answer").cast("string")}
    q = records.with_template(asked, grammar.templates(spark), "ExistsObject", slots, keys)
    return records.conversation(q, "ExistsObject", keys, F.array(F.col("image_id").cast("string")))


QUERIES["k1_exists_object_records"] = flagship


@table_query("t1_templates")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.templates(spark).groupBy("generator").agg(F.count(F.lit(1)).alias("n"))


@scene_query(
    "t5_multiple_choice",
    f"""select image_id, a_obj_idx, b_obj_idx, c_obj_idx, 'Which object is on the left?' || lead || array_to_string(opts, ', ') as prompt, opts[list_position(mixed, answer)] as response
    from (select *, list_transform(mixed, lambda x, i: case when style = 0 then chr((64 + i)::int) || '. ' || x else '(' || chr((64 + i)::int) || ') ' || x end) as opts
      from (select *, {some_sql('candidates', 3, 'left|order', 'image_id', 'a_obj_idx', 'b_obj_idx', 'c_obj_idx')} as mixed, floor({uniform_sql('left|style', 'image_id', 'a_obj_idx', 'b_obj_idx', 'c_obj_idx')} * 2) as style,
            {pick_sql('leads', 'left|lead', 'image_id', 'a_obj_idx', 'b_obj_idx', 'c_obj_idx')} as lead
        from (select *, [a_label, b_label, c_label] as candidates, case when a_x1 <= b_x1 and a_x1 <= c_x1 then a_label when b_x1 <= c_x1 then b_label else c_label end as answer,
              list_concat(list_transform(ws, lambda w: chr(10) || w), list_transform(ws, lambda w: ' ' || w)) as leads
              from triples, (select ['', 'Choices: ', 'Options: ', 'Selections: ', 'Pick from: ', 'Select from: ', 'Choose from: '] as ws))))""",
    disjoint_sql("x"),
)
def t5(s: Scene) -> DataFrame:
    keys = ["image_id", "a_obj_idx", "b_obj_idx", "c_obj_idx"]
    asked = single.outermost_object(s, "left").withColumn("prompt", F.lit("Which object is on the left?")).withColumn("response", F.col("answer"))
    return records.multiple_choice(asked, "left", keys).select(*keys, "prompt", "response")


@scene_query(
    "t8_descriptions",
    "select image_id, 'Among ' || a_label || ', ' || b_label || ', and ' || c_label || ', ' || case when a_x1 <= b_x1 and a_x1 <= c_x1 then a_label when b_x1 <= c_x1 then b_label else c_label end || ' is on the most left side.' as description from triples",
    disjoint_sql("x"),
)
def t8(s: Scene) -> DataFrame:
    asked = single.outermost_object(s, "left")
    return records.described(asked, grammar.DESCRIPTIONS["LeftMostObject"], {"candidates": words.and_list(F.col("candidates")), "name": F.col("answer")}).select("image_id", "description")


@scene_query("k2_multi_image_records")
def k2(s: Scene) -> DataFrame:
    keys = ["object", "image_id_0", "image_id_1"]
    asked = multi.has_most_object(s).withColumn("answer", F.concat(F.lit("Image "), F.col("answer").cast("string")))
    q = records.with_template(asked, grammar.templates(s.objects.sparkSession), "HasMostObject", {"object": words.plural(F.col("object")), "answer": F.col("answer")}, keys)
    return records.conversation(q, "HasMostObject", keys, F.array(F.col("image_id_0").cast("string"), F.col("image_id_1").cast("string")))


@scene_query("u1_union_of_generators", "select 'left' as generator, answer, count(*) as n from (select case when a_x1 <= b_x1 and a_x1 <= c_x1 then a_label when b_x1 <= c_x1 then b_label else c_label end as answer from triples) group by all union all select 'exists', label, count(*) from (select distinct image_id, label from countable_objects) group by all", disjoint_sql("x"))
def u1(s: Scene) -> DataFrame:
    parts = {"left": single.outermost_object(s, "left").select("answer"), "exists": single.exists_object(s).select(F.col("label").alias("answer"))}
    return records.union_all(parts).groupBy("generator", "answer").agg(F.count(F.lit(1)).alias("n"))


@scene_query(
    "w3_weighted_sample",
    f"""select image_id, label from (select *, row_number() over (partition by image_id order by -ln(greatest({uniform_sql('weighted', 'image_id', 'label')}, 1e-12)) / weight, label) as place
    from (select d.image_id, d.label, 1 / pow(c.cnt::double, 3) as weight from (select distinct image_id, label from objects) d join (select label, count(*) as cnt from objects group by 1) c using (label))) where place = 1""",
)
def w3(s: Scene) -> DataFrame:
    asked = s.label_counts().select("image_id", "label")
    counts = records.metadata_counts(s.objects, {"object": F.array("label")})
    weighted = records.rarity_weight(asked.withColumn("values", F.array("label")), counts, ["image_id", "label"], "values")
    return draws.sample_groups(weighted, ["image_id"], 1, "weighted", ["label"], F.col("weight")).select("image_id", "label")


@scene_query("w4_uniform_sample", f"select image_id, obj_idx from (select *, row_number() over (partition by image_id order by {key_sql('uniform', 'image_id', 'obj_idx')}, obj_idx) as place from objects) where place <= 2")
def w4(s: Scene) -> DataFrame:
    return draws.sample_groups(s.objects, ["image_id"], 2, "uniform", ["obj_idx"]).select("image_id", "obj_idx")


@scene_query(
    "w6_exact_sample",
    f"select image_id, obj_idx from (select *, row_number() over (partition by image_id order by {key_sql('exact', 'image_id', 'obj_idx')}, obj_idx) as place, count(*) over (partition by image_id) as n from objects) where place <= 3 and n >= 3",
)
def w6(s: Scene) -> DataFrame:
    return draws.sample_groups(s.objects, ["image_id"], 3, "exact", ["obj_idx"], exactly=True).select("image_id", "obj_idx")


@scene_query("w7_limited_sample", f"select image_id, obj_idx, label from objects order by {key_sql('limited', 'image_id', 'obj_idx')}, image_id, obj_idx limit 100")
def w7(s: Scene) -> DataFrame:
    return draws.sample_rows(s.objects, 100, "limited", ["image_id", "obj_idx"]).select("image_id", "obj_idx", "label")


@scene_query("w10_largest_regions", "select image_id, obj_idx from (select *, row_number() over (partition by image_id order by (x2 - x1) * (y2 - y1) desc, obj_idx) as place from objects) where place <= 2")
def w10(s: Scene) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(boxes.area("").desc(), "obj_idx"))
    return s.objects.withColumn("place", place).where("place <= 2").select("image_id", "obj_idx")


@scene_query("w17_shard", "select image_id from images where image_id % 4 = 1")
def w17(s: Scene) -> DataFrame:
    return records.sharded(s.images, "image_id", 4, 1).select("image_id")


@scene_query("w15_dense_ids", "select count(*) as n, min(id) as least, max(id) as most, count(distinct id) as n_distinct from (select row_number() over () - 1 as id from images)")
def w15(s: Scene) -> DataFrame:
    return records.numbered(s.images, ["image_id"]).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.count_distinct("id").alias("n_distinct"))


# Graphs

COMPONENTS_SQL = """both_ways as (select image_id, head as a, target as b from relations union select image_id, target, head from relations),
reach as (select o.image_id, o.obj_idx, min(x.obj_idx) as component from objects o join objects x using (image_id) where x.obj_idx <= o.obj_idx
          and not exists (select 1 from range(0, 100) k(i) where k.i > x.obj_idx and k.i <= o.obj_idx
                          and not exists (select 1 from both_ways w where w.image_id = o.image_id and w.a = k.i - 1 and w.b = k.i)) group by all)"""


@scene_query("sg3_components", "select image_id, obj_idx, component from reach", COMPONENTS_SQL)
def sg3(s: Scene) -> DataFrame:
    return graph.components(s)


@scene_query("sg2_single_edges", f"select image_id, head, rel, target from (select *, row_number() over (partition by image_id, least(head, target), greatest(head, target) order by {key_sql('single_edges', 'image_id', 'head', 'rel', 'target')}, head, rel) as no from relations) where no = 1")
def sg2(s: Scene) -> DataFrame:
    return graph.single_edges(s).select("image_id", "head", "rel", "target")


@scene_query("sg5_adjacency", "select image_id, head as obj_idx, target as other, rel, 0 as direction from relations union all select image_id, target, head, rel, 1 from relations")
def sg5(s: Scene) -> DataFrame:
    return graph.adjacency(s)


REFERENCES_SQL = """near_by as (select distinct image_id, obj_idx, other, rel, direction from (select image_id, head as obj_idx, target as other, rel, 0 as direction from relations union all select image_id, target, head, rel, 1 from relations)),
refs as (select n.image_id, n.obj_idx, n.other, o.label, o.attr, x.label as other_name, x.attr as other_attr, n.rel, n.direction,
         case when n.direction = 0 then 'is ' || n.rel || ' the ' || x.attr || ' ' || x.label else 'the ' || x.attr || ' ' || x.label || ' is ' || n.rel end as clause
         from near_by n join objects o on o.image_id = n.image_id and o.obj_idx = n.obj_idx join objects x on x.image_id = n.image_id and x.obj_idx = n.other)"""


@scene_query(
    "g23_object_questions",
    "select image_id, component, 'What is the ' || attr || ' object that ' || clause || '?' as prompt, array_to_string(list_sort(list(distinct label)), '|') as answers from refs join reach using (image_id, obj_idx) group by image_id, component, attr, clause",
    f"{COMPONENTS_SQL}, {REFERENCES_SQL}",
)
def g23(s: Scene) -> DataFrame:
    return graph.object_questions(s).select("image_id", "component", "prompt", *joined("answers"))


@scene_query("g24_attribute_questions")
def g24(s: Scene) -> DataFrame:
    return graph.attribute_questions(s, size=2).select("image_id", "component", "category", "prompt", *joined("answers"))


@scene_query(
    "g25_relation_questions",
    """select distinct r.image_id, r.head, r.target, 'What is the relation from the ' || a.attr || ' object, which ' || a.clause || ', to the ' || b.attr || ' object, which ' || b.clause || '?' as prompt, array_to_string(r.rels, '|') as answers
    from (select image_id, head, target, list_sort(list(distinct rel)) as rels from relations group by 1, 2, 3) r join alone a on a.image_id = r.image_id and a.obj_idx = r.head and a.other <> r.target join alone b on b.image_id = r.image_id and b.obj_idx = r.target and b.other <> r.head""",
    f"{COMPONENTS_SQL}, {REFERENCES_SQL}, alone as (select * from (select *, count(distinct obj_idx) over (partition by image_id, component, attr, clause) as n from refs join reach using (image_id, obj_idx)) where n = 1)",
)
def g25(s: Scene) -> DataFrame:
    return graph.relation_questions(s).select("image_id", "head", "target", "prompt", *joined("answers"))


@scene_query("g22_captions")
def g22(s: Scene) -> DataFrame:
    return graph.image_captions(s)


@scene_query("p8_graph_json")
def p8(s: Scene) -> DataFrame:
    return graph.as_json(s)


# Text

LINES_SQL = """rel_lines as (select image_id, head, 'region' || (head + 1) || ': ' || string_agg('region' || (target + 1) || ' ' || rel, ', ' order by target, rel) as line from relations group by image_id, head),
obj_lines as (select image_id, string_agg('region' || (obj_idx + 1) || ': ' || label || ' is ' || attr, chr(10) order by obj_idx) as block from objects group by image_id)"""


@scene_query(
    "sg15_graph_texts",
    "select o.image_id, 'Objects:' || chr(10) || o.block || chr(10) || coalesce(chr(10) || 'Relations:' || chr(10) || r.block || chr(10), '') as text from obj_lines o left join (select image_id, string_agg(line, chr(10) order by head) as block from rel_lines group by 1) r using (image_id)",
    LINES_SQL,
)
def sg15(s: Scene) -> DataFrame:
    return parse.graph_texts(s)


@scene_query("sg8_holistic_triples", "select distinct image_id, head, rel, target from relations")
def sg8(s: Scene) -> DataFrame:
    return parse.holistic_triples(parse.graph_texts(s))


@scene_query("sg13_triples_by_target", "select image_id, head, rel, target from relations")
def sg13(s: Scene) -> DataFrame:
    texts = parse.graph_texts(s).select("image_id", F.regexp_extract("text", r"(?s)Relations:\n(.*)$", 1).alias("text"))
    return parse.triples_by_target(texts)


@scene_query("sg12_triples_by_relation", "select distinct image_id, head, rel, target from relations")
def sg12(s: Scene) -> DataFrame:
    each = s.relations.distinct().groupBy("image_id", "head", "rel").agg(F.sort_array(F.collect_list("target")).alias("t"))
    part = F.concat("rel", F.lit(": "), F.array_join(F.transform("t", lambda x: F.concat(F.lit("region"), (x + 1).cast("string"))), ", "))
    lines = each.groupBy("image_id", "head").agg(F.array_join(F.sort_array(F.collect_list(part)), "; ").alias("parts")).select("image_id", F.concat(F.lit("region"), (F.col("head") + 1).cast("string"), F.lit(": "), "parts").alias("line"))
    return parse.triples_by_relation(lines.groupBy("image_id").agg(F.array_join(F.collect_list("line"), "\n").alias("text")))


@scene_query("sg14_object_lines", "select image_id, obj_idx, label, attr as attributes from objects")
def sg14(s: Scene) -> DataFrame:
    return parse.object_lines(parse.graph_texts(s)).select("image_id", "obj_idx", "label", *joined("attributes"))


@scene_query(
    "sg17_edited",
    "select image_id, head, rel, target from (select image_id, head, rel, target from relations union select image_id, target, 'beside', head from relations where rel = 'near') where not (rel = 'NO')",
)
def sg17(s: Scene) -> DataFrame:
    adds = s.relations.where("rel = 'near'").select("image_id", F.col("target").alias("head"), F.lit("beside").alias("rel"), F.col("head").alias("target"), F.lit("add").alias("op"))
    removes = s.relations.where("rel = 'NO'").select("image_id", "head", "rel", "target", F.lit("remove").alias("op"))
    names = s.objects.select("image_id", "obj_idx", "label")
    return parse.edited(s.relations, names, adds.unionByName(removes), names.limit(0).withColumnRenamed("label", "name"))[0]


REGIONS_SQL = "first_regions as (select * from objects where obj_idx % 2 = 0), second_regions as (select * from objects where obj_idx % 2 = 1)"


@scene_query(
    "sg18_merged_regions",
    """select m.image_id, m.region_id from (select s.image_id, s.obj_idx as region_id, any_value((s.x2 - s.x1) * (s.y2 - s.y1)) as area,
      max(coalesce(inter / ((s.x2 - s.x1) * (s.y2 - s.y1)), 0)) as overlap, max(coalesce(inter / ((s.x2 - s.x1) * (s.y2 - s.y1) + f_area - inter), 0)) as iou
      from second_regions s left join lateral (select f.image_id, greatest(least(f.x2, s.x2) - greatest(f.x1, s.x1), 0) * greatest(least(f.y2, s.y2) - greatest(f.y1, s.y1), 0)::double as inter, (f.x2 - f.x1) * (f.y2 - f.y1) as f_area
        from first_regions f where f.image_id = s.image_id) on true group by all) m
    left join (select image_id, quantile_cont((x2 - x1) * (y2 - y1), 0.5) as med from first_regions group by 1) f using (image_id)
    join (select image_id, quantile_cont((x2 - x1) * (y2 - y1), 0.75) as q from second_regions group by 1) q using (image_id)
    where m.iou <= 0.7 and (m.overlap < 0.6 or m.area > coalesce(med, 0) or m.area > q.q)""",
    REGIONS_SQL,
)
def sg18(s: Scene) -> DataFrame:
    second = s.objects.where("obj_idx % 2 = 1").withColumnRenamed("obj_idx", "region_id")
    return parse.merged_regions(s.objects.where("obj_idx % 2 = 0"), second, 0)


@scene_query("p13_proposed_boxes", "select image_id, obj_idx, (x1 * 1000 // 1024) * 1024 // 1000 as x1, (y1 * 1000 // 1024) * 1024 // 1000 as y1 from objects")
def p13(s: Scene) -> DataFrame:
    texts = s.objects.join(s.images, "image_id").select("image_id", "obj_idx", "width", "height", F.concat(F.lit("a ["), boxes.box_thousandths("", F.col("width"), F.col("height")), F.lit("] b")).alias("text"))
    found = parse.proposed_boxes(texts.withColumn("image_id", F.struct("image_id", "obj_idx")))
    return found.select("image_id.image_id", "image_id.obj_idx", "x1", "y1")


@scene_query("sg19_shuffled_regions", f"select r.image_id, h.n as head, r.rel, t.n as target from relations r join moved h on h.image_id = r.image_id and h.obj_idx = r.head join moved t on t.image_id = r.image_id and t.obj_idx = r.target", f"moved as (select image_id, obj_idx, cast(row_number() over (partition by image_id order by {key_sql('shuffle', 'image_id', 'obj_idx')}, obj_idx) - 1 as int) as n from objects)")
def sg19(s: Scene) -> DataFrame:
    return records.shuffled_regions(s.objects, s.relations, "shuffle")[1]


@scene_query("p6_subset", "select r.image_id, h.n as head, r.rel, t.n as target from relations r join kept h on h.image_id = r.image_id and h.obj_idx = r.head join kept t on t.image_id = r.image_id and t.obj_idx = r.target", "kept as (select image_id, obj_idx, cast(row_number() over (partition by image_id order by obj_idx) - 1 as int) as n from countable_objects)")
def p6(s: Scene) -> DataFrame:
    return records.subset(s.objects, s.relations, s.countable().select("image_id", "obj_idx"))[1]


@scene_query("d6_category_turns", "select image_id, head, category, string_agg('region' || (target + 1) || ' ' || rel, ', ' order by target, rel) as response from (select distinct image_id, head, case when rel = 'near' then 'spatial' else 'other' end as category, rel, target from relations) group by all")
def d6(s: Scene) -> DataFrame:
    return records.category_turns(s.relations, F.when(F.col("rel") == "near", "spatial").otherwise("other"))


@scene_query("d12_region_list", "select image_id, 'There are ' || n || ' regions: ' || (select string_agg('region' || i, ', ' order by i) from range(1, n + 1) t(i)) || '.' as text from (select image_id, count(*) as n from objects group by 1)")
def d12(s: Scene) -> DataFrame:
    return records.region_list(s.objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "n").select("image_id", "text")


# Evaluation: the scene's edges are the truth; predictions move some boxes and change some relations.

PREDICTED_SQL = """truth as (select r.image_id, r.head, r.target, h.label as subject, r.rel, t.label as object, h.x1 as s1, h.y1 as s2, h.x2 as s3, h.y2 as s4, t.x1 as o1, t.y1 as o2, t.x2 as o3, t.y2 as o4, h.det_score as score
  from relations r join objects h on h.image_id = r.image_id and h.obj_idx = r.head join objects t on t.image_id = r.image_id and t.obj_idx = r.target),
predicted as (select image_id, head, target, subject, case when (image_id + head) % 5 = 0 then 'near' else rel end as rel, object, s1 + d as s1, s2, s3 + d as s3, s4, o1 + d as o1, o2, o3 + d as o3, o4, score from (select *, cast((image_id % 7) * 8 as int) as d from truth))"""


def _edges_with_boxes(s: Scene, moved: bool) -> DataFrame:
    ends = lambda p, key: s.objects.select("image_id", F.col("obj_idx").alias(key), F.col("label").alias({"s": "subject", "o": "object"}[p]), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")], *([F.col("det_score").alias("score")] if p == "s" else []))
    edges = s.relations.join(ends("s", "head"), ["image_id", "head"]).join(ends("o", "target"), ["image_id", "target"])
    if not moved:
        return edges
    shift = (F.pmod("image_id", F.lit(7)) * 8).cast("int")
    for c in ("s_x1", "s_x2", "o_x1", "o_x2"):
        edges = edges.withColumn(c, F.col(c) + shift)
    return edges.withColumn("rel", F.when(F.pmod(F.col("image_id") + F.col("head"), F.lit(5)) == 0, "near").otherwise(F.col("rel")))


def iou_sql(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    inter = f"(greatest(least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}), 0) * greatest(least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}), 0))"
    return f"({inter} / (({a[2]} - {a[0]}) * ({a[3]} - {a[1]}) + ({b[2]} - {b[0]}) * ({b[3]} - {b[1]}) - {inter})::double)"


@scene_query(
    "v1_triplet_recall",
    f"""select round(100 * sum(hits) / sum(n), 6)::double as triplet_recall, round(100 * avg(hits / n), 6)::double as mean_recall, round(100 * sum(subject_hits) / sum(n), 6)::double as object_recall
    from (select rel, sum(hit)::double as hits, sum(subject_hit)::double as subject_hits, count(*)::double as n from
      (select t.id, t.rel, max(case when p.subject is not null and p.rel = t.rel and p.object = t.object and {iou_sql(('t.s1', 't.s2', 't.s3', 't.s4'), ('p.s1', 'p.s2', 'p.s3', 'p.s4'))} >= 0.5 and {iou_sql(('t.o1', 't.o2', 't.o3', 't.o4'), ('p.o1', 'p.o2', 'p.o3', 'p.o4'))} >= 0.5 then 1 else 0 end) as hit,
       max(case when {iou_sql(('t.s1', 't.s2', 't.s3', 't.s4'), ('p.s1', 'p.s2', 'p.s3', 'p.s4'))} >= 0.5 then 1 else 0 end) as subject_hit
       from (select *, row_number() over () as id from truth) t left join predicted p on p.image_id = t.image_id and p.subject = t.subject group by t.id, t.rel) group by rel)""",
    PREDICTED_SQL,
)
def v1(s: Scene) -> DataFrame:
    return metrics.triplet_recall(_edges_with_boxes(s, False), _edges_with_boxes(s, True))


@scene_query(
    "v2_recall_at_k",
    """select k, round(100 * sum(hits) / sum(n), 6)::double as recall, round(100 * avg(hits / n), 6)::double as mean_recall from
      (select k, t.rel, sum(case when b.place <= k then 1 else 0 end)::double as hits, count(*)::double as n from (select distinct image_id, head, target, rel from relations) t
       left join (select image_id, head, target, rel, min(place) as place from (select *, row_number() over (partition by image_id order by score desc, head, target, rel) as place from predicted) where place <= 100 group by all) b
         on b.image_id = t.image_id and b.head = t.head and b.target = t.target and b.rel = t.rel, (values (1), (3), (100)) v(k) group by k, t.rel) group by k""",
    PREDICTED_SQL,
)
def v2(s: Scene) -> DataFrame:
    scored = _edges_with_boxes(s, True).select("image_id", "head", "target", "rel", "score")
    return metrics.recall_at(s.relations.distinct(), scored, (1, 3, 100))


@scene_query(
    "v6_box_coverage",
    f"""select image_id, avg(case when best > 0.5 then 1.0 else 0.0 end)::double as coverage from (select t.image_id, t.obj_idx, max({iou_sql(('t.x1', 't.y1', 't.x2', 't.y2'), ('(p.x1 + d)', 'p.y1', '(p.x2 + d)', 'p.y2'))}) as best
    from objects t join (select *, cast((image_id % 7) * 8 as int) as d from objects where obj_idx % 2 = 0) p on p.image_id = t.image_id group by all) group by image_id""",
)
def v6(s: Scene) -> DataFrame:
    shift = (F.pmod("image_id", F.lit(7)) * 8).cast("int")
    predicted = s.objects.where("obj_idx % 2 = 0").withColumn("x1", F.col("x1") + shift).withColumn("x2", F.col("x2") + shift)
    return metrics.box_coverage(s.objects, predicted)


@scene_query("v7_greedy_assignment")
def v7(s: Scene) -> DataFrame:
    return metrics.greedy_assignment(s.objects.where("obj_idx % 2 = 0"), s.objects.where("obj_idx % 2 = 1"))


@scene_query("f11_filtered_detections")
def f11(s: Scene) -> DataFrame:
    return metrics.filtered_detections(s.objects)


@scene_query(
    "v17_referring_accuracy",
    f"select category, round(avg(hit), 6)::double as accuracy, round(avg(same), 6)::double as region_accuracy, count(*) as n from (select t.label as category, case when {iou_sql(('t.x1', 't.y1', 't.x2', 't.y2'), ('(t.x1 + d)', 't.y1', '(t.x2 + d)', 't.y2'))} > 0.5 then 1 else 0 end as hit, case when obj_idx % 3 <> 0 then case when image_id % 2 = 0 then 1 else 0 end end as same from (select *, cast((image_id % 7) * 8 as int) as d from objects) t) group by rollup (category)",
)
def v17(s: Scene) -> DataFrame:
    shift = (F.pmod("image_id", F.lit(7)) * 8).cast("int")
    rows = s.objects.select(
        F.col("label").alias("category"), *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")], (F.col("x1") + shift).alias("p_x1"), F.col("y1").alias("p_y1"), (F.col("x2") + shift).alias("p_x2"), F.col("y2").alias("p_y2"),
        F.when(F.col("obj_idx") % 3 != 0, F.lit(0)).alias("region_index"), F.pmod("image_id", F.lit(2)).alias("pred_region_index"),
    )
    return metrics.referring_accuracy(rows)


@scene_query("a26_relations_per_image", "select count(*) as n, round(avg(c), 6)::double as mean, round(stddev(c), 6)::double as std, min(c)::double as least, round(quantile_cont(c, 0.25), 6)::double as p25, round(quantile_cont(c, 0.5), 6)::double as p50, round(quantile_cont(c, 0.75), 6)::double as p75, max(c)::double as most from (select count(*) as c from relations group by image_id)")
def a26(s: Scene) -> DataFrame:
    return metrics.box_summary(s.relations.groupBy("image_id").agg(F.count(F.lit(1)).alias("c")), "c")


# Other driver tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@table_query("a23_accuracy", "select lang as category, round(avg(case when quality = 1 then 1 else 0 end), 6)::double as accuracy, count(*) as n from documents join labels using (doc_id) group by rollup (lang)")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.accuracy(rows, F.col("quality") == 1, "lang")


@table_query("a24_pair_accuracy", "select round(avg(case when ok then 1 else 0 end), 6)::double as accuracy, count(*) as n_groups from (select source, bool_and(quality = 1) as ok from documents join labels using (doc_id) group by source)")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return metrics.pair_accuracy(rows, "source", F.col("quality") == 1)


@table_query("a25_judge_ratio", "select p_type as category, round(round(avg(p_retailprice), 3) / round(avg(p_size * 100.0), 3) * 100, 2)::double as ratio from part group by rollup (p_type)")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judge_ratio(_table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), (F.col("p_size") * 100.0).alias("first"), F.col("p_retailprice").alias("second")))


@table_query("x19_word_jaccard", "select item_id, other_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6)::double as word_iou from (select x.item_id, y.item_id as other_id, list_distinct(regexp_split_to_array(trim(x.text), '\\s+')) as a, list_distinct(regexp_split_to_array(trim(y.text), '\\s+')) as b from benchmark x join benchmark y on y.item_id = x.item_id + 1)")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    other = items.select(F.col("item_id").alias("other_id"), F.col("text").alias("other"))
    return items.join(other, F.col("other_id") == F.col("item_id") + 1).select("item_id", "other_id", F.round(words.word_jaccard(F.col("text"), F.col("other")), 6).alias("word_iou"))


@table_query("j17_nearest_category")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    return nearest.nearest(vectors.select("vec_id", F.col("embedding").alias("vector")), means, "vec_id", "label").withColumn("score", F.round("score", 5))


@table_query(
    "d10_turn_pairs",
    "select conv_id, cast((no - 1) // 2 as int) as pair, question, answer from (select conv_id, row_number() over (partition by conv_id order by turn) as no, trim(regexp_replace(replace(text, '<image>', ''), '[<>]', '', 'g')) as question, lead(trim(regexp_replace(replace(text, '<image>', ''), '[<>]', '', 'g'))) over (partition by conv_id order by turn) as answer from conversations) where no % 2 = 1 and answer is not null",
)
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.turn_pairs(_table(spark, sf_dir, "conversations"))


@table_query("x26_embedded_json", "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def x26(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Sure: "), F.replace("props", F.lit('"'), F.lit("'")), F.lit(" done"))
    return _table(spark, sf_dir, "events").select("event_id", parse.embedded_json(text, "k int")["k"].alias("k"))


# Depth and masks: an image of 8 x 8 pixels from each embedding; a pixel's object by quadrant.


def embedding_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, depth and labels, packed."""
    ship(spark)
    v = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    low, high = F.array_min("embedding"), F.array_max("embedding")
    scaled = F.transform("embedding", lambda x: F.coalesce(((x.cast("double") - low) / F.nullif(high - low, F.lit(0)).cast("double") * 255).cast("int"), F.lit(0)))
    quadrant = lambda i: F.when((i % 8 < 4) & (i < 32), 1).when(i < 32, 2).when(i % 8 < 4, 3).otherwise(0)
    labels = F.transform(F.sequence(F.lit(0), F.lit(63)), quadrant)
    return v.select("image_id", rasters.packed(scaled, 8, 8).alias("depth"), rasters.packed(labels, 8, 8).alias("labels"))


@table_query("g14_closer_point")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.depth_points(embedding_maps(spark, sf_dir)).select("image_id", "closer.x", "closer.y", F.col("farther.x").alias("far_x"), F.col("farther.y").alias("far_y"))


@table_query("g15_farther_point")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.depth_points(embedding_maps(spark, sf_dir), farther=True).select("image_id", "answer.x", "answer.y")


@table_query(
    "a13_object_depths",
    """with px as (select vec_id as image_id, unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: cast(trunc((x::double - list_min(embedding)) / (list_max(embedding) - list_min(embedding))::double * 255) as int))) as depth from embeddings),
    obj as (select image_id, depth, case when i % 8 < 4 and i < 32 then 0 when i % 8 >= 4 and i < 32 then 1 when i % 8 < 4 then 2 end as obj_idx from px)
    select image_id, cast(obj_idx as int) as obj_idx, depth from (select *, row_number() over (partition by image_id, obj_idx order by n desc, depth) as r from (select image_id, obj_idx, depth, count(*) as n from obj where obj_idx is not null group by all)) where r = 1""",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.object_depths(embedding_maps(spark, sf_dir))


def _embedding_scene(spark: SparkSession, sf_dir: str) -> tuple[Scene, DataFrame]:
    maps = embedding_maps(spark, sf_dir)
    each = maps.select("image_id", F.inline(rasters.object_masks("labels"))).withColumn("box", masks.bounds("mask"))
    label = F.element_at(F.array(F.lit("gear"), F.lit("bolt"), F.lit("rod")), F.col("obj_idx") + 1)
    objects = each.select("image_id", "obj_idx", "box.*", label.alias("label"))
    scene = driver_scene(spark, sf_dir)
    return Scene(objects.select("image_id").distinct(), objects, scene.relations, scene.attribute_vocab, scene.object_vocab), single.object_depths(maps)


for _no, _name, _f in ((16, "closer_object", lambda s, d: single.object_depth_pairs(s, d)), (17, "farther_object", lambda s, d: single.object_depth_pairs(s, d, farther=True)), (18, "closer_to_anchor", lambda s, d: single.object_depth_anchors(s, d)), (19, "farther_to_anchor", lambda s, d: single.object_depth_anchors(s, d, farther=True))):

    @table_query(f"g{_no}_{_name}")
    def g16(spark: SparkSession, sf_dir: str, f=_f) -> DataFrame:
        return f(*_embedding_scene(spark, sf_dir)).drop("candidates")


for _no, _different in ((20, False), (21, True)):

    @table_query(f"g{_no}_{'diff' if _different else 'same'}_object_point")
    def g20(spark: SparkSession, sf_dir: str, different=_different) -> DataFrame:
        return single.segment_points(embedding_maps(spark, sf_dir), different).select("image_id", "obj_idx", "anchor_point.x", "anchor_point.y", F.col("answer.x").alias("answer_x"), F.col("answer.y").alias("answer_y"))
