"""Queries of operators that the others use but don't show by themselves, each with its SQL. Importing registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.functions import boxes, rasters, words
from prismloom.operators import graph, metrics, multi, nearest, parse, records, shaping, single
from prismloom.plans.queries import (
    COMPONENTS_SQL,
    ORACLES,
    LINES_SQL,
    PREDICTED_SQL,
    REFERENCES_SQL,
    REGIONS_SQL,
    _edges_with_boxes,
    _table,
    embedding_maps,
    iou_sql,
    joined,
    key_sql,
    pick_sql,
    scene_query,
    table_query,
    uniform_sql,
)
from prismloom.plans.scene import SCENE_SQL, Scene
from prismloom.sources import annotations, files, sinks
from prismloom.sources.scratch import scratch


def said(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each turn of conversations."""
    return df.select(*keys, F.posexplode("conversations").alias("no", "t")).select(*keys, "no", F.col("t.from").alias("who"), F.col("t.value").alias("value"))


# Sources and sinks, on files written first


def nation_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as annotated images."""
    key = F.col("n_nationkey").cast("int")
    box = F.array(key, key + 1, key + 10, key + 20)
    annotation = F.struct(F.lit(100).alias("width"), F.lit(80).alias("height"), F.array("n_name").alias("labels"), F.array(box).alias("bboxes"))
    return _table(spark, sf_dir, "nation").select(F.col("n_name").alias("image_id"), F.concat(F.lower("n_name"), F.lit(".jpg")).alias("data_path"), annotation.alias("annotation"), F.lit("atlas").alias("source"))


#: Bytes of a range of a document here: far below an entry's, so that entries reach over ranges and files.
RANGE = 50


def written_document(spark: SparkSession, rows: DataFrame) -> str:
    path = scratch(spark)
    annotations.write_document(rows, path, files=3)
    return path


@table_query("s1_annotation_file", "select n_name as image_id, lower(n_name) || '.jpg' as data_path, 'atlas' as source, 100 as width, n_name as label, n_nationkey::int + 10 as x2 from nation")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = annotations.read_keyed(spark, written_document(spark, nation_document(spark, sf_dir)), RANGE, parts=True)
    return read.select("image_id", "data_path", "source", "width", F.col("labels")[0].alias("label"), F.col("bboxes")[0][2].alias("x2"))


@table_query("s2_merged_annotation_files", "select n_name as image_id, n_name as label, n_comment as caption, 100 as width from (select *, 'about ' || lower(n_name) as n_comment from nation)")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("image_id"), F.lit(None).cast("string").alias("data_path"), F.struct(F.concat(F.lit("about "), F.lower("n_name")).alias("caption")).alias("annotation"), F.lit(None).cast("string").alias("source"))
    read = [annotations.read_keyed(spark, written_document(spark, d), RANGE, parts=True) for d in (nation_document(spark, sf_dir), more)]
    return annotations.merge(read).select("image_id", F.col("labels")[0].alias("label"), "caption", "width")


@table_query("s7_json_lines", "select n_nationkey, n_name, n_regionkey from nation")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}.jsonl"
    sinks.write_records(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_any(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@table_query("s12_coco_document", "select n_nationkey::bigint as id, r_name || '.jpg' as file_name, n_nationkey::bigint as x1, (n_nationkey + 7)::bigint as x2, (2 * n_nationkey)::bigint as y1, (2 * n_nationkey + 9)::bigint as y2 from nation join region on n_regionkey = r_regionkey")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _table(spark, sf_dir, "region").agg(F.collect_list(F.struct(F.col("r_regionkey").cast("long").alias("id"), F.concat("r_name", F.lit(".jpg")).alias("file_name"), F.lit(100).alias("width"), F.lit(80).alias("height"))).alias("images"))
    k = F.col("n_nationkey").cast("long")
    found = _table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(k.alias("id"), F.col("n_regionkey").cast("long").alias("image_id"), F.array(k, 2 * k, F.lit(7).cast("long"), F.lit(9).cast("long")).alias("bbox"))).alias("annotations"))
    path = scratch(spark)
    images.crossJoin(found).select(F.to_json(F.struct("images", "annotations"))).write.text(path)  # one document: a row
    return files.coco(spark, path).select("id", "file_name", "x1", "x2", "y1", "y2")


@table_query("s13_panoptic_truth", "select r_regionkey as image_id, cast(row_number() over (partition by r_regionkey order by n_nationkey) - 1 as int) as obj_idx, n_nationkey as category_id, n_nationkey as x1, n_nationkey + 5 as x2 from nation join region on n_regionkey = r_regionkey")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    grouped = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("image_id")).agg(F.sort_array(F.collect_list(F.struct(k.alias("category_id"), F.array(k, k, k + 5, k + 5).alias("bbox")))).alias("l"))
    doc = grouped.select("image_id", F.transform("l", lambda x: F.struct(x["category_id"].alias("category_id"))).alias("segments_info"), F.transform("l", lambda x: F.struct(x["bbox"].alias("bbox"))).alias("annotations"))
    return files.panoptic_truth(doc).select("image_id", "obj_idx", "category_id", "x1", "x2")


@table_query("s14_corner_boxes", "select p_partkey, p_size as x1, p_size + 1 as y1, p_size + 3 as x2, p_size + 5 as y2 from part")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", boxes.from_xywh(F.col("p_size"), F.col("p_size") + 1, F.lit(3), F.lit(4)).alias("b")).select("p_partkey", "b.*")


@table_query("s15_mixed_sources", "select 'people' as source, c_name as name from customer union all select 'shops', s_name from supplier")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = files.read_mix(spark, [{"type": "parquet", "path": "$TABLES/customer.parquet", "name": "people"}, {"type": "parquet", "path": "${TABLES}/supplier.parquet", "name": "shops"}], {"TABLES": sf_dir})
    return mix.select("source", F.coalesce("c_name", "s_name").alias("name"))


@table_query("s17_parquet_list", "select n_nationkey, n_name from nation")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    for k in range(3):
        _table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 3 == k).write.parquet(f"{path}/part-{k:03d}.parquet")
    return files.read_parquet_list(spark, f"{path}/part-{{000..002}}.parquet").select("n_nationkey", "n_name")


@table_query("s18_repeated_rows", "select s_suppkey, s_name from supplier, range(3)")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.repeated(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), 3)


@table_query("k3_resumed_output", "select c_custkey, c_name from customer")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run wrote a part of the rows; the second computes and appends the rest."""
    path, rows = scratch(spark), _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sinks.append_missing(rows.where("c_custkey % 2 = 0"), path, ["c_custkey"])
    sinks.append_missing(rows, path, ["c_custkey"])
    return sinks.existing(spark, path)


@table_query("k8_upserted_metrics", "select s_suppkey, case when s_suppkey % 4 = 0 then 'new' else s_name end as value from supplier")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("value"))
    return sinks.upserted(old, old.where("s_suppkey % 4 = 0").withColumn("value", F.lit("new")), ["s_suppkey"])


# Joins and sets

J9_ORDER = f"over (partition by label order by {key_sql('tuples', 'label', 'image_id')}, image_id)"


@scene_query("j9_image_triples", f"select * from (select label, image_id as image_id_0, lead(image_id) {J9_ORDER} as image_id_1, lead(image_id, 2) {J9_ORDER} as image_id_2 from (select distinct label, image_id from objects)) where image_id_2 is not null")
def j9(s: Scene) -> DataFrame:
    return multi.neighbours(s.object_index(), ["label"], "tuples", [], 3)


_HITS_SQL = f"""hits as (select t.id, t.image_id, t.subject, t.rel, t.object,
   max(case when p.rel = t.rel and p.object = t.object and {iou_sql(('t.s1', 't.s2', 't.s3', 't.s4'), ('p.s1', 'p.s2', 'p.s3', 'p.s4'))} >= 0.5 and {iou_sql(('t.o1', 't.o2', 't.o3', 't.o4'), ('p.o1', 'p.o2', 'p.o3', 'p.o4'))} >= 0.5 then 1 else 0 end) as hit,
   max(case when {iou_sql(('t.s1', 't.s2', 't.s3', 't.s4'), ('p.s1', 'p.s2', 'p.s3', 'p.s4'))} >= 0.5 then 1 else 0 end) as subject_hit
   from (select *, row_number() over () as id from truth) t left join predicted p on p.image_id = t.image_id and p.subject = t.subject group by all)"""


@scene_query("j10_triplet_hits", "select image_id, subject, rel, object, hit, subject_hit from hits", f"{PREDICTED_SQL}, {_HITS_SQL}")
def j10(s: Scene) -> DataFrame:
    return metrics.triplet_hits(_edges_with_boxes(s, False), _edges_with_boxes(s, True))


@scene_query("a20_recall_by_relation", "select rel, sum(hit)::bigint as hits, sum(subject_hit)::bigint as subject_hits, count(*) as n from hits group by rel", f"{PREDICTED_SQL}, {_HITS_SQL}")
def a20(s: Scene) -> DataFrame:
    return metrics.relation_recall(metrics.triplet_hits(_edges_with_boxes(s, False), _edges_with_boxes(s, True)))


def _half_moved(s: Scene) -> DataFrame:
    shift = (F.pmod("image_id", F.lit(7)) * 8).cast("int")
    return s.objects.where("obj_idx % 2 = 0").withColumn("x1", F.col("x1") + shift).withColumn("x2", F.col("x2") + shift)


@scene_query(
    "j11_best_overlaps",
    f"""select t.image_id, t.x1, t.y1, t.x2, t.y2, round(max({iou_sql(('t.x1', 't.y1', 't.x2', 't.y2'), ('(p.x1 + d)', 'p.y1', '(p.x2 + d)', 'p.y2'))}), 6)::double as best
    from (select *, row_number() over () as id from objects) t left join (select *, cast((image_id % 7) * 8 as int) as d from objects where obj_idx % 2 = 0) p on p.image_id = t.image_id group by t.id, t.image_id, t.x1, t.y1, t.x2, t.y2""",
)
def j11(s: Scene) -> DataFrame:
    return metrics.best_overlaps(s.objects, _half_moved(s)).withColumn("best", F.round("best", 6))


@scene_query("v5_registered_evaluator")
def v5(s: Scene) -> DataFrame:
    return metrics.evaluator("box_coverage")(s.objects, _half_moved(s))


ORACLES["v5_registered_evaluator"] = ORACLES["v6_box_coverage"]


@scene_query("j14_captions_with_graphs", "select image_id, 'order ' || image_id as caption, count(*) as n_edges from relations where image_id % 3 > 0 group by image_id")
def j14(s: Scene) -> DataFrame:
    captions = s.images.where("image_id % 3 > 0").select("image_id", F.concat(F.lit("order "), F.col("image_id").cast("string")).alias("caption"))
    return captions.join(s.relations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_edges")), "image_id")


@table_query("j15_annotated_results", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@scene_query("j18_regions_by_key", "select image_id, case when obj_idx % 2 = 0 then 'sam_' || obj_idx else obj_idx::varchar end as name, case when obj_idx % 2 = 0 then 'sam' else 'region' end as source, label from objects")
def j18(s: Scene) -> DataFrame:
    name = F.concat(F.when(F.col("obj_idx") % 2 == 0, "sam_").otherwise(""), F.col("obj_idx").cast("string"))
    named = s.objects.select("image_id", name.alias("name")).withColumn("key", words.region_key(F.col("name")))
    regions = s.objects.select("image_id", F.struct(F.when(F.col("obj_idx") % 2 == 0, "sam").otherwise("region").alias("source"), F.col("obj_idx").alias("region")).alias("key"), "label")
    return named.join(regions, ["image_id", "key"]).select("image_id", "name", "key.source", "label")


@scene_query(
    "j16_references",
    """select image_id, obj_idx, other, '' as attributes, other_name, other_attr as other_attributes, rel, direction from refs
    union all select image_id, obj_idx, other, attr, other_name, '', rel, direction from refs""",
    REFERENCES_SQL,
)
def j16(s: Scene) -> DataFrame:
    return graph.references(s, 2).select("image_id", "obj_idx", "other", *joined("attributes"), "other_name", *joined("other_attributes"), "rel", "direction")


@scene_query("a14_answers_of_references", "select image_id, component, 'What is the ' || attr || ' object that ' || clause || '?' as prompt, count(distinct label)::int as n_answers from refs join reach using (image_id, obj_idx) group by image_id, component, attr, clause", f"{COMPONENTS_SQL}, {REFERENCES_SQL}")
def a14(s: Scene) -> DataFrame:
    return graph.object_questions(s).select("image_id", "component", "prompt", F.size("answers").alias("n_answers"))


@scene_query("a15_objects_of_references", "select image_id, component, attr || ' object that ' || clause as reference, count(distinct obj_idx) as n from refs join reach using (image_id, obj_idx) group by image_id, component, attr, clause", f"{COMPONENTS_SQL}, {REFERENCES_SQL}")
def a15(s: Scene) -> DataFrame:
    return graph.fitting(s)


@scene_query("x4_object_references", "select image_id, obj_idx, attr || ' object that ' || clause as reference from refs", REFERENCES_SQL)
def x4(s: Scene) -> DataFrame:
    return graph._texts(graph.references(s), " that ").select("image_id", "obj_idx", "reference")


@scene_query("a27_output_metadata", "select 'object' as kind, object as value, count(*) as cnt from (select label as object, image_id from countable_objects group by all) group by object")
def a27(s: Scene) -> DataFrame:
    return records.metadata_counts(single.exists_object(s), {"object": F.array("label")})


@scene_query("f8_equal_points", "select image_id, obj_idx, round_even(x1 / 1024.0, 2) = round_even(x2 / 1024.0, 2) and round_even(y1 / 1024.0, 2) = round_even(y2 / 1024.0, 2) as same from objects")
def f8(s: Scene) -> DataFrame:
    sized = s.objects.join(s.images, "image_id")
    same = boxes.same_point([F.col("x1"), F.col("y1")], [F.col("x2"), F.col("y2")], [F.col("width"), F.col("height")])
    return sized.select("image_id", "obj_idx", same.alias("same"))


@scene_query("f9_all_different", "select image_id, count(*) = count(distinct label || '|' || attr) as different from objects group by image_id")
def f9(s: Scene) -> DataFrame:
    return s.objects.groupBy("image_id").agg(records.all_different(F.collect_list(F.array("label", F.col("attributes")[0]))).alias("different"))


@table_query("u8_common_columns", "select doc_id from documents union all select doc_id from labels")
def u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_common_columns([_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")])


@table_query("w12_nearest_three", """with m as (select label, i, avg(x)::double as x from (select label, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings) group by all),
    s as (select e.vec_id, m.label, sum(e.x * m.x) as score from (select vec_id, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings) e join m using (i) group by all)
    select vec_id, label, place from (select *, cast(row_number() over (partition by vec_id order by score desc, label desc) as int) as place from s) where place <= 3""")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(*_centred(spark, sf_dir), "vec_id", "label", 3).select("vec_id", "label", "place")


def _centred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _table(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    return vectors.select("vec_id", F.col("embedding").alias("vector")), means


ORACLES["j17_nearest_category"] = """with m as (select label, i, avg(x)::double as x from (select label, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings) group by all),
    s as (select e.vec_id, m.label, sum(e.x * m.x) as score from (select vec_id, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings) e join m using (i) group by all)
    select vec_id, arg_max(label, score) as label, round(max(score), 5)::double as score from s group by vec_id"""

# Wording


@scene_query("x3_attributed_names", "select image_id, obj_idx, attr || ' ' || label as name from objects")
def x3(s: Scene) -> DataFrame:
    return s.objects.select("image_id", "obj_idx", graph._named(F.col("attributes"), F.col("label")).alias("name"))


@scene_query("x5_filled_templates", "select image_id, obj_idx, 'Is the ' || attr || ' ' || label || ' here?' as text from objects")
def x5(s: Scene) -> DataFrame:
    return s.objects.select("image_id", "obj_idx", words.filled(F.lit("Is the {attribute} {object} here?"), {"object": F.col("label"), "attribute": F.col("attributes")[0]}).alias("text"))


@table_query("x7_inflected", """select p_partkey, split_part(p_name, ' ', 2) || 's' as plural, case when left(split_part(p_name, ' ', 1), 1) in ('a', 'e', 'i', 'o') then 'an ' else 'a ' end || split_part(p_name, ' ', 1) as article,
    p_partkey || case when p_partkey % 100 between 11 and 13 then 'th' when p_partkey % 10 = 1 then 'st' when p_partkey % 10 = 2 then 'nd' when p_partkey % 10 = 3 then 'rd' else 'th' end as ordinal from part""")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.split("p_name", " ")
    return _table(spark, sf_dir, "part").select("p_partkey", words.plural(name[1]).alias("plural"), words.article(name[0]).alias("article"), words.ordinal(F.col("p_partkey")).alias("ordinal"))


@table_query("x8_count_choices", "select p_partkey, case when p_size = 1 then '1|2|3|4' else concat_ws('|', p_size, p_size - 1, p_size + 1, p_size + 2) end as choices from part")
def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", words.count_choices(F.col("p_size").cast("long")).alias("choices")).select("p_partkey", *joined("choices"))


@table_query("x9_options", "select p_partkey, 'A. ' || p_brand || '|B. ' || p_type as lettered, '(1) ' || p_brand || '|(2) ' || p_type as numbered from part")
def x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array("p_brand", "p_type")
    rows = _table(spark, sf_dir, "part").select("p_partkey", words.options(both, F.lit(0)).alias("lettered"), words.options(both, F.lit(1), numeric=True).alias("numbered"))
    return rows.select("p_partkey", *joined("lettered", "numbered"))


@scene_query("x12_label_pairs", "select distinct a.image_id, a.label || '|' || b.label as pair from objects a join objects b on a.image_id = b.image_id and a.label < b.label")
def x12(s: Scene) -> DataFrame:
    labels = s.objects.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return labels.select("image_id", F.explode(graph._subsets(F.col("labels"), 2)).alias("pair")).select("image_id", *joined("pair"))


@scene_query("x17_intersections", "select a.image_id, a.obj_idx as a, b.obj_idx as b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as area from objects a join objects b on a.image_id = b.image_id and a.obj_idx < b.obj_idx")
def x17(s: Scene) -> DataFrame:
    a, b = (s.objects.select("image_id", F.col("obj_idx").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")]) for p in "ab")
    return a.join(b, "image_id").where("a < b").select("image_id", "a", "b", boxes.intersection("a_", "b_").alias("area"))


@table_query("x25_spoken_categories", "select p_partkey, 'Where is the ' || p_brand || ' ' || p_type || '?' as query from part")
def x25(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_brand", F.lit("-other-"), "p_type", F.lit("-merged"))
    return _table(spark, sf_dir, "part").select("p_partkey", words.spoken_category(name, "Where is the {}?").alias("query"))


@table_query("x27_json_in_text", "select p_partkey, p_size as a, p_size + 1 as b from part")
def x27(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("The list is ['"), F.col("p_size").cast("string"), F.lit("', '"), (F.col("p_size") + 1).cast("string"), F.lit("'], as asked."))
    found = parse.embedded_json(text, "array<string>")
    return _table(spark, sf_dir, "part").select("p_partkey", found[0].cast("int").alias("a"), found[1].cast("int").alias("b"))


# Graphs and text


@scene_query("sg16_region_by_region", "select o.image_id, string_agg('region' || (o.obj_idx + 1) || ': ' || o.label || ' is ' || o.attr || coalesce(chr(10) || 'Relations: ' || r.line, '') || chr(10), '' order by o.obj_idx) as text from objects o left join (select image_id, head, string_agg('region' || (target + 1) || ' ' || rel, ', ' order by target, rel) as line from relations group by 1, 2) r on r.image_id = o.image_id and r.head = o.obj_idx group by 1")
def sg16(s: Scene) -> DataFrame:
    return parse.graph_texts(s, mode=1)


ORACLES["w14_components_by_size"] = f"with {SCENE_SQL}, {COMPONENTS_SQL} select image_id, cast(row_number() over (partition by image_id order by size, component) - 1 as int) as component_no, size from (select image_id, component, count(*) as size from reach group by all)"
ORACLES["g24_attribute_questions"] = f"""with {SCENE_SQL}, {COMPONENTS_SQL}, {REFERENCES_SQL}
    select image_id, component, category, 'What is the ' || case when category = 'other' then 'attribute' else category end || ' of the object that ' || clause || '?' as prompt, array_to_string(list_sort(list(distinct attr)), '|') as answers
    from refs join reach using (image_id, obj_idx) join attribute_vocab on attribute = attr group by image_id, component, category, clause"""
ORACLES["p8_graph_json"] = f"""with {SCENE_SQL}, nodes as (select o.image_id, o.obj_idx, '"' || o.obj_idx || '":{{"name":"' || label || '","attributes":["' || attr || '"],"relations":[' || coalesce(r.out, '') || ']}}' as node
    from objects o left join (select image_id, head, string_agg('{{"name":"' || rel || '","object":' || target || '}}', ',' order by target, rel) as out from relations group by 1, 2) r on r.image_id = o.image_id and r.head = o.obj_idx)
    select image_id, '{{' || string_agg(node, ',' order by obj_idx::varchar) || '}}' as graph from nodes group by image_id"""

_PX = """px as (select vec_id as image_id, i % 8 as x, i // 8 as y, depth, case when i % 8 < 4 and i < 32 then 0 when i % 8 >= 4 and i < 32 then 1 when i % 8 < 4 then 2 end as obj_idx
    from (select vec_id, unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: cast(trunc((x::double - list_min(embedding)) / (list_max(embedding) - list_min(embedding))::double * 255) as int))) as depth from embeddings))"""
_POINTS = f"""{_PX}, o as (select *, row_number() over w as no, lead(x) over w as x2, lead(y) over w as y2, lead(depth) over w as depth2 from px window w as (partition by image_id order by {key_sql('depth_points', 'image_id', 'y', 'x')}, y, x)),
    f as (select * from (select *, row_number() over (partition by image_id order by no) as r from o where no % 2 = 1 and no <= 20 and abs(depth - depth2) >= 50) where r = 1)"""
ORACLES["g14_closer_point"] = f"with {_POINTS} select image_id, case when depth > depth2 then x else x2 end::int as x, case when depth > depth2 then y else y2 end::int as y, case when depth > depth2 then x2 else x end::int as far_x, case when depth > depth2 then y2 else y end::int as far_y from f"
ORACLES["g15_farther_point"] = f"with {_POINTS} select image_id, case when depth > depth2 then x2 else x end::int as x, case when depth > depth2 then y2 else y end::int as y from f"
_DEPTHS = f"""{_PX}, d as (select image_id, cast(obj_idx as int) as obj_idx, ['gear', 'bolt', 'rod'][obj_idx + 1] as label, depth from (select *, row_number() over (partition by image_id, obj_idx order by n desc, depth) as r from (select image_id, obj_idx, depth, count(*) as n from px where obj_idx is not null group by all)) where r = 1)"""
for _no, _name, _answer in ((16, "closer_object", "closer"), (17, "farther_object", "farther")):
    ORACLES[f"g{_no}_{_name}"] = f"""with {_DEPTHS} select *, {_answer} as answer from (select a.image_id, a.obj_idx as a_obj_idx, b.obj_idx as b_obj_idx, case when a.depth > b.depth then a.label else b.label end as closer, case when a.depth > b.depth then b.label else a.label end as farther
        from d a join d b on a.image_id = b.image_id and a.obj_idx < b.obj_idx and abs(a.depth - b.depth) >= 50)"""
for _no, _name, _answer in ((18, "closer_to_anchor", "closer"), (19, "farther_to_anchor", "farther")):
    ORACLES[f"g{_no}_{_name}"] = f"""with {_DEPTHS}, o as (select image_id, list(struct_pack(depth := depth, label := label) order by depth, obj_idx) as o from d group by 1 having count(*) = 3),
        g as (select *, o[2].depth - o[1].depth as gap1, o[3].depth - o[2].depth as gap2, 0 as a_obj_idx, 1 as b_obj_idx, 2 as c_obj_idx from o),
        n as (select *, case when gap1 < gap2 then o[1].label else o[3].label end as near, case when gap1 < gap2 then o[3].label else o[1].label end as farther, {uniform_sql('object_depth_anchors', 'image_id', 'a_obj_idx', 'b_obj_idx', 'c_obj_idx')} < 0.5 as coin from g where abs(gap1 - gap2) >= 50)
        select *, {_answer} as answer from (select image_id, a_obj_idx, b_obj_idx, c_obj_idx, case when coin then o[2].label else near end as anchor, case when coin then near else o[2].label end as closer, farther from n)"""

for _no, _name, _x, _y in ((20, "same_object_point", "bx", "cy"), (21, "diff_object_point", "dx", "dy")):
    ORACLES[f"g{_no}_{_name}"] = f"""with {_PX}, k as (select *, {key_sql('segment_points', 'image_id', 'obj_idx', 'y', 'x')} as k from px where obj_idx is not null),
        o as (select image_id, obj_idx, arg_min(x, k) as ax, arg_min(y, k) as ay, arg_max(x, k) as bx, arg_max(y, k) as cy from k group by 1, 2 having count(*) > 1),
        d as (select o.*, p.x as dx, p.y as dy, row_number() over (partition by o.image_id, o.obj_idx order by round(abs(sqrt((ax - p.x) ** 2 + (ay - p.y) ** 2) - sqrt((ax - bx) ** 2 + (ay - cy) ** 2)), 6), p.x, p.y) as r from o join px p on p.image_id = o.image_id and p.obj_idx is distinct from o.obj_idx)
        select image_id, obj_idx::int as obj_idx, ax::int as x, ay::int as y, {_x}::int as answer_x, {_y}::int as answer_y from d where r = 1"""

# Conversations, turn by turn


@scene_query(
    "d2_graph_conversations_with_boxes",
    f"""select image_id, {pick_sql("['List all objects with boxes.', 'Find the objects and relations.']", 'graph_conversations', 'image_id')} as question, text as answer from (select o.image_id, 'Objects:' || chr(10) || o.block || chr(10) || coalesce(chr(10) || 'Relations:' || chr(10) || r.block || chr(10), '') as text
    from (select image_id, string_agg('region' || (obj_idx + 1) || ': ' || label || ' is ' || attr || ' [' || concat_ws(', ', x1 * 1000 // 1024, y1 * 1000 // 1024, x2 * 1000 // 1024, y2 * 1000 // 1024) || ']', chr(10) order by obj_idx) as block from objects group by 1) o
    left join (select image_id, string_agg(line, chr(10) order by head) as block from (select image_id, head, 'region' || (head + 1) || ': ' || string_agg('region' || (target + 1) || ' ' || rel, ', ' order by target, rel) as line from relations group by image_id, head) group by 1) r using (image_id))""",
)
def d2(s: Scene) -> DataFrame:
    made = shaping.graph_conversations(parse.graph_texts(s, with_boxes=True), ["List all objects with boxes.", "Find the objects and relations."])
    return made.select("image_id", F.col("conversations")[0]["value"].alias("question"), F.col("conversations")[1]["value"].alias("answer"))


@scene_query(
    "d4_reasoning_turns",
    """select image_id, cast(2 * obj_idx as int) as no, 'human' as who, case when obj_idx = 0 then 'Think first. ' else '' end || 'What is region' || (obj_idx + 1) || '?' as value from objects where obj_idx < 3
    union all select image_id, cast(2 * obj_idx + 1 as int), 'gpt', 'region: ' || label || chr(10) || 'Answer: ' || label from objects where obj_idx < 3""",
)
def d4(s: Scene) -> DataFrame:
    questions = s.objects.select("image_id", F.col("obj_idx").alias("no"), F.concat(F.lit("What is region"), (F.col("obj_idx") + 1).cast("string"), F.lit("?")).alias("question"), F.col("label").alias("answer"), F.array("obj_idx").alias("region_ids"))
    regions = s.objects.select("image_id", F.col("obj_idx").alias("region_id"), F.concat(F.lit("region: "), "label").alias("line"))
    return said(shaping.reasoning_turns(questions, regions, "Think first.", 3), "image_id")


@scene_query(
    "d5_referring_turns",
    f"""select image_id, captioning, cast(2 * (k - 1) + side as int) as no, case side when 0 then 'human' else 'gpt' end as who,
    case when side = 0 then case when captioning then 'What is in region' || (obj_idx + 1) || '?' else 'Which region is ' || attr || ' ' || label || '?' end when captioning then attr || ' ' || label else 'region' || (obj_idx + 1) end as value
    from (select *, row_number() over (partition by image_id, captioning order by obj_idx) as k from (select *, {uniform_sql('referring_turns', 'image_id', 'obj_idx')} < 0.5 as captioning from objects)), (values (0), (1)) v(side)""",
)
def d5(s: Scene) -> DataFrame:
    rows = s.objects.select("image_id", F.col("obj_idx").alias("no"), F.concat_ws(" ", F.array_join("attributes", " "), "label").alias("caption"), F.col("obj_idx").alias("region_index"))
    return said(shaping.referring_turns(rows, ["Which region is {}?"], ["What is in {}?"]), "image_id", "captioning")


@scene_query(
    "d6b_subject_turns",
    """select image_id, cast(2 * (k - 1) + side as int) as no, case side when 0 then 'human' else 'gpt' end as who, case side when 0 then 'What does region' || (head + 1) || ' do?' else line end as value
    from (select *, row_number() over (partition by image_id order by head) as k from (select image_id, head, string_agg('region' || (target + 1) || ' ' || rel, ', ' order by target, rel) as line from (select distinct image_id, head, rel, target from relations) group by 1, 2)), (values (0), (1)) v(side)""",
)
def d6b(s: Scene) -> DataFrame:
    return said(shaping.subject_turns(s.relations, lambda r: F.concat(F.lit("What does "), r, F.lit(" do?"))), "image_id")


@scene_query(
    "d6c_summaries_with_regions",
    "select image_id, 'A |' || first_label || '| at [region1' || case when n > 2 then ', region3' else '' end || '] and it.' as text from (select image_id, list(label order by obj_idx)[1] as first_label, count(*) as n from objects group by 1)",
)
def d6c(s: Scene) -> DataFrame:
    texts = s.objects.where("obj_idx = 0").select("image_id", F.concat(F.lit("A <"), "label", F.lit("> [o0, o1, o2] and <it> [o1].")).alias("text"))
    return shaping.summaries_with_regions(texts, s.objects.where("obj_idx % 2 = 0").select("image_id", F.concat(F.lit("o"), F.col("obj_idx").cast("string")).alias("object_id"), F.col("obj_idx").alias("region")))


_TALK = "(select conv_id, row_number() over (partition by conv_id order by turn) as no, {0} as question, lead({0}) over (partition by conv_id order by turn) as answer from conversations)"
for _name, _keep in (("d11a_region_conversations", False), ("d11b_bracketed_conversations", True)):
    _clean = "text" if _keep else "regexp_replace(text, '[<>]', '', 'g')"

    @table_query(
        _name,
        f"""select conv_id, cast(no - 1 + side as int) as no, case side when 0 then 'human' else 'gpt' end as who, case side when 0 then question else answer end as value, conv_id::int % 50 + 30 as x2, conv_id::int % 40 + 25 as y2
        from {_TALK.format(_clean)}, (values (0), (1)) v(side) where no % 2 = 1 and answer is not null""",
    )
    def d11(spark: SparkSession, sf_dir: str, keep=_keep) -> DataFrame:
        talks = _table(spark, sf_dir, "conversations")
        number = F.col("conv_id").cast("int")
        regions = talks.select("conv_id").distinct().select("conv_id", F.lit(0).alias("no"), (number % 50).alias("x"), (number % 40).alias("y"), F.lit(30).alias("w"), F.lit(25).alias("h"))
        made = records.region_conversations(talks, regions, keep)
        return said(made, "conv_id", "boxes").select("conv_id", "no", "who", "value", F.col("boxes")[0][2].alias("x2"), F.col("boxes")[0][3].alias("y2"))


@scene_query("v14_named_region_boxes", "select image_id, obj_idx, x1, y1, x2, y2 from objects")
def v14(s: Scene) -> DataFrame:
    answers = s.objects.select("image_id", F.concat(F.lit("It is region"), (F.col("obj_idx") + 1).cast("string"), F.lit(".")).alias("said"))
    return answers.withColumn("obj_idx", words.region_number(F.col("said"))).join(s.objects, ["image_id", "obj_idx"]).select("image_id", "obj_idx", "x1", "y1", "x2", "y2")


@table_query("v9_exact_match", "select source as category, round(avg(case when lang = 'en' then 1 else 0 end), 6)::double as accuracy, count(*) as n from documents group by rollup (source)")
def v9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_table(spark, sf_dir, "documents"), F.coalesce(F.col("lang") == "en", F.lit(False)), "source")


@scene_query(
    "v13_recall_suite",
    "select metric, k, round(100 * sum(hits) / sum(n), 6)::double as recall, round(100 * avg(hits / n), 6)::double as mean_recall from (select metric, k, rel, sum(case when place <= k then 1 else 0 end)::double as hits, count(*)::double as n from found, (values (1), (2), (3)) v(k) group by all) group by metric, k",
    f"""{PREDICTED_SQL}, options as (select image_id, head, target, rel, score from predicted),
    bound as (select image_id, head, target, rel, score from (select *, row_number() over (partition by image_id, head, target order by score desc, rel) as r from options) where r = 1),
    places as (select 'b' as side, * from (select *, row_number() over (partition by image_id order by score desc, head, target, rel) as place from bound) union all select 'f', * from (select *, row_number() over (partition by image_id order by score desc, head, target, rel) as place from options)),
    best as (select side, image_id, head, target, rel, min(place) as place from places where place <= 3 group by all),
    fresh as (select * from truth t where not exists (select 1 from truth s where s.image_id % 10 = 0 and s.subject = t.subject and s.rel = t.rel and s.object = t.object)),
    found as (select m.metric, t.rel, b.place from (select 'R' as metric, 'b' as side union all select 'ngR', 'f') m, truth t left join best b on b.side = m.side and b.image_id = t.image_id and b.head = t.head and b.target = t.target and b.rel = t.rel
      union all select m.metric, t.rel, b.place from (select 'zR' as metric, 'b' as side union all select 'ng-zR', 'f') m, fresh t left join best b on b.side = m.side and b.image_id = t.image_id and b.head = t.head and b.target = t.target and b.rel = t.rel)""",
)
def v13(s: Scene) -> DataFrame:
    truth, scored = _edges_with_boxes(s, False), _edges_with_boxes(s, True).select("image_id", "head", "target", "rel", "score")
    seen = truth.where("image_id % 10 = 0").select("subject", "rel", "object").distinct()
    return metrics.recall_suite(truth, scored, seen, (1, 2, 3))


# Answers of models, read back


def _garbled(s: Scene) -> DataFrame:
    """Each image's objects, and its first region's relations under a subject that shrank to "s:"."""
    first = s.relations.where("head = 0").groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("region"), (F.col("target") + 1).cast("string"), F.lit(" "), "rel"))), ", ").alias("line"))
    whole = parse.graph_texts(s).select("image_id", F.split("text", "Relations:")[0].alias("block"))
    return whole.join(first, "image_id", "left").select("image_id", F.concat("block", F.coalesce(F.concat(F.lit("Relations:\ns: "), "line"), F.lit(""))).alias("text"))


@scene_query("sg11_parsed_relations", "select image_id, head, rel, target, coalesce(label, -1) as label from relations left join (values ('near', 1), ('NO', 2), ('RF', 3)) v(rel, label) using (rel) where head = 0")
def sg11(s: Scene) -> DataFrame:
    labels = s.images.sparkSession.createDataFrame([("near", 1), ("NO", 2), ("RF", 3)], "rel string, label int")
    return parse.parsed_relations(_garbled(s), labels=labels).withColumn("label", F.coalesce("label", F.lit(-1)))


@scene_query("sg11b_parsed_objects", "select image_id, obj_idx, label || ' is ' || attr as name from objects where image_id in (select image_id from relations where head = 0)")
def sg11b(s: Scene) -> DataFrame:
    return parse.parsed_objects(_garbled(s))


@scene_query(
    "sg11c_drawn_relations",
    f"select image_id, head, rel, target from (select *, row_number() over (partition by image_id order by {key_sql('parsed_relations', 'image_id', 'head', 'target', 'rel')}, head, target, rel) as place from (select distinct image_id, head, rel, target from relations)) where place <= 2",
)
def sg11c(s: Scene) -> DataFrame:
    return parse.parsed_relations(parse.graph_texts(s), most=2)


@scene_query(
    "sg17b_renamed",
    "select image_id, obj_idx, case when obj_idx % 3 = 0 then 'new ' || label else label end as label from objects",
)
def sg17b(s: Scene) -> DataFrame:
    renames = s.objects.where("obj_idx % 2 = 0 or obj_idx % 3 = 0").select("image_id", "obj_idx", F.when(F.col("obj_idx") % 3 == 0, F.concat(F.lit("new "), "label")).otherwise("").alias("name"))
    nothing = s.relations.select("image_id", "head", "rel", "target", F.lit("add").alias("op"))
    return parse.edited(s.relations, s.objects.select("image_id", "obj_idx", "label"), nothing, renames)[1]


@scene_query(
    "sg18b_merged_by_mode",
    """select mode, image_id, region_id from (select *, overlap < 0.6 as free, area > coalesce(med, 0) as medium, area > q as large from (select s.image_id, s.obj_idx as region_id, any_value((s.x2 - s.x1) * (s.y2 - s.y1)) as area,
      max(coalesce(inter / ((s.x2 - s.x1) * (s.y2 - s.y1)), 0)) as overlap, max(coalesce(inter / ((s.x2 - s.x1) * (s.y2 - s.y1) + f_area - inter), 0)) as iou
      from second_regions s left join lateral (select f.image_id, greatest(least(f.x2, s.x2) - greatest(f.x1, s.x1), 0) * greatest(least(f.y2, s.y2) - greatest(f.y1, s.y1), 0)::double as inter, (f.x2 - f.x1) * (f.y2 - f.y1) as f_area
        from first_regions f where f.image_id = s.image_id) on true group by all) m
    left join (select image_id, quantile_cont((x2 - x1) * (y2 - y1), 0.5) as med from first_regions group by 1) f using (image_id)
    join (select image_id, quantile_cont((x2 - x1) * (y2 - y1), 0.75) as q from second_regions group by 1) q using (image_id)), (values (1), (2), (3), (4)) v(mode)
    where iou <= 0.7 and case mode when 1 then free when 2 then medium when 3 then medium and free else large and free end""",
    REGIONS_SQL,
)
def sg18b(s: Scene) -> DataFrame:
    first, second = s.objects.where("obj_idx % 2 = 0"), s.objects.where("obj_idx % 2 = 1").withColumnRenamed("obj_idx", "region_id")
    made = [parse.merged_regions(first, second, mode).withColumn("mode", F.lit(mode)) for mode in (1, 2, 3, 4)]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


@scene_query(
    "sg20b_proposals_by_setup",
    """select setup, image_id, obj_idx from (select distinct 0 as setup, image_id, head as obj_idx from relations union select distinct 2, image_id, obj_idx from (select image_id, head as obj_idx from relations union select image_id, target from relations union select image_id, obj_idx from objects where obj_idx % 2 = 0)
    union select 3, image_id, obj_idx from objects where obj_idx % 3 = 1 union select 4, image_id, obj_idx from objects)
    qualify row_number() over (partition by setup, image_id order by obj_idx) <= 3""",
)
def sg20b(s: Scene) -> DataFrame:
    own = s.objects.select("image_id", "obj_idx")
    made = [shaping.proposals(s.relations, k, own, own.where("obj_idx % 2 = 0"), own.where("obj_idx % 3 = 1"), 3).withColumn("setup", F.lit(k)) for k in (0, 2, 3, 4)]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


# Further conversations

_GRAPH_QUESTIONS = ["What relates to what here?", "Give the scene as a graph."]


@scene_query(
    "d3_panoptic_conversations",
    f"""select image_id, {pick_sql("['" + "', '".join(_GRAPH_QUESTIONS) + "']", 'panoptic_conversations', 'image_id')} as question, text as answer from (select o.image_id, 'Objects:' || chr(10) || o.block || chr(10) || coalesce(chr(10) || 'Relations:' || chr(10) || r.block || chr(10), '') as text
    from (select image_id, string_agg('region' || (obj_idx + 1) || ': ' || label || ' is ' || attr, chr(10) order by obj_idx) as block from objects where obj_idx < 4 group by 1) o
    left join (select image_id, string_agg(line, chr(10) order by head) as block from (select image_id, head, 'region' || (head + 1) || ': ' || string_agg('region' || (target + 1) || ' ' || rel, ', ' order by target, rel) as line from relations where head < 4 and target < 4 group by image_id, head) group by 1) r using (image_id))""",
)
def d3(s: Scene) -> DataFrame:
    categories = s.objects.withColumn("label", F.concat_ws("-", "label", "attributes", F.lit("other"), F.lit("merged")))
    made = shaping.panoptic_conversations(Scene(s.images, categories, s.relations, s.attribute_vocab, s.object_vocab), _GRAPH_QUESTIONS, most=4)
    return made.select("image_id", F.col("conversations")[0]["value"].alias("question"), F.col("conversations")[1]["value"].alias("answer"))


@scene_query(
    "d7b_asked_twice",
    """select image_id, obj_idx, form, case form when 'object' then 'How many like the ' || label || '?' when 'box' then 'How many? [' || concat_ws(', ', x1 * 1000 // 1024, y1 * 1000 // 1024, x2 * 1000 // 1024, y2 * 1000 // 1024) || ']'
      else 'How many? [' || concat_ws(', ', x1 * 1000 // 1024, y1 * 1000 // 1024) || ']' end || chr(10) || 'Answer the question using a single word or phrase.' as question, label as answer from objects, (values ('object'), ('box'), ('point')) v(form)""",
)
def d7b(s: Scene) -> DataFrame:
    rows = s.objects.join(s.images, "image_id").select(F.struct("image_id", "obj_idx").alias("id"), F.concat(F.lit("How many like the "), "label", F.lit("?")).alias("object_question"), F.lit("How many?").alias("general_question"), F.col("label").alias("answer"), "x1", "y1", "x2", "y2", F.col("x1").alias("px"), F.col("y1").alias("py"), "width", "height")
    return shaping.asked_twice(rows).select("id.image_id", "id.obj_idx", "form", F.col("conversations")[0]["value"].alias("question"), F.col("conversations")[1]["value"].alias("answer"))


@scene_query(
    "d8_inference_turns",
    f"""select image_id, cast(2 * (place - 1) + side as int) as no, case side when 0 then 'human' else 'gpt' end as who, case side when 0 then case kind when 'before' then 'What came before ' else 'What comes after ' end || first || '?' || case when place = 1 then ' As a list.' else '' end else answer end as value
    from (select *, row_number() over (partition by image_id order by {key_sql('inference_turns', 'image_id', 'kind')}, kind) as place from
      (select r.image_id, 'region1' as first, case when rel = 'near' then 'before' else 'after' end as kind, string_agg(h.label || ' at region' || (head + 1) || ' is ' || rel || ' ' || t.label || ' at region' || (target + 1), '; ' order by head, target) as answer
       from relations r join objects h on h.image_id = r.image_id and h.obj_idx = head join objects t on t.image_id = r.image_id and t.obj_idx = target group by all)), (values (0), (1)) v(side)""",
)
def d8(s: Scene) -> DataFrame:
    names = s.objects.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("obj_idx", "label"))), lambda x: x["label"]).alias("names"))
    numbered = F.concat((F.col("head") + 1).cast("string"), F.lit(" is "), "rel", F.lit(" "), (F.col("target") + 1).cast("string"))
    kind = F.when(F.col("rel") == "near", "before").otherwise("after")
    rows = s.relations.join(names, "image_id").select(F.col("image_id").alias("id"), F.lit("region1").alias("subjects"), kind.alias("kind"), (F.col("head") * 1000 + F.col("target")).alias("no"), shaping.numbers_as_tags(numbered, F.col("names")).alias("text"))
    made = shaping.inference_turns(rows, {"before": ["What came before {}?"], "after": ["What comes after {}?"]}, ["As a list."])
    return said(made.withColumnRenamed("id", "image_id"), "image_id")


# Pixels and images


@table_query("p5_cropped", f"with {_PX} select image_id, box_no, (x - x1)::int as x, (y - y1)::int as y, depth from px, (values (0, 1, 2, 4, 6), (1, 5, 0, 8, 3)) v(box_no, x1, y1, x2, y2) where x >= x1 and x < x2 and y >= y1 and y < y2")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda *n: F.struct(*[F.lit(v).alias(c) for c, v in zip(("box_no", "x1", "y1", "x2", "y2"), n, strict=True)])
    cuts = embedding_maps(spark, sf_dir).select("image_id", "depth", F.inline(F.array(box(0, 1, 2, 4, 6), box(1, 5, 0, 8, 3))))
    parts = cuts.select("image_id", "box_no", rasters.cropped("depth", "x1", "y1", "x2", "y2").alias("part"))
    return parts.select("image_id", "box_no", F.inline(rasters.values("part"))).withColumnRenamed("value", "depth")
