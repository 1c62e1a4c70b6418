"""More queries over the driver tables: filters, set operations, windows, shaping and further metrics. Importing registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.functions import boxes, draws, words
from prismloom.operators import graph, metrics, parse, records, shaping
from prismloom.plans.queries import LINES_SQL, _table, joined, key_sql, pick_sql, scene_query, some_sql, table_query, uniform_sql
from prismloom.plans.scene import Scene
from prismloom.sources import annotations, sinks


@scene_query("f1_overlapping_pairs", "select a.image_id, a.obj_idx as a, b.obj_idx as b from objects a join objects b on a.image_id = b.image_id and a.obj_idx < b.obj_idx and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2")
def f1(s: Scene) -> DataFrame:
    a, b = (s.objects.select("image_id", F.col("obj_idx").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")]) for p in "ab")
    return a.join(b, "image_id").where((F.col("a") < F.col("b")) & boxes.overlaps("a_", "b_")).select("image_id", "a", "b")


@scene_query("f2_including_pairs", "select a.image_id, a.obj_idx as a, b.obj_idx as b from objects a join objects b on a.image_id = b.image_id and a.obj_idx <> b.obj_idx and a.x1 <= b.x1 and a.y1 <= b.y1 and a.x2 >= b.x2 and a.y2 >= b.y2")
def f2(s: Scene) -> DataFrame:
    a, b = (s.objects.select("image_id", F.col("obj_idx").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")]) for p in "ab")
    return a.join(b, "image_id").where((F.col("a") != F.col("b")) & boxes.includes("a_", "b_")).select("image_id", "a", "b")


@scene_query("f10_excluding_sample", f"select image_id, array_to_string({some_sql('others', 2, 'excluding', 'image_id')}, '|') as labels from (select image_id, list_sort(list(distinct label) filter (label <> 'gear')) as others from objects group by image_id) where len(others) > 0")
def f10(s: Scene) -> DataFrame:
    labels = s.objects.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("l"))
    return labels.select("image_id", draws.some(F.array_except("l", F.array(F.lit("gear"))), 2, "excluding", "image_id").alias("labels")).where(F.size("labels") > 0).select("image_id", *joined("labels"))


@scene_query("f14_plural_nouns", "select label, false as plural from objects group by label")
def f14(s: Scene) -> DataFrame:
    return s.objects.select("label").distinct().select("label", words.looks_plural(F.col("label")).alias("plural"))


@scene_query("f12_unprocessed", "select image_id, obj_idx from objects where image_id % 3 <> 0")
def f12(s: Scene) -> DataFrame:
    done = s.objects.where("image_id % 3 = 0").select("image_id")
    return s.objects.join(done, "image_id", "left_anti").select("image_id", "obj_idx")


@scene_query("f13_complete_ids", "select image_id, obj_idx from (select *, count(*) over (partition by image_id) as n from objects) where n = 4")
def f13(s: Scene) -> DataFrame:
    return sinks.complete_ids(s.objects, "image_id", 4).select("image_id", "obj_idx")


@scene_query("p1_normalized_attributes", "select image_id, obj_idx, case when attr in ('red', 'blue', 'small', 'large', 'hot', 'cold', 'new', 'old') then case when obj_idx % 2 = 0 and attr <> 'old' then least(attr, 'old') || '|' || greatest(attr, 'old') else attr end end as attributes from objects")
def p1(s: Scene) -> DataFrame:
    raw = F.array(F.concat_ws(" and ", F.col("attributes")[0], F.when(F.col("obj_idx") % 2 == 0, "old"), F.lit("unheard of")))
    vocab = F.array(*[F.lit(a) for a in ("red", "blue", "small", "large", "hot", "cold", "new", "old")])
    return s.objects.select("image_id", "obj_idx", annotations.normalized_attributes(F.array(raw), vocab)[0].alias("attributes")).select("image_id", "obj_idx", *joined("attributes"))


@scene_query("p4_ratio_points", "select image_id, obj_idx, '(' || regexp_replace(printf('%.2f', round_even(x1 / 1024.0, 2)), '(\\.\\d)0$', '\\1') || ', ' || regexp_replace(printf('%.2f', round_even(y1 / 1024.0, 2)), '(\\.\\d)0$', '\\1') || ')' as point from objects")
def p4(s: Scene) -> DataFrame:
    return s.objects.join(s.images, "image_id").select("image_id", "obj_idx", boxes.ratio_text([F.col("x1"), F.col("y1")], [F.col("width"), F.col("height")]).alias("point"))


@scene_query("p9_xywh", "select image_id, obj_idx, x1, y1, x1 + (x2 - x1) as x2, y1 + (y2 - y1) as y2 from objects")
def p9(s: Scene) -> DataFrame:
    return s.objects.select("image_id", "obj_idx", boxes.from_xywh(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("b")).select("image_id", "obj_idx", "b.*")


@scene_query("p16_formatted_graph", "select image_id, head, rel, string_agg(target, '|' order by target) as targets from (select distinct image_id, head, rel, target from relations) group by all")
def p16(s: Scene) -> DataFrame:
    return s.relations.groupBy("image_id", "head", "rel").agg(F.sort_array(F.collect_set("target")).alias("targets")).select("image_id", "head", "rel", *joined("targets"))


@scene_query("p17_capped_graph", "select image_id, head, string_agg(rel || ' ' || target, '|' order by target, rel) as relations from (select *, row_number() over (partition by image_id, head order by target, rel) as no from relations where rel <> 'NO') where no <= 2 group by all")
def p17(s: Scene) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("image_id", "head").orderBy("target", "rel"))
    kept = s.relations.where("rel <> 'NO'").withColumn("no", place).where("no <= 2")
    text = F.transform(F.sort_array(F.collect_list(F.struct("target", "rel"))), lambda e: F.concat(e["rel"], F.lit(" "), e["target"].cast("string")))
    return kept.groupBy("image_id", "head").agg(text.alias("relations")).select("image_id", "head", *joined("relations"))


@scene_query("j1_merged_fields", "select image_id, obj_idx, case when obj_idx % 2 = 0 then x1 + 1 else x1 end as x1 from objects")
def j1(s: Scene) -> DataFrame:
    later = s.objects.where("obj_idx % 2 = 0").select("image_id", "obj_idx", (F.col("x1") + 1).alias("new_x1"))
    return s.objects.join(later, ["image_id", "obj_idx"], "left").select("image_id", "obj_idx", F.coalesce("new_x1", "x1").alias("x1"))


@scene_query("a4_relations_of_unique_pairs", "select image_id, head_label, target_label, string_agg(distinct rel, '|' order by rel) as rels from unique_edges group by all")
def a4(s: Scene) -> DataFrame:
    return s.unique_edges().groupBy("image_id", "head_label", "target_label").agg(F.sort_array(F.collect_set("rel")).alias("rels")).select("image_id", "head_label", "target_label", *joined("rels"))


@scene_query("a5_relations_of_index_pairs", "select image_id, head, target, string_agg(rel, '|' order by rel) as rels from relations group by all")
def a5(s: Scene) -> DataFrame:
    return s.relations.groupBy("image_id", "head", "target").agg(F.sort_array(F.collect_list("rel")).alias("rels")).select("image_id", "head", "target", *joined("rels"))


@scene_query("a6_heads_of_targets", "select image_id, target_label, rel, string_agg(distinct head_label, '|' order by head_label) as heads from edges group by all")
def a6(s: Scene) -> DataFrame:
    return s.edges().groupBy("image_id", "target_label", "rel").agg(F.sort_array(F.collect_set("head_label")).alias("heads")).select("image_id", "target_label", "rel", *joined("heads"))


@scene_query("a22_area_percentiles", "select image_id, quantile_cont((x2 - x1) * (y2 - y1), 0.5)::double as p50, quantile_cont((x2 - x1) * (y2 - y1), 0.75)::double as p75 from objects group by image_id")
def a22(s: Scene) -> DataFrame:
    return s.objects.groupBy("image_id").agg(F.percentile(boxes.area(""), 0.5).alias("p50"), F.percentile(boxes.area(""), 0.75).alias("p75"))


@scene_query("w2_ordered_by_depth", "select image_id, string_agg(label, '|' order by det_score, obj_idx) as labels from objects group by image_id having count(*) = 3")
def w2(s: Scene) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("det_score", "obj_idx", "label"))), lambda x: x["label"])
    return s.objects.groupBy("image_id").agg(ordered.alias("labels"), F.count(F.lit(1)).alias("n")).where("n = 3").select("image_id", *joined("labels"))


@scene_query("w8_drawn_attribute", f"select image_id, {pick_sql('labels', 'drawn', 'image_id')} as label from (select image_id, list_sort(list(distinct label)) as labels from objects group by 1)")
def w8(s: Scene) -> DataFrame:
    return s.objects.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("labels")).select("image_id", draws.pick(F.col("labels"), "drawn", "image_id").alias("label"))


@scene_query("w9_permutation", f"select image_id, array_to_string({some_sql('labels', 100, 'permuted', 'image_id')}, '|') as labels from (select image_id, list_sort(list(distinct label)) as labels from objects group by 1)")
def w9(s: Scene) -> DataFrame:
    return s.objects.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("l")).select("image_id", draws.shuffled(F.col("l"), "permuted", "image_id").alias("labels")).select("image_id", *joined("labels"))


@scene_query("w11_two_level_ranking", "select image_id, head, target, place from (select *, row_number() over (partition by image_id order by score desc, head, target) as place from (select * from (select r.image_id, r.head, r.target, o.det_score as score, row_number() over (partition by r.image_id, r.head order by r.target, r.rel) as own from relations r join objects o on o.image_id = r.image_id and o.obj_idx = r.head) where own <= 1)) where place <= 2")
def w11(s: Scene) -> DataFrame:
    scored = s.relations.join(s.objects.select("image_id", F.col("obj_idx").alias("head"), F.col("det_score").alias("score")), ["image_id", "head"])
    own = F.row_number().over(Window.partitionBy("image_id", "head").orderBy("target", "rel"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("score").desc(), "head", "target"))
    return scored.withColumn("own", own).where("own <= 1").withColumn("place", place).where("place <= 2").select("image_id", "head", "target", F.col("place").cast("long").alias("place"))


@scene_query("w13_option_ranks", "select image_id, obj_idx, rank() over (partition by image_id order by det_score desc) as r from objects")
def w13(s: Scene) -> DataFrame:
    return s.objects.select("image_id", "obj_idx", F.rank().over(Window.partitionBy("image_id").orderBy(F.col("det_score").desc())).cast("long").alias("r"))


@scene_query("w14_components_by_size")
def w14(s: Scene) -> DataFrame:
    return graph.decomposed(s).groupBy("image_id", "component_no").agg(F.count(F.lit(1)).alias("size"))


@scene_query("w16_to_size", f"select image_id, count(*) as copies from (select image_id from images, range(2) union all select * from (select image_id from images order by {key_sql('to_size', 'image_id')}, image_id limit (select count(*) // 2 from images))) group by 1")
def w16(s: Scene) -> DataFrame:
    images = s.images.select("image_id")
    n = images.count()
    return draws.to_size(images, 2 * n + n // 2, n, "to_size", ["image_id"]).groupBy("image_id").agg(F.count(F.lit(1)).alias("copies"))


@scene_query("w18_image_sample", f"select image_id from images order by {key_sql('images', 'image_id')}, image_id limit 500")
def w18(s: Scene) -> DataFrame:
    return draws.sample_rows(s.images.select("image_id"), 500, "images", ["image_id"])


@scene_query("u4_other_labels", "select o.image_id, string_agg(distinct o.label, '|' order by o.label) as labels from objects o where not exists (select 1 from edges e where e.image_id = o.image_id and (e.head_label = o.label or e.target_label = o.label)) group by 1")
def u4(s: Scene) -> DataFrame:
    ends = s.edges().select("image_id", F.explode(F.array("head_label", "target_label")).alias("label")).distinct()
    rest = s.objects.join(ends, ["image_id", "label"], "left_anti")
    return rest.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("labels")).select("image_id", *joined("labels"))


@scene_query("u5_common_ids", "select distinct image_id from objects where label = 'gear' intersect select image_id from objects where label = 'bolt'")
def u5(s: Scene) -> DataFrame:
    return s.objects.where("label = 'gear'").select("image_id").intersect(s.objects.where("label = 'bolt'").select("image_id"))


@scene_query(
    "u6_regions_without_doubles",
    "select image_id, obj_idx from objects a where obj_idx % 2 = 0 or not exists (select 1 from objects b where b.image_id = a.image_id and b.obj_idx % 2 = 0 and greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) > 0.3 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)))",
)
def u6(s: Scene) -> DataFrame:
    first = s.objects.where("obj_idx % 2 = 0")
    theirs = first.select(F.col("image_id").alias("f_image"), *[F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")])
    both = boxes.intersection("", "f_")
    more = s.objects.where("obj_idx % 2 = 1").join(theirs, (F.col("image_id") == F.col("f_image")) & (both > 0.3 * (boxes.area("") + boxes.area("f_") - both)), "left_anti")
    return first.select("image_id", "obj_idx").unionByName(more.select("image_id", "obj_idx"))


@scene_query("u7_uncovered_regions", "select image_id, obj_idx from objects o where not exists (select 1 from relations r where r.image_id = o.image_id and (r.head = o.obj_idx or r.target = o.obj_idx))")
def u7(s: Scene) -> DataFrame:
    ends = graph.adjacency(s).select("image_id", "obj_idx")
    return s.objects.select("image_id", "obj_idx").join(ends, ["image_id", "obj_idx"], "left_anti")


@scene_query("x1_and_lists", "select image_id, case len(l) when 1 then l[1] when 2 then l[1] || ' and ' || l[2] else array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] end as text from (select image_id, list_sort(list(distinct label)) as l from objects group by 1)")
def x1(s: Scene) -> DataFrame:
    return s.objects.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("l")).select("image_id", words.and_list(F.col("l")).alias("text"))


@scene_query("x6_count_words", "select image_id, label, case cnt when 1 then 'one' when 2 then 'two' when 3 then 'three' when 4 then 'four' when 5 then 'five' when 6 then 'six' when 7 then 'seven' else cnt::varchar end as text from (select image_id, label, count(*) as cnt from objects group by all)")
def x6(s: Scene) -> DataFrame:
    return s.label_counts().select("image_id", "label", words.count_word(F.col("cnt"), F.col("cnt") < 8).alias("text"))


@scene_query("x16_pair_iou", "select a.image_id, a.obj_idx as a, b.obj_idx as b, round(i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i), 6)::double as iou from objects a join objects b on a.image_id = b.image_id and a.obj_idx < b.obj_idx, lateral (select (greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))::double as i)")
def x16(s: Scene) -> DataFrame:
    a, b = (s.objects.select("image_id", F.col("obj_idx").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")]) for p in "ab")
    return a.join(b, "image_id").where("a < b").select("image_id", "a", "b", F.round(boxes.iou("a_", "b_"), 6).alias("iou"))


@table_query("x15_sentence_case", "select p_partkey, upper(p_name[1]) || lower(p_name[2:]) as text from part")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", words.sentence_case(F.col("p_name")).alias("text"))


@table_query("x20_region_numbers", "select p_partkey, p_size - 1 as region from part where p_size % 2 = 0 union all select p_partkey, -1 from part where p_size % 2 <> 0")
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("it is region"), F.col("p_size").cast("string"), F.lit(" or region7"))).otherwise("none")
    return _table(spark, sf_dir, "part").select("p_partkey", words.region_number(text).alias("region"))


@table_query("x21_normalized", "select p_partkey, trim(lower(regexp_replace(p_brand || ', ' || p_type || '!', '[^\\w\\s]', '', 'g'))) as text from part")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", words.normalized(F.concat("p_brand", F.lit(", "), "p_type", F.lit("!"))).alias("text"))


@table_query("x22_yes_scores", "select event_id, case when event_type = 'click' then 1 else 0 end as score from events")
def x22(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "click", "Yes, it does.").otherwise("No. Yesterday.")
    return _table(spark, sf_dir, "events").select("event_id", words.yes_score(text).alias("score"))


@table_query("x23_judge_pairs", "select p_partkey, case when p_size % 3 = 0 then -1.0 else p_size end::double as a, case when p_size % 3 = 0 then -1.0 else p_retailprice end::double as b from part")
def x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.col("p_size").cast("string"), F.lit(", "), F.col("p_retailprice").cast("string"), F.lit("\nbecause"))
    pair = words.judge_pair(F.when(F.col("p_size") % 3 == 0, "no score").otherwise(good))
    return _table(spark, sf_dir, "part").select("p_partkey", pair[0].alias("a"), pair[1].alias("b"))


@scene_query("x24_numbers_as_tags", "select image_id, l[1] || ' at region1 is near ' || l[2] || ' at region2' as text from (select image_id, list(label order by obj_idx) as l from objects group by 1) where len(l) >= 2")
def x24(s: Scene) -> DataFrame:
    names = s.objects.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("obj_idx", "label"))), lambda x: x["label"]).alias("names"))
    return names.select("image_id", shaping.numbers_as_tags(F.lit("1 is near 2"), F.col("names")).alias("text")).where("text is not null")


@table_query("x18_dot_products", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5)::double as norm from embeddings")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(words.dot(F.col("embedding"), F.col("embedding")), 5).alias("norm"))


@scene_query("sg9_detailed_triples", "select distinct image_id, head, rel, target from relations")
def sg9(s: Scene) -> DataFrame:
    part = F.concat(F.lit("region"), (F.col("target") + 1).cast("string"), F.lit(" "), "rel")
    return parse.detailed_triples(s.relations.groupBy("image_id", "head").agg(F.array_join(F.collect_list(part), ", ").alias("text")))


@scene_query("sg20_proposals", "select distinct image_id, head as obj_idx from relations union select image_id, target from relations")
def sg20(s: Scene) -> DataFrame:
    own = s.objects.select("image_id", "obj_idx")
    return shaping.proposals(s.relations, 1, own, own.limit(0), own.limit(0))


@scene_query(
    "d1_graph_conversations",
    "select image_id, 'Describe the scene graph.' as question, text as answer from (select o.image_id, 'Objects:' || chr(10) || o.block || chr(10) || coalesce(chr(10) || 'Relations:' || chr(10) || r.block || chr(10), '') as text from obj_lines o left join (select image_id, string_agg(line, chr(10) order by head) as block from rel_lines group by 1) r using (image_id))",
    LINES_SQL,
)
def d1(s: Scene) -> DataFrame:
    made = shaping.graph_conversations(parse.graph_texts(s), ["Describe the scene graph."])
    return made.select("image_id", F.col("conversations")[0]["value"].alias("question"), F.col("conversations")[1]["value"].alias("answer"))


@scene_query("d7_located_questions", "select image_id, obj_idx, 'What is this? [' || concat_ws(', ', x1 * 1000 // 1024, y1 * 1000 // 1024, x2 * 1000 // 1024, y2 * 1000 // 1024) || ']' || chr(10) || 'Answer the question using a single word or phrase.' as question, label as answer from objects")
def d7(s: Scene) -> DataFrame:
    rows = s.objects.join(s.images, "image_id").select(F.struct("image_id", "obj_idx").alias("id"), F.lit("What is this?").alias("question"), F.col("label").alias("answer"), "x1", "y1", "x2", "y2", F.col("x1").alias("px"), F.col("y1").alias("py"), "width", "height")
    made = shaping.located_questions(rows).where("form = 'box'")
    return made.select("id.*", F.col("conversations")[0]["value"].alias("question"), F.col("conversations")[1]["value"].alias("answer"))


@table_query("d7c_box_choices", f"select p_partkey, chr((64 + list_position({some_sql('choices', 4, 'box_choices', 'p_partkey')}, 'd'))::int) as letter from (select p_partkey, ['a', 'b', 'c', 'd'] as choices from part)")
def d7c(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("Which?").alias("question"), F.array(*[F.lit(x) for x in "abcd"]).alias("choices"))
    return shaping.box_choices(rows, "Look. ").select(F.col("id").alias("p_partkey"), F.col("conversations")[1]["value"].alias("letter"))


@table_query("d9_lettered_questions", "select p_partkey, 'context' || chr(10) || 'Which brand?' || chr(10) || 'A. none' || chr(10) || 'B. ' || p_brand as question, 'Answer: ' || p_brand as answer from part")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = shaping.lettered_question(F.lit("Which brand?"), F.lit("context"), F.array(F.lit("none"), "p_brand"), F.lit(1))
    return _table(spark, sf_dir, "part").select("p_partkey", turns.alias("t")).select("p_partkey", F.col("t")[0]["value"].alias("question"), F.col("t")[1]["value"].alias("answer"))


@table_query("d10c_grounded_chunks", "select item_id, text[1:5] as phrase, '[0, 250, 500, 1000]' as box from benchmark")
def d10c(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("caption"), F.array(F.array(*[F.lit(float(x)) for x in (0, 5, 0, 0.25, 0.5, 1, 0.9)])).alias("chunks"))
    return shaping.grounded_chunks(rows).select(F.col("id").alias("item_id"), "phrase", "box")


@table_query("d10d_interleaved_boxes", "select p_partkey, 'a ' || p_brand || ' and ' || p_type || '.' as text from part")
def d10d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", records.interleaved(F.lit("a <box> and <box>."), "<box>", F.array("p_brand", "p_type")).alias("text"))


@table_query("d10e_marked_phrases", "select p_partkey, 'See the ring ' || p_brand || ' and rod ' || p_type || '.' as text from part")
def d10e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", shaping.marked_phrases(F.lit("See [the ring] and [rod]."), "[", "]", F.array("p_brand", "p_type")).alias("text"))


@table_query("d11c_described_regions", "select p_partkey, p_brand as answer from part")
def d11c(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.array(F.concat(F.lit("<region1>: "), "p_brand"), F.lit("none")).alias("descriptions"))
    return shaping.described_regions(rows, ["Describe {}."]).select(F.col("image_id").alias("p_partkey"), F.col("conversations")[1]["value"].alias("answer"))


@table_query("n4_comma_attributes", "select p_partkey, lower(p_type) || '|' || p_brand as attributes from part")
def n4(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.concat(F.lower("p_type"), F.lit(", ,"), "p_brand", F.lit(" "))
    return _table(spark, sf_dir, "part").select("p_partkey", shaping.comma_attributes(output).alias("attributes")).select("p_partkey", *joined("attributes"))


@table_query("v11_category_similarity", "select round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6)::double as word_iou from (select list_distinct(regexp_split_to_array(p_name, '\\s+')) as a, list_distinct(regexp_split_to_array('small ' || p_name, '\\s+')) as b from part)")
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_similarity(_table(spark, sf_dir, "part").withColumn("said", F.concat(F.lit("small "), "p_name")), "said", "p_name")


@scene_query("v8_grounding")
def v8(s: Scene) -> DataFrame:
    assigned = metrics.greedy_assignment(s.objects.where("obj_idx % 2 = 0"), s.objects.where("obj_idx % 2 = 1"))
    return metrics.grounding(assigned, s.images.select("image_id", (F.col("image_id") % 3 == 0).alias("right")))


@table_query("v15_size_table", "select * from (values ('CRPE', 7576), ('VSR', 1222), ('SugarCREPE', 2812), ('SEED', 14233), ('GQA', 12578), ('VCR', 26534)) t(name, n)")
def v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("CRPE", 7576), ("VSR", 1222), ("SugarCREPE", 2812), ("SEED", 14233), ("GQA", 12578), ("VCR", 26534)], "name string, n int")


@scene_query("v19_review_gallery", "select image_id, first_label, array_to_string(labels[1:5], '|') as labels from (select image_id, list(label order by obj_idx)[1] as first_label, list(label order by obj_idx) as labels from objects group by 1)")
def v19(s: Scene) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("obj_idx", "label"))), lambda x: x["label"])
    made = s.objects.groupBy("image_id").agg(ordered.alias("l"))
    return made.select("image_id", F.col("l")[0].alias("first_label"), F.slice("l", 1, 5).alias("labels")).select("image_id", "first_label", *joined("labels"))


@table_query("a12_event_counts", "select 'event' as kind, event_type as value, count(*) as cnt from events group by event_type")
def a12e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.metadata_counts(_table(spark, sf_dir, "events"), {"event": F.array("event_type")})
