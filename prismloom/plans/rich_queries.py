"""Queries over a second reading of the driver's tables: objects with up to three attributes, and relations between any two of an image's objects, with branches and circles. Importing registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.operators import graph, multi, single
from prismloom.plans.queries import CHOICES_SQL, ORACLES, QUERIES, joined, key_sql, pick_sql, some_sql
from prismloom.plans.scene import VOCAB_ATTRIBUTES, Scene, by_image, driver_scene
from prismloom.plans.shipping import ship

_WORDS = [a for a, _ in VOCAB_ATTRIBUTES]


def rich_scene(spark: SparkSession, sf_dir: str) -> Scene:
    ship(spark)
    line, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "image_id"), spark.read.parquet(f"{sf_dir}/part.parquet")
    order = Window.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    name, vocab = F.split("p_name", " "), F.array(*[F.lit(w) for w in _WORDS])
    more = lambda c, every: F.when(F.col(c) % every > 0, F.get(vocab, (F.col(c) % len(_WORDS)).cast("int")))
    attributes = F.array_sort(F.array_distinct(F.array_compact(F.array(name[0], more("l_suppkey", 3), more("l_partkey", 2)))))
    objects = line.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    raw = by_image(objects, line).select(
        "image_id", (F.row_number().over(order) - 1).cast("int").alias("obj_idx"), name[1].alias("label"), attributes.alias("attributes"), "l_suppkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("rel")
    )
    n = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    sized = raw.withColumn("n", n).where("l_partkey % 5 > 0").withColumn("target", ((F.col("l_suppkey") * 7 + F.col("l_partkey") * 3) % F.col("n")).cast("int"))
    relations = sized.where("target <> obj_idx").select("image_id", F.col("obj_idx").alias("head"), "rel", "target")
    plain = driver_scene(spark, sf_dir)
    return Scene(plain.images, raw.select("image_id", "obj_idx", "label", "attributes"), relations, plain.attribute_vocab, plain.object_vocab)


RICH_SQL = f"""
raw as (select l_orderkey as image_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as int) as obj_idx, split_part(p_name, ' ', 2) as label,
    list_sort(list_distinct(list_filter([split_part(p_name, ' ', 1), case when l_suppkey % 3 > 0 then {_WORDS}[l_suppkey % 8 + 1] end, case when l_partkey % 2 > 0 then {_WORDS}[l_partkey % 8 + 1] end], lambda a: a is not null))) as attributes,
    l_suppkey, l_partkey, l_returnflag || l_linestatus as rel, count(*) over (partition by l_orderkey) as n from lineitem join part on l_partkey = p_partkey),
objects as (select image_id, obj_idx, label, attributes from raw),
relations as (select image_id, obj_idx as head, rel, cast((l_suppkey * 7 + l_partkey * 3) % n as int) as target from raw where l_partkey % 5 > 0 and (l_suppkey * 7 + l_partkey * 3) % n <> obj_idx),
both_ways as (select image_id, head as a, target as b from relations union select image_id, target, head from relations),
paths(image_id, a, b) as (select image_id, obj_idx, obj_idx from objects union select p.image_id, p.a, w.b from paths p join both_ways w on w.image_id = p.image_id and w.a = p.b),
reach as (select image_id, a as obj_idx, min(b) as component from paths group by all),
near_by as (select distinct image_id, obj_idx, other, rel, direction from (select image_id, head as obj_idx, target as other, rel, 0 as direction from relations union all select image_id, target, head, rel, 1 from relations)),
own_attributes as (select image_id, obj_idx, unnest(attributes) as attribute from objects),
refs as (
  select a.image_id, a.obj_idx, null::int as other, a.attribute || '|' || b.attribute as attributes, null as other_name, '' as other_attributes, null as rel, null::int as direction
    from own_attributes a join own_attributes b on a.image_id = b.image_id and a.obj_idx = b.obj_idx and a.attribute < b.attribute
  union all select n.image_id, n.obj_idx, n.other, '', x.label, t.attribute, n.rel, n.direction from near_by n join objects x on x.image_id = n.image_id and x.obj_idx = n.other join own_attributes t on t.image_id = n.image_id and t.obj_idx = n.other
  union all select n.image_id, n.obj_idx, n.other, t.attribute, x.label, '', n.rel, n.direction from near_by n join objects x on x.image_id = n.image_id and x.obj_idx = n.other join own_attributes t on t.image_id = n.image_id and t.obj_idx = n.obj_idx),
said as (select *, case when attributes = '' then 'object' else replace(attributes, '|', ' and ') || ' object' end || coalesce(' that ' || case when direction = 0 then 'is ' || rel || ' the ' || named else 'the ' || named || ' is ' || rel end, '') as reference
  from (select *, case when other_attributes = '' then other_name else other_attributes || ' ' || other_name end as named from refs))
"""


def rich_query(name: str, sql: str, more: str = ""):
    def add(f: Callable[[Scene], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(rich_scene(spark, sf_dir))
        ORACLES[name] = f"with recursive {RICH_SQL}{',' + more if more else ''} {sql}"
        return f

    return add


@rich_query("sg3b_branching_components", "select image_id, obj_idx, component from reach")
def sg3b(s: Scene) -> DataFrame:
    return graph.components(s)


@rich_query("j16b_references_with_subsets", "select image_id, obj_idx, coalesce(other, -1) as other, attributes, coalesce(other_name, '') as other_name, other_attributes, coalesce(rel, '') as rel, coalesce(direction, -1) as direction from refs")
def j16b(s: Scene) -> DataFrame:
    refs = graph.references(s, 2).fillna(-1, ["other", "direction"]).fillna("", ["other_name", "rel"])
    return refs.select("image_id", "obj_idx", "other", *joined("attributes"), "other_name", *joined("other_attributes"), "rel", "direction")


@rich_query("a15c_objects_of_references", "select image_id, component, reference, count(distinct obj_idx) as n from said join reach using (image_id, obj_idx) group by all")
def a15c(s: Scene) -> DataFrame:
    return graph.fitting(s, 2)


@rich_query(
    "g23b_object_questions",
    f"""select image_id, component, 'What is the ' || reference || '?' as prompt, array_to_string(answers, '|') as answers, {pick_sql('answers', 'object_questions', 'image_id', 'component', 'reference')} as answer
    from (select image_id, component, reference, list_sort(list(distinct label)) as answers from said join reach using (image_id, obj_idx) join objects using (image_id, obj_idx) where (image_id, component) in (select (image_id, component) from reach group by image_id, component having count(*) > 1) group by all)""",
)
def g23b(s: Scene) -> DataFrame:
    return graph.object_questions(s, 2).select("image_id", "component", "prompt", *joined("answers"), "answer")


@rich_query(
    "g24b_attribute_questions",
    """select image_id, component, category, 'What is the ' || case when category = 'other' then 'attribute' else category end || ' of the ' || reference || '?' as prompt, array_to_string(list_sort(list(distinct attribute)), '|') as answers
    from (select distinct s.image_id, s.obj_idx, c.category, s.reference, c.attribute from said s join typed c on c.image_id = s.image_id and c.obj_idx = s.obj_idx
      where not exists (select 1 from typed u where u.image_id = s.image_id and u.obj_idx = s.obj_idx and u.category = c.category and list_contains(string_split(s.attributes, '|'), u.attribute)))
    join reach using (image_id, obj_idx) group by image_id, component, category, reference""",
    f"typed as (select image_id, obj_idx, attribute, category from own_attributes join (values {', '.join(str(v) for v in VOCAB_ATTRIBUTES)}) v(attribute, category) using (attribute))",
)
def g24b(s: Scene) -> DataFrame:
    return graph.attribute_questions(s, 2).select("image_id", "component", "category", "prompt", *joined("answers"))


@rich_query(
    "g25b_relation_questions",
    """select distinct r.image_id, r.head, r.target, 'What is the relation from the ' || a.said || ', to the ' || b.said || '?' as prompt, array_to_string(r.rels, '|') as answers
    from (select image_id, head, target, list_sort(list(distinct rel)) as rels from relations group by 1, 2, 3) r
    join alone a on a.image_id = r.image_id and a.obj_idx = r.head and a.other is distinct from r.target join alone b on b.image_id = r.image_id and b.obj_idx = r.target and b.other is distinct from r.head""",
    "alone as (select image_id, obj_idx, other, replace(reference, ' that ', ', which ') as said from (select *, min(obj_idx) over w as low, max(obj_idx) over w as high from said join reach using (image_id, obj_idx) window w as (partition by image_id, component, reference)) where low = high)",
)
def g25b(s: Scene) -> DataFrame:
    return graph.relation_questions(s, 2).select("image_id", "head", "target", "prompt", *joined("answers"))


@rich_query("g8b_exists_attributes", f"select image_id, array_to_string(attributes, ', ') || ' ' || label || case when cnt > 1 then 's' else '' end as name, case when cnt > 1 then 'are' else 'is' end as be, cnt as answer, {CHOICES_SQL} as candidates from (select image_id, attributes, label, count(*) as cnt from objects group by all)")
def g8b(s: Scene) -> DataFrame:
    return single.exists_attribute(s).select("image_id", "name", "be", "answer", *joined("candidates"))


@rich_query(
    "g10b_typed_attributes",
    f"""select image_id, obj_idx, category as attribute_type, answer, array_to_string(list_prepend(answer, {some_sql('others', 3, 'typed_attribute_of_box', 'image_id', 'obj_idx', 'category')}), '|') as candidates
    from (select image_id, obj_idx, category, {pick_sql('own', 'typed_attribute_of_box', 'image_id', 'obj_idx', 'category')} as answer, list_filter(vocab, lambda a: not list_contains(own, a)) as others
      from (select image_id, obj_idx, category, list_sort(list(distinct attribute)) as own from own_attributes join vocab_words using (attribute) where category <> 'other' group by all) join (select category, list_sort(list(attribute)) as vocab from vocab_words group by all) using (category))""",
    f"vocab_words as (select * from (values {', '.join(str(v) for v in VOCAB_ATTRIBUTES)}) v(attribute, category))",
)
def g10b(s: Scene) -> DataFrame:
    boxed = s.objects.withColumns({c: F.lit(k) for k, c in enumerate(("x1", "y1", "x2", "y2"))})
    return single.typed_attribute_of_box(Scene(s.images, boxed, s.relations, s.attribute_vocab, s.object_vocab)).select("image_id", "obj_idx", "attribute_type", "answer", *joined("candidates"))


@rich_query(
    "m12b_common_attributes",
    """select label as object, image_id_0, image_id_1, array_to_string(shared, '|') as answer, array_to_string(others, '|') as distractors from (select *, list_sort(list_intersect(a0, a1)) as shared, list_sort(list_filter(list_distinct(list_concat(a0, a1)), lambda a: not (list_contains(a0, a) and list_contains(a1, a)))) as others from pairs)
    where len(shared) > 0 and len(others) > 0""",
    f"""kinds as (select label, image_id, list_sort(list_distinct(flatten(list(attributes)))) as attributes from objects group by all),
    pairs as (select label, image_id as image_id_0, lead(image_id) over w as image_id_1, attributes as a0, lead(attributes) over w as a1 from kinds window w as (partition by label order by {key_sql('common_attribute', 'label', 'image_id')}, image_id) qualify image_id_1 is not null)""",
)
def m12b(s: Scene) -> DataFrame:
    return multi.common_attribute(s).select("object", "image_id_0", "image_id_1", *joined("answer", "distractors"))


@rich_query(
    "w14c_order_with_circles",
    "select image_id, component, unnest(range(len(o)))::int as place, unnest(o)::int as obj_idx from chosen",
    f"""single as (select image_id, head, target from (select *, row_number() over (partition by image_id, least(head, target), greatest(head, target) order by {key_sql('single_edges', 'image_id', 'head', 'rel', 'target')}, head, rel) as no from relations) where no = 1),
    members as (select image_id, component, list_sort(list(obj_idx)) as nodes from reach group by all),
    kept as (select r.image_id, r.component, list({{'head': s.head, 'target': s.target}}) as edges from single s join reach r on r.image_id = s.image_id and r.obj_idx = s.head group by all),
    g as (select m.*, coalesce(k.edges, []) as edges from members m left join kept k using (image_id, component)),
    walk(image_id, component, taken) as (
      select image_id, component, []::int[] from g
      union all
      select image_id, component, list_append(taken, next) from (select w.*, list_min(list_filter(g.nodes, lambda n: not list_contains(w.taken, n) and len(list_filter(g.edges, lambda e: e.target = n and not list_contains(w.taken, e.head))) = 0)) as next
        from walk w join g using (image_id, component)) where next is not null),
    longest as (select image_id, component, arg_max(taken, len(taken)) as taken from walk group by all),
    chosen as (select image_id, component, case when len(taken) = len(nodes) then taken else list_transform(list_sort(list_transform(nodes, lambda n: {{'d': -len(list_filter(edges, lambda e: e.head = n or e.target = n)), 'n': n}})), lambda x: x.n) end as o from g join longest using (image_id, component))""",
)
def w14c(s: Scene) -> DataFrame:
    return graph.topological(s)
