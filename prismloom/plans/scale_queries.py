"""Queries of uniform tuples, users' generators and the nearest-category index. Importing registers them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from prismloom.operators import generators, graph, nearest, tuples
from prismloom.plans.queries import COMPONENTS_SQL, ORACLES, _table, joined, key_sql, scene_query, table_query
from prismloom.plans.scene import SCENE_SQL, VOCAB_OBJECTS, Scene

# Uniform tuples


def _tuples_sql(op: str, groups: str, index: str, n_tuples: str, n_sample: int) -> str:
    """CTEs numbered(label, image_id, ..., place) and found(no, label, r): drawn tuples by rank within their group."""
    return f"""idx as ({index}), sizes as (select {groups}, count(*)::hugeint as m from idx group by all),
    t as (select {groups}, {n_tuples} as tuples from sizes where {n_tuples} > 0),
    e as (select *, (sum(tuples) over (order by {key_sql(op, groups)}, {groups}))::hugeint - tuples as start from t),
    h as (select id, {key_sql(op, 'id')} as h from range({4 * n_sample + 200}) r(id)),
    tries as (select id, (cast('0x' || substr(h, 1, 12) as bigint)::hugeint * 281474976710656 + cast('0x' || substr(h, 13, 12) as bigint)) % (select sum(tuples)::hugeint from t) as rank from h),
    firsts as (select rank, min(id) as k from tries group by rank order by k limit {n_sample}),
    found as (select (row_number() over (order by {key_sql(op + '|no', 'k')}, k) - 1)::bigint as no, {groups}, rank - start as r from firsts join e on rank >= start and rank < start + tuples),
    numbered as (select *, row_number() over (partition by {groups} order by {key_sql(op + '|image', groups, 'image_id')}, image_id) - 1 as place from idx)"""


_PAIR = "(select *, r - i1::hugeint * (i1 - 1) // 2 as i0 from (select *, list_max(list_filter(range(greatest(floor(sqrt(2.0 * r))::bigint - 2, 0), floor(sqrt(2.0 * r))::bigint + 4), lambda c: c::hugeint * (c - 1) // 2 <= r)) as i1 from {0}))"
_TRIPLE = "(select * exclude (r), r - i2::hugeint * (i2 - 1) * (i2 - 2) // 6 as r from (select *, list_max(list_filter(range(greatest(floor(cbrt(6.0 * r))::bigint - 2, 0), floor(cbrt(6.0 * r))::bigint + 5), lambda c: c::hugeint * (c - 1) * (c - 2) // 6 <= r)) as i2 from found))"


@scene_query(
    "j9b_uniform_triples",
    f"select f.no, f.label, a.image_id as image_id_0, b.image_id as image_id_1, c.image_id as image_id_2 from {_PAIR.format(_TRIPLE)} f join numbered a on a.label = f.label and a.place = i0 join numbered b on b.label = f.label and b.place = i1 join numbered c on c.label = f.label and c.place = i2",
    _tuples_sql("uniform_triples", "label", "select distinct label, image_id from objects", "m * (m - 1) * (m - 2) // 6", 2000),
)
def j9b(s: Scene) -> DataFrame:
    return tuples.uniform_tuples(s.object_index(), ["label"], 3, 2000, "uniform_triples")


@scene_query(
    "w7b_uniform_pairs",
    f"select f.no, f.label, a.image_id as image_id_0, b.image_id as image_id_1, a.cnt + b.cnt as answer from {_PAIR.format('found')} f join numbered a on a.label = f.label and a.place = i0 join numbered b on b.label = f.label and b.place = i1",
    _tuples_sql("uniform_pairs", "label", "select label, image_id, count(*) as cnt from countable_objects group by all", "m * (m - 1) // 2", 1000),
)
def w7b(s: Scene) -> DataFrame:
    """CountObject over pairs of images, each pair of any countable label with the same chance."""
    index = s.object_index().join(s.object_vocab.where("countable = 1").select(F.col("object").alias("label")), "label", "left_semi")
    pairs = tuples.uniform_tuples(index, ["label"], 2, 1000, "uniform_pairs", ("cnt",))
    return pairs.select("no", "label", "image_id_0", "image_id_1", (F.col("cnt_0") + F.col("cnt_1")).alias("answer"))


# Generators as users write them, the same questions as g1 and g4


def exists_object(image: Row):
    countable = {name for name, n in VOCAB_OBJECTS if n}
    labels = [o.label for o in image.objects if o.label in countable]
    for label in sorted(set(labels)):
        n = labels.count(label)
        choices = [1, 2, 3, 4] if n == 1 else [n, n - 1, n + 1, n + 2]
        yield {"slots": {"name": label + "s" if n > 1 else label, "be": "are" if n > 1 else "is"}, "answer": str(n), "candidates": [str(c) for c in choices], "objects": [label]}


def leftmost_object(image: Row):
    labels = [o.label for o in image.objects]
    apart = lambda a, b: a.x2 <= b.x1 or b.x2 <= a.x1
    for a, b, c in combinations([o for o in image.objects if labels.count(o.label) == 1], 3):
        if apart(a, b) and apart(b, c) and apart(a, c):
            first = min((a, b, c), key=lambda o: o.x1)
            yield {"slots": {k: str(o.obj_idx) for k, o in zip("abc", (a, b, c), strict=True)}, "answer": first.label, "candidates": [o.label for o in (a, b, c)], "objects": [a.label, b.label, c.label]}


@scene_query("t10_user_generator_exists")
def t10(s: Scene) -> DataFrame:
    generators.register(s.images.sparkSession, "exists_object", exists_object)
    asked = generators.questions(s, ["exists_object"])
    return asked.select("image_id", F.col("slots")["name"].alias("name"), F.col("slots")["be"].alias("be"), F.col("answer").cast("long").alias("answer"), *joined("candidates"))


@scene_query("t11_user_generator_leftmost")
def t11(s: Scene) -> DataFrame:
    generators.register(s.images.sparkSession, "leftmost_object", leftmost_object)
    asked = generators.questions(s, ["leftmost_object"])
    return asked.select("image_id", *[F.col("slots")[k].cast("int").alias(f"{k}_obj_idx") for k in "abc"], "answer", *joined("candidates"))


ORACLES["t10_user_generator_exists"] = ORACLES["g1_exists_object"]
ORACLES["t11_user_generator_leftmost"] = ORACLES["g4_leftmost"]


# Order of a component's objects


@scene_query("w14b_topological_order")
def w14b(s: Scene) -> DataFrame:
    return graph.topological(s)


ORACLES["w14b_topological_order"] = f"""with recursive {SCENE_SQL}, {COMPONENTS_SQL},
    single as (select image_id, head, target from (select *, row_number() over (partition by image_id, least(head, target), greatest(head, target) order by {key_sql('single_edges', 'image_id', 'head', 'rel', 'target')}, head, rel) as no from relations) where no = 1),
    members as (select image_id, component, list_sort(list(obj_idx)) as nodes from reach group by all),
    kept as (select r.image_id, r.component, list({{'head': s.head, 'target': s.target}}) as edges from single s join reach r on r.image_id = s.image_id and r.obj_idx = s.head group by all),
    g as (select m.*, coalesce(k.edges, []) as edges from members m left join kept k using (image_id, component)),
    walk(image_id, component, taken) as (
      select image_id, component, []::int[] from g
      union all
      select image_id, component, list_append(taken, next) from (select w.*, list_min(list_filter(g.nodes, lambda n: not list_contains(w.taken, n) and len(list_filter(g.edges, lambda e: e.target = n and not list_contains(w.taken, e.head))) = 0)) as next
        from walk w join g using (image_id, component)) where next is not null),
    longest as (select image_id, component, arg_max(taken, len(taken)) as taken from walk group by all),
    chosen as (select image_id, component, case when len(taken) = len(nodes) then taken else list_transform(list_sort(list_transform(nodes, lambda n: {{'d': -len(list_filter(edges, lambda e: e.head = n or e.target = n)), 'n': n}})), lambda x: x.n) end as o from g join longest using (image_id, component))
    select image_id, component, unnest(range(len(o)))::int as place, unnest(o)::int as obj_idx from chosen"""


# Nearest categories in a vocabulary as large as the table


@table_query("j17b_indexed_nearest")
def j17b(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest.indexed(vectors, vectors.withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id", 5)
