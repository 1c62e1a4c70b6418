"""Documents cut into ranges, uniform tuples, users' generators and nearest categories."""

import json
import random
import re
from collections import Counter
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismloom.operators import generators, graph, nearest, tuples
from prismloom.plans import scene as scenes
from prismloom.plans.rich_queries import rich_scene
from prismloom.plans.scene import Scene, driver_scene
from prismloom.sources import annotations, json_objects


def deep(draw, level=0):
    kind = draw.randrange(6 if level < 3 else 3)
    if kind == 0:
        return draw.choice([0, -1.5e9, True, None])
    if kind < 3:
        return "".join(draw.choice('a}{][",:\\\n é😀/u') for _ in range(draw.randrange(12)))
    return [deep(draw, level + 1) for _ in range(draw.randrange(4))] if kind < 5 else {f'k{k}"}}': deep(draw, level + 1) for k in range(draw.randrange(4))}


@pytest.mark.parametrize("width", [1, 7, 64, 100_000])
def test_ranges_give_the_entries_of_the_whole(width):
    draw = random.Random(width)
    for _ in range(60):
        data = {f'{k}\\",{{': deep(draw) for k in range(draw.randrange(5))}
        text = json.dumps(data, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])) + draw.choice(["", "\n", " \n}"])
        # ranges end behind closing brackets, as the reader's do
        parts, held = [], ""
        for piece in text.split("}"):
            held += piece + "}"
            if len(held) >= width:
                parts.append(held)
                held = ""
        parts += [held] if held else []
        in_string, depth, out, open_ = False, 0, [], ""
        for p in parts:
            cut = json_objects.pieces(p.encode(), in_string, depth)
            out += [open_ + cut[0], *cut[1:-1]] if len(cut) > 1 else []
            open_ = cut[-1] if len(cut) > 1 else open_ + cut[0]
            quotes, closed, opened = json_objects.summary(p.encode())
            depth += opened if in_string else closed
            in_string ^= quotes % 2 == 1
        out = [x for x in [*out, open_] if x.strip()]
        assert {k: v for x in out for k, v in json.loads("{" + x + "}").items()} == data and len(out) == len(data)


def test_documents_in_many_ranges(spark, tmp_path):
    draw = random.Random(3)
    docs = [{f"image {k}": {"data_path": f"{k}}}.jpg", "source": 'a "}" \\', "annotation": {"width": k, "height": 2, "labels": ["x" * draw.randrange(90), "é{"], "bboxes": [[k, 0, 1, 2]]}} for k in range(n)} for n in (40, 0, 1)]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(d))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = json_objects._ranges(spark, str(tmp_path / "0.json"), "}", 100)
        assert found.select("start").distinct().count() > 5 and found.count() > 20
        rows = annotations.read_keyed(spark, str(tmp_path / "*.json"), 100).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(name, at, v["data_path"], v["source"], v["annotation"]["width"], v["annotation"]["labels"]) for d in docs for at, (name, v) in enumerate(d.items())]
    assert sorted((r.image_id, r.row_idx, r.data_path, r.source, r.width, r.labels) for r in rows) == sorted(want)


def test_documents_in_parts(spark, tmp_path):
    schema = "image_id string, data_path string, annotation struct<width:int,labels:array<string>>, source string"
    rows = [(f"im\"{k:03}", f"{k}.jpg", (k, ["a\nb", "}"]), None) for k in range(50)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    annotations.write_document(df, str(tmp_path / "parts"), files=4)
    written = sorted((tmp_path / "parts").glob("part-*"))
    assert len(written) == 4
    whole = json.loads("".join(p.read_text() for p in written))
    assert list(whole) == [r[0] for r in rows] and whole['im"007']["annotation"] == {"width": 7, "labels": ["a\nb", "}"]}
    back = annotations.read_keyed(spark, str(tmp_path / "parts"), 60, parts=True)
    assert sorted((r.row_idx, r.image_id, r.width) for r in back.collect()) == [(k, r[0], k) for k, r in enumerate(rows)]
    annotations.write_document(df.limit(0), str(tmp_path / "empty"))
    assert annotations.read_keyed(spark, str(tmp_path / "empty"), parts=True).count() == 0


def test_ranks_are_all_combinations():
    for n in (1, 2, 3, 4):
        assert sorted(tuple(tuples.combination(r, n)) for r in range(comb(9, n))) == list(combinations(range(9), n))
    big = 10**12
    assert tuples.combination(comb(big, 3) - 1, 3) == [big - 3, big - 2, big - 1]


def index(spark, sizes):
    return spark.createDataFrame([(f"g{g}", 100 * g + k, k % 3) for g, n in enumerate(sizes) for k in range(n)], "label string, image_id long, cnt int")


def test_all_tuples_when_asked_for_more(spark):
    rows = tuples.uniform_tuples(index(spark, [4, 1, 6, 2]), ["label"], 2, 1000, "all", ("cnt",)).collect()
    found = {(r.label, frozenset((r.image_id_0, r.image_id_1))) for r in rows}
    assert len(rows) == len(found) == 6 + 15 + 1 and sorted(r.no for r in rows) == list(range(22))
    assert all(r.cnt_0 == r.image_id_0 % 100 % 3 for r in rows)


def test_no_tuple_is_drawn_twice(spark):
    rows = tuples.uniform_tuples(index(spark, [40, 3, 2, 25]), ["label"], 3, 500, "some").collect()
    assert len(rows) == 500 == len({(r.label, frozenset((r.image_id_0, r.image_id_1, r.image_id_2))) for r in rows})
    assert tuples.uniform_tuples(index(spark, [1, 1]), ["label"], 2, 5, "none").collect() == []


def test_every_tuple_has_the_same_chance(spark):
    df = index(spark, [5, 3]).cache()  # 13 pairs, of which 5 are drawn each time
    seen = Counter()
    for k in range(60):
        seen.update((r.label, frozenset((r.image_id_0, r.image_id_1))) for r in tuples.uniform_tuples(df, ["label"], 2, 5, f"draw {k}").collect())
    expected = 60 * 5 / 13
    assert len(seen) == 13 and sum((n - expected) ** 2 / expected for n in seen.values()) < 32.9  # 0.1 % of a chi-square of 12


def test_generators_of_users(spark, small):
    from prismloom.plans.scene import driver_scene

    scene = driver_scene(spark, small)

    def widest(image):
        best = max(image.objects, key=lambda o: (o.x2 - o.x1, -o.obj_idx))
        yield {"slots": {"side": "widest"}, "answer": best.label, "candidates": sorted({o.label for o in image.objects}), "objects": [best.label]}
        yield {"slots": {"side": "first"}, "answer": image.objects[0].label}

    generators.register(spark, "widest_object", widest)
    asked = generators.questions(scene, ["widest_object"])
    assert asked.count() == 2 * scene.objects.select("image_id").distinct().count()
    one = generators.questions(scene, ["widest_object"], 1)
    assert one.groupBy("image_id").count().where("count <> 1").count() == 0
    templates = spark.createDataFrame([("widest_object", 0, "Which is the {side}?", "The {answer}."), ("widest_object", 1, "{side}?", "{answer}")], "generator string, template_id int, prompt string, response string")
    told = generators.with_templates(one, templates, ["image_id"])
    assert {r.prompt for r in told.select("prompt").distinct().collect()} <= {"Which is the widest?", "Which is the first?", "widest?", "first?"}
    assert told.where("response = answer or response = concat('The ', answer, '.')").count() == one.count()
    generators.register(spark, "broken", lambda image: [{"answer": "x", "colour": "y"}])
    with pytest.raises(Exception, match="colour"):
        generators.questions(scene, ["broken"]).collect()
    generators.register(spark, "silent", lambda image: [])
    assert generators.questions(scene, ["silent"]).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 16))
    points = (centres[draw.integers(30, size=2500)] + 0.3 * draw.normal(size=(2500, 16))) * draw.uniform(0.5, 2, size=(2500, 1))
    rows = centres[draw.integers(30, size=400)] + 0.3 * draw.normal(size=(400, 16))
    left = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + [(999, None)], "id long, vector array<double>")
    right = spark.createDataFrame([(f"c{k:04}", v.tolist()) for k, v in enumerate(points)] + [("none", None)], "name string, vector array<double>")
    return rows, points, left, right


def test_exact_nearest(spark, vectors):
    rows, points, left, right = vectors
    scores = rows @ points.T
    want = {(k, f"c{c:04}", p + 1) for k, order in enumerate(np.argsort(-scores, axis=1)[:, :5]) for p, c in enumerate(order)}
    assert {(r.id, r.name, r.place) for r in nearest.nearest(left, right, "id", "name", 5).collect()} == want
    assert {(r.id, r.name) for r in nearest.nearest(left, right, "id", "name").collect()} == {(a, b) for a, b, p in want if p == 1}
    assert nearest.nearest(left, right.limit(0), "id", "name").collect() == []
    ties = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "name string, vector array<double>")
    one = spark.createDataFrame([(1, [2.0, 0.0])], "id long, vector array<double>")
    assert [(r.name, r.score, r.place) for r in nearest.nearest(one, ties, "id", "name", 2).orderBy("place").collect()] == [("b", 2.0, 1), ("a", 2.0, 2)]


def test_index_finds_the_nearest(spark, vectors, monkeypatch):
    _, _, left, right = vectors
    monkeypatch.setattr(nearest, "BLOCK", 100)
    exact = {(r.id, r.name) for r in nearest.exact(left, right, "id", "name", 10).collect()}
    found = {(r.id, r.name) for r in nearest.nearest(left, right, "id", "name", 10, most_bytes=1000).select("id", "name").collect()}
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9
    every = {(r.id, r.name) for r in nearest.indexed(left, right, "id", "name", 10, cells=20, probes=20).collect()}
    assert every == exact
    assert nearest.indexed(left, right.where(F.lit(False)), "id", "name", 3).collect() == []


def test_order_of_nodes_is_that_of_captions(spark):
    from prismloom.operators import graph
    from prismloom.plans.scene import Scene

    draw = random.Random(9)
    objects, relations = [], []
    for image in range(60):
        n = draw.randrange(1, 8)
        objects += [(image, k, "x", 0, 0, 1, 1, 1.0, []) for k in range(n)]
        relations += [(image, draw.randrange(n), "r", draw.randrange(n)) for _ in range(draw.randrange(9))]
    schema = "image_id long, obj_idx int, label string, x1 int, y1 int, x2 int, y2 int, det_score double, attributes array<string>"
    scene = Scene(None, spark.createDataFrame(objects, schema), spark.createDataFrame(relations, "image_id long, head int, rel string, target int"), None, None)
    edges = {}
    for r in graph.single_edges(scene).collect():
        edges.setdefault(r.image_id, []).append((r.head, r.rel, r.target))
    found = {}
    for r in sorted(graph.topological(scene).collect()):
        found.setdefault((r.image_id, r.component), []).append((r.place, r.obj_idx))
    assert sum(len(x) for x in found.values()) == len(objects)
    cycles = 0
    for (image, _), order in found.items():
        nodes = sorted(n for _, n in order)
        want = graph._order(nodes, [e for e in edges.get(image, []) if e[0] in nodes])
        assert [n for _, n in sorted(order)] == want
        cycles += want != sorted(want) and any(e[0] == e[2] for e in edges.get(image, []))
    assert cycles


def test_models_are_asked_once(spark, tmp_path):
    from pyspark.sql.types import StructType

    from prismloom.operators import models

    log, broken, cache = tmp_path / "log", tmp_path / "broken", str(tmp_path / "cache")
    log.mkdir()
    broken.write_text("")

    def model(inputs):
        import uuid

        if any(r["text"] == "bad" for r in inputs) and broken.exists():
            raise RuntimeError("no answer")
        (log / uuid.uuid4().hex).write_text("\n".join(f"{r['text']}" for r in inputs))
        return [{"length": len(r["text"] or "")} for r in inputs]

    texts = [f"t{k % 30}" for k in range(90)] + ["bad", None, "bad"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").repartition(3)
    answer = StructType().add("length", "integer")
    runs = models.run_batches(rows, ["text"], model, answer, cache, batches=4, at_once=7)
    next(runs)  # interrupted behind the first batch
    runs.close()
    first = models.answered(rows, ["text"], cache).where("answer is not null").count()
    assert 0 < first < 90
    out = models.asked(rows, ["text"], model, answer, cache, batches=4, at_once=7, tries=2)
    assert {(r.text, r.answer and r.answer.length, r.attempts) for r in out.collect()} == {(t, len(t or ""), 1) for t in texts if t != "bad"} | {("bad", None, 2)}
    assert [(r.attempts, r.error) for r in models.retry_table(spark, cache).collect()] == [(2, "RuntimeError: no answer")]
    broken.unlink()
    again = models.asked(rows, ["text"], model, answer, cache, batches=4, at_once=7, tries=3)
    assert again.where("answer is null").count() == 0
    asked = Counter(t for f in log.iterdir() for t in f.read_text().split("\n"))
    assert set(asked.values()) == {1} and len(asked) == 32


def test_old_keys_of_a_stream_are_forgotten(spark, tmp_path):
    from prismloom.streaming import incremental

    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    schema = "id long, at timestamp"

    def feed(rows):
        spark.createDataFrame(rows, "id long, at string").selectExpr("id", "cast(at as timestamp) at").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = incremental.generate_stream(stream, lambda batch: batch, out, str(tmp_path / "c"), ["id"], time="at", kept="1 hour")
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    day = "2026-01-01 "
    assert feed([(k, day + "10:00:00") for k in range(20)]) == 20
    assert feed([(3, day + "10:30:00"), (99, day + "15:00:00")]) <= 21
    assert feed([(99, day + "15:10:00"), (100, day + "15:20:00")]) == 2  # the twenty of ten o'clock are gone
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(20), 99, 100]


@pytest.mark.parametrize("ask", ["fitting", "object_questions", "attribute_questions", "relation_questions"])
def test_references_are_grouped_where_their_images_are(spark, small, ask):
    plan = getattr(graph, ask)(rich_scene(spark, small), 2)._jdf.queryExecution().executedPlan().toString()
    by = {re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)}
    assert "image_id" in by and by <= {"image_id", "l_partkey", "p_partkey"}


@pytest.mark.parametrize("ask", ["fitting", "object_questions", "attribute_questions", "relation_questions"])
def test_references_are_never_sorted_or_hashed_by_a_task(spark, small, ask):
    plan = getattr(graph, ask)(rich_scene(spark, small), 2)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"(?:Aggregate\(keys=|Sort )\[(.*?)\]", plan)
    assert keys and not any(re.search("reference|component|other", k) for k in keys)


@pytest.mark.parametrize("batch", [1, 3])
def test_batches_of_an_image_that_makes_many_rows(spark, small, monkeypatch, batch):
    scene = rich_scene(spark, small)
    part = Scene(scene.images, scene.objects.where("image_id < 40"), scene.relations.where("image_id < 40"), scene.attribute_vocab, scene.object_vocab)
    whole = sorted(graph.relation_questions(part, 2).collect())
    monkeypatch.setattr(graph, "BATCH", batch)
    assert whole and sorted(graph.relation_questions(part, 2).collect()) == whole


@pytest.mark.parametrize("read", [driver_scene, rich_scene])
def test_tasks_of_images_follow_the_input(spark, small, monkeypatch, read):
    monkeypatch.setattr(scenes, "TASK_OBJECTS", 500)
    held = read(spark, small).objects.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) > 5000 and max(r["count"] for r in held) < 1000


def test_captions_read_objects_and_relations_once(spark, small):
    plan = graph.image_captions(rich_scene(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 2


def test_references_that_read_alike_are_one(spark):
    objects = spark.createDataFrame([(1, 0, "rod", ["red"]), (1, 1, "small bolt", ["dark"]), (1, 2, "bolt", ["dark small"]), (1, 3, "rod", None)], "image_id long, obj_idx int, label string, attributes array<string>")
    relations = spark.createDataFrame([(1, 0, "near", 1), (1, 3, "near", 2), (1, 0, "on", 3), (1, 2, "by", 7)], "image_id long, head int, rel string, target int")
    scene = Scene(objects.select("image_id").distinct(), objects, relations.where("target < 7"), spark.createDataFrame([("red", "color")], "attribute string, category string"), spark.createDataFrame([("rod", 1)], "object string, countable int"))
    found = {r.reference: r.n for r in graph.fitting(scene, 2).collect()}
    assert found["object that is near the dark small bolt"] == 2 and found["red object that is near the small bolt"] == 1
    assert found["object that the red rod is on"] == 1
    loose = Scene(scene.images, objects, relations, scene.attribute_vocab, scene.object_vocab)
    assert {r.reference: r.n for r in graph.fitting(loose, 2).collect()} == found  # a relation to no object says nothing


@pytest.mark.parametrize(("images", "n"), [(2000, 8), (90, 30)])
def test_more_tuples_than_64_bits_hold(spark, images, n):
    index = spark.range(images).selectExpr("'a' as label", "id as image_id").unionByName(spark.range(n).selectExpr("'b' as label", "id as image_id"))
    assert comb(images, n) > 2**63
    found = tuples.uniform_tuples(index, ["label"], n, 20, "wide").collect()
    assert sorted(r.no for r in found) == list(range(20))
    assert all(len({r[f"image_id_{k}"] for k in range(n)}) == n for r in found)
