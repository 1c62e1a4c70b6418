import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismloom.functions import boxes, draws, grammar, words
from prismloom.operators import graph, metrics, multi, parse, records, shaping, single
from prismloom.plans.scene import Scene
from prismloom.sources import annotations, files, sinks
from prismloom.streaming import incremental

COUNTS = {
    "ExistsObject": 175, "ExistsAttribute": 175, "MostObject": 675, "LeastObject": 675, "LeftMostObject": 675, "RightMostObject": 675, "TopMostObject": 675, "BottomMostObject": 675, "AttributeBBox": 80,
    "TypedAttributeBBox": 80, "ExistsRelation": 30, "RelationBBox": 30, "HeadRelation": 100, "CloserObject": 2025, "CloserPoint": 2025, "FartherObject": 1650, "FartherPoint": 1650, "CloserToAnchorObject": 675,
    "FartherToAnchorObject": 550, "SameObjectSeg": 250, "DiffObjectSeg": 250, "HasObject": 15, "HasNotObject": 15, "HasAttributedObject": 15, "HasNotAttributedObject": 15, "HasMostObject": 60, "HasLeastObject": 60,
    "HasRelation": 10, "HasNotRelation": 10, "CommonObject": 135, "CommonAttribute": 90, "CountObject": 900, "CountAttributeObject": 900, "CompareAttribute": 60, "CompareRelation": 60,
}


def test_template_counts():
    assert {g: len(grammar.expand(g)) for g in grammar.families()} == COUNTS
    assert grammar.expand("ExistsObject")[0] == ("How many {name}?", "{count}")
    assert grammar.slots_of("{a} of {b} {a}") == ["a", "b"]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize("names,text", [((), ""), (("a",), "a"), (("a", "b"), "a and b"), (("a", "b", "c"), "a, b, and c")])
def test_and_list(spark, names, text):
    assert value(spark, words.and_list(strings(*names))) == text


@pytest.mark.parametrize("noun,many", [("box", "boxes"), ("baby", "babies"), ("toy", "toys"), ("knife", "knives"), ("man", "men"), ("tennis ball", "tennis balls"), ("cliff", "cliffs"), ("bush", "bushes")])
def test_plural(spark, noun, many):
    assert value(spark, words.plural(F.lit(noun))) == many


def test_wording(spark):
    assert words.number_words(342) == "three hundred and forty-two" and words.number_words(1_005) == "one thousand and five"
    assert value(spark, words.count_word(F.lit(21), F.lit(True))) == "twenty-one" and value(spark, words.count_word(F.lit(21), F.lit(False))) == "21"
    assert [value(spark, words.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 22)] == ["1st", "2nd", "3rd", "4th", "11th", "22nd"]
    assert value(spark, words.article(F.lit("apple"))) == "an apple" and value(spark, words.article(F.lit("unicorn"))) == "a unicorn"
    assert value(spark, words.sentence_case(F.lit("hello World"))) == "Hello world"
    assert value(spark, words.filled(F.lit("{a} and {b}"), {"a": F.lit("x"), "b": F.lit("y")})) == "x and y"
    assert value(spark, words.region_number(F.lit("see region12"))) == 11 and value(spark, words.region_number(F.lit("none"))) == -1
    assert value(spark, words.judge_pair(F.lit("8, 9.5\nbecause"))) == [8.0, 9.5] and value(spark, words.judge_pair(F.lit("no"))) == [-1.0, -1.0]
    assert value(spark, words.yes_score(F.lit("Yes, it is."))) == 1 and value(spark, words.yes_score(F.lit("yesterday"))) == 0
    assert value(spark, words.options(strings("x", "y"), F.lit(0))) == ["A. x", "B. y"] and value(spark, words.options(strings("x"), F.lit(1), numeric=True)) == ["(1) x"]
    assert value(spark, words.count_choices(F.lit(1).cast("long"))) == [1, 2, 3, 4] and value(spark, words.count_choices(F.lit(5).cast("long"))) == [5, 4, 6, 7]


def test_boxes(spark):
    frame = spark.createDataFrame([(0, 0, 10, 10, 10, 0, 20, 10), (0, 0, 10, 10, 0, 0, 10, 10), (0, 0, 10, 10, 5, 20, 15, 30)], "ax1 int, ay1 int, ax2 int, ay2 int, bx1 int, by1 int, bx2 int, by2 int")
    found = frame.select(boxes.overlaps("a", "b").alias("o"), boxes.overlaps("a", "b", "x").alias("x"), boxes.includes("a", "b").alias("i"), boxes.iou("a", "b").alias("iou")).collect()
    assert [tuple(r) for r in found] == [(False, False, False, 0.0), (True, True, True, 1.0), (False, True, False, 0.0)]
    text = spark.range(1).select(boxes.ratio_text([F.lit(x) for x in (4, 57, 265, 360)], [F.lit(x) for x in (401, 400, 401, 400)])).first()[0]
    assert text == "(0.01, 0.14, 0.66, 0.9)"


@pytest.fixture(scope="module")
def scene(spark):
    objects = [(1, 0, "cat", 0, 0, 10, 10, 0.9, ["black"]), (1, 1, "mat", 20, 0, 40, 12, 0.8, []), (1, 2, "cat", 50, 0, 60, 10, 0.7, ["black"]), (1, 3, "lamp", 70, 40, 80, 60, 0.2, ["tall", "red"]), (2, 0, "cat", 0, 0, 5, 5, 0.5, ["white"])]
    edges = [(1, 0, "on", 1), (1, 2, "on", 1), (1, 0, "beside", 1), (1, 1, "under", 0)]
    return Scene(
        spark.createDataFrame([(1, 100, 100), (2, 100, 100), (3, 100, 100)], "image_id long, width int, height int"),
        spark.createDataFrame(objects, "image_id long, obj_idx int, label string, x1 int, y1 int, x2 int, y2 int, det_score double, attributes array<string>"),
        spark.createDataFrame(edges, "image_id long, head int, rel string, target int"),
        spark.createDataFrame([("black", "color"), ("white", "color"), ("red", "color"), ("tall", "size")], "attribute string, category string"),
        spark.createDataFrame([("cat", 1), ("lamp", 1), ("mat", 0)], "object string, countable int"),
    )


def test_questions_on_one_image(scene):
    assert {(r.image_id, r.name, r.answer) for r in single.exists_object(scene).collect()} == {(1, "cats", 2), (1, "lamp", 1), (2, "cat", 1)}
    most = single.most_object(scene).collect()
    assert [(r.image_id, r.answer, sorted(r.candidates)) for r in most] == [(1, "cat", ["cat", "lamp"])]
    assert [(r.answer) for r in single.least_object(scene).collect()] == ["lamp"]
    heads = single.head_of_relation(scene).collect()
    assert {(r.object2, r.relation, r.answer) for r in heads} == {("mat", "on", "cat"), ("mat", "beside", "cat"), ("cat", "under", "mat")}
    for r in single.attribute_of_box(scene).collect():
        assert r.answer in r.candidates and len(set(r.candidates)) == len(r.candidates)


def test_components_and_captions(scene):
    parts = {(r.image_id, r.obj_idx): r.component for r in graph.components(scene).collect()}
    assert parts == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (2, 0): 0}
    text = {r.image_id: r.description for r in graph.image_captions(scene).collect()}
    assert text[2] == "There is a white cat."
    assert text[1].startswith("There is a red and tall lamp.") and "the mat" in text[1].lower()
    assert {r.size for r in graph.decomposed(scene).collect()} == {1, 3}


def test_caption_wording():
    assert graph.component_caption({0: ("dog", [], False), 1: ("dog", [], False), 2: ("trees", ["green"], True)}, [(0, "near", 1), (1, "under", 2)]) == "the 1st dog is near the 2nd dog;\nthe 2nd dog is under the green trees."


def test_graph_text_round_trip(scene):
    texts = parse.graph_texts(scene)
    assert {tuple(r) for r in parse.holistic_triples(texts).collect()} == {tuple(r) for r in scene.relations.collect()}
    assert {(r.obj_idx, r.label) for r in parse.object_lines(texts).where("image_id = 1").collect()} == {(0, "cat"), (1, "mat"), (2, "cat"), (3, "lamp")}


def test_parsers_leave_out_what_they_cannot_read(spark):
    texts = spark.createDataFrame([(1, "Relations:\nregion1: region2 on, region3 near\nnonsense\nregion4"), (2, "no relations"), (3, None)], "image_id long, text string")
    assert {tuple(r) for r in parse.holistic_triples(texts).collect()} == {(1, 0, "on", 1), (1, 0, "near", 2)}
    by_relation = spark.createDataFrame([(1, "region1: on: region2, region3; bad; near: region4")], "image_id long, text string")
    assert {tuple(r) for r in parse.triples_by_relation(by_relation).collect()} == {(1, 0, "on", 1), (1, 0, "on", 2), (1, 0, "near", 3)}
    detailed = spark.createDataFrame([(1, 0, "region2 on, near region3, none")], "image_id long, head int, text string")
    assert {tuple(r) for r in parse.detailed_triples(detailed).collect()} == {(1, 0, "on", 1), (1, 0, "near", 2)}
    answer = spark.createDataFrame([("Sure: {'k': 3} ok",), ("none",)], "t string").select(parse.embedded_json(F.col("t"), "k int")["k"].alias("k"))
    assert [r.k for r in answer.collect()] == [3, None]


def test_edits(spark, scene):
    edits = spark.createDataFrame([(1, 0, "likes", 3, "add"), (1, 0, "on", 1, "remove")], "image_id long, head int, rel string, target int, op string")
    renames = spark.createDataFrame([(1, 3, "light"), (1, 1, "")], "image_id long, obj_idx int, name string")
    edges, names = parse.edited(scene.relations, scene.objects.select("image_id", "obj_idx", "label"), edits, renames)
    assert {(r.head, r.rel, r.target) for r in edges.collect()} == {(0, "likes", 3), (2, "on", 1), (0, "beside", 1), (1, "under", 0)}
    assert {r.label for r in names.collect()} == {"cat", "mat", "light"}


def test_multiple_choice(spark):
    asked = spark.createDataFrame([(k, "Q?", "b", ["a", "b", "c"], "b") for k in range(40)], "k int, prompt string, response string, candidates array<string>, answer string")
    found = records.multiple_choice(asked, "t", ["k"]).collect()
    assert all(r.response in r.prompt and r.response.endswith("b") for r in found) and len({r.prompt for r in found}) > 10
    kept = records.multiple_choice(asked, "t", ["k"], share=0.0).collect()
    assert all(r.prompt == "Q?" for r in kept)


def test_conversation_and_interleaving(spark):
    q = spark.createDataFrame([(1, "Q?", "A")], "k int, prompt string, response string")
    turns = records.conversation(q, "t", ["k"], F.array(F.lit("a"), F.lit("b"))).first().conversations
    assert turns[0]["value"] == "<image> <image>\nQ?" and turns[1]["from"] == "gpt"
    assert value(spark, records.interleaved(F.lit("a # b # c #"), "#", strings("1", "2"))) == "a 1 b 2 c "


def test_numbered_and_sized(spark):
    df = spark.range(500)
    assert sorted(r.no for r in records.numbered(df, ["id"], buckets=16, name="no").collect()) == list(range(500))
    for n in (0, 3, 500, 1203):
        assert draws.to_size(df, n, 500, "t", ["id"]).count() == n


def test_suppression_and_assignment(spark):
    detections = spark.createDataFrame([(1, 0, 0.9, 0, 0, 10, 10), (1, 1, 0.8, 1, 0, 10, 10), (1, 2, 0.7, 50, 50, 60, 60), (1, 3, 0.01, 80, 80, 90, 90)], "image_id long, obj_idx int, det_score double, x1 int, y1 int, x2 int, y2 int")
    assert [r.obj_idx for r in metrics.filtered_detections(detections).orderBy("obj_idx").collect()] == [0, 2]
    other = detections.where("obj_idx < 3").withColumn("obj_idx", F.col("obj_idx") + 10)
    found = {(r.ref, r.cand): r.iou for r in metrics.greedy_assignment(detections.where("obj_idx <> 1"), other).collect()}
    assert found == {(0, 10): 1.0, (2, 12): 1.0}


def test_evaluator_registry():
    metrics.register("mine")(lambda t, p: t)
    with pytest.raises(ValueError):
        metrics.register("mine")(lambda t, p: t)
    assert "mine" in metrics.evaluators() and callable(metrics.evaluator("triplet_recall"))


def test_box_coverage_without_truth(spark):
    schema = "image_id long, x1 int, y1 int, x2 int, y2 int"
    truth, predicted = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 0, 0, 10, 10)], schema), spark.createDataFrame([(1, 0, 0, 10, 9), (3, 0, 0, 1, 1)], schema)
    assert {r.image_id: r.coverage for r in metrics.box_coverage(truth, predicted).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}


def write_json(path, data):
    path.write_text(json.dumps(data))
    return str(path)


def test_annotation_files(spark, tmp_path):
    one = {"a": {"data_path": "x/a.jpg", "source": "s", "annotation": {"width": 10, "height": 20, "labels": ["cat", "dog"], "bboxes": [[0, 0, 5, 5], [1, 1, 2, 2]]}}, "b": {"data_path": "b.jpg", "source": None, "annotation": {"width": 4, "height": 4, "labels": [], "bboxes": []}}}
    two = {"a": {"annotation": {"width": 11, "height": 20, "attributes": [["red and big", "odd"], ["grey"]], "relations": [[0, "near", 1], [1, "of", 0]]}}}
    first, second = (annotations.read_keyed(spark, write_json(tmp_path / f"{k}.json", d)) for k, d in enumerate((one, two)))
    merged = annotations.merge([first, second])
    assert {r.image_id: (r.width, r.row_idx, r.source) for r in merged.collect()} == {"a": (11, 0, "s"), "b": (4, 1, None)}
    vocab = spark.createDataFrame([("red", "color"), ("big", "size"), ("gray", "color")], "attribute string, category string")
    scene = annotations.scene_of(merged, vocab, spark.createDataFrame([("cat", 1)], "object string, countable int"))
    assert {(r.obj_idx, r.label, tuple(r.attributes), r.x2) for r in scene.objects.collect()} == {(0, "cat", ("big", "red"), 5), (1, "dog", (), 2)}
    assert [(r.head, r.rel, r.target) for r in scene.relations.collect()] == [(0, "near", 1)]
    gray = annotations.scene_of(merged, vocab, scene.object_vocab, gray_first=True)
    assert ("gray",) in {tuple(r.attributes) for r in gray.objects.collect()}
    with pytest.raises(Exception, match="first file lacks"):
        annotations.merge([second, first]).collect()
    assert value(spark, annotations.image_id(F.lit("p/q/im.1.jpg"))) == "im"


def test_file_sources(spark, tmp_path):
    assert files.expanded("p-{08..10}.parquet") == ["p-08.parquet", "p-09.parquet", "p-10.parquet"]
    spark.range(3).write.parquet(str(tmp_path / "p-0"))
    spark.range(2).write.parquet(str(tmp_path / "p-1"))
    assert files.read_parquet_list(spark, str(tmp_path / "p-{0..1}")).count() == 5
    doc = {"images": [{"id": 1, "file_name": "a", "width": 5, "height": 5}, {"id": 2, "file_name": "b", "width": 5, "height": 5}], "annotations": [{"id": 7, "image_id": 1, "bbox": [1, 1, 2, 2]}]}
    assert [(r.id, r.x2) for r in files.coco(spark, write_json(tmp_path / "coco.json", doc)).collect()] == [(7, 3)]
    doc["annotations"] *= 2
    with pytest.raises(ValueError, match="not unique"):
        files.coco(spark, write_json(tmp_path / "twice.json", doc))
    np.save(tmp_path / "depth.npy", np.arange(6, dtype=np.uint8).reshape(2, 3))
    assert files.array_pixels(spark, str(tmp_path / "depth.npy")).agg({"value": "sum"}).first()[0] == 15
    np.save(tmp_path / "masks.npy", np.array([[[1, 0]], [[1, 1]]], bool))
    assert {(r.x, r.obj_idx) for r in files.label_mask(files.array_pixels(spark, str(tmp_path / "masks.npy"))).collect()} == {(0, 1), (1, 1)}
    mix = files.read_mix(spark, [{"type": "parquet", "path": str(tmp_path / "p-0"), "name": "zero"}, {"type": "parquet", "path": str(tmp_path / "p-1")}])
    assert {(r.source, r["count"]) for r in mix.groupBy("source").count().collect()} == {("zero", 3), ("parquet", 2)}
    with pytest.raises(ValueError, match="no reader"):
        files.read_mix(spark, [{"type": "nope", "path": ""}])
    assert files.repeated(spark.range(3), 2).count() == 6


def test_tar_members(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        info = tarfile.TarInfo("x/y.txt")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"hi"))
    assert [(r.name, bytes(r.content)) for r in files.tar_members(spark, str(tmp_path / "a.tar")).collect()] == [("x/y.txt", b"hi")]


def test_resume_and_upsert(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.append_missing(spark.range(5), path, ["id"])
    sinks.append_missing(spark.range(8), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in sinks.upserted(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    rows = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,)], "k int")
    assert {r.k for r in sinks.complete_ids(rows, "k").collect()} == {1, 2}


def test_mask_images(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 1, None)], "image_id long, y int, x int, obj_idx int")
    assert bytes(sinks.mask_images(pixels).first().png)[:4] == b"\x89PNG"


def test_streams(spark, small, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(10).write.parquet(str(source))
    stream = spark.readStream.schema("id long").parquet(str(source))
    double = lambda batch: batch.select("id", (F.col("id") * 2).alias("twice"))
    incremental.generate_stream(stream, double, out, str(tmp_path / "c"), ["id"]).awaitTermination()
    spark.range(5, 12).write.mode("append").parquet(str(source))
    incremental.generate_stream(stream, double, out, str(tmp_path / "c"), ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(12))
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    counts = incremental.running_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "event", "event_type")
    counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").agg({"cnt": "sum"}).first()[0] == events.count()


def test_several_images(scene):
    assert {(r.object, r.answer) for r in multi.count_object(scene).collect()} == {("cat", 3)}
    (r,) = multi.has_attributed_object(scene).collect()
    assert r.object == "cat" and r.attribute in ("black", "white") and (r.image_id_0, r.image_id_1)[r.answer] == (1 if r.attribute == "black" else 2)
    assert {(r.object, r.with_id != r.without_id) for r in multi.has_not_object(scene).collect()} >= {("cat", True)}


def test_hot_groups_are_cut_into_ranges(spark, monkeypatch):
    """One label on all images: tuples of neighbours and pairs with and without are those of one sort, though ranges are small."""
    import hashlib

    from prismloom.functions import draws
    from prismloom.operators import multi

    monkeypatch.setattr(multi, "RANGE", 10)
    key = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    images = list(range(500))
    for by in (["label"], []):
        frame = spark.createDataFrame([(i, "a", i % 7) for i in images], "image_id long, label string, cnt int")
        for n in (2, 3):
            order = sorted(images, key=lambda i: (key("op", *["a"][: len(by)], i), i))
            found = {tuple(r[f"image_id_{k}"] for k in range(n)) for r in multi.neighbours(frame, by, "op", ["cnt"], n).collect()}
            assert found == {tuple(order[k : k + n]) for k in range(500 - n + 1)}
    places = multi.ranked(frame.select("image_id", "label"), ["label"], draws.key("op", "label", "image_id"))
    assert places.withColumn("part", F.substring(draws.key("op", "label", "image_id"), 1, 3)).groupBy("part").count().agg(F.max("count")).first()[0] <= 5

    held = [(i, "a") for i in images if i % 5] + [(i, "b") for i in range(40)]
    pairs = multi._with_and_without(spark.createDataFrame(held, "image_id long, label string"), frame.select("image_id"), [], ["label"], "op").collect()
    want = set()
    for label in "ab":
        having = sorted((i for i, x in held if x == label), key=lambda i: (key("op|with_id", label, i), i))
        lacking = sorted(set(images) - set(having), key=lambda i: (key("op|without_id", i), i))
        want |= {(label, a, b) for a, b in zip(having, lacking)}
    assert {(r.label, r.with_id, r.without_id) for r in pairs} == want and len(pairs) == len(want)


def test_images_that_lack_are_found_in_their_part(spark, monkeypatch):
    import random

    import pyarrow as pa

    from prismloom.operators import multi

    draw, names = random.Random(3), ["a", "b", "c", "d"]
    lists = [[{"image_id": 100 * k + i, "held": draw.sample(names, draw.choice([0, 1, 2, 4]))} for i in range(draw.choice([1, 3, 40]))] for k in range(30)]
    needed = [[{"what": w, "k": draw.randrange(50), "m": n} for w in names if (n := draw.randint(0, sum(w not in x["held"] for x in each)))] for each in lists]
    want = [[{"what": q["what"], "k": q["k"] + i, "without_id": x} for q in ask for i, x in enumerate([x["image_id"] for x in each if q["what"] not in x["held"]][: q["m"]])] for each, ask in zip(lists, needed, strict=True)]
    kinds = pa.list_(pa.struct([("image_id", pa.int64()), ("held", pa.list_(pa.string()))])), pa.list_(pa.struct([("what", pa.string()), ("k", pa.int64()), ("m", pa.int64())]))
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(multi, "IMAGES", most)
        found = multi._lacking(pa.array(lists, kinds[0]), pa.array(needed, kinds[1]))
        assert found.to_pylist() == want


def test_pairs_with_and_without_within_groups(spark, monkeypatch):
    import hashlib
    import random

    from prismloom.operators import multi

    calls = []
    monkeypatch.setattr(multi, "stored", lambda df, f=multi.stored, **more: calls.append(more) or f(df, **more))
    key = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    draw = random.Random(4)
    rows = sorted({(draw.choice("pq"), draw.choice("uvwxyz"), draw.randrange(300)) for _ in range(900)})
    having = spark.createDataFrame(rows, "pair string, rel string, image_id long")
    found = multi._with_and_without(having, having, ["pair"], ["pair", "rel"], "op")
    want = []
    for pair, rel in sorted({r[:2] for r in rows}):
        own = {i for p, x, i in rows if (p, x) == (pair, rel)}
        lacking = sorted({i for p, _, i in rows if p == pair} - own, key=lambda i: (key("op|without_id", pair, i), i))
        want += [(pair, rel, a, b) for a, b in zip(sorted(own, key=lambda i: (key("op|with_id", pair, rel, i), i)), lacking)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert calls == [{"within": True}]  # one table is stored


def test_shuffles_of_stored_tables_are_not_kept(spark):
    import time
    from pathlib import Path

    from prismloom.sources.scratch import stored

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before, settings = files(), ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    were = [spark.conf.get(k, None) for k in settings]
    assert len(stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), within=True).collect()) == 7
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and [spark.conf.get(k, None) for k in settings] == were


def test_subsets_of_many_attributes(spark):
    from prismloom.operators import graph

    row = spark.range(1).select(F.transform(F.sequence(F.lit(10), F.lit(22)), lambda x: x.cast("string")).alias("a")).select(*[graph._subsets(F.col("a"), k).alias(f"s{k}") for k in range(4)]).first()
    assert [len(set(map(tuple, x))) for x in row] == [1, 13, 78, 286] and ["10", "11", "22"] in row.s3


def test_other_relations_follow_a_drawn_place(spark):
    """Wrong answers are the names that follow a drawn place in a drawn order, round to it, without the row's own."""
    import hashlib
    from types import SimpleNamespace

    from prismloom.operators import single

    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    names = [f"rel{k}" for k in range(30)]
    owned = {1: ["rel3"], 2: names[:29], 3: names, 4: names[5:20] + ["rel5"]}
    scene = SimpleNamespace(relations=spark.createDataFrame([(n,) for n in names * 2], "rel string"))
    own = spark.createDataFrame(list(owned.items()), "image_id long, own array<string>")
    found = {r.image_id: r.others for r in single._other_relations(own, scene, "t", ["image_id"], 3).collect()}
    order = sorted(names, key=lambda n: (md5(f"t|names|{n}"), n))
    for image_id, mine in owned.items():
        start = int(int(md5(f"t|start|{image_id}")[:8], 16) / 4294967296 * len(order))
        assert found[image_id] == [n for n in order[start:] + order[:start] if n not in mine][:3]
    empty = SimpleNamespace(relations=scene.relations.limit(0))
    assert [r.others for r in single._other_relations(own.where("image_id = 1"), empty, "t", ["image_id"], 3).collect()] == [[]]


def test_answers_that_cannot_be_read_say_nothing(spark):
    texts = spark.createDataFrame(
        [
            (1, "Objects:\nregion1: cat\nregion2: mat is red\n\nRelations:\ns: region2 on, region3 near"),
            (2, "Objects:\nregion1: cat\nodd line\nregion3: dog\n\nRelations:\nregion1: region3 under\ns: region2 lost"),
            (3, "Objects:\nregion1: cat"),
            (4, "Relations:\nregion1: region2 on"),
            (5, "Objects:\nregion1: a\nRelations:\nregion1: region2 on\nRelations:\nregion1: region2 on"),
            (6, None),
            (7, ""),
        ],
        "image_id long, text string",
    )
    found = {tuple(r) for r in parse.parsed_relations(texts).select("image_id", "head", "rel", "target").collect()}
    assert found == {(1, 0, "on", 1), (1, 0, "near", 2), (2, 0, "under", 2)}
    assert {tuple(r) for r in parse.parsed_objects(texts).select("image_id", "obj_idx", "name").collect()} == {(1, 0, "cat"), (1, 1, "mat is red"), (2, 0, "cat"), (2, 2, "dog")}
    assert parse.parsed_relations(texts, most=1).groupBy("image_id").count().where("count > 1").isEmpty()


def test_panoptic_names(spark):
    names = spark.createDataFrame([("wall-other-brick-merged",), ("sky-stuff",), ("person",), (None,)], "n string")
    assert [r[0] for r in names.select(words.panoptic_name(F.col("n"))).collect()] == ["wall is brick", "sky", "person", None]


def test_inferences_without_a_region_are_left_out(spark):
    rows = spark.createDataFrame([(1, "region1", "before", 0, "a"), (1, "region1", "before", 1, None), (1, "region1", "after", 1, "c"), (1, "region1", "after", 0, "b")], "id long, subjects string, kind string, no int, text string")
    made = shaping.inference_turns(rows, {"before": ["Before {}?"], "after": ["After {}?"]}, ["List."]).first()
    assert [t["value"] for t in made.conversations] == ["After region1? List.", "b; c"]


def test_image_sizes(spark, tmp_path):
    for name, shape in (("a", (3, 5)), ("b", (1, 1))):
        (tmp_path / f"{name}.png").write_bytes(sinks.png(np.zeros(shape, np.uint8)))
    (tmp_path / "c.png").write_bytes(b"no image")
    assert {(r.path.rsplit("/", 1)[-1], r.width, r.height) for r in files.image_sizes(spark, str(tmp_path)).collect()} == {("a.png", 5, 3), ("b.png", 1, 1)}
