"""Questions about one image. Each function gives a row per question: image_id, the slots its templates use, candidates and answer.

Draws are by md5 of the operator's name and the row's keys (functions.draws). Arrays are sorted before anything is drawn
from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismloom.functions import boxes, draws, rasters, words
from prismloom.operators.multi import running
from prismloom.plans.scene import Scene

N_CHOICE = 4
DEPTH_GAP = 50


def exists_object(scene: Scene, only_countable: bool = True) -> DataFrame:
    """How many of a label there are."""
    counts = scene.label_counts(scene.countable() if only_countable else None)
    return counts.select(
        "image_id",
        "label",
        F.when(F.col("cnt") > 1, words.plural(F.col("label"))).otherwise(F.col("label")).alias("name"),
        F.when(F.col("cnt") > 1, "are").otherwise("is").alias("be"),
        F.col("cnt").alias("answer"),
        words.count_choices(F.col("cnt")).alias("candidates"),
    )


def _extreme(scene: Scene, most: bool, n_choice: int) -> DataFrame:
    own = scene.countable().join(scene.non_including().select("image_id", "obj_idx"), ["image_id", "obj_idx"], "left_semi")
    listed = scene.label_counts(own).groupBy("image_id").agg(
        (F.max_by("label", F.struct("cnt", -F.col("first_idx"))) if most else F.min_by("label", F.struct("cnt", "first_idx"))).alias("answer"),
        (F.max("cnt") if most else F.min("cnt")).alias("best"),
        F.sort_array(F.collect_list(F.struct("label", "cnt"))).alias("all"),
    )
    others = F.transform(F.filter("all", lambda x: x["cnt"] < F.col("best") if most else x["cnt"] > F.col("best")), lambda x: x["label"])
    drawn = listed.withColumn("others", others).where(F.size("others") > 0)
    op = "most_object" if most else "least_object"
    return drawn.select("image_id", "answer", "best", F.concat(F.array("answer"), draws.some(F.col("others"), n_choice - 1, op, "image_id")).alias("candidates"))


def most_object(scene: Scene, n_choice: int = N_CHOICE) -> DataFrame:
    """The countable label with most objects, against labels with fewer; the first seen of equals."""
    return _extreme(scene, True, n_choice)


def least_object(scene: Scene, n_choice: int = N_CHOICE) -> DataFrame:
    return _extreme(scene, False, n_choice)


#: Side -> axis on which the objects mustn't overlap, coordinate, and whether the smallest is meant.
SIDES = {"left": ("x", "x1", True), "right": ("x", "x2", False), "top": ("y", "y1", True), "bottom": ("y", "y2", False)}


def outermost_object(scene: Scene, side: str, n: int = 3) -> DataFrame:
    """Of each two or three labels apart on an axis, the one furthest to a side; the first of equals."""
    axis, coordinate, smallest = SIDES[side]
    groups, names = (scene.disjoint_triples(axis), "abc") if n == 3 else (scene.disjoint_pairs(axis), "ab")
    at = lambda p: F.col(f"{p}_{coordinate}")
    answer = F.col(f"{names[-1]}_label")
    for k in range(len(names) - 2, -1, -1):
        best = [at(names[k]) <= at(p) if smallest else at(names[k]) >= at(p) for p in names[k + 1 :]]
        answer = F.when(best[0] if len(best) == 1 else best[0] & best[1], F.col(f"{names[k]}_label")).otherwise(answer)
    return groups.select("image_id", *[f"{p}_obj_idx" for p in names], answer.alias("answer"), F.array(*[F.col(f"{p}_label") for p in names]).alias("candidates"))


def exists_attribute(scene: Scene) -> DataFrame:
    """How many objects carry the same attributes and label; objects without attributes are skipped."""
    kinds = scene.objects.where(F.size("attributes") > 0).groupBy("image_id", F.array_join(F.array_sort("attributes"), ", ").alias("attributes"), "label").agg(F.count(F.lit(1)).alias("cnt"))
    noun = F.when(F.col("cnt") > 1, words.plural(F.col("label"))).otherwise(F.col("label"))
    return kinds.select("image_id", F.concat_ws(" ", "attributes", noun).alias("name"), F.when(F.col("cnt") > 1, "are").otherwise("is").alias("be"), F.col("cnt").alias("answer"), words.count_choices(F.col("cnt")).alias("candidates"))


def attribute_of_box(scene: Scene, n_choice: int = N_CHOICE) -> DataFrame:
    """One attribute of each object with attributes, against the vocabulary's others."""
    vocab = scene.attribute_vocab.agg(F.sort_array(F.collect_set("attribute")).alias("vocab"))  # one row, the vocabulary
    sized = scene.objects.where(F.size("attributes") > 0).join(scene.images, "image_id").crossJoin(vocab)
    own = F.array_sort(F.array_distinct("attributes"))
    return sized.select(
        "image_id",
        "obj_idx",
        F.col("label").alias("name"),
        boxes.box_ratio_text("", F.col("width"), F.col("height")).alias("bbox"),
        draws.pick(own, "attribute_of_box", "image_id", "obj_idx").alias("answer"),
        draws.some(F.array_except("vocab", own), n_choice - 1, "attribute_of_box", "image_id", "obj_idx").alias("others"),
    ).withColumn("candidates", F.concat(F.array("answer"), "others")).drop("others")


def typed_attribute_of_box(scene: Scene, n_choice: int = N_CHOICE) -> DataFrame:
    """For each object and category of its attributes but "other": one of them, against the category's others."""
    vocab = scene.attribute_vocab.groupBy("category").agg(F.sort_array(F.collect_set("attribute")).alias("vocab"))
    typed = scene.attributes().where("category <> 'other'").groupBy("image_id", "obj_idx", "label", "category").agg(F.sort_array(F.collect_set("attribute")).alias("own")).join(vocab, "category")
    place = scene.objects.select("image_id", "obj_idx", "x1", "y1", "x2", "y2").join(scene.images, "image_id")
    keys = ("typed_attribute_of_box", "image_id", "obj_idx", "category")
    return (
        typed.join(place, ["image_id", "obj_idx"])
        .select("image_id", "obj_idx", F.col("category").alias("attribute_type"), F.col("label").alias("name"), boxes.box_ratio_text("", F.col("width"), F.col("height")).alias("bbox"), draws.pick(F.col("own"), *keys).alias("answer"), draws.some(F.array_except("vocab", "own"), n_choice - 1, *keys).alias("others"))
        .withColumn("candidates", F.concat(F.array("answer"), "others"))
        .drop("others")
    )


def _other_relations(own: DataFrame, scene: Scene, op: str, keys: list[str], n: int) -> DataFrame:
    """own(*keys, own, ...) with others: up to n names of relations that aren't among the array own.

    Names may be many, so no row meets all of them: they stand in a drawn order, a row starts at a drawn place and looks up
    the n + size(own) names that follow it, the last being followed by the first; at least n of them aren't its own.
    """
    names = scene.relations.select("rel").distinct().withColumn("drawn", draws.key(f"{op}|names", "rel")).withColumn("part", F.substring("drawn", 1, 3))
    placed = running(names, [], "part", ["drawn", "rel"], F.lit(1), "no").select((F.col("no") - 1).alias("place"), "rel")
    size = names.agg(F.count(F.lit(1)).alias("n_names"))  # one row
    start = F.floor(draws.uniform(f"{op}|start", *keys) * F.col("n_names"))
    steps = F.sequence(F.lit(0), F.least(F.col("n_names"), F.size(F.array_distinct("own")) + n).cast("int") - 1)
    asked = own.crossJoin(F.broadcast(size)).select(*keys, "own", start.alias("start"), "n_names", F.explode(steps).alias("step"))
    met = asked.withColumn("place", (F.col("start") + F.col("step")) % F.col("n_names")).join(placed, "place").where(~F.array_contains("own", F.col("rel")))
    found = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "rel"))).alias("found")).select(*keys, F.slice("found.rel", 1, n).alias("others"))
    return own.join(found, keys, "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))


def exists_relation(scene: Scene, n_choice: int = N_CHOICE) -> DataFrame:
    """How two labels that occur once relate; one of several relations is asked for, against relations they don't have."""
    keys = ["image_id", "object1", "object2"]
    own = scene.unique_edges().groupBy("image_id", F.col("head_label").alias("object1"), F.col("target_label").alias("object2")).agg(F.sort_array(F.collect_set("rel")).alias("own"))
    return (
        _other_relations(own, scene, "exists_relation", keys, n_choice - 1)
        .select(*keys, F.when(words.looks_plural(F.col("object1")), "are").otherwise("is").alias("be"), draws.pick(F.col("own"), "exists_relation", *keys).alias("answer"), "others")
        .withColumn("candidates", F.concat(F.array("answer"), "others"))
        .drop("others")
    )


def relation_of_boxes(scene: Scene, n_choice: int = N_CHOICE) -> DataFrame:
    """How two objects, given by their boxes, relate."""
    keys = ["image_id", "head", "target"]
    own = scene.relations.groupBy(*keys).agg(F.sort_array(F.collect_list("rel")).alias("own"))
    place = scene.objects.join(scene.images, "image_id").select("image_id", "obj_idx", boxes.box_ratio_text("", F.col("width"), F.col("height")).alias("bbox"))
    return (
        _other_relations(own, scene, "relation_of_boxes", keys, n_choice - 1)
        .join(place.select("image_id", F.col("obj_idx").alias("head"), F.col("bbox").alias("bbox1")), ["image_id", "head"])
        .join(place.select("image_id", F.col("obj_idx").alias("target"), F.col("bbox").alias("bbox2")), ["image_id", "target"])
        .select(*keys, "bbox1", "bbox2", draws.pick(F.col("own"), "relation_of_boxes", *keys).alias("answer"), "others")
        .withColumn("candidates", F.concat(F.array("answer"), "others"))
        .drop("others")
    )


def head_of_relation(scene: Scene, n_choice: int = N_CHOICE) -> DataFrame:
    """Which label has a relation to another, against the image's labels that haven't; a row for each that has."""
    heads = scene.edges().groupBy("image_id", F.col("target_label").alias("object2"), F.col("rel").alias("relation")).agg(F.sort_array(F.collect_set("head_label")).alias("heads"))
    labels = scene.objects.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    others = F.array_except(F.array_except("labels", "heads"), F.array("object2"))
    keys = ("head_of_relation", "image_id", "object2", "relation", "answer")
    return (
        heads.join(labels, "image_id")
        .withColumn("others", others)
        .where(F.size("others") > 0)
        .select("image_id", "object2", "relation", F.explode("heads").alias("answer"), "others")
        .withColumn("candidates", F.concat(F.array("answer"), draws.some(F.col("others"), n_choice - 1, *keys)))
        .drop("others")
    )


# Depth and segmentation: maps(image_id, depth, labels) with packed maps (functions.rasters); label 0 is no object, label k the object k - 1.


def _first_pair(points: DataFrame, farther: bool, gap: int) -> DataFrame:
    """Of points(image_id, p), taken two by two, the first two whose values differ by at least gap; the larger is closer."""
    no = F.sequence(F.lit(1), F.floor(F.size("p") / 2))
    pairs = F.when(F.size("p") > 1, F.transform(no, lambda k: F.struct(F.element_at("p", (2 * k - 1).cast("int")).alias("a"), F.element_at("p", (2 * k).cast("int")).alias("b"))))
    good = F.filter(pairs, lambda x: F.abs(x["a"]["value"] - x["b"]["value"]) >= gap)
    first = points.select("image_id", good.alias("good")).where(F.size("good") > 0).select("image_id", F.col("good")[0].alias("g"))
    near = F.col("g.a.value") > F.col("g.b.value")
    a, b = (F.struct(F.col(f"g.{s}.x").alias("x"), F.col(f"g.{s}.y").alias("y")) for s in "ab")
    out = first.select("image_id", F.when(near, a).otherwise(b).alias("closer"), F.when(near, b).otherwise(a).alias("farther"))
    return out.withColumn("answer", F.col("farther" if farther else "closer"))


def _prefix(op: str) -> F.Column:
    return F.concat_ws("|", F.lit(op), F.coalesce(F.col("image_id").cast("string"), F.lit("")))


def depth_points(maps: DataFrame, farther: bool = False, gap: int = DEPTH_GAP, tries: int = 10) -> DataFrame:
    """Two points of an image whose depths differ by at least gap, the larger closer: the first of `tries` drawn pairs that does.

    Pairs are adjacent in an order of the image's pixels by a key of each, of which only the first are kept.
    """
    return _first_pair(maps.select("image_id", rasters.keyed_points("depth", _prefix("depth_points"), F.lit(2 * tries)).alias("p")), farther, gap)


def depth_probes(maps: DataFrame, farther: bool = False, gap: int = DEPTH_GAP, tries: int = 10) -> DataFrame:
    """As depth_points, but the places are drawn by offset and only these are read: `tries` pairs cost the same on any image."""
    return _first_pair(maps.select("image_id", rasters.drawn_points("depth", _prefix("depth_probes"), F.lit(2 * tries)).alias("p")), farther, gap)


def object_depths(maps: DataFrame) -> DataFrame:
    """image_id, obj_idx and the most frequent depth of the object's pixels, the smallest of equals."""
    return maps.select("image_id", F.inline(rasters.object_depths("depth", "labels")))


def object_depth_pairs(scene: Scene, depths: DataFrame, farther: bool = False, gap: int = DEPTH_GAP) -> DataFrame:
    """Which of two labels apart is closer to the camera (larger depth)."""
    d = lambda p: depths.select("image_id", F.col("obj_idx").alias(f"{p}_obj_idx"), F.col("depth").cast("int").alias(f"{p}_depth"))
    pairs = scene.disjoint_pairs().join(d("a"), ["image_id", "a_obj_idx"]).join(d("b"), ["image_id", "b_obj_idx"]).where(F.abs(F.col("a_depth") - F.col("b_depth")) >= gap)
    near = F.col("a_depth") > F.col("b_depth")
    a, b = F.col("a_label"), F.col("b_label")
    out = pairs.select("image_id", "a_obj_idx", "b_obj_idx", F.when(near, a).otherwise(b).alias("closer"), F.when(near, b).otherwise(a).alias("farther"))
    return out.withColumn("answer", F.col("farther" if farther else "closer")).withColumn("candidates", F.array("closer", "farther"))


def object_depth_anchors(scene: Scene, depths: DataFrame, farther: bool = False, gap: int = DEPTH_GAP) -> DataFrame:
    """Of three labels apart in depth order: which of the outer two is closer in depth to the middle one.

    Rows need gaps to the middle that differ by at least `gap`. A drawn coin decides whether the middle object or the
    outer one nearer to it is the anchor.
    """
    d = lambda p: depths.select("image_id", F.col("obj_idx").alias(f"{p}_obj_idx"), F.col("depth").cast("int").alias(f"{p}_depth"))
    triples = scene.disjoint_triples()
    for p in "abc":
        triples = triples.join(d(p), ["image_id", f"{p}_obj_idx"])
    ordered = F.array_sort(F.array(*[F.struct(F.col(f"{p}_depth").alias("depth"), F.col(f"{p}_obj_idx").alias("idx"), F.col(f"{p}_label").alias("label")) for p in "abc"]))
    t = triples.select("image_id", "a_obj_idx", "b_obj_idx", "c_obj_idx", ordered.alias("o"))
    low, mid, high = (F.col("o")[k] for k in range(3))
    gap1, gap2 = mid["depth"] - low["depth"], high["depth"] - mid["depth"]
    t = t.where(F.abs(gap1 - gap2) >= gap)
    near, far = F.when(gap1 < gap2, low["label"]).otherwise(high["label"]), F.when(gap1 < gap2, high["label"]).otherwise(low["label"])
    coin = draws.uniform("object_depth_anchors", "image_id", "a_obj_idx", "b_obj_idx", "c_obj_idx") < 0.5
    out = t.select("image_id", "a_obj_idx", "b_obj_idx", "c_obj_idx", F.when(coin, mid["label"]).otherwise(near).alias("anchor"), F.when(coin, near).otherwise(mid["label"]).alias("closer"), far.alias("farther"))
    return out.withColumn("answer", F.col("farther" if farther else "closer")).withColumn("candidates", F.array("closer", "farther"))


def segment_points(maps: DataFrame, different: bool = False, by_rank: bool = False) -> DataFrame:
    """For each object: an anchor and another of its points, drawn, and of all points outside it the one whose distance from the anchor is closest to theirs.

    The two points have the first and the last key of the object's pixels or, by_rank, two drawn ranks, which costs two
    keys an object of any size. The point outside is looked for on rings around the distance; distances count to six
    digits, and of ties the first by x and y is taken.
    """
    found = (rasters.drawn_segment_points if by_rank else rasters.keyed_segment_points)("labels", _prefix("segment_points"))
    out = maps.select("image_id", F.inline(found)).withColumn("answer", F.col("diff_point" if different else "same_point"))
    return out.withColumn("candidates", F.array("same_point", "diff_point"))
