"""Questions about several images.

All pairs of images that share a label grow with the square of its frequency. Instead, the images of a group (a label,
a relation, ...) stand in a drawn order and each is joined with its successor: distinct images that share the group. What
qualifies is then kept, and the first n_sample in drawn order are the result.

A group may hold most of the images, so none meets in one task: its order is cut into ranges of the draw, whose counts
give the rows of a range their numbers, and successors are found in blocks of numbers that overlap by a tuple.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from prismloom.functions import draws, masks, words
from prismloom.plans.scene import Scene
from prismloom.plans.shipping import ship
from prismloom.sources.scratch import stored

#: Successive numbers of a group that one task orders.
RANGE = 10_000
#: Images of a batch that are looked through at once.
IMAGES = 1 << 20


def running(df: DataFrame, by: list[str], part: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group up to and with it, in the order of part, then order."""
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*by, part).agg(F.sum(value).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.sum(value).over(Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(starts, [*by, part]).withColumn(name, F.col("__start") + inside).drop("__start", part)


def ranked(df: DataFrame, by: list[str], drawn: Column, name: str = "no") -> DataFrame:
    """df with each image's number in the drawn order of its group, from 0. The draw, longer than most rows, is made again behind the shuffle."""
    keyed = df.withColumn("__part", F.substring(drawn, 1, 3))
    place = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(drawn, "image_id"))
    placed = keyed.repartition(*by, "__part").withColumn("__place", place)
    starts = keyed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n")).select(*by, "__part", _before("__n", by).alias("__start"))
    return placed.join(starts, [*by, "__part"]).withColumn(name, F.col("__start") + F.col("__place") - 1).drop("__part", "__place", "__start")


def _before(n: str, by: list[str]) -> Column:
    """The sum of n over the parts of a group before this one."""
    return F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def neighbours(df: DataFrame, by: list[str], op: str, carry: list[str], n: int = 2) -> DataFrame:
    """Tuples of n successive images of a group in drawn order: columns <c>_0 ... <c>_{n-1} for image_id and carry."""
    placed = ranked(df.select(*by, "image_id", *carry), by, draws.key(op, *by, "image_id")).withColumn("__block", F.floor(F.col("no") / RANGE))
    twice = (F.col("no") >= RANGE) & (F.col("no") % RANGE < n - 1)  # the first of a block also end the tuples of the block before
    held = F.when(twice, F.array("__block", F.col("__block") - 1)).otherwise(F.array("__block"))
    order = Window.partitionBy(*by, "__held").orderBy("no")
    ahead = [F.lead(c, k).over(order).alias(f"{c}_{k}") for k in range(n) for c in ("image_id", *carry)]
    tuples = placed.withColumn("__held", F.explode(held)).select(*by, "__block", "__held", *ahead)
    return tuples.where((F.col("__block") == F.col("__held")) & F.col(f"image_id_{n - 1}").isNotNull()).drop("__block", "__held")


def limited(df: DataFrame, n_sample: int | None, op: str, keys: list[str]) -> DataFrame:
    return df if n_sample is None else draws.sample_rows(df, n_sample, op, keys)


def _contents(scene: Scene) -> DataFrame:
    """image_id and its sorted labels: bounded by an image's objects."""
    return scene.objects.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def image_pairs(scene: Scene, op: str) -> DataFrame:
    """Each image with the next in a drawn order of all."""
    return neighbours(_contents(scene), [], op, ["labels"])


def has_object(scene: Scene, n_sample: int | None = None) -> DataFrame:
    """Which of two images has a label that only one has."""
    pairs = image_pairs(scene, "has_object")
    only0, only1 = F.array_except("labels_0", "labels_1"), F.array_except("labels_1", "labels_0")
    both = F.array_sort(F.concat(only0, only1))
    out = pairs.where(F.size(both) > 0).select("image_id_0", "image_id_1", draws.pick(both, "has_object", "image_id_0", "image_id_1").alias("object"), "labels_0")
    out = out.select("image_id_0", "image_id_1", "object", F.when(F.array_contains("labels_0", F.col("object")), 0).otherwise(1).alias("answer"))
    return limited(out, n_sample, "has_object", ["image_id_0", "image_id_1"])


def _attributes_of(scene: Scene) -> DataFrame:
    """label, image_id, sorted distinct attributes and the number of objects."""
    each = scene.objects.select("image_id", "label", "obj_idx", F.explode_outer("attributes").alias("attribute"))
    return each.groupBy("label", "image_id").agg(F.sort_array(F.collect_set("attribute")).alias("attributes"), F.count_distinct("obj_idx").alias("cnt"))


def has_attributed_object(scene: Scene, n_sample: int | None = None, negated: bool = False) -> DataFrame:
    """Of two images with a label, which has (or, negated, hasn't) it with an attribute that only one has."""
    op = "has_not_attributed_object" if negated else "has_attributed_object"
    pairs = neighbours(_attributes_of(scene), ["label"], op, ["attributes"])
    one = F.array_sort(F.concat(F.array_except("attributes_0", "attributes_1"), F.array_except("attributes_1", "attributes_0")))
    out = pairs.where(F.size(one) > 0).select(F.col("label").alias("object"), "image_id_0", "image_id_1", "attributes_0", draws.pick(one, op, "label", "image_id_0", "image_id_1").alias("attribute"))
    holder = F.when(F.array_contains("attributes_0", F.col("attribute")), 0).otherwise(1)
    out = out.select("object", "attribute", "image_id_0", "image_id_1", (1 - holder if negated else holder).alias("answer"))
    return limited(out, n_sample, op, ["object", "image_id_0", "image_id_1"])


def _lacking(images: pa.Array, needed: pa.Array) -> pa.Array:
    """Of lists of (image_id, held) and of needed (what, k, m): for each needed what the first m images that don't hold it, numbered from k."""
    parts = []
    for a, b in masks.in_parts(pc.list_value_length(images).to_numpy(zero_copy_only=False), IMAGES):
        each, need = images[a:b].flatten(), needed[a:b].flatten()
        first = masks.ends_of(pc.list_value_length(images[a:b]).to_numpy(zero_copy_only=False))
        asks = pc.list_value_length(needed[a:b]).to_numpy(zero_copy_only=False)
        held, (what, k, m) = pc.struct_field(each, "held"), (pc.struct_field(need, c) for c in ("what", "k", "m"))
        k, m = (x.to_numpy(zero_copy_only=False) for x in (k, m))
        owner = pc.list_parent_indices(held).to_numpy(zero_copy_only=False)
        names = pa.concat_arrays([pc.list_flatten(held), what]).dictionary_encode()
        code, some = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(names.dictionary)
        list_of = np.searchsorted(first, owner, "right") - 1
        own = list_of * some + code[: len(owner)]
        order = np.lexsort((owner, own))
        own, place = own[order], (owner - first[list_of])[order]
        asked_of = np.repeat(np.arange(b - a), asks)
        asked = asked_of * some + code[len(owner) :]
        low, high = np.searchsorted(own, asked), np.searchsorted(own, asked, "right")
        # the j-th place that holds it has place - j before it that don't: an l-th lacking one stands behind as many holders as have no more than l
        of = np.repeat(np.arange(len(low)), high - low)
        j = np.arange(len(of)) - masks.ends_of(high - low)[of]
        room = int(max(m.max(initial=0), place.max(initial=0))) + 1
        gaps = of * room + place[low[of] + j] - j
        question = np.repeat(np.arange(len(m)), m)
        lth = np.arange(len(question)) - masks.ends_of(m)[question]
        passed = np.searchsorted(gaps, question * room + lth, "right") - masks.ends_of(high - low)[question]
        found = pc.struct_field(each, "image_id").take(pa.array(first[asked_of[question]] + lth + passed))
        flat = pa.StructArray.from_arrays([what.take(pa.array(question)), pa.array(k[question] + lth), found], names=["what", "k", "without_id"])
        ends = np.concatenate(([0], np.cumsum(m)))[masks.ends_of(asks)]
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
    return pa.concat_arrays(parts)


def _with_and_without(having: DataFrame, universe: DataFrame, all_of: list[str], by: list[str], op: str) -> DataFrame:
    """Per group `by` pairs of the k-th drawn image of having and the k-th drawn image of universe (grouped by all_of) that having lacks.

    What a group lacks is never listed as a whole: as many images as have it are asked for at most. The drawn order of the
    universe, which its groups share, is cut into parts of the draw. Counts say how many images of a part lack what a group
    has and how many do before it, so each part is shuffled once, with what its images hold, and gives the numbers that are
    asked of it by itself. An image's row, with all it holds, is stored, as it is read more than once.
    """
    (what,) = (c for c in by if c not in all_of)
    group, parts = [*all_of, "image_id"], [*all_of, "__part"]
    rows = having.select(*group, what).groupBy(*group).agg(F.collect_set(what).alias("held"))
    if universe is not having:
        rows = universe.select(*group).distinct().join(rows, group, "left").withColumn("held", F.coalesce("held", F.array().cast(rows.schema["held"].dataType)))
    rows = stored(rows, within=True)
    ship(rows.sparkSession)
    asked = ranked(rows.select(*group, F.explode("held").alias(what)), by, draws.key(f"{op}|with_id", *by, "image_id"), "k").select(*by, "k", F.col("image_id").alias("with_id"))

    drawn = draws.key(f"{op}|without_id", *group)
    keyed = rows.withColumn("__part", F.substring(drawn, 1, 3))
    sizes = keyed.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).withColumn("first", _before("n", all_of))
    own = keyed.select(*parts, F.explode("held").alias(what)).groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("own"))
    totals = rows.select(*all_of, F.explode("held").alias(what)).groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    # of the images before a part at most `total` have it, so where twice as many came before, enough lack it
    near = (totals.join(sizes, all_of) if all_of else totals.crossJoin(sizes)).where("first < 2 * total").join(own, [*by, "__part"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    counted = near.withColumn("k", F.col("first") - _before("own", by)).withColumn("m", F.least(F.col("n") - F.col("own"), F.col("total") - F.col("k"))).where("m > 0")
    needed = counted.groupBy(*parts).agg(F.collect_list(F.struct(F.col(what).alias("what"), "k", "m")).alias("needed"))

    kinds = {c: rows.schema[c].dataType for c in ("image_id", "held")}
    lacking = F.arrow_udf(_lacking, ArrayType(StructType([StructField("what", kinds["held"].elementType), StructField("k", LongType()), StructField("without_id", kinds["image_id"])])))
    placed = keyed.repartition(*parts).groupBy(*parts).agg(F.sort_array(F.collect_list(F.struct(drawn.alias("drawn"), "image_id", "held"))).alias("l"))
    placed = placed.join(needed, parts).select(*all_of, lacking(F.transform("l", lambda x: F.struct(x["image_id"].alias("image_id"), x["held"].alias("held"))), F.col("needed")).alias("found"))
    found = placed.select(*all_of, F.explode("found").alias("f")).select(*all_of, F.col("f.what").alias(what), "f.k", "f.without_id")
    return asked.join(found, [*by, "k"]).select(*by, "with_id", "without_id")


def has_not_object(scene: Scene, n_sample: int | None = None) -> DataFrame:
    """Of an image with a label and one without, which hasn't it."""
    out = _with_and_without(scene.object_index().select("label", "image_id"), scene.images, [], ["label"], "has_not_object").select(F.col("label").alias("object"), "with_id", "without_id")
    return limited(out, n_sample, "has_not_object", ["object", "with_id"])


def has_relation(scene: Scene, n_sample: int | None = None, negated: bool = False) -> DataFrame:
    """Of two images with a label pair, one with a relation between them and one without, which has (or hasn't) it."""
    index, pair = scene.relation_index(), ["head_label", "target_label"]
    op = "has_not_relation" if negated else "has_relation"
    out = _with_and_without(index, index, pair, [*pair, "rel"], op)
    out = out.select(F.col("head_label").alias("object1"), F.col("rel").alias("relation"), F.col("target_label").alias("object2"), "with_id", "without_id", F.lit(negated).alias("negated"))
    return limited(out, n_sample, op, ["object1", "relation", "object2", "with_id"])


def _countable_index(scene: Scene) -> DataFrame:
    return scene.object_index().join(scene.object_vocab.where("countable = 1").select(F.col("object").alias("label")), "label", "left_semi")


def has_most_object(scene: Scene, n_sample: int | None = None, least: bool = False) -> DataFrame:
    """Of two images with different counts of a countable label, which has most (or least)."""
    op = "has_least_object" if least else "has_most_object"
    pairs = neighbours(_countable_index(scene), ["label"], op, ["cnt"]).where("cnt_0 <> cnt_1")
    first = F.col("cnt_0") < F.col("cnt_1") if least else F.col("cnt_0") > F.col("cnt_1")
    out = pairs.select(F.col("label").alias("object"), "image_id_0", "image_id_1", "cnt_0", "cnt_1", F.when(first, 0).otherwise(1).alias("answer"))
    return limited(out, n_sample, op, ["object", "image_id_0", "image_id_1"])


def count_object(scene: Scene, n_sample: int | None = None) -> DataFrame:
    """How many of a countable label two images hold together."""
    pairs = neighbours(_countable_index(scene), ["label"], "count_object", ["cnt"])
    total = F.col("cnt_0") + F.col("cnt_1")
    out = pairs.select(F.col("label").alias("object"), "image_id_0", "image_id_1", total.alias("answer"), words.count_choices(total).alias("candidates"))
    return limited(out, n_sample, "count_object", ["object", "image_id_0", "image_id_1"])


def count_attribute_object(scene: Scene, n_sample: int | None = None) -> DataFrame:
    """How many objects of a countable label with an attribute two images hold together, where more than one."""
    each = scene.countable().select("image_id", "label", F.explode("attributes").alias("attribute")).groupBy("label", "attribute", "image_id").agg(F.count(F.lit(1)).alias("cnt"))
    pairs = neighbours(each, ["label", "attribute"], "count_attribute_object", ["cnt"])
    total = F.col("cnt_0") + F.col("cnt_1")
    out = pairs.where(total > 1).select(F.col("label").alias("object"), "attribute", "image_id_0", "image_id_1", total.alias("answer"), words.count_choices(total).alias("candidates"))
    return limited(out, n_sample, "count_attribute_object", ["object", "attribute", "image_id_0"])


def common_object(scene: Scene, n_sample: int | None = None) -> DataFrame:
    """Labels that two images share, against those that only one has; both must exist."""
    pairs = image_pairs(scene, "common_object")
    shared = F.array_sort(F.array_intersect("labels_0", "labels_1"))
    others = F.array_sort(F.array_except(F.array_union("labels_0", "labels_1"), shared))
    out = pairs.select("image_id_0", "image_id_1", shared.alias("answer"), others.alias("distractors")).where((F.size("answer") > 0) & (F.size("distractors") > 0))
    return limited(out, n_sample, "common_object", ["image_id_0", "image_id_1"])


def common_attribute(scene: Scene, n_sample: int | None = None) -> DataFrame:
    """Attributes of a label in both of two images, against those in one; both must exist."""
    pairs = neighbours(_attributes_of(scene), ["label"], "common_attribute", ["attributes"])
    shared = F.array_sort(F.array_intersect("attributes_0", "attributes_1"))
    others = F.array_sort(F.array_except(F.array_union("attributes_0", "attributes_1"), shared))
    out = pairs.select(F.col("label").alias("object"), "image_id_0", "image_id_1", shared.alias("answer"), others.alias("distractors")).where((F.size("answer") > 0) & (F.size("distractors") > 0))
    return limited(out, n_sample, "common_attribute", ["object", "image_id_0"])


def described(subject: Column, lists: list[Column], object_: Column | None = None) -> Column:
    """"{subject} is {list} {object} in Image 0, {list} {object} in Image 1."."""
    parts = [F.concat_ws(" ", words.and_list(x), *([object_] if object_ is not None else []), F.lit(f"in Image {k}")) for k, x in enumerate(lists)]
    return F.concat(subject, F.lit(" is "), F.concat_ws(", ", *parts), F.lit("."))


def compare_attribute(scene: Scene, n_sample: int | None = None) -> DataFrame:
    """How a label that occurs once in each of two images differs in attributes; the lists swapped are the distractor."""
    single = _attributes_of(scene).where("cnt = 1 and size(attributes) > 0")
    pairs = neighbours(single, ["label"], "compare_attribute", ["attributes"]).where("attributes_0 <> attributes_1")
    a, b = F.col("attributes_0"), F.col("attributes_1")
    out = pairs.select(F.col("label").alias("object"), "image_id_0", "image_id_1", described(F.col("label"), [a, b]).alias("answer"), described(F.col("label"), [b, a]).alias("distractor"))
    return limited(out, n_sample, "compare_attribute", ["object", "image_id_0"])


def compare_relation(scene: Scene, n_sample: int | None = None) -> DataFrame:
    """How the relations of two labels that occur once in each of two images differ."""
    own = scene.unique_edges().groupBy("head_label", "target_label", "image_id").agg(F.sort_array(F.collect_set("rel")).alias("rels"))
    pairs = neighbours(own, ["head_label", "target_label"], "compare_relation", ["rels"]).where("rels_0 <> rels_1")
    a, b, o1, o2 = F.col("rels_0"), F.col("rels_1"), F.col("head_label"), F.col("target_label")
    out = pairs.select(o1.alias("object1"), o2.alias("object2"), "image_id_0", "image_id_1", described(o1, [a, b], o2).alias("answer"), described(o1, [b, a], o2).alias("distractor"))
    return limited(out, n_sample, "compare_relation", ["object1", "object2", "image_id_0"])
