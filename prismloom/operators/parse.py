"""Scene graphs as text: writing, parsing and editing. All columns; a line that can't be read is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismloom.functions import boxes, draws, masks, words
from prismloom.plans.scene import Scene


def _relations_part(text: Column) -> Column:
    """Lines after "Relations:"; null without it."""
    return F.when(F.contains(text, F.lit("Relations:")), F.split(F.split(F.trim(text), "Relations:")[1], "\n"))


def holistic_triples(texts: DataFrame, text: str = "text") -> DataFrame:
    """image_id, head, rel, target of "regionS: regionA rel, regionB rel" lines after "Relations:", each once.

    A line's regions after the first are paired with its comma-separated names by position; regions count from 1 in the
    text and from 0 in the result.
    """
    lines = texts.select("image_id", F.explode(F.slice(_relations_part(F.col(text)), 2, 1_000_000)).alias("line"))
    numbers = F.transform(F.regexp_extract_all("line", F.lit(r"region(\d+)"), F.lit(1)), lambda x: x.try_cast("int") - 1)
    bare = F.regexp_replace("line", r"region(\d+)", "")
    names = F.transform(F.split(F.trim(F.element_at(F.split(F.trim(bare), ":"), -1)), ","), lambda x: F.trim(x))
    parts = lines.select("image_id", numbers.alias("ids"), names.alias("names")).where(F.size("ids") > 0)
    pairs = F.filter(F.arrays_zip(F.slice("ids", 2, 1_000_000).alias("target"), F.col("names").alias("rel")), lambda p: p["target"].isNotNull() & p["rel"].isNotNull())
    return parts.select("image_id", F.col("ids")[0].alias("head"), F.explode(pairs).alias("p")).select("image_id", "head", "p.rel", "p.target").distinct()


def detailed_triples(texts: DataFrame) -> DataFrame:
    """image_id, head, rel, target of texts(image_id, head, text): ", "-separated "regionN rel" of one source each."""
    each = texts.select("image_id", "head", F.explode(F.split("text", ", ")).alias("part"))
    target = F.regexp_extract("part", r"region(\d+)", 1).try_cast("int") - 1
    return each.select("image_id", "head", F.trim(F.regexp_replace("part", r"region(\d+)", "")).alias("rel"), target.alias("target")).where("target is not null").distinct()


def triples_by_relation(texts: DataFrame) -> DataFrame:
    """"regionS: rel: regionA, regionB; rel: regionC" lines of texts(image_id, text): image_id, head, rel, target."""
    lines = texts.select("image_id", F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit(":")))
    halves = lines.select("image_id", words.region_number(F.split("line", ":", 2)[0]).alias("head"), F.explode(F.split(F.split("line", ":", 2)[1], ";")).alias("part")).where(F.contains("part", F.lit(":")))
    named = halves.select("image_id", "head", F.split(F.trim("part"), ":", 2).alias("p"))
    return named.select("image_id", "head", F.col("p")[0].alias("rel"), F.explode(F.split(F.col("p")[1], ",")).alias("t")).select("image_id", "head", "rel", words.region_number(F.col("t")).alias("target"))


def triples_by_target(texts: DataFrame) -> DataFrame:
    """"regionS: regionA rel, regionB rel" lines with exactly one colon: image_id, head, rel, target."""
    lines = texts.select("image_id", F.explode(F.split("text", "\n")).alias("line")).where(F.size(F.split("line", ":")) == 2)
    each = lines.select("image_id", words.region_number(F.split("line", ":")[0]).alias("head"), F.explode(F.split(F.split("line", ":")[1], ",")).alias("part"))
    halves = each.select("image_id", "head", F.split(F.trim("part"), " ", 2).alias("p")).where(F.size("p") == 2)
    return halves.select("image_id", "head", F.col("p")[1].alias("rel"), words.region_number(F.col("p")[0]).alias("target"))


def object_lines(texts: DataFrame) -> DataFrame:
    """"regionN: name is a, b" lines before any "Relations:": image_id, obj_idx, label, attributes."""
    before = F.split("text", "Relations:")[0]
    lines = texts.select("image_id", F.explode(F.split(before, "\n")).alias("line")).where(F.col("line").rlike(r"^region\d+: "))
    head = F.regexp_extract("line", r"^region\d+: (.*?)(?: is |$)", 1)
    rest = F.regexp_extract("line", r"^region\d+: .*? is (.*)$", 1)
    nothing = F.array().cast("array<string>")
    return lines.select("image_id", words.region_number(F.col("line")).alias("obj_idx"), head.alias("label"), F.when(rest == "", nothing).otherwise(F.split(rest, ", ")).alias("attributes"))


def _sections(texts: DataFrame) -> DataFrame:
    """image_id, told_objects and told_relations of answers with one "Relations:" after "Objects:"; any other answer says nothing."""
    parts = F.split("text", "Relations:")
    told = F.when(F.contains(parts[1], F.lit("region1")), F.replace(parts[1], F.lit("s:"), F.lit(""))).otherwise(F.replace(parts[1], F.lit("s:"), F.lit("region1:")))
    return texts.where((F.size(parts) == 2) & F.contains(parts[0], F.lit("Objects:"))).select("image_id", F.trim(F.split(parts[0], "Objects:")[1], F.lit(" \n\t")).alias("told_objects"), F.trim(told, F.lit(" \n\t")).alias("told_relations"))


def parsed_objects(texts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """image_id, obj_idx (the line's place) and name of the objects in a model's answers; with labels(name, label) also label, null for others.

    labels is the caller's table of names and classes, by spelling or by metrics.nearest.
    """
    lines = _sections(texts).select("image_id", F.posexplode(F.split("told_objects", "\n")).alias("obj_idx", "line"))
    named = lines.where(F.contains("line", F.lit(":"))).select("image_id", "obj_idx", F.trim(F.split("line", ":")[1]).alias("name"))
    return named if labels is None else named.join(labels, "name", "left")


def parsed_relations(texts: DataFrame, mode: int = 2, most: int | None = None, labels: DataFrame | None = None, op: str = "parsed_relations") -> DataFrame:
    """image_id, head, rel, target of the relations in a model's answers, mode 0 by relation, else by target; with `most` a draw of as many an image.

    A subject that shrank to "s:" is region 1, unless region 1 is named. labels(rel, label) as for parsed_objects.
    """
    told = _sections(texts).select("image_id", F.col("told_relations").alias("text"))
    found = (triples_by_relation(told) if mode == 0 else triples_by_target(told)).select("image_id", "head", "rel", "target").distinct()
    kept = found if most is None else draws.sample_groups(found, ["image_id"], most, op, ["head", "target", "rel"])
    return kept if labels is None else kept.join(labels, "rel", "left")


def graph_texts(scene: Scene, mode: int = 2, most_relations: int = 1_000_000, with_boxes: bool = False) -> DataFrame:
    """image_id and text: an "Objects:" block and, if any, a "Relations:" block (mode 2), or region by region (mode 1)."""
    place = F.row_number().over(Window.partitionBy("image_id", "head").orderBy("target", "rel"))
    out = scene.relations.withColumn("no", place).where(F.col("no") <= most_relations).groupBy("image_id", F.col("head").alias("obj_idx")).agg(F.sort_array(F.collect_list(F.struct("target", "rel"))).alias("out"))
    text = F.array_join(F.transform("out", lambda e: F.concat(F.lit("region"), (e["target"] + 1).cast("string"), F.lit(" "), e["rel"])), ", ")
    name = F.concat(F.col("label"), F.when(F.size("attributes") > 0, F.concat(F.lit(" is "), F.array_join("attributes", ", "))).otherwise(""))
    objects = scene.objects.join(scene.images, "image_id") if with_boxes else scene.objects
    if with_boxes:
        name = F.concat(name, F.lit(" "), boxes.box_thousandths("", F.col("width"), F.col("height")))
    region = F.concat(F.lit("region"), (F.col("obj_idx") + 1).cast("string"), F.lit(": "))
    each = objects.join(out, ["image_id", "obj_idx"], "left").select("image_id", "obj_idx", F.concat(region, name).alias("object_line"), F.when(F.col("out").isNotNull(), F.concat(region, text)).alias("relation_line"), text.alias("relations"))
    lines = each.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("obj_idx", "object_line", "relation_line", "relations"))).alias("l"))
    if mode == 1:
        return lines.select("image_id", F.array_join(F.transform("l", lambda x: F.concat(x["object_line"], F.coalesce(F.concat(F.lit("\nRelations: "), x["relations"]), F.lit("")), F.lit("\n"))), "").alias("text"))
    relation_lines = F.filter(F.transform("l", lambda x: x["relation_line"]), lambda x: x.isNotNull())
    block = lambda title, ls: F.concat(F.lit(f"{title}:\n"), F.array_join(ls, "\n"), F.lit("\n"))
    objects_block = block("Objects", F.transform("l", lambda x: x["object_line"]))
    return lines.select("image_id", F.when(F.size(relation_lines) > 0, F.concat(objects_block, F.lit("\n"), block("Relations", relation_lines))).otherwise(objects_block).alias("text"))


def edited(relations: DataFrame, names: DataFrame, edits: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations and names after edits.

    edits(image_id, head, rel, target, op) with op "add" or "remove"; what is both added and removed is gone.
    renames(image_id, obj_idx, name); an empty name changes nothing.
    """
    edge = ["image_id", "head", "rel", "target"]
    kept = relations.select(*edge).unionByName(edits.where("op = 'add'").select(*edge)).distinct().join(edits.where("op = 'remove'").select(*edge), edge, "left_anti")
    named = names.join(renames.select("image_id", "obj_idx", F.nullif("name", F.lit("")).alias("new")), ["image_id", "obj_idx"], "left").select("image_id", "obj_idx", F.coalesce("new", "label").alias("label"))
    return kept, named


def proposed_boxes(texts: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """[[x1, y1, x2, y2]] in thousandths in texts(image_id, text, width, height): image_id, box_no and pixel coordinates, cut to whole numbers."""
    found = texts.select("image_id", width, height, F.posexplode(F.regexp_extract_all("text", F.lit(r"\[\[(.*?)\]\]"), F.lit(1))).alias("box_no", "inner"))
    n = F.transform(F.split("inner", ","), lambda x: F.trim(x).try_cast("double") / 1000)
    good = found.withColumn("n", n).where((F.size("n") == 4) & F.forall("n", lambda x: x.isNotNull()))
    size = [width, height, width, height]
    return good.select("image_id", "box_no", *[(F.col("n")[k] * F.col(size[k])).cast("int").alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


def _to_add(met: DataFrame, first_areas: DataFrame, second_areas: DataFrame, mode: int, most_overlap: float, most_iou: float) -> DataFrame:
    """Of met(image_id, region_id, overlap, iou, area) the regions that a merge mode takes."""
    medians = first_areas.groupBy("image_id").agg(F.percentile("area", 0.5).alias("median"))
    quartiles = second_areas.groupBy("image_id").agg(F.percentile("area", 0.75).alias("quartile"))
    return _taken(met.join(medians, "image_id", "left").join(quartiles, "image_id"), mode, most_overlap, most_iou)


def _taken(met: DataFrame, mode: int, most_overlap: float, most_iou: float) -> DataFrame:
    """The same with median and quartile beside each region."""
    both = met.where(F.col("iou") <= most_iou)
    free, medium, large = F.col("overlap") < most_overlap, F.col("area") > F.coalesce("median", F.lit(0.0)), F.col("area") > F.col("quartile")
    return both.where({0: free | medium | large, 1: free, 2: medium, 3: medium & free, 4: large & free}[mode]).select("image_id", "region_id")


def merged_regions(first: DataFrame, second: DataFrame, mode: int, most_overlap: float = 0.6, most_iou: float = 0.7) -> DataFrame:
    """Regions of second to add to first, by their boxes: image_id, region_id.

    The share of a region's area that first covers at most (by one region) is under most_overlap: "free"; its area is
    over the median of first ("medium") or over the third quartile of second ("large"). Mode 0 takes any of these, 1
    free, 2 medium, 3 medium and free, 4 large and free; none takes regions with IoU over most_iou with one of first.
    """
    f = first.select("image_id", *[F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")])
    met = second.join(f, "image_id", "left").groupBy("image_id", "region_id").agg(
        F.max(F.coalesce(boxes.intersection("", "f_") / boxes.area(""), F.lit(0.0))).alias("overlap"), F.max(F.coalesce(boxes.iou("", "f_"), F.lit(0.0))).alias("iou"), F.max(boxes.area("")).alias("area")
    )
    area = boxes.area("").alias("area")
    return _to_add(met, first.select("image_id", area), second.select("image_id", area), mode, most_overlap, most_iou)


def _beside(first: DataFrame, second: DataFrame) -> DataFrame:
    """A row per image of second: f and b, the masks of first and second with key, mask, area and box. Both are bounded by an image and read once."""
    listed = lambda df, key, name: df.groupBy("image_id").agg(F.collect_list(F.struct(F.col(key).alias("key"), "mask", masks.area("mask").alias("area"), masks.bounds("mask").alias("box"))).alias(name))
    f = listed(first, "first_id", "f")
    return listed(second, "region_id", "b").join(f, "image_id", "left").withColumn("f", F.coalesce("f", F.array().cast(f.schema["f"].dataType)))


def _near(region: str) -> Column:
    """Those of f whose boxes meet a region's: only they are worth a sweep."""
    b = F.col(region)["box"]
    return F.filter("f", lambda x: (x["box"]["x1"] < b["x2"]) & (b["x1"] < x["box"]["x2"]) & (x["box"]["y1"] < b["y2"]) & (b["y1"] < x["box"]["y2"]))


def mask_overlaps(first: DataFrame, second: DataFrame, ordered: bool = False) -> DataFrame:
    """Pairs of masks of an image that share pixels: image_id, first_id, region_id and shared, their number.

    first(image_id, first_id, mask), second(image_id, region_id, mask). Boxes decide which pairs are worth a sweep, and
    with ordered only those with first_id < region_id are.
    """
    wanted = F.filter(_near("r"), lambda x: x["key"] < F.col("r.key")) if ordered else _near("r")
    met = _beside(first, second).select("image_id", "f", F.explode("b").alias("r")).select("image_id", "r", F.explode(wanted).alias("x"))
    return met.select("image_id", F.col("x.key").alias("first_id"), F.col("r.key").alias("region_id"), masks.intersection_area("x.mask", "r.mask").alias("shared")).where("shared > 0")


def _percentile(values: Column, share: float) -> Column:
    """As F.percentile, of an array in order; null of an empty one."""
    at = (F.size(values) - 1) * F.lit(share)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    of = lambda k: F.get(values, k).cast("double")
    return F.when(F.size(values) > 0, F.when(of(low) == of(high), of(low)).otherwise((high - at) * of(low) + (at - low) * of(high)))


def merged_by_masks(first: DataFrame, second: DataFrame, mode: int, most_overlap: float = 0.6, most_iou: float = 0.7) -> DataFrame:
    """As merged_regions, with areas and overlaps of masks. first(image_id, first_id, mask), second(image_id, region_id, mask).

    A region meets the masks of first in its image's row; what is grouped afterwards are numbers, not masks.
    """
    areas = lambda c: F.array_sort(F.filter(F.transform(c, lambda x: x["area"]), lambda a: a.isNotNull()))
    given = _beside(first, second).select("image_id", "f", "b", _percentile(areas("f"), 0.5).alias("median"), _percentile(areas("b"), 0.75).alias("quartile"))
    each = given.select("image_id", "f", "median", "quartile", F.explode("b").alias("r")).select("image_id", "median", "quartile", "r", F.explode_outer(_near("r")).alias("x"))
    shared = each.select("image_id", F.col("r.key").alias("region_id"), "median", "quartile", F.col("r.area").alias("area"), F.col("x.area").alias("f_area"), masks.intersection_area("x.mask", "r.mask").alias("shared"))
    most = lambda of: F.max(F.when(F.col("shared") > 0, F.col("shared") / of))
    met = shared.groupBy("image_id", "region_id").agg(
        most(F.col("area")).alias("overlap"), most(F.col("area") + F.col("f_area") - F.col("shared")).alias("iou"), *[F.max(c).alias(c) for c in ("area", "median", "quartile")]
    )
    return _taken(met.fillna(0.0, ["overlap", "iou"]), mode, most_overlap, most_iou)


def embedded_json(text: Column, schema: str) -> Column:
    """The first {...} or [...] block of a model's answer, read with single or double quotes; null if it can't be."""
    block = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.from_json(block, schema, {"allowSingleQuotes": "true"})
