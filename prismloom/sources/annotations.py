"""Annotation files: one JSON document keyed by image id, merged over several files and normalised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.plans.scene import Scene
from prismloom.sources import json_objects

#: All fields of an image's annotation. Relations come as [head, name, target] in one array of mixed types.
ANNOTATION = (
    "width int, height int, labels array<string>, bboxes array<array<int>>, det_scores array<double>, attributes array<array<string>>, "
    "relations array<array<string>>, raw_relations string, caption string, depth_mask_id string, seg_mask_id string"
)
IMAGE = f"data_path: string, source: string, annotation: struct<{', '.join(x.replace(' ', ': ', 1) for x in ANNOTATION.split(', '))}>"


def read_keyed(spark: SparkSession, path: str, range_bytes: int = json_objects.RANGE, parts: bool = False) -> DataFrame:
    """image_id, row_idx (its place in the document), data_path, source and the annotation's fields.

    Each file is one JSON object, which many tasks read in ranges; with parts, a folder's files together are one.
    """
    found = json_objects.entries(spark, path, range_bytes, parts)
    parsed = F.map_entries(F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), f"map<string, struct<{IMAGE}>>"))[0]
    rows = found.select(F.col("row_idx").cast("int").alias("row_idx"), parsed.alias("e"))
    return rows.select(F.col("e.key").alias("image_id"), "row_idx", "e.value.data_path", "e.value.source", "e.value.annotation.*")


def merge(files: Sequence[DataFrame], check: bool = True) -> DataFrame:
    """The first file's images with the others' fields; the last file that has a field wins.

    An image that only a later file has is an error, raised when the rows are computed.
    """
    base = files[0]
    fields = [c for c in base.columns if c not in ("image_id", "row_idx")]
    for k, more in enumerate(files[1:], 1):
        theirs = more.select("image_id", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__there"))
        met = base.join(theirs, "image_id", "full" if check else "left")
        if check:
            known = F.when(F.col("row_idx").isNull(), F.raise_error(F.concat(F.lit(f"image of file {k} that the first file lacks: "), "image_id")).cast("int")).otherwise(F.col("row_idx"))
            met = met.withColumn("row_idx", known)
        base = met.select("image_id", "row_idx", *[F.coalesce(f"__{c}", c).alias(c) for c in fields])
    return base


def normalized_attributes(attributes: Column, vocab: Column, gray_first: bool = False) -> Column:
    """Each object's attributes split at " and ", those in the vocabulary, each once, sorted. "grey" is "gray" only with gray_first."""

    def own(values: Column) -> Column:
        parts = F.flatten(F.transform(values, lambda a: F.split(a, " and ")))
        if gray_first:
            parts = F.transform(parts, lambda a: F.when(a == "grey", "gray").otherwise(a))
        return F.array_sort(F.array_intersect(parts, vocab))

    return F.transform(attributes, own)


def scene_of(images: DataFrame, attribute_vocab: DataFrame, object_vocab: DataFrame, gray_first: bool = False) -> Scene:
    """A Scene of merged annotations; relations named "of" are dropped. Vocabularies are closed lists."""
    vocab = attribute_vocab.agg(F.collect_set("attribute").alias("vocab"))
    with_vocab = images.crossJoin(F.broadcast(vocab))  # one row
    attributes = normalized_attributes(F.col("attributes"), F.col("vocab"), gray_first)
    each = with_vocab.select("image_id", F.posexplode("labels").alias("obj_idx", "label"), "bboxes", "det_scores", attributes.alias("attributes"))
    box = F.col("bboxes")[F.col("obj_idx")]
    nothing = F.array().cast("array<string>")
    at = lambda c: F.try_element_at(c, F.col("obj_idx") + 1)
    objects = each.select("image_id", "obj_idx", "label", *[box[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], at("det_scores").alias("det_score"), F.coalesce(at("attributes"), nothing).alias("attributes"))
    edges = images.select("image_id", F.explode("relations").alias("r")).select("image_id", F.col("r")[0].cast("int").alias("head"), F.col("r")[1].alias("rel"), F.col("r")[2].cast("int").alias("target"))
    return Scene(images.select("image_id", "width", "height"), objects, edges.where("rel <> 'of'"), attribute_vocab, object_vocab)


def image_id(path: Column) -> Column:
    """The file's name up to its first dot."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))


def write_document(rows: DataFrame, path: str, files: int | None = None) -> None:
    """rows(image_id, data_path, annotation, source) as one JSON object by image id, in parts that follow each other."""
    entry = rows.select(F.col("image_id").cast("string").alias("image_id"), F.to_json(F.struct("data_path", "annotation", "source")).alias("entry"))
    json_objects.write_document(entry, path, "image_id", "entry", files)
