"""Generators that users write: a Python function of one image, registered under a name and called from SQL.

A generator takes an image (a row of image_id, width, height, objects and relations) and yields questions as dicts. It
becomes a table function, so it stands in SQL beside any other table by LATERAL, and only its own work is Python: images
are put together, questions sampled and templates applied by Spark around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from prismloom.functions import draws
from prismloom.operators import records
from prismloom.plans.scene import Scene
from prismloom.plans.shipping import ship

#: What a generator yields: the values of its templates' slots, the answer, the choices, and what the metadata counts.
QUESTION = "slots map<string,string>, answer string, candidates array<string>, objects array<string>, attributes array<string>, relations array<string>"
_FIELDS = [f.split(" ")[0] for f in QUESTION.split(", ")]
Generator = Callable[[Row], Iterable[dict]]


def images(scene: Scene) -> DataFrame:
    """image_id and image: its size, its objects by index and its relations, as one struct. Bounded by what an image holds."""
    objects = scene.objects.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("obj_idx", "label", "x1", "y1", "x2", "y2", "attributes"))).alias("objects"))
    relations = scene.relations.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("head", "rel", "target"))).alias("relations"))
    met = scene.images.join(objects, "image_id", "left").join(relations, "image_id", "left")
    nothing = lambda c, of: F.coalesce(F.col(c), F.array().cast(of.schema[c].dataType)).alias(c)
    return met.select("image_id", F.struct("image_id", "width", "height", nothing("objects", objects), nothing("relations", relations)).alias("image"))


def register(spark: SparkSession, name: str, generator: Generator) -> None:
    """Make a generator a table function: SELECT ... FROM images, LATERAL name(image)."""
    ship(spark)

    class Questions:
        def eval(self, image: Row):
            for question in generator(image):
                unknown = set(question) - set(_FIELDS)
                if unknown:
                    raise ValueError(f"{name} yields {sorted(unknown)}; known are {_FIELDS}")
                if "answer" not in question:
                    raise ValueError(f"{name} yields a question without an answer")
                yield tuple(question.get(c) if c in ("answer", "slots") else list(question.get(c) or []) for c in _FIELDS)

    spark.udtf.register(name, F.udtf(Questions, returnType=QUESTION))


def questions(scene: Scene, names: list[str], n_per_image: int | None = None) -> DataFrame:
    """image_id, generator, no (a question's place among its image's by slots and answer) and the question's columns, of registered generators.

    With n_per_image, so many of each image and generator, drawn by key.
    """
    spark = scene.images.sparkSession
    parts = {}
    for name in names:
        parts[name] = spark.sql(f"SELECT i.image_id, q.* FROM {{images}} i, LATERAL `{name}`(i.image) q", images=images(scene))
    out = records.union_all(parts)
    if n_per_image is None:
        return out
    told = out.withColumn("told", F.to_json(F.struct(F.map_entries("slots").alias("slots"), "answer")))
    return draws.sample_groups(told, ["image_id", "generator"], n_per_image, "generator", ["told"]).drop("told")


def with_templates(asked: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """prompt and response of each question, from a drawn template of templates(generator, template_id, prompt, response); {name} in them is a slot."""
    n = templates.groupBy("generator").agg(F.count(F.lit(1)).alias("n"))
    drawn = asked.join(n, "generator").withColumn("template_id", F.floor(draws.uniform("generators", "generator", *keys) * F.col("n")).cast("int")).drop("n")
    met = drawn.join(templates, ["generator", "template_id"])
    slots = F.map_entries(F.map_concat(F.coalesce("slots", F.create_map().cast("map<string,string>")), F.create_map(F.lit("answer"), F.col("answer"))))
    fill = lambda c: F.aggregate(slots, F.col(c), lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return met.withColumn("prompt", fill("prompt")).withColumn("response", fill("response"))
