"""Scene-graph tables, from annotation files or from the driver's star schema, and the views that queries share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismloom.functions import boxes
from prismloom.plans.shipping import ship

CANVAS = 1024
VOCAB_ATTRIBUTES = [("red", "color"), ("blue", "color"), ("small", "size"), ("large", "size"), ("hot", "state"), ("cold", "state"), ("new", "other"), ("old", "other")]
VOCAB_OBJECTS = [("anvil", 1), ("bolt", 1), ("gear", 1), ("gizmo", 1), ("plate", 0), ("ring", 1), ("rod", 1), ("widget", 1)]


@dataclass
class Scene:
    """images(image_id, width, height), objects(image_id, obj_idx, label, x1, y1, x2, y2, det_score, attributes),
    relations(image_id, head, rel, target), attribute_vocab(attribute, category), object_vocab(object, countable).

    Vocabularies are parameters of bounded size; they are small enough for Spark to broadcast by itself.
    """

    images: DataFrame
    objects: DataFrame
    relations: DataFrame
    attribute_vocab: DataFrame
    object_vocab: DataFrame

    # objects and their boxes

    def countable(self) -> DataFrame:
        """Objects that can be counted; a label the vocabulary doesn't know can't."""
        known = self.object_vocab.where("countable = 1").select(F.col("object").alias("label"))
        return self.objects.join(known, "label", "left_semi")

    def non_including(self) -> DataFrame:
        """Objects that hold no other box; equal boxes hold each other."""
        other = self.objects.select("image_id", F.col("obj_idx").alias("o_idx"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
        mine = self.objects.alias("mine")
        cond = (F.col("mine.image_id") == other["image_id"]) & (F.col("obj_idx") != F.col("o_idx")) & boxes.includes("", "o_")
        return mine.join(other, cond, "left_anti")

    def non_overlapping(self, axis: str = "both") -> DataFrame:
        """Of the non-including objects, those that overlap no other of them."""
        kept = self.non_including()
        other = kept.select("image_id", F.col("obj_idx").alias("o_idx"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
        cond = (F.col("own.image_id") == other["image_id"]) & (F.col("obj_idx") != F.col("o_idx")) & boxes.overlaps("", "o_", axis)
        return kept.alias("own").join(other, cond, "left_anti")

    def small(self, share: float = 0.5) -> DataFrame:
        sized = self.objects.join(self.images.select("image_id", "width", "height"), "image_id")
        return sized.where(boxes.area("") < share * F.col("width") * F.col("height")).drop("width", "height")

    def label_counts(self, objects: DataFrame | None = None) -> DataFrame:
        """image_id, label, cnt and the index of its first object."""
        return (self.objects if objects is None else objects).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("cnt"), F.min("obj_idx").alias("first_idx"))

    def unique_labels(self) -> DataFrame:
        """Objects whose label occurs once in their image."""
        n = F.count(F.lit(1)).over(Window.partitionBy("image_id", "label"))
        return self.objects.withColumn("__n", n).where("__n = 1").drop("__n")

    def disjoint_pairs(self, axis: str = "both") -> DataFrame:
        """a_ and b_ columns of pairs of uniquely labelled objects, in index order, that don't overlap."""
        unique = self.unique_labels().select("image_id", "obj_idx", "label", "x1", "y1", "x2", "y2")
        a = unique.select("image_id", *[F.col(c).alias(f"a_{c}") for c in unique.columns[1:]])
        b = unique.select("image_id", *[F.col(c).alias(f"b_{c}") for c in unique.columns[1:]])
        return a.join(b, "image_id").where((F.col("a_obj_idx") < F.col("b_obj_idx")) & ~boxes.overlaps("a_", "b_", axis))

    def disjoint_triples(self, axis: str = "both") -> DataFrame:
        """a_, b_ and c_ columns of triples of uniquely labelled objects that don't overlap pairwise."""
        pairs = self.disjoint_pairs(axis)
        bc = pairs.select("image_id", *[F.col(f"a_{c}").alias(f"b_{c}") for c in ("obj_idx",)], *[F.col(f"b_{c}").alias(f"c_{c}") for c in ("obj_idx", "label", "x1", "y1", "x2", "y2")])
        return pairs.join(bc, ["image_id", "b_obj_idx"]).where(~boxes.overlaps("a_", "c_", axis))

    # attributes

    def attributes(self) -> DataFrame:
        """A row for each attribute of an object, with its category."""
        each = self.objects.select("image_id", "obj_idx", "label", F.explode("attributes").alias("attribute"))
        return each.join(self.attribute_vocab, "attribute")

    # relations

    def edges(self) -> DataFrame:
        """Relations with both ends' labels."""
        ends = self.objects.select("image_id", "obj_idx", "label")
        head = ends.select("image_id", F.col("obj_idx").alias("head"), F.col("label").alias("head_label"))
        tail = ends.select("image_id", F.col("obj_idx").alias("target"), F.col("label").alias("target_label"))
        return self.relations.join(head, ["image_id", "head"]).join(tail, ["image_id", "target"])

    def unique_edges(self) -> DataFrame:
        """Edges between objects whose labels occur once in the image."""
        unique = self.unique_labels().select("image_id", "obj_idx", "label")
        head = unique.select("image_id", F.col("obj_idx").alias("head"), F.col("label").alias("head_label"))
        tail = unique.select("image_id", F.col("obj_idx").alias("target"), F.col("label").alias("target_label"))
        return self.relations.join(head, ["image_id", "head"]).join(tail, ["image_id", "target"])

    # across images

    def object_index(self) -> DataFrame:
        """label, image_id, cnt: which images hold a label, how often."""
        return self.objects.groupBy("label", "image_id").agg(F.count(F.lit(1)).alias("cnt"))

    def relation_index(self) -> DataFrame:
        """head_label, rel, target_label, image_id, each once."""
        return self.edges().select("head_label", "rel", "target_label", "image_id").distinct()


#: Objects that one task holds by image. What sorts and groups by image follows in the same task, one operator's memory beside the other's.
TASK_OBJECTS = 250_000


def by_image(raw: DataFrame, line: DataFrame) -> DataFrame:
    """Objects dealt by image over as many tasks as line has rows for, so that a task's share doesn't grow with the input."""
    return raw.repartition(max(raw.sparkSession.sparkContext.defaultParallelism, -(-line.count() // TASK_OBJECTS)), "image_id")


def driver_scene(spark: SparkSession, sf_dir: str) -> Scene:
    """The scene-graph reading of lineitem and part: orders are images, line items objects, and neighbours relate."""
    ship(spark)
    # named before the window, so that what groups by image finds the images together and shuffles nothing
    line, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "image_id"), spark.read.parquet(f"{sf_dir}/part.parquet")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    name = F.split("p_name", " ")
    joined = line.join(part.select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    raw = by_image(joined, line).select(
        "image_id",
        place.cast("int").alias("obj_idx"),
        name[1].alias("label"),
        F.array(name[0]).alias("attributes"),
        F.pmod(F.col("l_partkey") * 37 + F.col("l_suppkey") * 11, F.lit(800)).cast("int").alias("x1"),
        F.pmod(F.col("l_suppkey") * 53 + F.col("l_partkey") * 7, F.lit(800)).cast("int").alias("y1"),
        F.col("l_quantity").cast("int").alias("quantity"),
        "p_size",
        (1 - F.col("l_discount")).alias("det_score"),
        F.concat("l_returnflag", "l_linestatus").alias("rel"),
        (F.pmod("l_suppkey", F.lit(3)) != 0).alias("forward"),
        (F.pmod("l_partkey", F.lit(4)) == 0).alias("backward"),
    )
    objects = raw.select("image_id", "obj_idx", "label", "x1", "y1", (F.col("x1") + 20 + F.col("quantity") * 4).alias("x2"), (F.col("y1") + 20 + F.col("p_size") * 4).alias("y2"), "det_score", "attributes")
    last = F.max("obj_idx").over(Window.partitionBy("image_id"))
    linked = raw.select("image_id", "obj_idx", "rel", "forward", "backward", last.alias("last")).where("obj_idx < last")
    here, after = F.col("obj_idx"), F.col("obj_idx") + 1
    both = F.array(F.when(F.col("forward"), F.struct(here.alias("head"), F.col("rel").alias("rel"), after.alias("target"))), F.when(F.col("backward"), F.struct(after.alias("head"), F.lit("near").alias("rel"), here.alias("target"))))
    relations = linked.select("image_id", F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e")).select("image_id", "e.head", "e.rel", "e.target")
    images = line.select("image_id").distinct().select("image_id", F.lit(CANVAS).alias("width"), F.lit(CANVAS).alias("height"))
    return Scene(images, objects, relations, spark.createDataFrame(VOCAB_ATTRIBUTES, "attribute string, category string"), spark.createDataFrame(VOCAB_OBJECTS, "object string, countable int"))


#: The same tables for SQL: attr is an object's one attribute.
SCENE_SQL = """
raw_objects as (
  select l_orderkey as image_id,
         cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as int) as obj_idx,
         split_part(p_name, ' ', 2) as label, split_part(p_name, ' ', 1) as attr,
         cast((l_partkey * 37 + l_suppkey * 11) % 800 as int) as x1, cast((l_suppkey * 53 + l_partkey * 7) % 800 as int) as y1,
         cast(l_quantity as int) as quantity, p_size, 1 - l_discount as det_score,
         l_returnflag || l_linestatus as rel, l_suppkey % 3 <> 0 as forward, l_partkey % 4 = 0 as backward
  from lineitem join part on l_partkey = p_partkey),
objects as (select image_id, obj_idx, label, attr, x1, y1, x1 + 20 + quantity * 4 as x2, y1 + 20 + p_size * 4 as y2, det_score from raw_objects),
linked as (select * from (select *, max(obj_idx) over (partition by image_id) as last_idx from raw_objects) where obj_idx < last_idx),
relations as (select image_id, obj_idx as head, rel, obj_idx + 1 as target from linked where forward
              union all select image_id, obj_idx + 1, 'near', obj_idx from linked where backward),
images as (select distinct l_orderkey as image_id from lineitem),
attribute_vocab(attribute, category) as (values ('red','color'),('blue','color'),('small','size'),('large','size'),('hot','state'),('cold','state'),('new','other'),('old','other')),
object_vocab(object, countable) as (values ('anvil',1),('bolt',1),('gear',1),('gizmo',1),('plate',0),('ring',1),('rod',1),('widget',1)),
countable_objects as (select o.* from objects o join object_vocab v on v.object = o.label where v.countable = 1),
non_including as (select * from objects a where not exists (select 1 from objects b where a.image_id = b.image_id and a.obj_idx <> b.obj_idx
                  and a.x1 <= b.x1 and a.y1 <= b.y1 and a.x2 >= b.x2 and a.y2 >= b.y2)),
unique_labels as (select * exclude (n) from (select *, count(*) over (partition by image_id, label) as n from objects) where n = 1),
edges as (select r.image_id, r.head, r.rel, r.target, h.label as head_label, t.label as target_label
          from relations r join objects h on h.image_id = r.image_id and h.obj_idx = r.head join objects t on t.image_id = r.image_id and t.obj_idx = r.target),
unique_edges as (select r.image_id, r.head, r.rel, r.target, h.label as head_label, t.label as target_label
          from relations r join unique_labels h on h.image_id = r.image_id and h.obj_idx = r.head join unique_labels t on t.image_id = r.image_id and t.obj_idx = r.target)
"""


def disjoint_sql(axis: str) -> str:
    """CTEs pairs and triples of uniquely labelled objects that don't overlap on the axis."""
    parts = {"x": "({0}.x1 < {1}.x2 and {1}.x1 < {0}.x2)", "y": "({0}.y1 < {1}.y2 and {1}.y1 < {0}.y2)"}
    parts["both"] = f"({parts['x']} and {parts['y']})"
    apart = lambda a, b: f"not {parts[axis].format(a, b)}"
    cols = lambda a: ", ".join(f"{a}.{c} as {a}_{c}" for c in ("obj_idx", "label", "x1", "y1", "x2", "y2"))
    return f"""
pairs as (select a.image_id, {cols('a')}, {cols('b')} from unique_labels a join unique_labels b on a.image_id = b.image_id and a.obj_idx < b.obj_idx and {apart('a', 'b')}),
triples as (select a.image_id, {cols('a')}, {cols('b')}, {cols('c')} from unique_labels a join unique_labels b on a.image_id = b.image_id and a.obj_idx < b.obj_idx and {apart('a', 'b')}
            join unique_labels c on c.image_id = a.image_id and b.obj_idx < c.obj_idx and {apart('b', 'c')} and {apart('a', 'c')})
"""
