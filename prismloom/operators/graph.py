"""Scene graphs as edge tables: single edges, components, adjacency, references and captions."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismloom.functions import draws, words
from prismloom.plans.scene import Scene

REFERENCE_SIZE = 3
#: Rows that a task makes of its images before it passes them on.
BATCH = 20_000


def single_edges(scene: Scene) -> DataFrame:
    """One drawn relation, with its direction, of each pair of objects that relate."""
    low, high = F.least("head", "target"), F.greatest("head", "target")
    place = F.row_number().over(Window.partitionBy("image_id", low, high).orderBy(draws.key("single_edges", "image_id", "head", "rel", "target"), "head", "rel"))
    return scene.relations.withColumn("__no", place).where("__no = 1").drop("__no")


def _classes(own: list[int], ends: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Each node's component, named by its smallest node; ends that are no nodes connect nothing."""
    parent = {n: n for n in own}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for h, t in ends:
        if h in parent and t in parent:
            a, b = find(h), find(t)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def _roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of each image's objects."""
    for frame in frames:
        images, nodes, roots = [], [], []
        for image_id, own, heads, targets in zip(frame["image_id"], frame["nodes"], frame["heads"], frame["targets"], strict=True):
            found = _classes(own.tolist(), zip(heads.tolist(), targets.tolist(), strict=True) if heads is not None else ())
            images += [image_id] * len(found)
            nodes += found
            roots += found.values()
        yield pd.DataFrame({"image_id": images, "obj_idx": nodes, "component": roots})


def components(scene: Scene) -> DataFrame:
    """image_id, obj_idx, component (its smallest object).

    A component lies within an image, whose objects and edges are few: both are gathered per image, in one shuffle each,
    and connected in one pass. (Rounds of joins would shuffle all edges again and again.)
    """
    nodes = scene.objects.groupBy("image_id").agg(F.collect_list("obj_idx").alias("nodes"))
    edges = scene.relations.groupBy("image_id").agg(F.collect_list(F.struct("head", "target")).alias("e"))
    both = nodes.join(edges, "image_id", "left").select("image_id", "nodes", F.col("e.head").alias("heads"), F.col("e.target").alias("targets"))
    kind = scene.objects.schema["image_id"].dataType.simpleString()
    return both.mapInPandas(_roots, f"image_id {kind}, obj_idx int, component int")


def decomposed(scene: Scene) -> DataFrame:
    """Components numbered by size, then by their smallest object, with each object's new index in its component."""
    found = components(scene)
    sizes = found.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("size"))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("size", "component")) - 1
    place = F.row_number().over(Window.partitionBy("image_id", "component").orderBy("obj_idx")) - 1
    return found.withColumn("new_idx", place).join(sizes.withColumn("component_no", number), ["image_id", "component"])


def adjacency(scene: Scene) -> DataFrame:
    """Both views of each edge: image_id, obj_idx, other, rel, direction (0 out, 1 in)."""
    view = lambda mine, other, direction: F.struct(F.col(mine).alias("obj_idx"), F.col(other).alias("other"), F.col("rel").alias("rel"), F.lit(direction).alias("direction"))
    return scene.relations.select("image_id", F.explode(F.array(view("head", "target", 0), view("target", "head", 1))).alias("v")).select("image_id", "v.*")


def _subsets(attributes: Column, size: int) -> Column:
    """All subsets of this size of a sorted array of distinct values, as sorted arrays: each step appends what comes after the last."""
    if size == 0:
        return F.array(F.array().cast("array<string>"))
    found = F.transform(attributes, lambda a: F.array(a))
    for _ in range(size - 1):
        found = F.flatten(F.transform(found, lambda c: F.transform(F.filter(attributes, lambda a: F.coalesce(a > F.get(c, F.size(c) - 1), F.lit(True))), lambda a: F.concat(c, F.array(a)))))  # noqa: B023
    return found


def _edges(scene: Scene) -> DataFrame:
    """A row per image: its relations, each once."""
    return scene.relations.groupBy("image_id").agg(F.collect_set(F.struct("head", "rel", "target")).alias("edges"))


def _lists(column: pa.Array) -> list:
    """A column as Python lists, however deep."""
    if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        return column.to_pylist()
    values, ends = _lists(column.flatten()), column.offsets.to_pylist()
    return [values[a - ends[0] : b - ends[0]] for a, b in itertools.pairwise(ends)]


Nodes = dict[int, tuple[str, list[str]]]
Edges = list[tuple[int, str, int]]
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _per_image(scene: Scene, rows: Callable[[Nodes, Edges], Iterable[tuple]], fields: dict[str, str]) -> DataFrame:
    """image_id and what rows gives for each image's nodes (obj_idx -> label and sorted attributes) and edges, each once.

    An image's objects and relations are few and come as one row. What follows from them is many times as much and is made
    and grouped while the image passes: the task holds a batch of it, and nothing of it is sorted, shuffled or stored.
    """
    own = F.struct("obj_idx", F.col("label").alias("label"), F.coalesce(F.array_sort(F.array_distinct(F.array_compact("attributes"))), F.array().cast("array<string>")).alias("attributes"))
    objects = scene.objects.groupBy("image_id").agg(F.collect_list(own).alias("nodes"))
    both = objects.join(_edges(scene), "image_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    pictures = both.select("image_id", "nodes.obj_idx", "nodes.label", "nodes.attributes", none(F.col("edges.head"), "int").alias("head"), none(F.col("edges.rel"), "string").alias("rel"), none(F.col("edges.target"), "int").alias("target"))

    def batch(images: list, out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        made = [pa.array(c, KINDS[k]) for c, k in zip(zip(*out, strict=True), fields.values(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(images, kind), *made], names=["image_id", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        images, out, kind = [], [], None
        for b in batches:
            kind = b.schema.field("image_id").type
            for image_id, idx, labels, attributes, heads, rels, targets in zip(*[_lists(c) for c in b.columns], strict=True):
                for row in rows(dict(zip(idx, zip(labels, attributes, strict=True), strict=True)), list(zip(heads, rels, targets, strict=True))):
                    images.append(image_id)
                    out.append(row)
                    if len(out) == BATCH:
                        yield batch(images, out, kind)
                        images, out = [], []
        if out:
            yield batch(images, out, kind)

    kind = scene.objects.schema["image_id"].dataType.simpleString()
    return pictures.mapInArrow(run, ", ".join([f"image_id {kind}", *(f"{c} {k}" for c, k in fields.items())]))


Way = tuple[tuple[str, ...], int | None, str | None, tuple[str, ...], str | None, int | None]


def _neighbours(nodes: Nodes, edges: Edges) -> dict[int, list[tuple[int, str, int]]]:
    """Both views of each edge between different objects: obj_idx -> other, rel, direction (0 out, 1 in)."""
    near: dict[int, list[tuple[int, str, int]]] = {n: [] for n in nodes}
    for h, rel, t in edges:
        if h != t and h in nodes and t in nodes:
            near[h].append((t, rel, 0))
            near[t].append((h, rel, 1))
    return near


def _ways(nodes: Nodes, given: list[str], near: list[tuple[int, str, int]], size: int) -> Iterator[Way]:
    """Of an object: every choice of `size` of the given attributes, and of i of them with one neighbour and size - 1 - i of its own."""
    for a in itertools.combinations(given, size):
        yield a, None, None, (), None, None
    for other, rel, direction in near:
        name, theirs = nodes[other]
        for i in range(size):
            for a in itertools.combinations(given, i):
                for b in itertools.combinations(theirs, size - 1 - i):
                    yield a, other, name, b, rel, direction


def _reading(way: Way, joint: str) -> str:
    """What reference_text gives."""
    a, _, name, b, rel, direction = way
    mine = f"{_anded(a)} object" if a else "object"
    if name is None or rel is None:
        return mine
    other = f"{_anded(b)} {name}" if b else name
    return f"{mine}{joint}is {rel} the {other}" if direction == 0 else f"{mine}{joint}the {other} is {rel}"


def _categories(scene: Scene) -> dict[str, list[str]]:
    """Attribute -> its categories; the vocabulary is a parameter of bounded size."""
    found: dict[str, list[str]] = {}
    for r in scene.attribute_vocab.select("attribute", "category").distinct().collect():
        if r.category is not None:
            found.setdefault(r.attribute, []).append(r.category)
    return found


def _by_category(attributes: list[str], categories: dict[str, list[str]]) -> dict[str, list[str]]:
    """Category -> the attributes of it."""
    found: dict[str, list[str]] = {}
    for a in attributes:
        for c in categories.get(a, ()):
            found.setdefault(c, []).append(a)
    return found


def references(scene: Scene, size: int = REFERENCE_SIZE, exclude_category: bool = False) -> DataFrame:
    """Ways to refer to an object: `size` of its attributes, or some of them with one neighbour and attributes of it.

    image_id, obj_idx, other (null without a neighbour), attributes, other_name, other_attributes, rel, direction; with
    exclude_category also category: for each category of the object's attributes, references that use none of it.
    """
    categories = _categories(scene) if exclude_category else {}

    def rows(nodes: Nodes, edges: Edges) -> Iterator[tuple]:
        near = _neighbours(nodes, edges)
        for n, (_, attributes) in nodes.items():
            for category, own in _by_category(attributes, categories).items() if exclude_category else [(None, ())]:
                for way in _ways(nodes, [a for a in attributes if a not in own], near[n], size):
                    yield (n, category, *way) if exclude_category else (n, *way)

    fields = {"obj_idx": "int", **({"category": "string"} if exclude_category else {}), "attributes": "array<string>", "other": "int", "other_name": "string", "other_attributes": "array<string>", "rel": "string", "direction": "int"}
    return _per_image(scene, rows, fields)


def _named(attributes: Column, name: Column) -> Column:
    return F.when(F.size(attributes) > 0, F.concat(words.and_list(attributes), F.lit(" "), name)).otherwise(name)


def reference_text(attributes: Column, other_name: Column, other_attributes: Column, rel: Column, direction: Column, joint: str) -> Column:
    """"red object that is near the small bolt" (joint " that ") or "red object, which ..." (joint ", which ")."""
    other = _named(other_attributes, other_name)
    clause = F.when(direction == 0, F.concat(F.lit("is "), rel, F.lit(" the "), other)).otherwise(F.concat(F.lit("the "), other, F.lit(" is "), rel))
    return F.concat(_named(attributes, F.lit("object")), F.coalesce(F.concat(F.lit(joint), clause), F.lit("")))


def _texts(df: DataFrame, joint: str) -> DataFrame:
    return df.withColumn("reference", reference_text(*[F.col(c) for c in ("attributes", "other_name", "other_attributes", "rel", "direction")], joint))


def fitting(scene: Scene, size: int = REFERENCE_SIZE, joint: str = " that ") -> DataFrame:
    """image_id, component, reference and how many objects of the component it fits."""

    def rows(nodes: Nodes, edges: Edges) -> Iterator[tuple]:
        near, of = _neighbours(nodes, edges), _classes(list(nodes), ((h, t) for h, _, t in edges))
        fits: dict[tuple[int, str], set[int]] = {}
        for n, (_, attributes) in nodes.items():
            for way in _ways(nodes, attributes, near[n], size):
                fits.setdefault((of[n], _reading(way, joint)), set()).add(n)
        return ((*k, len(v)) for k, v in fits.items())

    return _per_image(scene, rows, {"component": "int", "reference": "string", "n": "long"})


def object_questions(scene: Scene, size: int = REFERENCE_SIZE) -> DataFrame:
    """What a reference means, per component of more than one object: all names it fits, one drawn as answer."""

    def rows(nodes: Nodes, edges: Edges) -> Iterator[tuple]:
        near, of = _neighbours(nodes, edges), _classes(list(nodes), ((h, t) for h, _, t in edges))
        members = Counter(of.values())
        names: dict[int, set[str]] = {c: set() for c in members}
        meant: dict[tuple[int, str], set[str]] = {}
        for n, (label, attributes) in nodes.items():
            if members[of[n]] > 1:
                own = {label} - {None}
                names[of[n]] |= own
                for way in _ways(nodes, attributes, near[n], size):
                    meant.setdefault((of[n], _reading(way, " that ")), set()).update(own)
        return ((*k, sorted(v), sorted(names[k[0]])) for k, v in meant.items())

    grouped = _per_image(scene, rows, {"component": "int", "reference": "string", "answers": "array<string>", "names": "array<string>"})
    keys = ("object_questions", "image_id", "component", "reference")
    return grouped.select(
        "image_id", "component", F.concat(F.lit("What is the "), "reference", F.lit("?")).alias("prompt"), "answers", draws.pick(F.col("answers"), *keys).alias("answer"), draws.some(F.array_except("names", "answers"), 3, *keys).alias("others")
    )


def attribute_questions(scene: Scene, size: int = REFERENCE_SIZE) -> DataFrame:
    """What an attribute category of a referred object is; "other" is asked for as "attribute"."""
    categories = _categories(scene)

    def rows(nodes: Nodes, edges: Edges) -> Iterator[tuple]:
        near, of = _neighbours(nodes, edges), _classes(list(nodes), ((h, t) for h, _, t in edges))
        meant: dict[tuple[int, str, str], set[str]] = {}
        for n, (_, attributes) in nodes.items():
            for category, own in _by_category(attributes, categories).items():
                for way in _ways(nodes, [a for a in attributes if a not in own], near[n], size):
                    meant.setdefault((of[n], category, _reading(way, " that ")), set()).update(own)
        return ((*k, sorted(v)) for k, v in meant.items())

    grouped = _per_image(scene, rows, {"component": "int", "category": "string", "reference": "string", "answers": "array<string>"})
    kind = F.when(F.col("category") == "other", "attribute").otherwise(F.col("category"))
    return grouped.select("image_id", "component", "category", F.concat(F.lit("What is the "), kind, F.lit(" of the "), "reference", F.lit("?")).alias("prompt"), "answers", draws.pick(F.col("answers"), "attribute_questions", "image_id", "component", "category", "reference").alias("answer"))


def relation_questions(scene: Scene, size: int = REFERENCE_SIZE) -> DataFrame:
    """The relations from one object to another, each given by a reference that fits it alone and doesn't use the other."""

    def rows(nodes: Nodes, edges: Edges) -> Iterator[tuple]:
        near, of = _neighbours(nodes, edges), _classes(list(nodes), ((h, t) for h, _, t in edges))
        used: dict[tuple[int, str], tuple[set[int], set[int | None]]] = {}
        for n, (_, attributes) in nodes.items():
            for way in _ways(nodes, attributes, near[n], size):
                fits, uses = used.setdefault((of[n], _reading(way, ", which ")), (set(), set()))
                fits.add(n)
                uses.add(way[1])
        alone: dict[int, list[tuple[str, set[int | None]]]] = {}
        for (_, reference), (fits, uses) in used.items():
            if len(fits) == 1:
                alone.setdefault(*fits, []).append((reference, uses))
        rels: dict[tuple[int, int], set[str | None]] = {}
        for h, rel, t in edges:
            rels.setdefault((h, t), set()).add(rel)
        for (h, t), found in rels.items():
            answers = sorted(found, key=lambda r: (r is not None, r))
            heads, targets = [[r for r, uses in alone.get(end, ()) if uses - {other}] for end, other in ((h, t), (t, h))]
            for prompt in dict.fromkeys(f"What is the relation from the {a}, to the {b}?" for a in heads for b in targets):
                yield h, t, prompt, answers

    return _per_image(scene, rows, {"head": "int", "target": "int", "prompt": "string", "answers": "array<string>"})


def as_json(scene: Scene) -> DataFrame:
    """A JSON object per image: index -> name, attributes and outgoing relations."""
    out = scene.relations.groupBy("image_id", F.col("head").alias("obj_idx")).agg(F.sort_array(F.collect_list(F.struct("target", "rel"))).alias("out"))
    each = scene.objects.join(out, ["image_id", "obj_idx"], "left").select(
        "image_id", "obj_idx", F.struct(F.col("label").alias("name"), "attributes", F.coalesce(F.transform("out", lambda e: F.struct(e["rel"].alias("name"), e["target"].alias("object"))), F.array().cast("array<struct<name:string,object:int>>")).alias("relations")).alias("node")
    )
    return each.groupBy("image_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("obj_idx").cast("string"), "node"))))).alias("graph"))


def topological(scene: Scene) -> DataFrame:
    """image_id, component, obj_idx and place: heads before targets, of those that may come next the smallest index; where edges run in a circle, by number of edges.

    Edges are single_edges. A component's nodes and edges are one row, bounded by an image; each step of the aggregate takes
    the smallest node all of whose heads are taken.
    """
    parts = components(scene)
    members = parts.groupBy("image_id", "component").agg(F.sort_array(F.collect_list("obj_idx")).alias("nodes"))
    edges = single_edges(scene).join(parts.withColumnRenamed("obj_idx", "head"), ["image_id", "head"]).groupBy("image_id", "component").agg(F.collect_list(F.struct("head", "target")).alias("edges"))
    both = members.join(edges, ["image_id", "component"], "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<head:int,target:int>>")))
    none = F.array().cast("array<int>")

    def step(taken: Column, _: Column) -> Column:
        ready = F.filter("nodes", lambda n: ~F.array_contains(taken, n) & F.forall("edges", lambda e: (e["target"] != n) | F.array_contains(taken, e["head"])))
        return F.concat(taken, F.slice(ready, 1, 1))

    ordered = F.aggregate("nodes", none, step)
    degree = lambda n: F.size(F.filter("edges", lambda e: (e["head"] == n) | (e["target"] == n)))
    by_degree = F.transform(F.array_sort(F.transform("nodes", lambda n: F.struct((-degree(n)).alias("d"), n.alias("n")))), lambda x: x["n"])
    found = both.select("image_id", "component", ordered.alias("ordered"), by_degree.alias("by_degree"), "nodes")
    order = F.when(F.size("ordered") == F.size("nodes"), F.col("ordered")).otherwise(F.col("by_degree"))
    return found.select("image_id", "component", F.posexplode(order).alias("place", "obj_idx"))


# Captions: a component's text depends on what was mentioned before, so it is written object by object.

def _ordinal(n: int) -> str:
    return f"{n}{'th' if 10 < n % 100 < 14 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def _anded(parts: Sequence[str]) -> str:
    return " and ".join(parts) if len(parts) < 3 else ", ".join([*parts[:-1], f"and {parts[-1]}"])


def _order(nodes: list[int], edges: list[tuple[int, str, int]]) -> list[int]:
    """Heads before targets, smallest index first; in a cycle, by number of edges."""
    into = {n: sum(t == n for _, _, t in edges) for n in nodes}
    ready, out = sorted(n for n in nodes if not into[n]), []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for h, _, t in edges:
            if h == n:
                into[t] -= 1
                if not into[t]:
                    ready = sorted([*ready, t])
    degree = {n: sum(n in (h, t) for h, _, t in edges) for n in nodes}
    return out if len(out) == len(nodes) else sorted(nodes, key=lambda n: (-degree[n], n))


def component_caption(objects: dict[int, tuple[str, list[str], bool]], edges: list[tuple[int, str, int]]) -> str:
    """objects: index -> (name, attributes, whether the name is plural)."""
    alike: dict[tuple, list[int]] = {}
    for n in sorted(objects):
        alike.setdefault((objects[n][0], tuple(objects[n][1])), []).append(n)
    number = {n: k + 1 for group in alike.values() if len(group) > 1 for k, n in enumerate(group)}
    mentioned: set[int] = set()

    def noun(n: int) -> str:
        name, attributes, many = objects[n]
        text = " ".join(x for x in (_ordinal(number[n]) if n in number else "", _anded(attributes), name) if x)
        if n in number or n in mentioned:
            return f"the {text}"
        return text if many else f"{'an' if text[0] in 'aeiou' else 'a'} {text}"

    clauses = []
    for n in _order(sorted(objects), edges):
        subject, by_rel = noun(n), {}
        for h, rel, t in edges:
            if h == n:
                by_rel.setdefault(rel, []).append(t)
        said = []
        for rel, targets in by_rel.items():
            mentioned.update([n, *targets])
            said.append(f"{'are' if objects[n][2] else 'is'} {rel} {_anded([noun(t) for t in targets])}")
        if said:
            clauses.append(f"{subject} {_anded(said)}")
        elif n not in mentioned:
            clauses.append(f"there {'are' if objects[n][2] else 'is'} {subject}")
    return ";\n".join(clauses) + "."


def captions(scene: Scene) -> DataFrame:
    """image_id, component, size and caption of every component. An image's objects and drawn edges come as one row, and its components are found there."""
    kind = scene.objects.schema["image_id"].dataType.simpleString()
    own = F.struct("obj_idx", F.col("label").alias("label"), F.array_sort("attributes").alias("attributes"), words.looks_plural(F.col("label")).alias("many"))
    nodes = scene.objects.groupBy("image_id").agg(F.sort_array(F.collect_list(own)).alias("nodes"))
    edges = single_edges(scene).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("head", "rel", "target"))).alias("edges"))
    none = lambda c, of: F.coalesce(c, F.array().cast(f"array<{of}>"))
    both = nodes.join(edges, "image_id", "left").select(
        "image_id", "nodes.obj_idx", "nodes.label", none(F.col("nodes.attributes"), "array<string>").alias("attributes"), "nodes.many", none(F.col("edges.head"), "int").alias("head"), none(F.col("edges.rel"), "string").alias("rel"), none(F.col("edges.target"), "int").alias("target")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for image_id, idx, labels, attributes, many, heads, rels, targets in zip(*[_lists(c) for c in b.columns], strict=True):
                objects = dict(zip(idx, zip(labels, attributes, many, strict=True), strict=True))
                of = _classes(idx, zip(heads, targets, strict=True))
                for component in sorted(set(of.values())):
                    part = {n: o for n, o in objects.items() if of[n] == component}
                    out.append((image_id, component, len(part), component_caption(part, [e for e in zip(heads, rels, targets, strict=True) if of.get(e[0]) == component])))
            if out:
                kinds = [b.schema.field("image_id").type, pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["image_id", "component", "size", "caption"])

    return both.mapInArrow(run, f"image_id {kind}, component int, size int, caption string")


def image_captions(scene: Scene) -> DataFrame:
    """image_id and caption: a paragraph for each component, smallest first."""
    each = captions(scene).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("size", "component", "caption"))).alias("parts"))
    return each.select("image_id", F.array_join(F.transform("parts", lambda p: words.sentence_case(p["caption"])), "\n\n").alias("description"))
