"""Question grammar: structures with named slots, expanded into prompt and response templates.

A slot named in SLOTS runs over its phrases; any other slot stays for the record to fill. A sentence gives a plain
question and one behind each of four imperatives; a noun phrase gives one prompt behind each of five.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession

# The phrase lists that questions are made of.
AMONG = ["in the list of", "among", "in", "from", "out of"]
SEEN = ["exist", "are available", "you see", "are there", "are visible", "present"]
FOUND_AT = ["located at", "positioned at", "found at", "present at"]
APPEARS = ["appears", "occurs", "is seen"]
ALL_IMAGES = ["in these images", "across these images", "among these images"]
IN_DEPTH = ["in depth"]
FROM_CAMERA = ["in depth", "to the camera", "to the viewpoint"]
BEFORE_SENTENCE = ["can you tell", "tell me", "identify", "determine"]
BEFORE_PHRASE = [*BEFORE_SENTENCE, "provide"]
DIRECTION_VERBS = ["is positioned on", "is located on"]
DISTANCE_VERBS = ["is positioned", "is located"]
MOST = {
    "most": (["the most frequent", "the most commonly found", "the most frequently occurring"], ["the most frequently", "the most commonly"], ["the most instances of", "the most", "the most of", "the most number of"]),
    "least": (["the least frequent", "the least commonly found", "the least frequently occurring"], ["the least frequently", "the least commonly"], ["the least instances of", "the least", "the least of", "the least number of"]),
}
SIDES = {
    "left": ["the most leftward", "the extreme left", "the far left"],
    "right": ["the most rightward", "the extreme right", "the far right"],
    "top": ["the most top side", "the extreme top", "the most upward"],
    "bottom": ["the most bottom side", "the extreme bottom", "the most downward"],
}
DISTANCES = {"closer": (["closer", "nearer", "closest"], ["closer", "nearer", "closest"]), "farther": (["farther", "farthest"], ["farther", "farthest", "farther away"])}
REFERENCES = {"same": ["the same object", "the part of the same object"], "diff": ["the different objects", "the part of different objects"]}

# What a generator says of itself where descriptions are asked for.
DESCRIPTIONS = {
    "ExistsObject": "There {be} {count_name}.",
    "MostObject": "Among {candidates}, {name} is the most frequent object.",
    "LeastObject": "Among {candidates}, {name} is the least frequent object.",
    "LeftMostObject": "Among {candidates}, {name} is on the most left side.",
    "RightMostObject": "Among {candidates}, {name} is on the most right side.",
    "TopMostObject": "Among {candidates}, {name} is on the most top side.",
    "BottomMostObject": "Among {candidates}, {name} is on the most bottom side.",
    "ExistsAttribute": "There {be} {count_name}.",
    "AttributeBBox": "The {name} at region {bbox} is {attribute_values}.",
    "ExistsRelation": "{object1} {be} {relation} {object2}.",
    "RelationBBox": "Object at {bbox1} is {relation} object at {bbox2}.",
    "CloserPoint": "Point {closer} is closer than {farther}.",
    "FartherPoint": "Point {farther} is further than {closer}.",
    "CloserObject": "{closer} is closer than {farther}.",
    "FartherObject": "{farther} is farther than {closer}.",
    "CloserToAnchorObject": "{closer} is closer to {anchor} than {farther}.",
    "FartherToAnchorObject": "{farther} is farther to {anchor} than {closer}.",
    "SameObjectSeg": "Among points {candidates}, {same_point} is in the same object with {anchor_point}.",
    "DiffObjectSeg": "Among points {candidates}, {diff_point} is in the different object with {anchor_point}.",
}

Family = tuple[list[str], list[str], str, dict[str, list[str]]]


def _frequency(kind: str) -> Family:
    adjectives, adverbs, _ = MOST[kind]
    return (
        [
            "{among} {candidates}, which object is {adj}",
            "{among} {candidates}, what is {adj} object",
            "which object is {adj}, {among} {candidates}",
            "what is the {adj} object {among} {candidates}",
            "{among} {candidates}, which object {appears} {adv}",
            "which object {appears} {adv}, {among} {candidates}",
        ],
        ["{adj} object {among} {candidates}"],
        "{name}",
        {"among": AMONG, "adj": adjectives, "adv": adverbs, "appears": APPEARS},
    )


def _side(side: str) -> Family:
    return (
        [
            "{among} {candidates}, which one is on {side}",
            "{among} {candidates}, what is {side} object",
            "which object is {side}, {among} {candidates}",
            "what is the {side} object {among} {candidates}",
            "{among} {candidates}, which object {verb} {side}",
            "which object {verb} {side}, {among} {candidates}",
        ],
        ["{side} object {among} {candidates}"],
        "{name}",
        {"among": AMONG, "side": SIDES[side], "verb": DIRECTION_VERBS},
    )


def _distance(kind: str, thing: str, anchor: str, view: list[str]) -> Family:
    adjectives, adverbs = DISTANCES[kind]
    to = f" to the {{{anchor}}}" if anchor else ""
    return (
        [
            f"{{among}} {{candidates}}, which {thing} is {{adj}}{to} {{view}}",
            f"{{among}} {{candidates}}, what is {{adj}} {thing}{to} {{view}}",
            f"which {thing} is {{adj}}{to} {{view}}, {{among}} {{candidates}}",
            f"what is the {{adj}} {thing}{to} {{view}}, {{among}} {{candidates}}",
            f"{{among}} {{candidates}}, which {thing} {{verb}} {{adv}}{to} {{view}}",
            f"which {thing} {{verb}} {{adv}}{to} {{view}}, {{among}} {{candidates}}",
        ],
        [f"the {{adj}} {thing}{to} {{view}}, {{among}} {{candidates}}"],
        f"{{{kind}}}",
        {"among": AMONG, "adj": adjectives, "adv": adverbs, "verb": DISTANCE_VERBS, "view": view},
    )


def _reference(kind: str) -> Family:
    return (
        [
            "{among} {candidates}, which point is in {reference} as {anchor_point}",
            "which point from {candidates} is in {reference} as {anchor_point}",
            "which of {candidates} is in {reference} as {anchor_point}",
            "which point {among} {candidates} belong to {reference} as {anchor_point}",
        ],
        ["the point that is in {reference} as {anchor_point} {among} {candidates}"],
        f"{{{kind}_point}}",
        {"among": AMONG, "reference": REFERENCES[kind]},
    )


def _how_many(what: str, where: str, response: str) -> Family:
    heads = ["how many", "what is the number of", "what is the quantity of"]
    return (
        [f"{h} {what}{that}{where}" for h in heads for that in ("", " {seen}" if h == "how many" else " that {seen}")],
        [f"the {noun} of {what}{that}{where}" for that in ("", " that {seen}") for noun in ("number", "quantity")],
        response,
        {"seen": SEEN, "all_images": ALL_IMAGES},
    )


def _has(verb_forms: list[str], rest: str, slots: dict[str, list[str]] | None = None) -> Family:
    return [f"which image {v} {rest}" for v in verb_forms], [], "{answer}", slots or {}


_HAS, _HAS_NOT = ["has", "contains", "shows"], ["doesn't have", "doesn't contain", "doesn't show"]
_RELATED = ["how are {x} related", "what relation exists between {x}", "what kind of relationship exists between {x}", "what is the specific relationship between {x}", "what is the relation between {x}"]


def _related(ends: str, objects: str) -> Family:
    return [s.replace("{x}", objects + ends) for s in _RELATED], [f"the relation between {ends}"], "{relation}", {}


def _attributes(what: str) -> Family:
    return (
        [f"what {'are' if what == 'attributes' else 'is'} the {what} {p} the {{name}} {{at}} region {{bbox}}" for p in ("of", "for")],
        [f"the {what} {p} the {{name}} {{at}} region {{bbox}}" for p in ("of", "for")],
        "{attribute_values}",
        {"at": FOUND_AT},
    )


def families() -> dict[str, Family]:
    """Generator -> (sentences, noun phrases, response, phrases of slots)."""
    every = {"all_images": ALL_IMAGES}
    return {
        "ExistsObject": _how_many("{name}", "", "{count}"),
        "MostObject": _frequency("most"),
        "LeastObject": _frequency("least"),
        "LeftMostObject": _side("left"),
        "RightMostObject": _side("right"),
        "TopMostObject": _side("top"),
        "BottomMostObject": _side("bottom"),
        "ExistsAttribute": _how_many("{name}", "", "{count}"),
        "AttributeBBox": _attributes("attributes"),
        "TypedAttributeBBox": _attributes("{attribute_type}"),
        "ExistsRelation": _related("{object1} and {object2}", ""),
        "RelationBBox": _related("{bbox1} and {bbox2}", "objects at "),
        "HeadRelation": (
            ["{among} {candidates}, which one is {relation} {object2}", "which one is {relation} {object2} {among} {candidates}", "which of {candidates} is {relation} {object2}"],
            ["the one that {relation} {object2} {among} {candidates}"],
            "{object1}",
            {"among": AMONG},
        ),
        "CloserObject": _distance("closer", "object", "", FROM_CAMERA),
        "FartherObject": _distance("farther", "object", "", FROM_CAMERA),
        "CloserToAnchorObject": _distance("closer", "object", "anchor", IN_DEPTH),
        "FartherToAnchorObject": _distance("farther", "object", "anchor", IN_DEPTH),
        "CloserPoint": _distance("closer", "point", "", FROM_CAMERA),
        "FartherPoint": _distance("farther", "point", "", FROM_CAMERA),
        "SameObjectSeg": _reference("same"),
        "DiffObjectSeg": _reference("diff"),
        "HasObject": _has(_HAS, "{object}"),
        "HasAttributedObject": _has(_HAS, "{attribute} {object}"),
        "HasNotObject": _has(_HAS_NOT, "{object}"),
        "HasNotAttributedObject": _has(_HAS_NOT, "{attribute} {object}"),
        "HasRelation": (["in which image {object1} is {relation} {object2}", "which image shows that {object1} is {relation} {object2}"], [], "{answer}", {}),
        "HasNotRelation": (["in which image {object1} isn't {relation} {object2}", "which image doesn't show that {object1} is {relation} {object2}"], [], "{answer}", {}),
        "HasMostObject": _has(_HAS, "{most} {object}", {"most": MOST["most"][2]}),
        "HasLeastObject": _has(_HAS, "{most} {object}", {"most": MOST["least"][2]}),
        "CountObject": _how_many("{object}", " {all_images}", "{answer}"),
        "CountAttributeObject": _how_many("{attribute} {object}", " {all_images}", "{answer}"),
        "CommonObject": (
            ["what are common objects {all_images}", "what are the objects that are common {all_images}", "which objects do these images have in common", "what objects appear in all of these images", "what objects are seen in all of these images"],
            ["the common objects {all_images}", "the objects that are common {all_images}", "the objects that appear in all of these images", "the objects that are seen in all of these images"],
            "{objects}",
            every,
        ),
        "CommonAttribute": (
            ["what is common attribute of {object} {all_images}", "what is a similar attribute among these {object} {all_images}", "what attribute is consistent across these {object} {all_images}"],
            ["the common attribute of {object} {all_images}", "the similar attribute among these {object} {all_images}", "the attribute that is consistent across these {object} {all_images}"],
            "{attributes}",
            every,
        ),
        "CompareAttribute": (
            ["what is the difference of attributes of {object} {all_images}", "what differences can be observed in the attributes of {object} {all_images}", "How do the attributes of {object} compare {all_images}"],
            ["the difference of attributes of {object} {all_images}"],
            "{answer}",
            every,
        ),
        "CompareRelation": (
            ["what is the difference of the relation between {object1} and {object2} {all_images}", "what differences can be observed in the relation between {object1} and {object2}", "How do the relation between {object1} and {object2} compare {all_images}"],
            ["the difference of the relation between {object1} and {object2} {all_images}"],
            "{answer}",
            every,
        ),
    }


#: Families in which a structure counts once for each phrase of these slots even where it doesn't use them.
WEIGHTED = {"CountObject": ("seen", "all_images"), "CountAttributeObject": ("seen", "all_images"), "HeadRelation": ("among",), "SameObjectSeg": ("among", "reference"), "DiffObjectSeg": ("among", "reference"), "CommonObject": ("all_images",), "CompareRelation": ("all_images",)}


def capitalize(text: str) -> str:
    """First character upper case, the rest lower."""
    return text[:1].upper() + text[1:].lower()


def _filled(structure: str, slots: dict[str, list[str]], always: tuple[str, ...]) -> list[str]:
    used = [s for s in slots if f"{{{s}}}" in structure or s in always]
    out = []
    for values in itertools.product(*[slots[s] for s in used]):
        text = structure
        for s, v in zip(used, values, strict=True):
            text = text.replace(f"{{{s}}}", v)
        out.append(text)
    return out


def expand(name: str) -> list[tuple[str, str]]:
    """(prompt, response) templates of a generator; duplicates are kept, they weigh."""
    sentences, phrases, response, slots = families()[name]
    always = WEIGHTED.get(name, ())
    asked = [s for x in sentences for s in _filled(x, slots, always)]
    named = [s for x in phrases for s in _filled(x, slots, always)]
    prompts = [f"{lead}{s}?" for s in asked for lead in ("", *(f"{b} " for b in BEFORE_SENTENCE))]
    prompts += [f"{b} {p}{'?' if b == 'can you tell' else '.'}" for p in named for b in BEFORE_PHRASE]
    return [(capitalize(p), response) for p in prompts]


def templates(spark: SparkSession, mode: str = "qa") -> DataFrame:
    """generator, template_id, prompt, response (mode "qa"), or generator, template_id, description; a few thousand rows."""
    if mode == "description":
        return spark.createDataFrame([(g, 0, d) for g, d in DESCRIPTIONS.items()], "generator string, template_id int, description string")
    if mode != "qa":
        raise ValueError(f"unknown template mode {mode!r}")
    rows = [(g, k, p, r) for g in families() for k, (p, r) in enumerate(expand(g))]
    return spark.createDataFrame(rows, "generator string, template_id int, prompt string, response string")


def slots_of(template: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", template)))
