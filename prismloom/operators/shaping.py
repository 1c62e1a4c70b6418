"""Shaping of training records: grounded conversations, reasoning turns, referring turns, choices, tag rewriting.

Turns are arrays of struct(from, value). Question texts are parameters, drawn where there are several.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismloom.functions import boxes, draws, words
from prismloom.operators import parse
from prismloom.plans.scene import Scene

SHORT_ANSWER = "Answer the question using a single word or phrase."
LETTER_ANSWER = "Answer with the option's letter from the given choices directly."


def turn(who: str, value: Column) -> Column:
    return F.struct(F.lit(who).alias("from"), value.alias("value"))


def exchange(question: Column, answer: Column) -> Column:
    return F.array(turn("human", question), turn("gpt", answer))


def drawn(questions: Sequence[str], op: str, *keys: str) -> Column:
    return draws.pick(F.array(*[F.lit(q) for q in questions]), op, *keys)


def graph_conversations(texts: DataFrame, questions: Sequence[str], op: str = "graph_conversations") -> DataFrame:
    """image_id and a question for the scene graph with its text as answer; texts(image_id, text)."""
    return texts.select("image_id", exchange(drawn(questions, op, "image_id"), F.col("text")).alias("conversations"))


def panoptic_conversations(scene: Scene, questions: Sequence[str], most: int = 1_000_000, most_relations: int = 1_000_000) -> DataFrame:
    """image_id and a question for the scene graph of the image's first `most` regions, labels being panoptic categories.

    A region has at most `most_relations` relations; those with a region that isn't shown are left out.
    """
    shown = scene.objects.where(F.col("obj_idx") < most)
    named = shown.withColumns({"label": words.panoptic_name(F.col("label")), "attributes": F.array().cast("array<string>")})
    edges = scene.relations.where((F.col("head") < most) & (F.col("target") < most))
    part = Scene(scene.images, named, edges, scene.attribute_vocab, scene.object_vocab)
    return graph_conversations(parse.graph_texts(part, most_relations=most_relations), questions, "panoptic_conversations")


def reasoning_turns(questions: DataFrame, regions: DataFrame, lead: str, most: int = 1_000_000) -> DataFrame:
    """One record an image: each question answered by the lines of the regions it needs and "Answer: ...".

    questions(image_id, no, question, answer, region_ids array<int>); regions(image_id, region_id, line). The first
    question of an image has `lead` before it.
    """
    q = questions.where(F.col("no") < most)
    needed = q.select("image_id", "no", F.explode("region_ids").alias("region_id")).join(regions, ["image_id", "region_id"]).groupBy("image_id", "no").agg(F.sort_array(F.collect_set(F.struct("region_id", "line"))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    each = q.join(needed, ["image_id", "no"], "left").select(
        "image_id", "no", exchange(F.when(F.col("no") == 0, F.concat(F.lit(f"{lead} "), "question")).otherwise(F.col("question")), F.concat(F.coalesce(lines, F.lit("")), F.lit("Answer: "), "answer")).alias("turns")
    )
    return each.groupBy("image_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "turns"))), lambda x: x["turns"])).alias("conversations"))


def referring_turns(captions: DataFrame, grounding: Sequence[str], captioning: Sequence[str], share: float = 0.5, with_boxes: bool = False) -> DataFrame:
    """One record an image and kind: regions found for captions, or captions for regions, a drawn share the latter.

    captions(image_id, no, caption, region_index, and with_boxes x1 ... y2, width, height); {} in a question takes the
    caption or region.
    """
    region = boxes.box_thousandths("", F.col("width"), F.col("height")) if with_boxes else F.concat(F.lit("region"), (F.col("region_index") + 1).cast("string"))
    by_region = draws.uniform("referring_turns", "image_id", "no") < share
    ask = lambda qs, x: F.replace(drawn(qs, "referring_turns|question", "image_id", "no"), F.lit("{}"), x)
    each = captions.select("image_id", "no", by_region.alias("captioning"), F.when(by_region, exchange(ask(captioning, region), F.col("caption"))).otherwise(exchange(ask(grounding, F.col("caption")), region)).alias("turns"))
    return each.groupBy("image_id", "captioning").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "turns"))), lambda x: x["turns"])).alias("conversations"))


def subject_turns(relations: DataFrame, description: Callable[[Column], Column], most: int = 20) -> DataFrame:
    """One record an image: for each subject the question `description(region)` and its relations, sorted by region."""
    place = F.row_number().over(Window.partitionBy("image_id", "head").orderBy("target", "rel"))
    own = relations.select("image_id", "head", "rel", "target").distinct().withColumn("no", place).where(F.col("no") <= most)
    name = lambda x: F.concat(F.lit("region"), (x + 1).cast("string"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "rel"))), lambda e: F.concat(name(e["target"]), F.lit(" "), e["rel"])), ", ")
    each = own.groupBy("image_id", "head").agg(text.alias("answer")).select("image_id", "head", exchange(description(name(F.col("head"))), F.col("answer")).alias("turns"))
    return each.groupBy("image_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("head", "turns"))), lambda x: x["turns"])).alias("conversations"))


def summaries_with_regions(summaries: DataFrame, mapping: DataFrame) -> DataFrame:
    """"<a dog> [3, 5]" becomes "|a dog| at [region1, region2]"; ids without a region go, and without any the words stay alone.

    summaries(image_id, text); mapping(image_id, object_id string, region int from 0). The map of one image is an array.
    """
    maps = mapping.groupBy("image_id").agg(F.map_from_entries(F.collect_set(F.struct("object_id", "region"))).alias("m"))
    pattern = r"<[^>]+>\s*\[[^\]]+\]"
    marks = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))

    def reworded(mark: Column) -> Column:
        words = F.regexp_extract(mark, r"<([^>]+)>", 1)
        ids = F.transform(F.split(F.regexp_extract(mark, r"\[([^\]]+)\]$", 1), ","), lambda x: F.trim(x))
        known = F.filter(F.transform(ids, lambda x: F.try_element_at(F.col("m"), x)), lambda r: r.isNotNull())
        listed = F.array_join(F.transform(known, lambda r: F.concat(F.lit("region"), (r + 1).cast("string"))), ", ")
        return F.when(F.size(known) > 0, F.concat(F.lit("|"), words, F.lit("| at ["), listed, F.lit("]"))).otherwise(words)

    gaps = F.split("text", pattern, -1)
    joined = summaries.join(maps, "image_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,int>")))
    return joined.select("image_id", F.array_join(F.zip_with(gaps, F.transform(marks, reworded), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "").alias("text"))


def located_questions(rows: DataFrame, forms: Sequence[str] = ("box", "point")) -> DataFrame:
    """A record for each form: the question with the box's or the point's text and a request for a short answer.

    rows(id, question, answer, x1 ... y2, px, py, width, height).
    """
    w, h = F.col("width"), F.col("height")
    places = {"box": boxes.box_thousandths("", w, h), "point": boxes.thousandths([F.col("px"), F.col("py")], [w, h])}
    each = rows.select("id", "question", "answer", F.explode(F.array(*[F.struct(F.lit(f).alias("form"), places[f].alias("place")) for f in forms])).alias("f"))
    return each.select("id", "f.form", exchange(F.concat_ws("\n", F.concat_ws(" ", "question", "f.place"), F.lit(SHORT_ANSWER)), F.col("answer")).alias("conversations"))


def asked_twice(rows: DataFrame, forms: Sequence[str] = ("box", "point")) -> DataFrame:
    """A record for the question that names its object (form "object"), and for each form the general question with the place; all ask for a short answer.

    rows(id, object_question, general_question, answer, x1 ... y2, px, py, width, height).
    """
    by_name = rows.select("id", F.lit("object").alias("form"), exchange(F.concat_ws("\n", "object_question", F.lit(SHORT_ANSWER)), F.col("answer")).alias("conversations"))
    return by_name.unionByName(located_questions(rows.withColumn("question", F.col("general_question")), forms))


def inference_turns(rows: DataFrame, questions: dict[str, Sequence[str]], lists: Sequence[str], op: str = "inference_turns") -> DataFrame:
    """One record an id: for each kind, in drawn order, a question on the subjects and its inferences joined by "; ".

    rows(id, subjects, kind, no, text); {} in questions[kind] takes the subjects, and the first question asks for a
    list. A kind with an inference that could not be worded (null) is left out.
    """
    each = rows.groupBy("id", "subjects", "kind").agg(F.sort_array(F.collect_list(F.struct("no", "text"))).alias("l"))
    worded = each.where(F.forall("l", lambda x: x["text"].isNotNull())).withColumn("answer", F.array_join(F.transform("l", lambda x: x["text"]), "; "))
    ask = F.coalesce(*[F.when(F.col("kind") == k, drawn(qs, f"{op}|question", "id", "kind")) for k, qs in questions.items()])
    asked = worded.withColumn("question", F.replace(ask, F.lit("{}"), F.col("subjects"))).where("question is not null")
    place = F.row_number().over(Window.partitionBy("id").orderBy(draws.key(op, "id", "kind"), "kind"))
    listed = F.when(F.col("place") == 1, F.concat_ws(" ", "question", drawn(lists, f"{op}|list", "id"))).otherwise(F.col("question"))
    turns = asked.withColumn("place", place).select("id", "place", exchange(listed, F.col("answer")).alias("turns"))
    return turns.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "turns"))), lambda x: x["turns"])).alias("conversations"))


def box_choices(rows: DataFrame, lead: str, op: str = "box_choices") -> DataFrame:
    """Four boxes in drawn order with letters; the right one is the last before the draw. rows(id, question, choices array<string>)."""
    mixed = draws.shuffled(F.col("choices"), op, "id")
    listed = F.array_join(F.transform(mixed, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c)), "\n")
    letter = F.char(F.array_position(mixed, F.element_at("choices", -1)).cast("int") + 64)
    return rows.select("id", exchange(F.concat(F.lit(lead), "question", F.lit("\n"), listed, F.lit(f"\n{LETTER_ANSWER}")), letter).alias("conversations"))


def numbers_as_tags(text: Column, names: Column) -> Column:
    """Each whole number k in text becomes "{name k} at region{k}", names counting from 1; null if a number has no name."""
    pattern = r"\b\d+\b"
    gaps, found = F.split(text, pattern, -1), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x.try_cast("int"))
    known = F.forall(found, lambda k: F.coalesce((k >= 1) & (k <= F.size(names)), F.lit(False)))
    tags = F.transform(found, lambda k: F.concat(F.try_element_at(names, F.greatest(k, F.lit(1))), F.lit(" at region"), k.cast("string")))
    return F.when(known, F.array_join(F.zip_with(gaps, tags, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), ""))


def tokens_as_text(tokens: Column, names: Column) -> Column:
    """Tokens joined, ids (struct token, ids array<int> from 0) as "{name} at region{id + 1}", no space before marks. tokens: array<struct<token,ids>>."""
    tag = lambda k: F.concat(F.try_element_at(names, k + 1), F.lit(" at region"), (k + 1).cast("string"))
    parts = F.flatten(F.transform(tokens, lambda t: F.when(t["ids"].isNotNull(), F.transform(t["ids"], tag)).otherwise(F.array(t["token"]))))
    return F.regexp_replace(F.array_join(parts, " "), r"\s(?=[,.?!])", "")


def lettered_question(question: Column, context: Column, choices: Column, right: Column) -> Column:
    """Context lines, the question and lettered choices; the answer is "Answer: " and the right choice."""
    listed = F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c)), "\n")
    return exchange(F.concat_ws("\n", context, question, listed), F.concat(F.lit("Answer: "), F.element_at(choices, right + 1)))


def grounded_chunks(rows: DataFrame) -> DataFrame:
    """phrase and box text of noun chunks [start, end, x1, y1, x2, y2, score] of rows(id, caption, chunks array<array<double>>), coordinates as shares."""
    each = rows.select("id", "caption", F.posexplode("chunks").alias("no", "c"))
    start, end = F.col("c")[0].cast("int"), F.col("c")[1].cast("int")
    one = F.lit(1.0)
    return each.select("id", "no", F.substring("caption", start + 1, end - start).alias("phrase"), boxes.thousandths([F.col("c")[k] for k in range(2, 6)], [one] * 4).alias("box"))


def tidy_tags(text: Column) -> Column:
    """No space inside tags' edges, one between tags."""
    out = F.trim(text)
    for a, b in (("> ", ">"), (" </", "</"), ("><", "> <")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def marked_phrases(text: Column, start: str, end: str, places: Column) -> Column:
    """The k-th start ... end pair becomes its words followed by the k-th place."""
    pattern = f"\\Q{start}\\E(.*?)\\Q{end}\\E"
    gaps, words = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    named = F.transform(words, lambda w, i: F.concat_ws(" ", F.trim(w), F.try_element_at(places, i + 1)))
    return F.array_join(F.zip_with(gaps, named, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def described_regions(rows: DataFrame, questions: Sequence[str]) -> DataFrame:
    """A question and answer for each region, the answer what follows "<...>: " in the description at its place; rows(image_id, descriptions)."""
    each = rows.select("image_id", F.posexplode("descriptions").alias("no", "d")).select("image_id", "no", F.regexp_extract("d", r"<.*>: (.*)", 1).alias("answer")).where("answer <> ''")
    ask = F.replace(drawn(questions, "described_regions", "image_id", "no"), F.lit("{}"), F.concat(F.lit("region"), (F.col("no") + 1).cast("string")))
    return each.select("image_id", "no", exchange(ask, F.col("answer")).alias("conversations"))


def proposals(relations: DataFrame, setup: int, all_objects: DataFrame, mentioned: DataFrame, detailed: DataFrame, most: int = 100) -> DataFrame:
    """image_id, obj_idx of the regions to show: 0 subjects, 1 subjects and objects, 2 all mentioned, 3 with details, 4 those and the uncovered rest.

    Where there are more than `most` in an image, the first by index stay; the setups name their sets, each (image_id, obj_idx).
    """
    subjects = relations.select("image_id", F.col("head").alias("obj_idx"))
    ends = subjects.unionByName(relations.select("image_id", F.col("target").alias("obj_idx")))
    chosen = {0: subjects, 1: ends, 2: ends.unionByName(mentioned), 3: detailed, 4: detailed.unionByName(all_objects.join(detailed, ["image_id", "obj_idx"], "left_anti"))}[setup]
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("obj_idx"))
    return chosen.distinct().withColumn("no", place).where(F.col("no") <= most).drop("no")


def batched_model(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """The hook for models: run(iterator of pandas frames) -> iterator of pandas frames, as a mapInPandas."""
    return rows.mapInPandas(run, schema)


def comma_attributes(output: Column) -> Column:
    """A model's comma-separated attributes, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(output, ","), lambda x: F.trim(x)), lambda x: x != "")
