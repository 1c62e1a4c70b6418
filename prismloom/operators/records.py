"""From questions to training records: templates, multiple choice, conversations, metadata counts and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismloom.functions import draws, words


def with_template(questions: DataFrame, templates: DataFrame, generator: str, slots: dict[str, Column], keys: list[str], every: bool = False) -> DataFrame:
    """prompt and response of each question from a drawn template, or from every template."""
    own = templates.where(F.col("generator") == generator).drop("generator")
    if every:
        met = questions.crossJoin(F.broadcast(own))  # a few thousand templates at most
    else:
        n = own.count()
        if n == 0:
            return questions.limit(0).withColumn("prompt", F.lit("")).withColumn("response", F.lit(""))
        met = questions.withColumn("template_id", F.floor(draws.uniform(f"{generator}|template", *keys) * n).cast("int")).join(F.broadcast(own), "template_id")
    fill = lambda c: words.filled(F.col(c), slots)
    return met.withColumn("prompt", fill("prompt")).withColumn("response", fill("response"))


def described(questions: DataFrame, description: str, slots: dict[str, Column]) -> DataFrame:
    return questions.withColumn("description", words.filled(F.lit(description), slots))


def multiple_choice(questions: DataFrame, op: str, keys: list[str], share: float = 1.0) -> DataFrame:
    """Turn a drawn share of questions (prompt, response, candidates array<string>, answer) into multiple choice.

    Candidates are permuted; one of two option styles and one of fourteen lead-ins are drawn; the response is the right
    option's full text.
    """
    mixed = draws.shuffled(F.col("candidates").cast("array<string>"), f"{op}|order", *keys)
    style = F.floor(draws.uniform(f"{op}|style", *keys) * 2)
    leads = F.array(*[F.lit(x) for x in words.OPTION_LEADS])
    q = questions.withColumn("__mixed", mixed).withColumn("__options", words.options(F.col("__mixed"), style))
    right = F.element_at("__options", F.array_position("__mixed", F.col("answer").cast("string")).cast("int"))
    chosen = draws.uniform(f"{op}|choice", *keys) < share
    prompt = F.concat("prompt", draws.pick(leads, f"{op}|lead", *keys), F.array_join("__options", ", "))
    return q.withColumn("prompt", F.when(chosen, prompt).otherwise(F.col("prompt"))).withColumn("response", F.when(chosen, right).otherwise(F.col("response"))).drop("__mixed", "__options")


def conversation(questions: DataFrame, op: str, keys: list[str], images: Column) -> DataFrame:
    """id, image and a two-turn conversation. images is an array; a single image's mark stands before or after the prompt by a coin."""
    marks = F.array_join(F.array_repeat(F.lit("<image>"), F.size(images)), " ")
    before = (F.size(images) > 1) | (draws.uniform(f"{op}|mark", *keys) < 0.5)
    asked = F.when(before, F.concat(marks, F.lit("\n"), "prompt")).otherwise(F.concat("prompt", F.lit("\n"), marks))
    turns = F.array(F.struct(F.lit("human").alias("from"), asked.alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("response").alias("value")))
    return questions.select(*keys, images.alias("image"), turns.alias("conversations"))


def numbered(df: DataFrame, order: list[str], buckets: int = 1024, name: str = "id") -> DataFrame:
    """Dense ids from 0 in the order of a hash of `order`, then order: ranges are counted, then numbered within, so no task sorts all rows."""
    part = F.floor(draws.uniform("numbered", *order) * buckets).cast("int")
    placed = df.withColumn("__part", part)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))  # at most `buckets` rows
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(draws.key("numbered", *order), *order)) - 1
    return placed.withColumn("__in", inside).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__in")).cast("long")).drop("__part", "__in", "__start")


def union_all(parts: dict[str, DataFrame], tag: str = "generator") -> DataFrame:
    """All rows, with the part's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def metadata_counts(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """kind, value, cnt over rows; each kind is a string or an array of strings."""
    tagged = [rows.select(F.lit(k).alias("kind"), F.explode(F.when(F.lit(True), v)).alias("value")) for k, v in kinds.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("cnt"))


def rarity_weight(candidates: DataFrame, counts: DataFrame, keys: list[str], values: str) -> DataFrame:
    """weight of each candidate: 1 / mean of its values' counts cubed; an unseen value counts 1, no values give weight 1."""
    each = candidates.select(*keys, F.explode(values).alias("value"))
    weighed = each.join(counts.groupBy("value").agg(F.sum("cnt").alias("cnt")), "value", "left").groupBy(*keys).agg((1 / F.avg(F.pow(F.coalesce("cnt", F.lit(1)).cast("double"), 3))).alias("weight"))
    return candidates.join(weighed, keys, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def turn_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Question and answer of each turn pair (2i, 2i + 1) of conversations with two turns or more; marks of images and angle brackets are taken out."""
    order = Window.partitionBy(key).orderBy("turn")
    clean = F.trim(F.regexp_replace(F.replace("text", F.lit("<image>"), F.lit("")), "[<>]", ""))
    t = turns.select(key, F.row_number().over(order).alias("no"), clean.alias("question"), F.lead(clean).over(order).alias("answer"))
    return t.where("no % 2 = 1 and answer is not null").select(key, ((F.col("no") - 1) / 2).cast("int").alias("pair"), "question", "answer")


def interleaved(text: Column, mark: str, values: Column) -> Column:
    """The k-th mark in text replaced by the k-th value; marks without a value vanish."""
    parts = F.split(text, mark)
    n = F.size(parts)
    filled = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k <= n - 1, F.coalesce(F.try_element_at(values, k.cast("int")), F.lit(""))).otherwise(""))
    return F.array_join(F.zip_with(parts, filled, lambda a, b: F.concat(a, b)), "")


def lettered(choices: Column, answer: Column, op: str, *keys: str) -> Column:
    """Permuted choices with letters and the right one's letter."""
    mixed = draws.shuffled(choices, op, *keys)
    listed = F.array_join(F.transform(mixed, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c)), "\n")
    return F.struct(listed.alias("choices"), F.char(F.array_position(mixed, answer).cast("int") + 64).alias("letter"))


def shuffled_regions(objects: DataFrame, relations: DataFrame, op: str) -> tuple[DataFrame, DataFrame]:
    """Objects of each image in a drawn order with new indexes, and relations on them."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(draws.key(op, "image_id", "obj_idx"), "obj_idx")) - 1
    moved = objects.withColumn("new_idx", place)
    ids = moved.select("image_id", "obj_idx", "new_idx")
    mapped = relations.join(ids.select("image_id", F.col("obj_idx").alias("head"), F.col("new_idx").alias("new_head")), ["image_id", "head"]).join(ids.select("image_id", F.col("obj_idx").alias("target"), F.col("new_idx").alias("new_target")), ["image_id", "target"])
    return moved, mapped.select("image_id", F.col("new_head").alias("head"), "rel", F.col("new_target").alias("target"))


def subset(objects: DataFrame, relations: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects in kept(image_id, obj_idx) with dense new indexes, and the relations whose ends are both kept."""
    own = objects.join(kept, ["image_id", "obj_idx"], "left_semi").withColumn("new_idx", F.row_number().over(Window.partitionBy("image_id").orderBy("obj_idx")) - 1)
    ids = own.select("image_id", "obj_idx", "new_idx")
    mapped = relations.join(ids.select("image_id", F.col("obj_idx").alias("head"), F.col("new_idx").alias("new_head")), ["image_id", "head"]).join(ids.select("image_id", F.col("obj_idx").alias("target"), F.col("new_idx").alias("new_target")), ["image_id", "target"])
    return own, mapped.select("image_id", F.col("new_head").alias("head"), "rel", F.col("new_target").alias("target"))


def category_turns(edges: DataFrame, category: Column, most: int = 20) -> DataFrame:
    """A question and answer for each subject and category: "regionN rel" sorted by region, at most `most`."""
    place = F.row_number().over(Window.partitionBy("image_id", "head", "category").orderBy("target", "rel"))
    each = edges.withColumn("category", category).select("image_id", "head", "category", "rel", "target").distinct().withColumn("no", place).where(F.col("no") <= most)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "rel"))), lambda e: F.concat(F.lit("region"), (e["target"] + 1).cast("string"), F.lit(" "), e["rel"])), ", ")
    return each.groupBy("image_id", "head", "category").agg(text.alias("response"))


def region_list(images: DataFrame, n: str) -> DataFrame:
    """"There are n regions: region1, region2, ..." of each image."""
    names = F.array_join(F.transform(F.sequence(F.lit(1), F.col(n).cast("int")), lambda k: F.concat(F.lit("region"), k.cast("string"))), ", ")
    return images.withColumn("text", F.concat(F.lit("There are "), F.col(n).cast("string"), F.lit(" regions: "), names, F.lit(".")))


def sharded(df: DataFrame, index: str, n: int, k: int) -> DataFrame:
    """Every n-th row from the k-th, by index."""
    return df.where(F.pmod(F.col(index), F.lit(n)) == k)


def all_different(sets: Column) -> Column:
    """Whether the sets of an array are pairwise distinct, whatever the order of their elements."""
    return F.size(F.array_distinct(F.transform(sets, lambda x: F.array_sort(x)))) == F.size(sets)


def common_columns(parts: list[DataFrame]) -> list[str]:
    """Columns that all parts have, in the order of the first."""
    return [c for c in parts[0].columns if all(c in p.columns for p in parts)]


def with_common_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows with what the parts have in common."""
    keep = common_columns(parts)
    return reduce(DataFrame.unionByName, [p.select(*keep) for p in parts])


def region_conversations(turns: DataFrame, regions: DataFrame, keep_brackets: bool = False) -> DataFrame:
    """One record a conversation: its turn pairs, angle brackets taken out unless kept, and its regions as corner boxes.

    turns(conv_id, turn, text); regions(conv_id, no, x, y, w, h).
    """
    text = F.col("text") if keep_brackets else F.regexp_replace("text", "[<>]", "")
    order = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.select("conv_id", F.row_number().over(order).alias("no"), text.alias("question"), F.lead(text).over(order).alias("answer")).where("no % 2 = 1 and answer is not null")
    said = F.struct("no", F.array(F.struct(F.lit("human").alias("from"), F.col("question").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("answer").alias("value"))).alias("t"))
    talks = t.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["t"])).alias("conversations"))
    corner = F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    boxes_ = regions.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", corner.alias("box")))), lambda x: x["box"]).alias("boxes"))
    return talks.join(boxes_, "conv_id", "left")
