"""English wording as columns: lists, numbers, plurals, options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, irregular plurals and the lead-ins of options.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
IRREGULAR = {"man": "men", "woman": "women", "person": "people", "child": "children", "foot": "feet", "tooth": "teeth", "goose": "geese", "mouse": "mice", "sheep": "sheep", "fish": "fish", "deer": "deer"}
OPTION_LEADS = [f"{space}{lead}" for space in ("\n", " ") for lead in ("", "Choices: ", "Options: ", "Selections: ", "Pick from: ", "Select from: ", "Choose from: ")]


def number_words(n: int) -> str:
    """English words of 0 to 999,999."""
    if n < 20:
        return UNITS[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f"-{UNITS[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{UNITS[n // 100]} hundred" + (f" and {number_words(n % 100)}" if n % 100 else "")
    rest = n % 1000
    return f"{number_words(n // 1000)} thousand" + (f"{' and' if rest < 100 else ','} {number_words(rest)}" if rest else "")


def count_word(n: Column, words: Column, up_to: int = 100) -> Column:
    """n in words where `words` holds, else in digits; in digits beyond up_to."""
    table = F.array(*[F.lit(number_words(k)) for k in range(up_to + 1)])
    return F.when(words & n.between(0, up_to), F.element_at(table, (n + 1).cast("int"))).otherwise(n.cast("string"))


def plural(noun: Column) -> Column:
    """A noun's plural by rule; its last word changes."""
    head, last = F.regexp_extract(noun, r"^(.* )?\S+$", 1), F.regexp_extract(noun, r"(\S+)$", 1)
    by_rule = (
        F.when(last.rlike("(s|x|z|ch|sh)$"), F.concat(last, F.lit("es")))
        .when(last.rlike("[^aeiou]y$"), F.regexp_replace(last, "y$", "ies"))
        .when(last.rlike("(?<!f)fe?$"), F.regexp_replace(last, "fe?$", "ves"))
        .otherwise(F.concat(last, F.lit("s")))
    )
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.concat(head, F.coalesce(F.try_element_at(known, last), by_rule))


def looks_plural(noun: Column) -> Column:
    """Whether a noun's last word is a plural by rule or in the list of irregular ones."""
    last = F.regexp_extract(noun, r"(\S+)$", 1)
    return last.isin(*IRREGULAR.values()) & ~last.isin("sheep", "fish", "deer") | last.rlike("s$") & ~last.rlike("(ss|us|is)$")


def article(noun: Column) -> Column:
    return F.concat(F.when(F.lower(noun).rlike("^(?:[aeio]|u(?!n[ei]|s[ae]))"), "an ").otherwise("a "), noun)


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def and_list(names: Column) -> Column:
    """"", "a", "a and b", "a, b, and c"."""
    n = F.size(names)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.try_element_at(names, F.lit(1)))
        .when(n == 2, F.array_join(names, " and "))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.try_element_at(names, F.lit(-1))))
    )


def sentence_case(text: Column) -> Column:
    """First character upper case, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def filled(template: Column, slots: dict[str, Column]) -> Column:
    """Named placeholders replaced, one after the other; lists are worded with "and"."""
    for name, value in slots.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return template


def count_choices(n: Column) -> Column:
    """The right count and three near it."""
    return F.when(n == 1, F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 4)])).otherwise(F.array(n, n - 1, n + 1, n + 2))


def options(choices: Column, style: Column, numeric: bool = False) -> Column:
    """Choices with letters or numbers: "A. x" in style 0, "(A) x" in style 1."""
    mark = (lambda i: (i + 1).cast("string")) if numeric else (lambda i: F.char(i + 65))
    return F.transform(choices, lambda c, i: F.when(style == 0, F.concat(mark(i), F.lit(". "), c)).otherwise(F.concat(F.lit("("), mark(i), F.lit(") "), c)))


def normalized(text: Column) -> Column:
    """Lower case, without marks, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\w\s]", "")))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(F.trim(a), r"\s+")), F.array_distinct(F.split(F.trim(b), r"\s+"))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def region_number(text: Column) -> Column:
    """The number of the first "regionN", from 0; -1 without one."""
    found = F.regexp_extract(text, r"region(\d+)", 1)
    return F.when(found == "", -1).otherwise(found.try_cast("int") - 1)


def yes_score(text: Column) -> Column:
    clean = normalized(text)
    return F.when(clean.rlike(r"\byes\b"), 1).otherwise(0)


def judge_pair(review: Column) -> Column:
    """The two numbers of a review's first line, or [-1, -1]."""
    parts = F.split(F.trim(F.replace(F.split(F.trim(review), "\n")[0], F.lit(","), F.lit(" "))), r"\s+")
    pair = F.transform(parts, lambda x: x.try_cast("double"))
    good = (F.size(parts) == 2) & F.forall(pair, lambda x: x.isNotNull())
    return F.when(F.coalesce(good, F.lit(False)), pair).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


# Parts of category names that say nothing.
EMPTY_PARTS = ("stuff", "other", "merged")


def spoken_category(name: Column, sentence: str = "{}") -> Column:
    """A category name such as "sky-other-merged" as words, put into a sentence at {}."""
    parts = F.filter(F.split(name, "-"), lambda x: ~x.isin(*EMPTY_PARTS))
    return F.replace(F.lit(sentence), F.lit("{}"), F.array_join(parts, " "))


def panoptic_name(name: Column) -> Column:
    """A panoptic category as an object's text: "wall-other-brick-merged" is "wall is brick"."""
    return F.trim(F.replace(F.regexp_replace(name, "-(?:" + "|".join(EMPTY_PARTS) + ")", ""), F.lit("-"), F.lit(" is ")))


def region_key(text: Column) -> Column:
    """struct(source, region): "sam_3" names region 3 of source "sam", "7" region 7 of source "region"; null for anything else."""
    source = F.regexp_extract(text, r"^(?:([A-Za-z]+)_)?(\d+)$", 1)
    number = F.regexp_extract(text, r"^(?:([A-Za-z]+)_)?(\d+)$", 2)
    return F.when(number != "", F.struct(F.when(source == "", "region").otherwise(source).alias("source"), number.try_cast("int").alias("region")))
