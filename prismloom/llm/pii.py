"""Personal data by weak supervision, with DataFrame operations only.

Regular expressions propose spans. Labelers vote on each (1 private, -1 not, 0 abstains): the format check of its kind,
gazetteers (top-level domains, card issuers, country codes, reserved addresses), words before it and marks around it.
Expectation-maximisation over the table of vote patterns (a few hundred rows at most, counted on the executors)
estimates the labelers' reliabilities, and a logistic span classifier is trained on the posteriors; both are plain
arithmetic over that bounded table, and the classifier returns to the rows as a column expression.

The base kinds are rules: a match that passes its check stays a span whatever the classifier says, and one that fails is
dropped. The method adds spans of further forms: phone numbers in national form, secrets that are assigned to a telling
name, persons by title or given name, and street addresses.

Positions come from the gaps between matches (split and extract agree on the matches), summed by a window over the
matches of one text and kind, so long texts with many matches cost no more than their matches. The patterns are
possessive and anchored with look-behind where that leaves their matches as they are, so they read a text once.

Defined results: a null text counts as empty, and stays null where texts are masked; a text without spans gets zero
counts, the hash of the empty string and empty spans; repeated rows are reported each; null doc_ids are kept; very long
texts are searched whole. A probability of exactly one half adds the span; where spans overlap, base ones stay and added
ones go, and a mask covers overlapping base spans together under the kind that starts first. An empty table gives no rows.
Columns but doc_id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismloom.llm.common import materialize

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "local_phone", "secret", "person", "address")
BASE = KINDS[:4]

#: Frequent given names that are rarely other words, and frequent surnames.
GIVEN_NAMES = (
    "Alexander Alice Amanda Andrea Andrew Angela Anna Anthony Barbara Benjamin Betty Brandon Brenda Brian Carlos Carol Catherine Charles Christine Christopher Claudia Cynthia Daniel David "
    "Deborah Dennis Diana Donald Donna Dorothy Edward Elizabeth Emily Emma Eric Frank Gabriel Gary George Gregory Hannah Heather Helen Henry Jacob James Janet Jason Jeffrey Jennifer Jessica "
    "Joan John Jonathan Jose Joseph Joshua Juan Julia Julie Karen Katherine Kathleen Kenneth Kevin Kimberly Larry Laura Linda Lisa Louis Luis Margaret Maria Marie Martha Martin Mary Matthew "
    "Megan Melissa Michael Michelle Nancy Nathan Nicholas Nicole Olivia Pamela Patricia Patrick Paul Peter Philip Rachel Raymond Rebecca Richard Robert Ronald Samantha Samuel Sandra Sarah "
    "Scott Sharon Shirley Sophia Stephanie Stephen Steven Susan Thomas Timothy Victoria Virginia Walter William Zachary"
).split()
SURNAMES = (
    "Adams Allen Anderson Baker Brown Campbell Carter Clark Davis Evans Fischer Garcia Gomez Gonzalez Hall Harris Hernandez Hill Jackson Johnson Jones King Lee Lewis Lopez Martin Martinez "
    "Meyer Miller Mitchell Moore Mueller Nelson Nguyen Parker Perez Phillips Ramirez Roberts Robinson Rodriguez Sanchez Schmidt Schneider Scott Smith Taylor Thomas Thompson Torres Turner "
    "Walker Weber White Williams Wilson Wright Young"
).split()
TITLES = "Mr Mrs Ms Dr Prof".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Way Court Ct Place Pl Square Sq Terrace".split()

#: Each kind's candidates. \G lets a match start where the last one ended, inside a run of its own characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+)] ?)\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
    "secret": r"(?<=[\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key) {0,2}[:=] {0,2}[\"'])[A-Za-z0-9+/_=-]{16,}+(?=[\"'])",
    "person": rf"(?<![A-Za-z])(?=[A-Z])(?:(?:{'|'.join(TITLES)})\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?+|(?:{'|'.join(GIVEN_NAMES)}) (?:[A-Z]\. )?[A-Z][a-z]+)(?![A-Za-z])",
    "address": rf"(?<![A-Za-z0-9])[0-9]{{1,5}}[A-Za-z]? (?:[A-Z][a-z]+ ){{1,3}}(?:{'|'.join(STREETS)})(?![A-Za-z])",
}

#: Fixed word lists of the gazetteer and context labelers.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at")
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED_IP = r"^(?:0|127|255)\."
CONTEXT = {
    "email": r"(?i)(?:mail|e-mail|contact|write|from|to)\W*$",
    "ip": r"(?i)(?:ip|host|address|server|client)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|pay)\W*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|\+[0-9]{1,3}\W{0,4})\W*$",
    "local_phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|\+[0-9]{1,3}\W{0,5})\W*$",
    "secret": r"(?i)(?:token|secret|password|passwd|key)\W*$",
    "person": r"(?i)(?:name|dear|contact|by|from|to|author|signed|patient|customer|employee)\W*$",
    "address": r"(?i)(?:address|lives? at|ship to|street|at)\W*$",
}
VERSION_BEFORE = r"(?i)(?:version|release|v|section|isbn|order|no|nr|#)[ .:]*$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the up to 19 digits in value pass the Luhn check."""
    rev = F.reverse(_digits(value))
    total = F.lit(0)
    for p in range(1, 20):
        d = F.greatest(F.ascii(F.substring(rev, p, 1)) - 48, F.lit(0))
        total = total + (d if p % 2 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """The check of a base kind; other kinds pass by their pattern."""
    parts = F.split(value, r"\.")
    small = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(parts, lambda p: F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255")
    n = F.length(_digits(value))
    return F.when(kind == "ip", small).when(kind == "card", n.between(16, 19) & luhn(value)).when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True))


def _wanted(kind: str, text: Column) -> Column:
    """A cheap test without which a kind's pattern can't match."""
    digit = text.rlike("[0-9]")
    return {
        "email": text.contains("@"),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]"),
        "card": digit & text.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
        "phone": text.rlike(r"\+[0-9]"),
        "local_phone": text.rlike(r"\([0-9]{3}\)"),
        "secret": text.rlike("[:=] {0,2}[\"'][A-Za-z0-9+/_=-]{16}"),
        "person": text.rlike(r"[A-Z][a-z]*\.? [A-Z]"),
        "address": digit & text.rlike("[0-9][A-Za-z]? [A-Z][a-z]+ [A-Z]"),
    }[kind]


def _span(kind: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("no"), F.length(x["gap"]).alias("gap"), F.right(x["gap"], F.lit(32)).alias("before"), x["value"].alias("value"), F.left(x["next"], F.lit(16)).alias("after")
    )


def proposed(text: Column) -> Column:
    """The spans that the patterns propose in a text: kind (number), no (of its kind), gap before it, value and surroundings."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for k, kind in enumerate(KINDS):
        gaps, matches = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        found.append(F.when(_wanted(kind, text), F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), matches.alias("value"), F.slice(gaps, 2, F.size(gaps)).alias("next")), _span(k))))
    none = F.array().cast("array<struct<kind:int,no:int,gap:int,before:string,value:string,after:string>>")
    return F.concat(*[F.coalesce(x, none) for x in found])


def placed(rows: DataFrame) -> DataFrame:
    """rows(row_id, doc_id, spans) -> a row for each proposed span, with start and end (code points, end exclusive), and one with a null kind for each row without any."""
    flat = rows.select("row_id", "doc_id", F.explode_outer("spans").alias("s")).select("row_id", "doc_id", "s.*")
    running = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row_id", "kind").orderBy("no"))
    return flat.withColumn("end", running).withColumn("start", F.col("end") - F.length("value"))


def candidates(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, kind, start, end, value, before and after of each proposed span, and a row with a null kind for each text without any."""
    return placed(materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", proposed(F.col("text")).alias("spans")), "op2-candidates"))


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def votes(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Labeler -> vote on a candidate of this kind (by name), between what stands before and after it."""
    yes_no = lambda yes, no: F.when(no, -1).when(yes, 1).otherwise(0)
    tld = F.lower(F.substring_index(value, ".", -1)).isin(*TOP_LEVEL)
    named = F.arrays_overlap(F.split(value, "[^A-Za-z]+"), F.array(*[F.lit(x) for x in SURNAMES]))
    known = (kind == "person") & named | (kind == "address") | (kind == "email") & tld | (kind == "card") & value.rlike(CARD_ISSUERS) | (kind == "phone") & value.rlike(COUNTRY_CODES)
    odd = (kind == "ip") & value.rlike(RESERVED_IP) | (kind == "email") & value.rlike(r"(?:^\.|\.\.|\.[0-9-]+$)") | (kind == "secret") & value.rlike(r"^(.)\1*$")
    context = F.lit(False)
    for k, pattern in CONTEXT.items():
        context = context | (kind == k) & before.rlike(pattern)
    mixed = (kind == "secret") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return {
        "format": yes_no(passes(kind, value), ~passes(kind, value)),
        "gazetteer": yes_no(known, odd),
        "context": yes_no(context, ~kind.isin("phone", "local_phone", "person", "address") & before.rlike(VERSION_BEFORE)),
        "shape": yes_no(mixed | (kind != "secret") & value.rlike("[ .()@-]"), (kind == "secret") & ~mixed),
        "surroundings": yes_no(after.rlike(r"^(?:$|[\s,;:.!?)\"'<])"), after.rlike("^[A-Za-z0-9_]") | before.rlike("[A-Za-z0-9_]$")),
    }


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30, trust: float = 0.8, strength: float = 20.0) -> tuple[list[float], list[float]]:
    """Expectation-maximisation: each labeler's accuracy where it votes, and the posterior of "private" for each pattern.

    `strength` pseudo-votes of accuracy `trust` keep labelers that rarely vote from extremes.
    """
    labelers = len(patterns[0][0]) if patterns else 0
    accuracy, share = [trust] * labelers, 0.5
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (vote, _) in enumerate(patterns):
            posterior[i] = _logistic(math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(vote, accuracy, strict=True)))
        for j in range(labelers):
            right = sum(n * (p if vote[j] > 0 else 1 - p) for (vote, n), p in zip(patterns, posterior, strict=True) if vote[j])
            cast = sum(n for vote, n in patterns if vote[j])
            accuracy[j] = min(0.99, max(0.51, (right + strength * trust) / (cast + strength)))
        total = sum(n for _, n in patterns)
        share = min(0.95, max(0.05, (sum(n * p for (_, n), p in zip(patterns, posterior, strict=True)) + 1) / (total + 2)))
    return accuracy, posterior


def train(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """A logistic classifier of (kind, votes) fitted to the posteriors: {"kind": [weight], "vote": [weight]}."""
    _, target = reliabilities([(v, n) for _, v, n in patterns])
    kinds, labelers = [0.0] * len(KINDS), [0.0] * (len(patterns[0][1]) if patterns else 0)
    total = sum(math.sqrt(n) for _, _, n in patterns) or 1.0
    for _ in range(rounds):
        by_kind, by_vote = [decay * w for w in kinds], [decay * w for w in labelers]
        for (k, vote, n), goal in zip(patterns, target, strict=True):
            slip = (_logistic(kinds[k] + sum(w * v for w, v in zip(labelers, vote, strict=True))) - goal) * math.sqrt(n) / total
            by_kind[k] += slip
            for j, v in enumerate(vote):
                by_vote[j] += slip * v
        kinds = [w - rate * g for w, g in zip(kinds, by_kind, strict=True)]
        labelers = [w - rate * g for w, g in zip(labelers, by_vote, strict=True)]
    return {"kind": kinds, "vote": labelers}


def scored(kind: Column, cast: dict[str, Column], model: dict) -> Column:
    """The classifier's probability of "private" for a kind (by number) and the labelers' votes."""
    score = F.element_at(F.array(*[F.lit(w) for w in model["kind"]]), kind + 1)
    for vote, w in zip(cast.values(), model["vote"], strict=False):
        score = score + F.lit(w) * vote
    return 1 / (1 + F.exp(-score))


def judged(found: DataFrame) -> tuple[DataFrame, dict]:
    """The candidates with their votes, and the classifier trained on them."""
    cast = votes(kind_name(F.col("kind")), F.col("value"), F.col("before"), F.col("after"))
    seen = materialize(found.select("row_id", "doc_id", "kind", "start", "end", *[F.when(F.col("kind").isNotNull(), v).alias(f"vote_{x}") for x, v in cast.items()]), "op2-votes")
    table = seen.where("kind is not null").groupBy("kind", *[f"vote_{x}" for x in cast]).count().collect()  # at most kinds * 3 ** labelers rows
    return seen, train(sorted((r[0], tuple(r)[1:-1], r["count"]) for r in table))


def spans(found: DataFrame) -> DataFrame:
    """candidates -> a row for each span kept (and one with a null kind for each candidate that isn't and each text without any): row_id, doc_id, kind, start, end, base, probability."""
    seen, model = judged(found)
    cast = {c.removeprefix("vote_"): F.col(c) for c in seen.columns if c.startswith("vote_")}
    rated = seen.withColumn("probability", scored(F.col("kind"), cast, model)).withColumn("base", (F.col("kind") < len(BASE)) & (F.col("vote_format") == 1))
    by_start = Window.partitionBy("row_id").orderBy("start", "end", "kind")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    clear = (F.coalesce(F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(base_start).over(by_start.rowsBetween(1, Window.unboundedFollowing)), F.col("end")) >= F.col("end")
    )
    added = (F.col("kind") >= len(BASE)) & (F.col("probability") >= 0.5) & F.col("clear")
    kept = rated.withColumn("clear", clear).withColumn("kept", F.coalesce(F.col("base") | added, F.lit(False)))
    return kept.select("row_id", "doc_id", *[F.when(F.col("kept"), F.col(c)).alias(c) for c in ("kind", "start", "end", "base", "probability")])


#: `cuts` of a text in UTF-32 (`wide`) replaced by their kinds. A letter goes before each piece that is decoded, or a U+FEFF there would be lost.
_REWRITTEN = """
array_join(transform(sequence(0, size(cuts)), i -> concat(
    substring(decode(concat(X'00000078', substring(wide, 4 * coalesce(get(cuts, i - 1).end, 0) + 1, 4 * (coalesce(get(cuts, i).start, length(wide) div 4) - coalesce(get(cuts, i - 1).end, 0)))), 'UTF-32'), 2),
    coalesce('[' || get(cuts, i).kind || ']', ''))), '')
"""


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span that `report` lists replaced by its kind in square brackets; nothing else changes.

    Rows are written once with what the patterns propose in them; only those with a proposal meet their spans in a join.
    """
    own = {f"own_{k}": c for k, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select(*[docs[f"`{c}`"].alias(k) for k, c in own.items()], docs["text"], proposed(docs["text"]).alias("spans"), F.monotonically_increasing_id().alias("row_id"))
    rows = materialize(rows, "op2-rows")
    some = rows.where(F.size("spans") > 0)
    kept = spans(placed(some.select("row_id", F.lit(None).cast("long").alias("doc_id"), "spans"))).where("kind is not null")
    in_order = Window.partitionBy("row_id").orderBy("start", "end", "kind")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    runs = kept.withColumn("apart", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int")).withColumn("run", F.sum("apart").over(in_order))
    first = F.min_by(kind_name(F.col("kind")), F.struct("start", "end", "kind"))
    cuts = runs.groupBy("row_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("kind")).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    rewritten = some.drop("spans").join(cuts, "row_id", "left").withColumn("wide", F.encode("text", "UTF-32"))
    rewritten = rewritten.select(*own, F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.expr(_REWRITTEN)).alias("text"))
    both = rows.where(F.size("spans") == 0).select(*own, "text").unionByName(rewritten)
    names = {c: k for k, c in own.items()}
    return both.select(*[F.col(names.get(c, "text")).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of every row."""
    here = F.struct("kind", "start", "end")
    listed: Callable[[Column], Column] = lambda x: F.array_join(
        F.transform(F.array_sort(x), lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ","
    )
    grouped = spans(candidates(docs)).groupBy("row_id", "doc_id").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.collect_list(F.when(F.col("base"), here)).alias("base_spans"),
        F.collect_list(F.when(F.col("kind").isNotNull(), here)).alias("all_spans"),
    )
    return grouped.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))
