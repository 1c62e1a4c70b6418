"""Source divergence audit: how far the word distributions of a language's sources lie apart, term by term.

Each language keeps the terms in at least `LEAST` of its documents. Each group (lang, source), and each language as a
whole, gives every kept term a smoothed probability p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)). The distance of two
groups sums |p - q| over all V kept terms, though most counts are zero. So it comes from an inverted index by baseline
correction, where p0 and q0 stand for the probabilities of a count of zero:

1. Each pair of groups starts at V * |p0 - q0|, as if no term occurred in either.
2. A posting of a group corrects each of its pairs by |p - q0| - |p0 - q0|. Postings of equal p correct alike, so a group
   sends one row for each different p, with the number of its terms.
3. A term with postings in both groups replaces what both have sent: |p - q| - |p - q0| - |p0 - q| + |p0 - q0|. Pairs
   meet on the term and only corrections other than zero are emitted; terms without postings cost nothing.

Terms that set a source apart are ranked by window, and Spark cuts each task's rows to `TOP` before they are sent.

All arithmetic is on whole numbers; the quotient is taken on decimals, so counts beyond 9 * 10**9 do not overflow. Words
are counted in tables of at most `HELD` terms a task before they are shuffled, by language, source and term, so neither a
hot source nor a frequent word lands in one task.

Defined results: null text, lang and source are ''; a group without a kept term takes part with N = 0; a language without
kept terms has pairs of value 0 and no terms; very long texts are read whole; repeated rows are documents of their own;
values that tie are ranked by item, as UTF-8 bytes; an empty table gives no rows; a language of one source has no pairs.
doc_id and further columns are not read, so nulls or clashing names there do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, materialize, row_chunks

LEAST = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTH = 5
#: Different terms that a task counts before it hands its counts over.
HELD = 400_000
#: ASCII letters in lower case, bytes of other characters as they are, all else is a blank.
_TERM_BYTES = bytes(c if c >= 0x80 else c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A else 0x20 for c in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every (lang, source, term), combined as far as `HELD` allows; term '' says that a group occurs."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def handed_over() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            columns = [[lang] * len(terms), [source] * len(terms), [t.decode("utf-8", "replace") for t in terms], list(n.values()), [docs[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)
        counts.clear()

    for rows in row_chunks(batches, "text", 2_000_000):
        for r in rows:
            n, docs = counts.setdefault((r["lang"], r["source"]), (Counter(), Counter()))
            here = Counter(r["text"].translate(_TERM_BYTES).split())
            here[b""] = 0
            before = len(n)
            n.update(here)
            docs.update(here.keys())
            held += len(n) - before
        if held > HELD:
            yield from handed_over()
            held = 0
    yield from handed_over()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of every group; a row of term '' and n = 0 for each group itself."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    given = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), text)
    found = mapped(given, _count_terms, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(count: str, total: str, terms: str) -> F.Column:
    quotient = f"cast({SCALE} as decimal(38,0)) * cast({count} + {SMOOTH} as decimal(20,0)) div cast({total} + {SMOOTH} * {terms} as decimal(38,0))"
    return F.expr(f"1 + case when {terms} > 0 then {quotient} else 0 end")


class Index:
    """The inverted index of kept terms: `groups` (lang, source, total, terms, p0) and `postings` (lang, term, source, n, p, q, p0), tables in the shared folder."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        counts = materialize(term_counts(docs), "op12-counts")
        words = counts.where("term <> ''")
        kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least).drop("in_docs")
        kept = materialize(kept, "op12-kept")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
        found = materialize(words.join(kept.hint("merge"), ["lang", "term"]).select("lang", "term", "source", "n", "lang_n"), "op12-found")
        totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        every = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        every = every.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")])
        self.groups = materialize(every.withColumn("p0", _probability("0", "total", "terms")), "op12-groups")
        smoothed = found.join(self.groups, ["lang", "source"]).select("lang", "term", "source", "n", _probability("n", "total", "terms").alias("p"), _probability("lang_n", "lang_total", "terms").alias("q"), "p0")
        self.postings = materialize(smoothed, "op12-postings")

    def _pairs_of_groups(self) -> DataFrame:
        """Each unordered pair of a language's sources with its baseline."""
        g = self.groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms")
        h = self.groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
        return g.join(h, "lang").where("a < b")

    def distances(self) -> DataFrame:
        """lang, a, b (sources, a < b) and value, the sum of |p - q| over all kept terms."""
        zero = "abs(a0 - b0)"
        pairs = self._pairs_of_groups()
        start = pairs.select("lang", "a", "b", F.expr(f"terms * {zero}").alias("value"))
        alike = self.postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
        one_side = []
        for own, other in (("a", "b"), ("b", "a")):
            met = alike.withColumnRenamed("source", own).join(pairs, ["lang", own])
            one_side.append(met.select("lang", "a", "b", F.expr(f"m * (abs(p - {other}0) - {zero})").alias("value")).where("value <> 0"))
        left, right = (self.postings.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"{x}_p"), F.col("p0").alias(f"{x}0")) for x in "ab")
        both = left.join(right.hint("merge"), ["lang", "term"]).where("a < b")
        both = both.select("lang", "a", "b", F.expr(f"abs(a_p - b_p) - abs(a_p - b0) - abs(a0 - b_p) + {zero}").alias("value")).where("value <> 0")
        parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (*one_side, both)]
        total = start
        for x in parts:
            total = total.unionByName(x)
        return total.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def audit(self, top: int = TOP) -> DataFrame:
        """lang, source, part ('pair' or 'term'), item, value and rank (see the contract of the query)."""
        far = materialize(self.distances(), "op12-distances")
        both_ways = far.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(far.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pair = both_ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        above = self.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        term = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
        return pair.unionByName(term)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart from its language."""
    return Index(docs, least).audit(top)


ORACLE = rf"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
),
numbered as (select row_number() over () as row_id, * from d),
words as (select row_id, lang, source, unnest(terms) as term from numbered),
per_doc as (select row_id, lang, source, term, count(*) as n from words group by all),
counts as (select lang, source, term, sum(n)::bigint as n, count(*) as docs from per_doc group by all),
kept as (select lang, term, sum(n)::bigint as lang_n from counts group by all having sum(docs) >= {LEAST}),
langs as (select lang, count(*) as v, sum(lang_n)::bigint as lang_total from kept group by all),
found as (select c.lang, c.source, c.term, c.n, k.lang_n from counts c join kept k using (lang, term)),
groups as (
  select g.lang, g.source, coalesce(l.v, 0) as v, coalesce(l.lang_total, 0) as lang_total, coalesce(t.total, 0) as total
  from (select distinct lang, source from d) g left join langs l using (lang)
  left join (select lang, source, sum(n)::bigint as total from found group by all) t using (lang, source)
),
every as (
  select g.lang, g.source, k.term, coalesce(f.n, 0) as n,
    1 + ({SCALE}::bigint * (coalesce(f.n, 0) + {SMOOTH})) // (g.total + {SMOOTH} * g.v) as p,
    1 + ({SCALE}::bigint * (k.lang_n + {SMOOTH})) // (g.lang_total + {SMOOTH} * g.v) as q
  from groups g join kept k using (lang) left join found f using (lang, source, term)
),
far as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
  from every a join every b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(f.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
),
terms as (select lang, source, term as item, (p - q)::bigint as value from every where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
