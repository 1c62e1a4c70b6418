"""Quality rules as weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document's figures. Expectation-maximisation over the table of
vote patterns (at most 3 ** len(RULES) rows, counted on the executors) estimates for each rule how it votes on good and
on bad documents; the posterior probability of "good" then replaces demanding that all rules pass.

Defined results: a null or empty text has no words and fails the base test; an empty table gives no rows; repeated rows
are judged alike; very long texts are read whole; a quality of exactly one half counts as good, which settles ties. Columns other than doc_id and text are not read.
A row whose doc_id is null is judged like any other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, materialize, text_chunks

SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Two or more marks at the end of a word.
MARKED = re.compile(rb"[!-/:-@\[-`{-~]{2,}(?=[\x20\x09-\x0d]|$)")
ENDS = tuple(".!?:;\"')]")
#: A few of the most frequent words of each of several languages.
STOP_WORDS = frozenset(
    (
        "the of and to in is that it for with as was on be at by this are from "
        "de la le les et des en un une du que est pour dans qui par sur pas "
        "der die und das den von zu mit sich ist im dem nicht ein eine als auch es für "
        "el los las y del se una por con para su al como más"
    )
    .encode()
    .split()
)
FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ended_lines long, n_stop_words long, n_capital_words long, n_distinct_words long, n_marked_words long"
MIN_WORDS = 50


def text_figures(text: str | None) -> tuple[int, ...]:
    """The figures of one text, in the order of FIGURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(SYMBOLS.findall(raw)), *[0] * 8)
    word_chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    stop = np.fromiter((w in STOP_WORDS for w in numbers), bool, len(numbers))
    capital = np.fromiter((len(w) > 1 and w.isupper() for w in numbers), bool, len(numbers))
    repeated = 0
    if n >= 3:
        _, pairs = np.unique(codes[:-1] * len(numbers) + codes[1:], return_inverse=True)
        _, windows, counts = np.unique(pairs[:-1] * len(numbers) + codes[2:], return_inverse=True, return_counts=True)
        again = counts[windows] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(covered.sum())
    return (n, word_chars, len(SYMBOLS.findall(raw)), len(lines) - len(set(lines)), repeated, len(lines), sum(x.rstrip().endswith(ENDS) for x in lines), int(stop[codes].sum()), int(capital[codes].sum()), len(numbers), len(MARKED.findall(raw)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in text_chunks(batches):
        figures = zip(*[text_figures(r["text"]) for r in rows], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), *[pa.array(x, pa.int64()) for x in figures]], names=["doc_id", *[x.split()[0] for x in FIGURES.split(", ")]])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of every row's whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").transform(mapped, _measure, f"doc_id long, {FIGURES}")


def _votes(value: F.Column, good, bad) -> F.Column:
    vote = F.when(bad(value), -1)
    return (vote.when(good(value), 1) if good else vote).otherwise(0)


def rules() -> dict[str, F.Column]:
    """name -> vote. Shares are of words, word characters or lines; a rule that only knows a defect never votes good."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda x, of="n_words": F.col(x) / F.greatest(F.col(of), F.lit(1))
    return {
        "length": _votes(F.col("n_words"), lambda x: x >= 100, lambda x: x < MIN_WORDS),
        "symbols": _votes(share("n_symbols", "word_chars"), None, lambda x: x > 0.05),
        "marks": _votes(share("n_marked_words"), None, lambda x: x > 0.2),
        "capitals": _votes(share("n_capital_words"), None, lambda x: x > 0.3),
        "repeated_lines": _votes(share("n_dup_lines", "n_lines"), None, lambda x: (x > 0.3) & (F.col("n_dup_lines") > 2)),
        "repeated_words": _votes(share("n_repeat_words"), lambda x: x < 0.05, lambda x: x > 0.3),
        "word_length": _votes(F.col("word_chars") / words, None, lambda x: (x < 2.5) | (x > 12)),
        "stop_words": _votes(share("n_stop_words"), lambda x: x > 0.1, lambda x: x < 0.03),
        "line_ends": _votes(share("n_ended_lines", "n_lines"), lambda x: x > 0.8, lambda x: x < 0.2),
        "variety": _votes(share("n_distinct_words"), None, lambda x: x < 0.1),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, trust: float = 0.9, bad: float = 0.2, weight: float = 0.1) -> tuple[float, list[dict]]:
    """Expectation-maximisation over (votes, count): the log odds of good, and per rule {vote: log likelihood ratio}.

    Starts from the belief that a share `bad` of the documents is bad and that a share `trust` of the votes for either
    side falls on documents of that side. The belief stays in as a prior worth `weight` of all documents, so the two
    classes keep their meaning, and a rule that never errs isn't overstated.
    """
    if not patterns:
        return 0.0, []
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    total = n.sum()
    shares = lambda w: np.stack([(votes == v).T @ w for v in (-1, 0, 1)], axis=1)  # noqa: E731  rules x votes
    seen = shares(n) / total

    def believed(against: float, in_favour: float) -> np.ndarray:
        lost, won = np.clip(seen[:, 0] * against, 1e-4, 0.9), np.clip(seen[:, 2] * in_favour, 1e-4, 0.98)
        table = np.stack([lost, np.maximum(1 - lost - won, 0.02), won], axis=1)
        return table / table.sum(axis=1, keepdims=True)

    prior = {True: believed((1 - trust) / (1 - bad), trust / (1 - bad)), False: believed(trust / bad, (1 - trust) / bad)}
    like, odds = dict(prior), math.log((1 - bad) / bad)
    for _ in range(rounds):
        ratio = np.log(like[True]) - np.log(like[False])
        logit = odds + sum(ratio[j, votes[:, j] + 1] for j in range(votes.shape[1]))
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        for side, w in ((True, good * n), (False, (1 - good) * n)):
            counts = shares(w) + weight * total * prior[side]
            like[side] = counts / counts.sum(axis=1, keepdims=True)
        share = (good @ n + weight * (1 - bad) * total) / ((1 + weight) * total)
        odds = math.log(share / (1 - share))
    ratio = np.log(like[True]) - np.log(like[False])
    return odds, [{v: float(ratio[j, v + 1]) for v in (-1, 0, 1)} for j in range(votes.shape[1])]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the figures, one vote column per rule, quality (posterior), base_failed and kept, for every row."""
    named = rules()
    votes = [F.col(f"vote_{x}") for x in named]
    voted = materialize(measure(docs).select("*", *[v.cast("int").alias(f"vote_{x}") for x, v in named.items()]), "op1-votes")
    table = voted.groupBy(*votes).count().collect()  # at most 3 ** rules rows
    odds, ratios = estimate([(tuple(r)[:-1], r["count"]) for r in table])
    logit = F.lit(odds)
    for name, ratio in zip(named, ratios, strict=False):
        logit = logit + F.element_at(F.array(*[F.lit(ratio[v]) for v in (-1, 0, 1)]), F.col(f"vote_{name}") + 2)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
