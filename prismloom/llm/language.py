"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of 1-, 2- and 3-grams of lower-cased code points, hashed into `BUCKETS` buckets, are summed per language on the
executors. The log-probability matrix (languages x buckets, one float each) goes to every task; a batch of documents is
one long code point array, scored by gathering the columns of its n-grams and summing per document.

Fitting reads whole texts of at most `MAX_TRAIN` labelled rows, or a few more: every language has the same share of that
number, keeps all its rows up to it and a sample by a hash of doc_id and text beyond, so that no labelled language is
lost; how frequent languages are is counted over all rows. The matrix is bounded by `MAX_LANGUAGES`; more raise an error.
Prediction reads whole texts of every row and nothing but the text.

Defined results: a text that is null or has no letter is `und` with score 0; without any learnable row everything is
`und`; an empty table gives no rows. A null doc_id is neither held out nor learned from. Very long texts are read whole, one at a time. Repeated rows
are scored alike; columns other than doc_id, text and lang are not read. Ties go to the first language by code point.
A letter is what Unicode calls one, so number signs are none; no n-gram reaches over a U+0000 in a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, text_chunks, unused

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_TRAIN = 400_000
UNDETERMINED = "und"
#: At most this many rows of the log-probability matrix: 131 MB.
MAX_LANGUAGES = 1000
_SEPARATOR = "\0"


def gram_buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram starting at each position; BUCKETS where it touches a separator."""
    codes = codes.astype(np.uint64)
    gap = codes == 0
    rolled, broken = codes, gap
    for order in ORDERS:
        if order > 1:
            if len(codes) < order:
                return
            rolled = rolled[:-1] * np.uint64(1_000_003) + codes[order - 1 :]
            broken = broken[:-1] | gap[order - 1 :]
        mixed = (rolled + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (mixed >> np.uint64(49)).astype(np.int64)
        bucket[broken] = BUCKETS
        yield bucket


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for rows in text_chunks(batches):
        by_lang: dict[str, list[str]] = {}
        for row in rows:
            by_lang.setdefault(row["lang"], []).append(row["text"])
        for lang, texts in by_lang.items():
            total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for bucket in gram_buckets(_codes(_SEPARATOR.join(texts))):
                total += np.bincount(bucket, minlength=BUCKETS + 1)
    for lang, total in sums.items():
        at = np.flatnonzero(total[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])


class LanguageModel:
    """Languages in code point order and their log probabilities, with a last column of 0 for broken n-grams."""

    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray):
        smooth = counts + SMOOTHING
        table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32) if langs else np.zeros((0, BUCKETS), np.float32)
        self.langs = langs
        self.log_p = np.hstack([table, np.zeros((len(langs), 1), np.float32)])
        self.prior = np.log(rows / rows.sum()) if langs else np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        """Log joint probability, documents x languages."""
        sums = np.tile(self.prior, (len(texts), 1))
        starts = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
        codes = np.frombuffer(_SEPARATOR.join(texts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
        for bucket in gram_buckets(codes):
            at = np.minimum(starts, len(bucket) - 1)
            for k, row in enumerate(self.log_p):
                sums[:, k] += np.add.reduceat(row[bucket], at, dtype=np.float64)
        return sums

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if self.langs and some:
            joint = self.score([texts[i].lower() for i in some])
            joint -= joint.max(axis=1, keepdims=True)
            share = np.exp(joint)
            share /= share.sum(axis=1, keepdims=True)
            for i, k, p in zip(some, share.argmax(axis=1), share.max(axis=1), strict=True):
                out[i] = (self.langs[k], float(p))
        return out


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel:
    """Learn from (doc_id, text, lang); a language with more than its share of max_train rows from about that many, chosen by hash."""
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()  # a row a language
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than MAX_LANGUAGES = {MAX_LANGUAGES} languages")
    share = max_train / max(len(rows), 1)
    sampled = {r["lang"]: share / r["count"] for r in rows if r["count"] > share}
    if sampled:
        part = F.coalesce(F.create_map(*[F.lit(x) for pair in sampled.items() for x in pair])[F.col("lang")], F.lit(1.0))
        known = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < part * (1 << 20))
    counted = known.select("text", "lang").transform(mapped, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    found = counted["lang"].combine_chunks().dictionary_encode()
    names = found.dictionary.to_pylist()
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names], np.int64)
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        counts[place[found.indices.to_numpy()], counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    frequent = {r["lang"]: r["count"] for r in rows}
    return LanguageModel(langs, counts, np.array([frequent[x] for x in langs], float))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep (columns of docs), the language predicted from text and its posterior, under `names`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in keep if c != "text"]
    given = docs.select(*[F.col(f"`{c}`") for c in extra], F.col("text"))
    kept = given.select(*[F.col(f"`{c}`") for c in keep])
    schema = kept.schema.add(names[0], "string", False).add(names[1], "double", False)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_chunks(batches):
            found = shared.value.predict([r["text"] for r in rows])
            out = {c: [r[c] for r in rows] for c in keep} | {names[0]: [x for x, _ in found], names[1]: [p for _, p in found]}
            yield pa.RecordBatch.from_pydict(out, schema=to_arrow_schema(schema))

    return given.transform(mapped, scored, schema)


def to_arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert

    return convert(schema)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def learnable() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that aren't held out."""
    model = fit(docs.where(learnable()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, as they are, whose language is determined with at least this posterior."""
    model = fit(docs.where(learnable()))
    cols = docs.columns
    predicted, score = unused("__lang_pred", cols), unused("__score", cols)
    judged = predict(docs, model, cols, (predicted, score))
    return judged.where((F.col(predicted) != UNDETERMINED) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in cols])
