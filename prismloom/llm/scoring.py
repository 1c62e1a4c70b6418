"""Language-model scoring by masked pseudo-likelihood.

A small window network predicts every word from the two words on either side: each neighbour's row of an embedding table
for its place is added up, passes a tanh layer and gives a softmax over classes of words. The HEADS most frequent words
are a class each; the others fall into TAIL classes by hash and are predicted within theirs from the counts of all words
of the corpus, with one more of each and one word kept for all that never occur, so that probabilities sum to one. The
sum of the conditional log-probabilities of all words is the document's score.

Words are split once: a record for each chunk of texts holds its distinct words, their counts and the number of the word
at each place. Words are counted from these by shuffle, never on the driver. Training reads all records, in ROUNDS rounds
of disjoint parts: each task trains a copy of the network by mini-batches in numpy and sends it in blocks; blocks are
averaged on the executors in two steps, weighted by words, and start the next round, so what reaches the driver is one
network (a fixed number of parameters). Which records a task trains on moves scores a little: at sf0.001 the mean
log-probability of a word, -8.5, by 0.09 between 1 and 8 tasks (less than 0.15 is tested). For scoring, a chunk's distinct words are
joined with the counts and come back to their chunk, so a frequent word meets its count once a chunk and not once a
document.

Defined results: a null or empty text has no words, log-probability 0 and no mean; repeated rows are scored alike; long
texts are read whole; words are told apart by 64-bit hashes; of words that tie in frequency those with the smaller hash
are heads; an empty table gives no rows. Columns but doc_id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, materialize, text_chunks

INPUTS, WIDTH = 4096, 16
HEADS, TAIL = 96, 32
PLACES = (-2, -1, 1, 2)
BATCH = 4096
RATE = 0.1
BLOCK = 4096
ROUNDS = 2
AVERAGED = 256  # groups of tasks whose networks are averaged before all are
RECORD = 4_000_000  # bytes of text in a chunk: larger ones hold fewer distinct words for their text


def word_numbers(text: str | None) -> np.ndarray:
    """Hashes of a text's A-Z lower-cased words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class WindowNetwork:
    """Parameters in one flat array; `steps` holds the squared gradients so far (Adagrad). Untrained it gives each class its share."""

    def __init__(self, flat: np.ndarray):
        self.flat = np.array(flat, np.float32)
        self.steps: np.ndarray | None = None
        self.embed, self.bias, self.out, self.out_bias = self.parts(self.flat)

    @staticmethod
    def parts(flat: np.ndarray) -> list[np.ndarray]:
        """Views of a flat array: embeddings by place, hidden bias, output weights and output bias."""
        fixed = len(PLACES) * (INPUTS + 1) * WIDTH + WIDTH
        classes = (len(flat) - fixed) // (WIDTH + 1)
        shapes = ((len(PLACES), INPUTS + 1, WIDTH), (WIDTH,), (WIDTH, classes), (classes,))
        cuts = np.cumsum([0, *(np.prod(x) for x in shapes)])
        return [flat[a:b].reshape(x) for a, b, x in zip(cuts, cuts[1:], shapes, strict=False)]

    @staticmethod
    def start(class_counts: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(7).normal(0, 0.1, len(PLACES) * (INPUTS + 1) * WIDTH + WIDTH).astype(np.float32)
        share = (class_counts + 1) / (class_counts + 1).sum()
        return np.concatenate([random, np.zeros(WIDTH * len(share), np.float32), np.log(share).astype(np.float32)])

    def forward(self, inputs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(sum(self.embed[k][inputs[at + p]] for k, p in enumerate(PLACES)) + self.bias)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return hidden, logits

    def log_p(self, inputs: np.ndarray, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of the class of the word at each place."""
        out = np.empty(len(at), np.float64)
        for k in range(0, len(at), BATCH):
            here = at[k : k + BATCH]
            _, p = self.forward(inputs, here)
            out[k : k + BATCH] = np.log(np.maximum(p[np.arange(len(here)), classes[here]], 1e-12))
        return out

    def gradient(self, inputs: np.ndarray, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability, flat like the parameters."""
        hidden, slip = self.forward(inputs, at)
        slip[np.arange(len(at)), classes[at]] -= 1
        slip /= len(at)
        back = (slip @ self.out.T) * (1 - hidden * hidden)
        whole = np.zeros(len(self.flat), np.float32)
        embed, bias, out, out_bias = self.parts(whole)
        for k, p in enumerate(PLACES):
            here = inputs[at + p]
            for j in range(WIDTH):
                embed[k][:, j] = np.bincount(here, weights=back[:, j], minlength=INPUTS + 1)
        bias[:] = back.sum(axis=0)
        out[:] = hidden.T @ slip
        out_bias[:] = slip.sum(axis=0)
        return whole

    def train(self, inputs: np.ndarray, classes: np.ndarray, at: np.ndarray) -> None:
        if self.steps is None:
            self.steps = np.full(len(self.flat), 1e-6, np.float32)
        for k in range(0, len(at), BATCH):
            grad = self.gradient(inputs, classes, at[k : k + BATCH])
            self.steps += grad * grad
            self.flat -= RATE * grad / np.sqrt(self.steps)


@dataclass
class Model:
    """The head words (hashes, sorted) and the network's parameters."""

    heads: np.ndarray
    flat: np.ndarray

    def classes(self, words: np.ndarray) -> np.ndarray:
        """A head's place among the heads, or the hash class of another word behind them."""
        tail = len(self.heads) + ((words >> np.uint64(40)) % np.uint64(TAIL)).astype(np.int64)
        if not len(self.heads):
            return tail
        at = np.minimum(np.searchsorted(self.heads, words), len(self.heads) - 1)
        return np.where(self.heads[at] == words, at, tail)

    def layout(self, words: np.ndarray, places: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts one after the other, with two edge marks around each: inputs, classes, and where their words are."""
        at = np.arange(len(places)) + 2 * (np.repeat(np.arange(len(n_words)), n_words) + 1)
        inputs = np.full(len(places) + 2 * (len(n_words) + 1), INPUTS, np.int64)
        classes = np.zeros(len(inputs), np.int64)
        inputs[at] = ((words >> np.uint64(20)) % np.uint64(INPUTS)).astype(np.int64)[places]
        classes[at] = self.classes(words)[places]
        return inputs, classes, at


CHUNKS = "chunk long, doc_ids array<long>, n_words array<long>, words array<long>, counts array<long>, places binary"


def _record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for k, rows in enumerate(text_chunks(batches, RECORD)):
        numbers = [word_numbers(r["text"]) for r in rows]
        words, places, counts = np.unique(np.concatenate(numbers), return_inverse=True, return_counts=True)
        columns = ([r["doc_id"] for r in rows], [len(x) for x in numbers], words.view(np.int64), counts)
        packed = zlib.compress(places.astype(np.uint32).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k], pa.int64()), *[pa.array([c], pa.list_(pa.int64())) for c in columns], pa.array([packed], pa.binary())], names=["chunk", "doc_ids", "n_words", "words", "counts", "places"])


def chunk_records(docs: DataFrame) -> DataFrame:
    """A row for each chunk of texts: its documents, its distinct words (hashes) with their counts, and the number of the word at each place."""
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), _record, CHUNKS)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Chunk records as arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            yield row | {
                "n": row["n_words"].values.to_numpy(zero_copy_only=False),
                "hashes": row["words"].values.to_numpy(zero_copy_only=False).view(np.uint64) if "words" in row else None,
                "at_places": np.frombuffer(zlib.decompress(row["places"].as_py()), np.uint32),
            }


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    weights: dict[tuple[int, int], int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            k, own = (row["block"], row["part"]), np.frombuffer(row["floats"], np.float32).astype(np.float64) * row["words"]
            sums[k] = sums[k] + own if k in sums else own
            weights[k] = weights.get(k, 0) + row["words"]
    for k, total in sums.items():
        yield _blocks([k[0]], k[1], weights[k], [(total / weights[k]).astype(np.float32)])


def _blocks(numbers: list[int], part: int, words: int, floats: list[np.ndarray]) -> pa.RecordBatch:
    n = len(numbers)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([words] * n, pa.int64()), pa.array([x.tobytes() for x in floats], pa.binary())], names=["block", "part", "words", "floats"])


SCHEMA = "block int, part int, words long, floats binary"


def train_round(chunks: DataFrame, model: Model) -> Model:
    """The average of the networks that the tasks make of this one."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, words = WindowNetwork(shared.value.flat), 0
        for r in _records(batches):
            if len(r["at_places"]):
                network.train(*shared.value.layout(r["hashes"], r["at_places"], r["n"]))
                words += len(r["at_places"])
        if words:
            blocks = [network.flat[k : k + BLOCK] for k in range(0, len(network.flat), BLOCK)]
            yield _blocks(list(range(len(blocks))), TaskContext.get().partitionId() % AVERAGED, words, blocks)

    made = mapped(chunks.select("n_words", "words", "places"), trained, SCHEMA)
    parts = mapped(made.repartition("block", "part"), _average, SCHEMA).withColumn("part", F.lit(0))
    rows = sorted(mapped(parts.repartition("block"), _average, SCHEMA).collect(), key=lambda r: r["block"])  # the parameters of one network
    return Model(model.heads, np.frombuffer(b"".join(bytes(r["floats"]) for r in rows), np.float32)) if rows else model


def word_counts(chunks: DataFrame) -> DataFrame:
    """word (hash) and n of every word of the chunks."""
    return chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))


def tail_class(counts: DataFrame, heads: np.ndarray) -> DataFrame:
    """counts with `tail`, the hash class of each word, null for heads."""
    listed = [int(x) for x in heads.view(np.int64)]
    own = (F.shiftrightunsigned("word", 40) % TAIL).cast("int")
    return counts.withColumn("tail", F.when(~F.col("word").isin(listed), own) if listed else own)


def tail_sizes(counts: DataFrame, heads: np.ndarray) -> list[int]:
    """For each hash class all its words, one more of each, and one for those that never occur."""
    sizes = [1] * TAIL
    for r in tail_class(counts, heads).where("tail is not null").groupBy("tail").agg((F.sum("n") + F.count("*")).alias("size")).collect():  # TAIL rows
        sizes[r["tail"]] += r["size"]
    return sizes


def untrained(counts: DataFrame, heads: int = HEADS) -> Model:
    top = counts.orderBy(F.col("n").desc(), "word").limit(heads).collect()  # HEADS rows
    order = np.argsort(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)[order]
    often = np.array([r["n"] for r in top], float)[order]
    return Model(words, WindowNetwork.start(np.concatenate([often, tail_sizes(counts, words)])))


def fit(chunks: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The network after all rounds, each on the chunks whose number falls to it."""
    model = untrained(counts)
    for k in range(rounds):
        model = train_round(chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == k), model)
    return model


def within_class(chunks: DataFrame, counts: DataFrame, heads: np.ndarray) -> DataFrame:
    """chunk, and of its distinct words in no order, but both lists alike, the numbers (at) and the log-probabilities within their classes (within)."""
    size = F.element_at(F.array(*[F.lit(float(x)) for x in tail_sizes(counts, heads)]), F.col("tail") + 1)
    asked = chunks.select("chunk", F.posexplode("words").alias("at", "word"))
    found = tail_class(asked.join(counts, "word", "left"), heads).select("chunk", "at", F.when(F.col("tail").isNull(), F.lit(0.0)).otherwise(F.log((F.coalesce("n", F.lit(0)) + 1) / size)).alias("log_p"))
    return found.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("log_p").alias("within"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _records(batches):
        n, sums = row["n"], row["log_probs"].values.to_numpy(zero_copy_only=False)
        if row["within"].is_valid:
            each = np.empty(len(row["at"]))
            each[row["at"].values.to_numpy()] = row["within"].values.to_numpy(zero_copy_only=False)
            sums = sums + by_text(each[row["at_places"]], n)
        means = [float(s / m) if m else None for s, m in zip(sums, n, strict=True)]
        yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], names=["doc_id", "n_words", "log_prob", "mean_log_prob"])


def by_text(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Sums of the words' values over each text."""
    ends, after = np.concatenate(([0], np.cumsum(values, dtype=np.float64))), np.cumsum(n_words)
    return ends[after] - ends[after - n_words]


def score(chunks: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_words, log_prob and mean_log_prob of every row of the chunks, by these counts of words."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = WindowNetwork(shared.value.flat)
        for r in _records(batches):
            sums = by_text(network.log_p(*shared.value.layout(r["hashes"], r["at_places"], r["n"])), r["n"])
            yield pa.RecordBatch.from_arrays([*[pa.array([r[c].as_py()], t) for c, t in (("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())))], pa.array([sums], pa.list_(pa.float64())), pa.array([r["places"].as_py()], pa.binary())], names=["chunk", "doc_ids", "n_words", "log_probs", "places"])

    by_class = mapped(chunks.drop("counts"), scored, "chunk long, doc_ids array<long>, n_words array<long>, log_probs array<double>, places binary")
    whole = by_class.join(within_class(chunks, counts, model.heads), "chunk", "left")
    return mapped(whole.select("doc_ids", "n_words", "log_probs", "places", "at", "within"), _summed, "doc_id long, n_words long, log_prob double, mean_log_prob double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    chunks = materialize(chunk_records(docs), "op9-chunks")
    counts = materialize(word_counts(chunks), "op9-counts")
    return score(chunks, fit(chunks, counts), counts)
