"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, by a dictionary of groups.

Tokenizer A is a byte-level BPE (a file of the tokenizers library), B a sentencepiece model with byte fallback. Both encode
a space and the text. Byte offsets where tokens of both end cut the two sequences into groups, and every A token of a
group is linked with every B token of it.

1. Texts are encoded segment by segment: a segment begins at white space that follows other characters. No pre-token of
   A and no piece of B reaches over such a place (the vocabulary is asked once; if one does, a text is one segment), so a
   segment has the same tokens wherever it stands, and a task encodes each different segment once.
2. Groups are interned: a block of documents (about `BLOCK` bytes of text) keeps a list of its different groups, and each
   document the numbers of its groups with their frequencies. The links of a group are expanded once for the block, and
   counted by the number of the block's distinct documents that hold them. Only lists of distinct groups and links leave
   the task; both stop growing where the vocabularies are used up.
3. Counts of links are summed over blocks. Of all blocks' groups the distinct ones form the corpus's dictionary; each is
   expanded once, meets the counts of its links, and gets their sum and the number of its best links.
4. These results go back by the group's key to the blocks that hold it, and each document sums them by its frequencies.

A group of repeated ids is expanded into distinct pairs with multiplicities, so a long run costs no square of its length.
Blocks are cut by bytes and named by task and number in a written table; a lost executor costs no other block.

Defined results: a null or empty text, and one whose tokens of A or B don't join to a space and the text (U+2581 in it,
characters that B doesn't know), has no tokens: zeros and ''. Special tokens' strings are plain text. Very long texts are
read whole; repeated rows are documents of their own; ties for an id's highest count are all best; an empty table gives
no rows. A null doc_id is carried along. Columns other than doc_id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from prismloom.llm.common import mapped, materialize, row_chunks

#: Bytes of text in a block of documents.
BLOCK = 12_000_000
#: Segments that a Python process keeps encoded from one block to the next; a block's own are always kept.
KEPT = 300_000
#: Segments encoded in one call.
AT_ONCE = 4096
SPACE = "▁"
#: Texts with white space other than blanks and line ends are cut by the pattern below.
_RARE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n\t])")
_REACHES_OVER = re.compile(rf"[^\s{SPACE}][\n\t {SPACE}]")


class Vocabularies(NamedTuple):
    """Contents of the two files: A's JSON and B's model."""

    a: str
    b: bytes


def read_vocabularies(a_path: str, b_path: str) -> Vocabularies:
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return Vocabularies(a.read(), b.read())


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, all others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class _Numbers(dict):
    """Keys numbered as they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a group's ids, as a * 2**32 + b, and how often each occurs."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    return ((ua[:, None] << 32) | ub).ravel(), np.outer(ca, cb).ravel()


def parse_group(group: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(side.split(","), np.int64) for side in group.split("|"))


def _gather(offsets: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions offsets[k] ... offsets[k] + lengths[k] - 1 of each k in `of`, one after the other."""
    n = lengths[of]
    return np.repeat(offsets[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Aligner:
    """Two tokenizers, and the segments and groups met so far."""

    def __init__(self, vocabularies: Vocabularies):
        self.a = Tokenizer.from_str(vocabularies.a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=vocabularies.b)
        letters = _byte_letters()
        tokens = self.a.get_vocab()
        self.a_bytes = [b""] * (max(tokens.values()) + 1)
        for token, k in tokens.items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in all_bytes], np.int64) for all_bytes in (self.a_bytes, self.b_bytes))
        split = json.loads(vocabularies.a).get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.cuts = usual and not any(_REACHES_OVER.search(p) for p in pieces) and len(self.b.encode("a")) == 1
        self.forget()

    def forget(self) -> None:
        self.segments = _Numbers()
        self.groups = _Numbers()
        self.names: list[str] = []  # of segments: their groups as text
        self.size = {k: np.zeros(0, np.int64) for k in ("good", "n_a", "n_b", "n_groups", "n_links", "start")}
        self.group_of = np.zeros(0, np.int64)  # groups of the segments, one after the other
        self.pair_start = self.pair_count = np.zeros(0, np.int64)
        self.pair_of = np.zeros(0, np.int64)

    def _b_ids(self, text: str) -> list[int]:
        """B's ids of a text that begins with white space. B puts a space before what it is given, so a letter goes first and is left out again; a whole text loses its space."""
        return self.b.encode("a" + text)[1:] if self.cuts else self.b.encode(text[1:])

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of the segments of a space and text."""
        if not self.cuts:
            keys = ["\0 " + text]
        elif _RARE.search(text) or "  " in text or " \n" in text or "\n " in text or text[0] in " \n":
            keys = ["\0" + s for s in _CUT.split(" " + text)]  # no other key has white space but at its beginning
        else:
            spaced = text.replace("\n", " \n")
            while "\n \n" in spaced:
                spaced = spaced.replace("\n \n", "\n\n")
            keys = spaced.split(" ")  # a blank before each, but for those that begin with a line end
        return np.fromiter(map(self.segments.__getitem__, keys), np.int64, len(keys))

    @staticmethod
    def _segment(key: str) -> str:
        return key[1:] if key[:1] == "\0" and key[1:2] in (" ", "\n", "\t") else key if key[:1] == "\n" else " " + key

    def _encoded(self, batch: list[str]) -> list[np.ndarray]:
        """For each segment how many ids A and B give and whether both join to it; and the ids of A and of B, one segment after the other."""
        whole = "".join(batch)
        raw = whole.encode("utf-8", "surrogatepass")
        found = self.a.encode(whole, add_special_tokens=False).ids, self._b_ids(whole)
        if b"".join([self.a_bytes[k] for k in found[0]]) == raw == b"".join([self.b_bytes[k] for k in found[1]]):
            ends = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in batch])
            ids, counts = [np.array(x, np.int64) for x in found], []
            for x, lengths in zip(ids, (self.a_len, self.b_len), strict=True):
                tokens = np.cumsum(lengths[x])
                cut = np.searchsorted(tokens, ends)
                if not np.array_equal(tokens[cut], ends):
                    break
                counts.append(np.diff(cut + 1, prepend=0))
            else:
                return [*counts, np.ones(len(batch), np.int64), *ids]
        if len(batch) > 1:
            return [np.concatenate(x) for x in zip(*(self._encoded([s]) for s in batch), strict=True)]
        return [np.zeros(1, np.int64)] * 3 + [np.zeros(0, np.int64)] * 2

    def learn(self) -> None:
        """Encode the segments that are new since the last call."""
        done = len(self.names)
        if done == len(self.segments):
            return
        new = [self._segment(k) for k in list(self.segments)[done:]]
        # one after the other they stand as in a text; those that end in white space, or don't begin with it, go alone
        joined = [k for k, s in enumerate(new) if self.cuts and s[0] in " \n\t" and not s[-1].isspace()]
        alone = sorted(set(range(len(new))) - set(joined))
        batches = [joined[at : at + AT_ONCE] for at in range(0, len(joined), AT_ONCE)] + [[k] for k in alone]
        encoded = [np.concatenate(x) for x in zip(*(self._encoded([new[k] for k in part]) for part in batches), strict=True)]
        n_a, n_b, good = encoded[:3]
        back = np.argsort(np.array(joined + alone, np.int64))  # from the order of encoding to that of the numbers
        flat_a, flat_b = (ids[_gather(np.cumsum(n) - n, n, back)] for ids, n in zip(encoded[3:], (n_a, n_b), strict=True))
        n_a, n_b, good = n_a[back], n_b[back], good[back]
        # offsets where both end; segments join without gaps, so all are found at once
        ends_a, ends_b = np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        lo_a, lo_b = np.concatenate(([0], at_a[:-1] + 1)).astype(np.int64), np.concatenate(([0], at_b[:-1] + 1)).astype(np.int64)
        len_a, len_b = at_a + 1 - lo_a, at_b + 1 - lo_b
        group = self._numbered_groups(flat_a, flat_b, lo_a[: len(at_a)], lo_b[: len(at_b)], len_a, len_b)
        first = np.searchsorted(at_a, np.cumsum(n_a) - n_a)
        n_groups = np.append(first[1:], len(at_a)) - first
        in_segment = np.repeat(np.arange(len(new)), n_groups)
        n_links = np.bincount(in_segment, weights=len_a * len_b, minlength=len(new)).astype(np.int64)
        names, listed = list(self.groups), group.tolist()
        self.names += [";".join([names[g] for g in listed[i : i + n]]) for i, n in zip(first.tolist(), n_groups.tolist(), strict=True)]
        for key, value in (("good", good), ("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links), ("start", first + len(self.group_of))):
            self.size[key] = np.concatenate((self.size[key], value))
        self.group_of = np.concatenate((self.group_of, group))

    def _numbered_groups(self, flat_a, flat_b, lo_a, lo_b, len_a, len_b) -> np.ndarray:
        """The number of each group; new groups get the links they expand into."""
        known = len(self.groups)
        out = np.empty(len(lo_a), np.int64)
        one = (len_a == 1) & (len_b == 1)
        pairs, back = np.unique((flat_a[lo_a[one]] << 32) | flat_b[lo_b[one]], return_inverse=True)
        out[one] = np.array([self.groups[f"{p >> 32}|{p & 0xFFFFFFFF}"] for p in pairs.tolist()], np.int64)[back]
        text_a, text_b = (list(map(str, flat.tolist())) for flat in (flat_a, flat_b))
        many = np.flatnonzero(~one)
        out[many] = [
            self.groups[",".join(text_a[i : i + m]) + "|" + ",".join(text_b[j : j + n])]
            for i, m, j, n in zip(lo_a[many].tolist(), len_a[many].tolist(), lo_b[many].tolist(), len_b[many].tolist(), strict=True)
        ]
        expanded = [links(*parse_group(g))[0] for g in list(self.groups)[known:]]
        count = np.array([len(x) for x in expanded], np.int64)
        self.pair_start = np.concatenate((self.pair_start, len(self.pair_of) + np.cumsum(count) - count))
        self.pair_count = np.concatenate((self.pair_count, count))
        self.pair_of = np.concatenate((self.pair_of, *expanded))
        return out

    def aligned(self, segments: np.ndarray | None) -> bool:
        return segments is not None and bool(self.size["good"][segments].all())

    def text(self, segments: np.ndarray) -> str:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        return ";".join([self.names[s] for s in segments.tolist()])

    def group_counts(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.group_of[_gather(self.size["start"], self.size["n_groups"], segments)], return_counts=True)

    def pairs(self, groups: np.ndarray) -> np.ndarray:
        """The distinct links of distinct groups."""
        return np.unique(self.pair_of[_gather(self.pair_start, self.pair_count, groups)])


_worker: tuple[Vocabularies, Aligner] | None = None


def _aligner(vocabularies: Vocabularies) -> Aligner:
    """One for each Python process, as it costs a second to build."""
    global _worker
    if _worker is None or _worker[0] != vocabularies:
        _worker = (vocabularies, Aligner(vocabularies))
    return _worker[1]


_ENCODED = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("refs", pa.binary()), ("freqs", pa.binary())]
    + [("groups", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("pair_docs", pa.list_(pa.int64()))]
)
_ENCODED_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, refs binary, freqs binary, groups array<string>, pairs array<long>, pair_docs array<long>"


def _block(aligner: Aligner, rows: list[dict], name: int) -> pa.RecordBatch:
    """A row for each document and, last, one with the block's distinct groups and its counts of links."""
    if len(aligner.segments) > KEPT:
        aligner.forget()
    segments = [aligner.numbers(r["text"]) if r["text"] else None for r in rows]
    aligner.learn()
    out: list[dict] = []
    counted = [aligner.group_counts(s) if aligner.aligned(s) else None for s in segments]
    held = np.unique(np.concatenate([np.zeros(0, np.int64), *[c[0] for c in counted if c]]))
    pairs = aligner.pairs(held)
    in_docs = np.zeros(len(pairs), np.int64)
    for r, s, c in zip(rows, segments, counted, strict=True):
        row = {"block": name, "doc_id": r["doc_id"], "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "refs": b"", "freqs": b""}
        if c:
            row |= {k: int(aligner.size[k][s].sum()) for k in ("n_a", "n_b", "n_groups", "n_links")}
            row["groups_sha256"] = hashlib.sha256(aligner.text(s).encode()).hexdigest()
            row["refs"], row["freqs"] = np.searchsorted(held, c[0]).astype("<i4").tobytes(), c[1].astype("<i4").tobytes()
            in_docs[np.searchsorted(pairs, aligner.pairs(c[0]))] += 1
        out.append(row)
    names = list(aligner.groups)
    out.append({"block": name, "groups": [names[g] for g in held.tolist()], "pairs": pairs, "pair_docs": in_docs})
    return pa.RecordBatch.from_pylist(out, schema=_ENCODED)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in row_chunks(batches, "group", 200_000):
        found = [links(*parse_group(r["group"])) for r in rows]
        names = pa.array([r["group"] for r in rows]).take(pa.array(np.repeat(np.arange(len(rows)), [len(p) for p, _ in found])))
        yield pa.RecordBatch.from_arrays([names, *[pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]], names=["group", "pair", "times"])


_OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _sums(docs: pa.Table, results: pa.Table) -> pa.Table:
    """The documents of a block with the results of their groups, weighted by frequencies."""
    at = results.column("at").to_numpy()
    by_place = {}
    for c in ("best", "total"):
        by_place[c] = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
        by_place[c][at] = results.column(c).to_numpy()
    read = [(np.frombuffer(r, "<i4"), np.frombuffer(f, "<i4").astype(np.int64)) for r, f in zip(docs.column("refs").to_pylist(), docs.column("freqs").to_pylist(), strict=True)]
    sums = {name: pa.array([int((by_place[c][refs] * freqs).sum()) for refs, freqs in read], pa.int64()) for name, c in (("n_best", "best"), ("count_sum", "total"))}
    return pa.table({c: sums[c] if c in sums else docs.column(c) for c in _OUT})


class Alignment:
    """Alignment of all documents: `documents` and `pairs` read tables in the shared folder."""

    def __init__(self, docs: DataFrame, vocabularies: Vocabularies, block: int = BLOCK):
        shared = docs.sparkSession.sparkContext.broadcast(vocabularies)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId() << 32
            for k, rows in enumerate(row_chunks(batches, "text", block)):
                yield _block(_aligner(shared.value), rows, task + k)

        self.encoded = materialize(mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, _ENCODED_SQL), "op11-encoded")
        self.blocks = self.encoded.where("groups is not null")
        each = self.blocks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.pair_docs").alias("n"))
        counted = materialize(each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftrightunsigned("pair", 32)), "op11-counted")
        most = materialize(counted.groupBy("a").agg(F.max("n").alias("most")), "op11-most")
        self.linked = materialize(counted.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "op11-linked")

    def pairs(self) -> DataFrame:
        """a_id, b_id, n_docs (documents that hold the two linked) and best (the A id's highest count, ties included)."""
        return self.linked.select(F.shiftrightunsigned("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), F.col("n").alias("n_docs"), "best")

    def dictionary(self) -> DataFrame:
        """group, total (counts summed over its links) and best (how many of its links are best), once for each distinct group."""
        groups = materialize(self.blocks.select(F.explode("groups").alias("group")).distinct(), "op11-groups")
        expanded = materialize(mapped(groups, _expand, "group string, pair long, times long"), "op11-expanded")
        met = expanded.join(self.linked, "pair")
        return met.groupBy("group").agg(F.sum(F.col("times") * F.col("n")).alias("total"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
        results = materialize(self.dictionary(), "op11-results")
        held = self.blocks.select("block", F.posexplode("groups").alias("at", "group"))
        back = materialize(held.join(results, "group").select("block", "at", "total", "best"), "op11-back")
        docs = self.encoded.where("groups is null").select("block", *[c for c in _OUT if c not in ("n_best", "count_sum")], "refs", "freqs")
        schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in _OUT)
        return docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_sums, schema)


def groups(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """doc_id and the groups of every document as text, '' where it has no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for rows in row_chunks(batches, "text", BLOCK // 8):
            if len(aligner.segments) > KEPT:
                aligner.forget()
            segments = [aligner.numbers(r["text"]) if r["text"] else None for r in rows]
            aligner.learn()
            texts = [aligner.text(s) if aligner.aligned(s) else "" for s in segments]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "groups"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, groups string")


def align(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    return Alignment(docs, vocabularies).documents()
