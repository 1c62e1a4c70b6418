"""Byte-pair encoding and decoding by a deterministic tokenization automaton.

Compiling, on the driver, goes by successive merge gadgets. The automaton over tokens starts universal: its states are
the tokens read last, its labels the tokens read next, and every arc is there. The gadget of merge (u, v), in order of
rank, removes the arcs from states that still end in a piece u to labels that still begin with a piece v when the merge
has its turn, and brings in the label uv if its own arc from u to v is still there. A piece is in a token from its own
rank until the rank of the piece that takes it up. What remains accepts exactly one token sequence for each byte string:
its encoding. States that no gadget tells apart are one state, labels likewise, so the table of arcs is a bit matrix
(14,639 states x 10,603 labels and 19 MB for 50,000 merges; `MOST_BYTES` bounds what may be broadcast).

Encoding reads bytes. Every prefix of a word has one encoding, so the byte automaton's state is the set of its live
pairs (token state, place in the trie of labels), and a step by a byte yields the next state and the prefix's last token.
Sets become numbered states and steps become entries of a table the first time they are met; a word is encoded by one
table step a byte, and its tokens are read off from the end. No step is ever taken back. Words are pre-split by the usual
pattern and encoded once per distinct word and task; decoding emits the arcs' labels.

Defined results: a null or empty text has no tokens and the hash of nothing; special tokens in a text become their ids,
as the tokenizers library does by default; long texts and long words are read whole; repeated rows are encoded alike;
there are no ties, as every text has one encoding; an empty table gives no rows. Columns other than doc_id and text are
not read, so clashing names do no harm; `encode` replaces columns named like its own.
"""

from __future__ import annotations

import array
import hashlib
import json
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, text_chunks

#: The usual pre-splitting pattern, with white space as Unicode has it.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# Letters and numbers that the `regex` library knows and the Unicode version of the tokenizers library doesn't.
UNKNOWN = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F "
    "12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_UNKNOWN = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in UNKNOWN.split())
HAS_UNKNOWN = regex.compile(f"[{_UNKNOWN}]")
#: The same pattern for the rare texts with such characters.
SPLIT_UNKNOWN = regex.compile(
    r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[UNKNOWN]]+| ?[\p{N}--[UNKNOWN]]+| ?(?:[^\p{White_Space}\p{L}\p{N}]|[UNKNOWN])+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+".replace("UNKNOWN", _UNKNOWN)
)
#: Bytes of text kept by each of two generations of a Python process's table of words; longer words aren't kept.
CACHED_BYTES, LONGEST_CACHED = 24_000_000, 64
#: Byte states kept in the table before it is emptied.
STATES = 400_000
#: Of the compiled table that is broadcast.
MOST_BYTES = 200_000_000


def byte_letters() -> dict[str, int]:
    """How vocabulary files write bytes: printable Latin-1 characters as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeAutomaton:
    """Encodes and decodes as the vocabulary's merges say."""

    def __init__(self, vocabulary: str):
        data = json.loads(vocabulary)
        check_form(data)
        letters = byte_letters()
        ids, merges = data["model"]["vocab"], data["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.label: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(ids[x] for x in (pair.split(" ") if isinstance(pair, str) else pair)) for pair in merges]
        made = [ids[data_token(pair)] for pair in merges]
        ends, begins = self._pieces(ids.values(), pairs, made)
        self.state, from_piece = self._classes(ends, [u for u, _ in pairs], bisect_left)  # taken up at its turn, a piece at the end is gone
        self.entry, to_piece = self._classes(begins, [v for _, v in pairs], bisect_right)  # at the beginning it isn't: of equal ranks the left goes first
        self.width = (max(self.entry.values(), default=0) + 8) // 8
        self.arcs = self._add_gadgets(pairs, made, from_piece, to_piece)
        if len(self.arcs) > MOST_BYTES:
            raise ValueError(f"the arcs take {len(self.arcs)} bytes, more than MOST_BYTES")
        self.child: dict[int, int] = {}  # (node << 8 | byte) -> node
        self.token_at: list[int] = [-1]
        self.inner = {0}  # nodes with children
        for t in self.usable:
            node = 0
            for b in self.label[t]:
                self.inner.add(node)
                node = self.child.setdefault(node << 8 | b, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = t
        self.stops = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget(words=True, states=True)

    @staticmethod
    def _pieces(tokens, pairs: list[tuple[int, int]], made: list[int]) -> tuple[dict, dict]:
        """For each token its last and its first pieces, each with the rank that takes it up."""
        parts: dict[int, tuple[int, int, int]] = {}
        for r, ((u, v), t) in enumerate(zip(pairs, made, strict=True)):
            parts.setdefault(t, (r, u, v))
        never = len(pairs)
        ends: dict[int, list[tuple[int, int]]] = {}
        begins: dict[int, list[tuple[int, int]]] = {}
        for t in sorted(tokens, key=lambda x: parts[x][0] if x in parts else -1):
            r, u, v = parts.get(t, (never, t, t))
            ends[t] = [(t, never), *((p, min(d, r)) for p, d in ends.get(v, []))]
            begins[t] = [(t, never), *((p, min(d, r)) for p, d in begins.get(u, []))]
        return ends, begins

    @staticmethod
    def _classes(pieces: dict[int, list[tuple[int, int]]], merged: list[int], below: Callable) -> tuple[dict[int, int], dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Token -> class of those whose pieces the same merges meet; piece -> the classes that show it and until which rank."""
        ranks: dict[int, list[int]] = {}
        for r, piece in enumerate(merged):
            ranks.setdefault(piece, []).append(r)
        numbers: dict[tuple, int] = {}
        of: dict[int, int] = {}
        shown: dict[int, list[tuple[int, int]]] = {}
        for t, own in pieces.items():
            key = tuple((p, n) for p, d in own if (n := below(ranks.get(p, []), d)))
            of[t] = numbers.setdefault(key, len(numbers))
        for key, k in numbers.items():
            for p, n in key:
                shown.setdefault(p, []).append((k, ranks[p][n - 1]))
        return of, {p: tuple(np.array(x) for x in zip(*who, strict=True)) for p, who in shown.items()}

    def _add_gadgets(self, pairs: list[tuple[int, int]], made: list[int], from_piece: dict, to_piece: dict) -> bytes:
        """The arcs removed, a bit for each state and label, and `usable`: the labels that merges bring in."""
        gone = np.zeros((max(self.state.values(), default=0) + 1, self.width), np.uint8)
        self.usable = {t for t in self.state if len(self.label[t]) == 1}
        seen: set[int] = set()
        for r, ((u, v), t) in enumerate(zip(pairs, made, strict=True)):
            open_ = not gone[self.state[u], self.entry[v] >> 3] >> (self.entry[v] & 7) & 1
            if open_ and u in self.usable and v in self.usable and t not in seen:
                self.usable.add(t)
            seen.add(t)
            states, until = from_piece[u]
            labels, and_until = to_piece[v]
            row = np.zeros(self.width * 8, bool)
            row[labels[and_until >= r]] = True
            gone[states[until >= r]] |= np.packbits(row, bitorder="little")
        return gone.tobytes()

    def allows(self, state: int, t: int) -> bool:
        label = self.entry[t]
        return state < 0 or not self.arcs[state * self.width + (label >> 3)] >> (label & 7) & 1

    def _step(self, state: int, byte: int) -> int:
        """Enter into the table what reading a byte in a state leads to: the next state << 32 and the prefix's last token."""
        live, last = [], -1
        for before, node in self.live[state]:
            node = self.child.get(node << 8 | byte, -1)
            if node >= 0:
                t = self.token_at[node]
                if last < 0 <= t and self.allows(before, t):
                    last = t
                if node in self.inner:
                    live.append((before, node))
        if last < 0:
            raise ValueError(f"no encoding of byte {byte}")
        live.append((self.state[last], 0))
        key = tuple(live)
        following = self.numbers.setdefault(key, len(self.live))
        if following == len(self.live):
            self.live.append(key)
        found = self.steps[state << 8 | byte] = following << 32 | last
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The accepted token sequence of one pre-split word."""
        steps, state, lasts = self.steps.get, 0, []
        for byte in word:
            found = steps(state << 8 | byte)
            if found is None:
                found = self._step(state, byte)
            lasts.append(found & 0xFFFFFFFF)
            state = found >> 32
        path, at, label = [], len(word), self.label
        while at:
            t = lasts[at - 1]
            path.append(t)
            at -= len(label[t])
        path.reverse()
        return path

    def forget(self, words: bool = False, states: bool = False) -> None:
        """Empty the table of steps where asked or where it has grown large, and the words where asked; both fill again."""
        if states or len(self.live) > STATES:
            self.live: list[tuple] = [((-1, 0),)]
            self.numbers: dict[tuple, int] = {self.live[0]: 0}
            self.steps: dict[int, int] = {}
        if words:
            self.words: dict[str, bytes] = {}
            self.older_words: dict[str, bytes] = {}
            self.held = 0

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not self.stops:
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.stops.finditer(text):
            out += [self._encode_plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def _encode_plain(self, text: str) -> bytes:
        words, out = self.words, []
        for word in SPLIT.findall(text):
            known = words.get(word)
            if known is None:
                if not word.isascii() and HAS_UNKNOWN.search(word):  # such words stay out of the table
                    return b"".join(little_endian(self.encode_word(w.encode())) for w in SPLIT_UNKNOWN.findall(text))
                known = self.older_words.get(word) or little_endian(self.encode_word(word.encode()))
                if len(word) <= LONGEST_CACHED:
                    words[word] = known
                    self.held += len(word) + len(known)
            out.append(known)
        if self.held >= CACHED_BYTES:
            self.words, self.older_words, self.held = {}, words, 0
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        whole = array.array("I", ids)
        if sys.byteorder == "big":
            whole.byteswap()
        return b"".join(map(self.label.__getitem__, whole)).decode("utf-8", "replace")


def check_form(data: dict) -> None:
    """Raise where a vocabulary file asks for something else than byte-level pre-splitting and plain merges."""
    level, model = data.get("pre_tokenizer") or {}, data["model"]
    odd = [x for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(x)]
    odd += [f"{k} of an added token" for x in data.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if x.get(k)]
    if data.get("normalizer") or model.get("type") != "BPE" or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex", True) or odd:
        raise ValueError(f"not a plain byte-level vocabulary: {odd or level}")


def data_token(pair: str | list[str]) -> str:
    return pair.replace(" ", "") if isinstance(pair, str) else "".join(pair)


def little_endian(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def compiled(vocabulary: str) -> MergeAutomaton:
    return MergeAutomaton(vocabulary)


_broadcasts: dict[tuple[str, str], Broadcast] = {}


def broadcast(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The vocabulary's automaton, compiled and broadcast once for each application; the driver doesn't keep it."""
    context = spark.sparkContext
    key = context.applicationId, hashlib.md5(vocabulary.encode()).hexdigest()
    if key not in _broadcasts:
        while len(_broadcasts) >= 2:
            del _broadcasts[next(iter(_broadcasts))]
        _broadcasts[key] = context.broadcast(compiled(vocabulary))
    return _broadcasts[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(docs: DataFrame, keep: list[str], extra: str, make, vocabulary: str) -> DataFrame:
    """keep (columns of docs) and what make(automaton, text) returns for each whole text, as the columns `extra`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = broadcast(docs.sparkSession, vocabulary)
    others = [c for c in keep if c != "text"]
    given = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text"))
    schema = given.select(*[F.col(f"`{c}`") for c in keep]).schema
    for part in extra.split(", "):
        schema = schema.add(*part.split(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        out = to_arrow_schema(schema)
        for rows in text_chunks(batches):
            made = [make(automaton, r["text"] or "") for r in rows]
            automaton.forget()
            yield pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in keep} | dict(zip([p.split(" ")[0] for p in extra.split(", ")], map(list, zip(*made, strict=True)), strict=True)), schema=out)

        automaton.forget(words=True)

    return mapped(given, run, schema)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs with token_ids (binary, little-endian unsigned 32-bit) and n_tokens, in place of columns so named."""
    docs = docs.drop("token_ids", "n_tokens")

    def make(automaton: MergeAutomaton, text: str):
        ids = automaton.encode(text)
        return ids, len(ids) // 4

    return _mapped(docs, docs.columns, "token_ids binary, n_tokens long", make, vocabulary)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def make(automaton: MergeAutomaton, text: str):
        ids = automaton.encode(text)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(automaton.decode(ids).encode()).hexdigest()

    return _mapped(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", make, vocabulary)
