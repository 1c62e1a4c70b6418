"""Cross-tokenizer alignment beside the two libraries on whole texts, and on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from prismloom.llm import alignment
from prismloom.llm.registry import PIECES, VOCABULARY

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The quick brown fox.\n\nUnbelievable tokenization, isn't it?", "  two  blanks \n and \t tabs\r\n", "a\n\n\nb", "trailing \n", " \n", "日本語 テキスト 𐐀 🙂🙂 ок", "<s> </s> <|endoftext|> <unk> <0x0A>", "▁ low line", "nul\0 in\0\nit",
    "\x1c odd\x85 white　space　", "12345 6.78 e+9 ;\r\n);\r\n}\r", "word" * 900, "x " * 300, "é" * 50 + " ünïcode", "﻿bom ​ zero", "ﬁ ligature Ⅷ ①", "a" + "́" + " combining ́ alone", "tab\tsep\tvalues", "-" * 77, "_ __ ___",
]


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.read_vocabularies(VOCABULARY, PIECES)


@pytest.fixture(scope="module")
def plain(vocabularies):
    """The groups of a whole text, by the libraries alone."""
    a, b = Tokenizer.from_file(VOCABULARY), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    shape = alignment.Aligner(vocabularies)

    def groups(text):
        if not text:
            return None
        raw = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [[shape.a_bytes[k] for k in ids[0]], [shape.b_bytes[k] for k in ids[1]]]
        if any(b"".join(p) != raw for p in pieces):
            return None
        out, at, end, group = [], [0, 0], [0, 0], ([], [])
        while at[0] < len(ids[0]) or at[1] < len(ids[1]):
            side = 0 if end[0] <= end[1] and at[0] < len(ids[0]) else 1
            group[side].append(ids[side][at[side]])
            end[side] += len(pieces[side][at[side]])
            at[side] += 1
            if end[0] == end[1]:
                out.append(group)
                group = ([], [])
        return out

    return groups


def brute(docs, groups):
    """docs: (doc_id, text). The contract, link by link."""
    all_groups = [groups(t) for _, t in docs]
    held = Counter(p for g in all_groups for p in {(x, y) for a, b in g or [] for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for (doc_id, _), g in zip(docs, all_groups, strict=True):
        links = [(x, y) for a, b in g or [] for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        rows.append((doc_id, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(rows, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def many():
    draw = random.Random(11)
    parts = [p for t in TEXTS for p in (t, t[: len(t) // 2], t[len(t) // 2 :])]
    glue = ["", " ", "\n", "  ", "\t", "\r\n", "　", " \n"]
    mixed = ["".join(draw.choice(parts) + draw.choice(glue) for _ in range(draw.randrange(1, 6))) for _ in range(250)]
    letters = "ab é\n\t.,'\"-_09 ▁日🙂\r\x85"
    mixed += ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 40))) for _ in range(400)]
    return list(enumerate(TEXTS + mixed))


def test_alignment_equals_whole_texts(spark, vocabularies, plain, many, monkeypatch):
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    want = brute(many, plain)
    assert found(alignment.align(docs, vocabularies)) == want
    assert sum(r[3] > 0 for r in want) > 400 and sum(r[3] == 0 for r in want) > 30
    # other blocks, and a dictionary that is emptied in between
    monkeypatch.setattr(alignment, "KEPT", 10)
    assert found(alignment.Alignment(docs.repartition(2), vocabularies, block=500).documents()) == want


def test_groups_as_text(spark, vocabularies, plain):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r.groups for r in alignment.groups(docs, vocabularies).collect()}
    for k, t in enumerate(TEXTS):
        assert rows[k] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(t) or [])


def test_vocabularies_that_reach_over_white_space_take_whole_texts(vocabularies, plain, many):
    aligner = alignment.Aligner(vocabularies)
    assert aligner.cuts
    aligner.cuts = False
    for _, t in many[:80]:
        segments = aligner.numbers(t)
        aligner.learn()
        want = plain(t)
        assert len(segments) == 1 and aligner.aligned(segments) == (want is not None)
        assert not want or aligner.text(segments) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)


def test_pairs_of_the_corpus(spark, vocabularies):
    docs = spark.createDataFrame([(1, "the the the"), (2, "the unbelievable"), (3, None)], "doc_id long, text string")
    pairs = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.Alignment(docs, vocabularies).pairs().collect()}
    the = Tokenizer.from_file(VOCABULARY).encode(" the").ids[0], SentencePieceProcessor(model_file=PIECES).encode("the")[0]
    assert pairs[the] == (2, True)
    assert all(n in (1, 2) for n, _ in pairs.values())


def test_long_runs_cost_no_square():
    import numpy as np

    pairs, times = alignment.links(np.full(50_000, 7), np.full(40_000, 9))
    assert pairs.tolist() == [(7 << 32) | 9] and times.tolist() == [2_000_000_000]


def test_odd_rows(spark, odd_docs, no_docs, vocabularies, plain):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(alignment.align(odd_docs, vocabularies)) == brute(rows, plain)
    assert found(alignment.align(no_docs, vocabularies)) == []
    assert found(alignment.align(odd_docs.where("text is null"), vocabularies)) == sorted([(r[0], 0, 0, 0, 0, 0, 0, "") for r in rows if r[1] is None], key=str)
