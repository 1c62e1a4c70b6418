"""MinHash near-duplicates beside all pairs of plain sets, and on odd rows."""

import random

import numpy as np
import pytest

from prismloom.llm import minhash

WORD = "[^\x20\x09-\x0d]+"


def plain_set(text):
    words = [w.encode().lower() for w in __import__("re").findall(WORD, text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """docs: (doc_id, text), doc_ids may be null. (doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    out = []
    for k, (d, _) in enumerate(docs):
        c = least.get(top(k)) if sets[k] else d
        out.append((d, len(sets[k]), c, d == c))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in minhash.classes(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def copies(draw, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(most + 1)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    """A group of 260 copies from alike to not, small groups, short texts, exact copies in other case and other texts that share a passage."""
    draw = random.Random(13)
    fresh = lambda n: [f"v{draw.randrange(10**7)}" for _ in range(n)]
    texts = copies(draw, fresh(150), 260, 9)
    for _ in range(25):
        texts += copies(draw, fresh(draw.randrange(20, 90)), draw.randrange(2, 6), 2)
    passage = fresh(60)
    texts += [" ".join(fresh(draw.randrange(5, 60)) + passage) for _ in range(120)]
    texts += ["Short One", "short one", "SHORT  one", "a b c d", "a b c d e", "A b c d e f", "", None, " \n"]
    texts += [texts[0].upper(), texts[0], "same words " * 40, "same words " * 41]
    draw.shuffle(texts)
    return [(1000 + k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("block", "hubs"), [(48, 16), (10, 2), (3, 1)])
def test_classes_equal_all_pairs(spark, corpus, block, hubs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "HUBS", hubs)
    want = brute(corpus)
    sizes = {}
    for _, _, c, _ in want:
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) > 60 and sum(n > 1 for n in sizes.values()) > 10
    assert found(spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)) == want


def test_bytes_cut_blocks_too(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 5000)
    assert found(spark.createDataFrame(corpus[:200], "doc_id long, text string")) == brute(corpus[:200])


def test_sketches_fill_and_estimate():
    draw = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 300, 20_000):
        s = draw.integers(0, 2**63, n, dtype=np.uint64)
        values = minhash.sketch(s)
        assert len(values) == minhash.COORDINATES and (values < np.iinfo(np.uint64).max).all()
        assert np.array_equal(values, minhash.sketch(draw.permutation(s)))
    common, mean = draw.integers(0, 2**63, 150, dtype=np.uint64), []
    for _ in range(60):
        a, b = (np.concatenate((common, draw.integers(0, 2**63, 25, dtype=np.uint64))) for _ in range(2))
        mean.append((minhash.sketch(a) == minhash.sketch(b)).mean())
    assert abs(np.mean(mean) - 0.75) < 0.02 and np.std(mean) < 1.3 * (0.75 * 0.25 / minhash.COORDINATES) ** 0.5


def test_places_that_no_draw_reaches_are_filled(monkeypatch):
    # with a single element and few rounds most places are left to the last rounds, which serve one place each
    values = minhash.sketch(np.array([12345], np.uint64))
    assert (values >> np.uint64(32)).max() >= minhash.COORDINATES
    assert np.array_equal(values, minhash.sketch(np.array([12345], np.uint64)))


def test_verified_needs_a_band_and_the_percentage():
    a, b = np.arange(100, dtype=np.uint64), np.arange(8, 100, dtype=np.uint64)
    same, other = np.arange(minhash.BANDS), np.arange(100, 100 + minhash.BANDS)
    assert minhash.verified([(same, a)], [(same, b)]).tolist() == [[True]]
    assert minhash.verified([(same, a)], [(other, b)]).tolist() == [[False]]
    assert minhash.verified([(same, a)], [(same, a[:85]), (same, a[:84])]).tolist() == [[True, False]]


def test_spanning_keeps_connections():
    pairs = [(1, 11), (2, 12), (3, 11), (3, 12), (1, 12), (2, 11)]
    assert len(minhash.spanning(pairs)) == 4


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs) == brute(rows)
    assert found(no_docs) == []
    assert found(odd_docs.where("text is null")) == sorted([(d, 0, d, True) for d, t in rows if t is None], key=str)


def test_two_texts_under_one_id_stay_apart(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "Q r s t u v w"), (2, "Q r s t u v w")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
