"""Each document operator against a plain version of its contract, and on odd inputs."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from prismloom.llm import language, mixing, pii, quality, scoring, simhash, substrings, tokens
from prismloom.llm.common import table
from prismloom.llm.registry import VOCABULARY

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


@pytest.fixture(scope="module", params=["table", "odd", "none"])
def given(request, docs, odd_docs, no_docs):
    return {"table": docs, "odd": odd_docs, "none": no_docs}[request.param]


def both(frame, found, *columns):
    """Rows of found as a multiset."""
    return Counter(tuple(r[c] for c in columns) for r in found.collect())


def test_quality_base(given):
    def figures(text):
        words = WORDS.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        n = len(words)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n

    found = quality.judge(given)
    want = Counter((r.doc_id, *figures(r.text)) for r in given.collect())
    assert both(given, found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r.kept and r.base_failed for r in found.collect())


def test_quality_finds_planted_labels(spark):
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, big, "labels").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in quality.judge(table(spark, big, "documents")).where("not base_failed").collect() if r.doc_id in labels]
    good, bad = [k for q, k in judged if q == 1], [k for q, k in judged if q == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.1


def test_quality_estimate_separates():
    patterns = [((1, 1, 1), 80), ((-1, -1, 0), 15), ((1, -1, 0), 3), ((0, 1, -1), 2)]
    odds, ratios = quality.estimate(patterns)
    score = lambda p: odds + sum(r[v] for r, v in zip(ratios, p))
    assert score((1, 1, 1)) > 0 > score((-1, -1, 0))
    assert quality.estimate([]) == (0.0, [])


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def passes(kind, match):
        digits = [int(c) for c in match if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


HARD = [
    "a@b.c.d%x@y.z",
    "1.2.3.4.5.6.7.8 300.1.2.3.4 0001.02.255.256 00255.1.1.1",
    "4111 1111 1111 1111 12345678901234567890 4111-1111-1111-1111-",
    "+12 345-678 90. +1 (743) 555-3824 +123 +1234567890123456",
    "x@y a@b..c @ a@b.c",
    "é@b.com ñ 4111111111111111é \U0001f600a@b.co, (499) 555-6503",
    'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6',
    "5 4111111111111111",
]


def test_pii_base(spark, given):
    hard = spark.createDataFrame(list(enumerate(HARD, 10_000)), "doc_id long, text string")
    frame = given.select("doc_id", "text").unionByName(hard)
    want = Counter()
    for r in frame.collect():
        found = base_spans(r.text)
        want[(r.doc_id, *[sum(x.startswith(k) for x in found) for k in PII], hashlib.sha256(",".join(found).encode()).hexdigest())] += 1
    report = pii.report(frame)
    assert both(frame, report, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    for r in report.collect():
        assert r.spans == "" or all(x.split(":")[0] in pii.KINDS for x in r.spans.split(","))


PEOPLE = [
    'auth_token="' + "a1" * 200 + '" API_KEY: \'ABCDEFGH12345678\'',
    "Write to John Smith, 12 Main Street, or Dr. Okafor at 5 Old Mill Rd; John smith and 12 main street don't count",
    "\ufeff\U0001f600 a@b.co\ufeff(212) 555-0199 Tel: (212) 555-0000",
    "+1 212.555.0000.12 4111 1111 1111 1111",
    'version = "abcdefghijklmnopq" secret="aaaaaaaaaaaaaaaaaaaa" x_password = "correcthorsebattery1"',
]


def plain_spans(text, model):
    """(kind, start, end) of all spans, by matches, votes and the classifier's weights in plain Python."""
    import regex

    base = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(text))]
    found = []
    for k, kind in enumerate(pii.KINDS[4:], 4):
        for m in regex.finditer(pii.PATTERNS[kind], text):
            value, before, after = m[0], text[max(0, (found[-1][2] if found and found[-1][0] == k else 0), m.start() - 32) : m.start()], text[m.end() : m.end() + 16]
            has = lambda p, x: bool(regex.search(p, x))
            mixed = kind == "secret" and has("[0-9]", value) and has("[A-Za-z]", value)
            names = set(regex.findall("[A-Za-z]+", value))
            votes = (
                1,
                -1 if kind == "secret" and has(r"^(.)\1*$", value) else 1 if kind == "person" and names & set(pii.SURNAMES) or kind == "address" else 0,
                -1 if kind == "secret" and has(pii.VERSION_BEFORE, before) else 1 if has(pii.CONTEXT[kind], before) else 0,
                -1 if kind == "secret" and not mixed else 1,
                -1 if has("^[A-Za-z0-9_]", after) or has("[A-Za-z0-9_]$", before) else 1 if has(r"^(?:$|[\s,;:.!?)\"'<])", after) else 0,
            )
            score = model["kind"][k] + sum(w * v for w, v in zip(model["vote"], votes, strict=True))
            if score >= 0 and all(e <= m.start() or m.end() <= s for _, s, e in base):
                found.append((k, m.start(), m.end()))
    return sorted(base + found)


def test_pii_spans_and_masks(spark, given):
    hard = spark.createDataFrame(list(enumerate(HARD + PEOPLE, 10_000)), "doc_id long, text string")
    frame = given.select("doc_id", "text").where("doc_id is not null and coalesce(length(text), 0) < 100000").dropDuplicates(["doc_id"]).unionByName(hard)
    _, model = pii.judged(pii.candidates(frame))
    want = {r.doc_id: plain_spans(r.text or "", model) for r in frame.collect()}
    found = {r.doc_id: r.spans for r in pii.report(frame).collect()}
    assert found == {d: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans) for d, spans in want.items()}
    masked = {r.doc_id: r.text for r in pii.masked(frame).collect()}
    for r in frame.collect():
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in want[r.doc_id]):
            if a >= at:
                out += [r.text[at:a], f"[{pii.KINDS[k]}]"]
            at = max(at, b)
        assert masked[r.doc_id] == (None if r.text is None else "".join([*out, r.text[at:]]))


def test_pii_added(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([HARD[6], *PEOPLE, "plain words only", None])], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.report(frame).collect()}
    assert spans[0] == "secret:9:49" and spans[6] == spans[7] == ""
    assert spans[1] == "secret:12:412,secret:424:440"
    assert {x.split(":")[0] for x in spans[2].split(",")} == {"person", "address"} and spans[2].count(":") == 8


def test_bpe_equals_the_tokenizers_library(given):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)

    def digest(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    want = Counter((r.doc_id, *digest(r.text)) for r in given.collect())
    assert both(given, tokens.digests(given, tokens.read_vocabulary(VOCABULARY)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_on_random_strings():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(VOCABULARY), tokens.compiled(tokens.read_vocabulary(VOCABULARY))
    rng = np.random.default_rng(3)
    letters = list("aabbe  \n\t'sdtlm.,!0123é漢字\U0001f600 ​\x00Àß")
    labels = [b.decode("utf-8", "ignore") for b in own.label.values()]
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(500)] + ["".join(rng.choice(labels, 6)) for _ in range(500)] + ["a" * 4000, "<|endoftext|>x<|endoftext|>", " " * 99]
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


def test_language_held_out(docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    found = [r for r in language.identify(docs).collect() if r.held_out]
    assert found and sum(lang[r.doc_id] == r.lang_pred for r in found) / len(found) > 0.97


def test_language_odd(given):
    import binascii

    found = language.identify(given)
    want = Counter((r.doc_id, r.doc_id is not None and binascii.crc32(str(r.doc_id).encode()) % 3 == 1, not any(c.isalpha() for c in r.text or "")) for r in given.collect())
    assert Counter((r.doc_id, r.held_out, r.lang_pred == "und") for r in found.collect()) == want
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert language.accepted(given).columns == given.columns


def test_mixing(given):
    sizes: dict = {}
    rows = given.collect()
    for r in rows:
        sizes.setdefault(r.source, []).append(len(WORDS.findall(r.text or "")))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(x) for s, x in sizes.items()}
    left, open_, target = 1.5 * sum(total.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    found = mixing.mix_report(given).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r.doc_id, len(WORDS.findall(r.text or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    taken: dict = {}
    for r in found:
        key = (r.source_size, round(r.target, 6))
        taken[key] = taken.get(key, 0) + r.taken
    want: dict = {}
    for s in order:
        key = (total[s], round(target[s], 6))
        want[key] = want.get(key, 0) + target[s]
    longest = max((r.size for r in found), default=0)  # a source is served whole documents, but for the one at the cut
    assert taken.keys() == want.keys() and all(abs(taken[k] - want[k]) <= longest + len(order) for k in want)
    assert abs(sum(taken.values()) - sum(want.values())) <= 1
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mix_report(given.repartition(3)).collect()))
    assert mixing.mixed_documents(given).columns == given.columns


def plain_language(rows, texts):
    """Naive Bayes by dictionaries over the same buckets: rows (text, lang) -> the language of each text."""

    def grams(text):
        return [b for bucket in language.gram_buckets(np.array([ord(c) for c in text.lower()], np.uint32)) for b in bucket.tolist() if b < language.BUCKETS]

    seen: dict = {}
    for text, lang in rows:
        seen.setdefault(lang, [0, Counter()])
        seen[lang][0] += 1
        seen[lang][1].update(grams(text))
    total = {lang: sum(c.values()) + language.SMOOTHING * language.BUCKETS for lang, (_, c) in seen.items()}

    def score(text, lang):
        n, counts = seen[lang]
        return np.log(n / len(rows)) + sum(np.log((counts[g] + language.SMOOTHING) / total[lang]) for g in grams(text))

    return [max(sorted(seen), key=lambda lang: score(t, lang)) if any(map(str.isalpha, t or "")) else "und" for t in texts]


def test_language_equals_a_plain_version(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents").where("text is not null and lang is not null and length(text) < 800").limit(90).collect()
    learned, asked = [(r.text, r.lang) for r in rows[:60]], [r.text for r in rows[60:]] + ["½ ② ³", "١٢٣", "", None, "e", "été"]
    model = language.fit(spark.createDataFrame([(k, *x) for k, x in enumerate(learned)], "doc_id long, text string, lang string"))
    assert [x for x, _ in model.predict(asked)] == plain_language(learned, asked)
    assert [model.predict([x])[0] for x in ("½ ② ³", "١٢٣")] == [("und", 0.0)] * 2


def test_language_keeps_rare_labels(spark):
    rows = [(k, f"common words of the frequent language {k}", "aa") for k in range(300)] + [(1000, "ñandú güiro", "zz")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20)
    assert model.langs == ["aa", "zz"] and model.prior[0] == pytest.approx(np.log(300 / 301))


def plain_taken(rows):
    """rows: (key, source, size, target, source_size) in shuffled order within each source -> words taken, by one sort of all copies."""
    before: dict = {}
    queue = []
    for k, (_, source, size, target, whole) in enumerate(rows):
        start = before.get(source, 0)
        before[source] = start + size
        queue += [((whole * c + start + size) / target, "" if source is None else "=" + source, c, k) for c in (0, 1) if size]
    left, taken = int(sum({r[1]: r[3] for r in rows}.values()) + 0.25), [0] * len(rows)
    for *_, k in sorted(queue):
        served = min(left, rows[k][2])
        taken[k] += served
        left -= served
    return taken


def test_mixing_is_one_sort_and_one_cut(spark):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(k, " ".join(["w"] * int(rng.integers(0, 90))) + f" {k}", "abcd"[k % 4] if k % 9 else None) for k in range(600)], "doc_id long, text string, source string")
    queue = mixing.fair_queue(frame.select(*[c.alias(k) for k, c in mixing.marks(frame).items()])).collect()
    order = sorted(queue, key=lambda r: (r.flow, hashlib.md5(f"{r.id}:{r.text_hash}:{r.no}".encode()).hexdigest()))
    want = plain_taken([(r.id, r.flow[1:] if r.flow else None, r.size, r.target, r.source_size) for r in order])
    assert [r.taken for r in order] == want


@pytest.mark.parametrize("doc_id", [7, None])
def test_mixing_one_doc_id_in_many_tasks(spark, doc_id):
    """One doc_id, or none, on all rows: a range of the shuffled order holds few of them, and equal rows are dealt out."""
    rows = [(doc_id, f"text {k}" if k % 2 else "the same text", "s" if k % 3 else "t") for k in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    dealt = mixing.dealt_out(frame.select(*[c.alias(k) for k, c in mixing.marks(frame).items()]))
    assert dealt.count() == dealt.distinct().count() == 2000
    found = mixing.mix_report(frame)
    assert found.count() == 2000 and max(Counter(round(r.virtual_finish * 64) for r in found.collect()).values()) < 200
    mixed = mixing.mixed_documents(frame)
    words = sum(r.taken for r in found.collect())
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - words) <= 3
    assert max(Counter(mixed.collect()).values()) <= 2 * 667


def test_substrings(given):
    words = [(r.doc_id, WORDS.findall(r.text or "")) for r in given.collect()]
    seen = Counter(" ".join(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    want = Counter()
    for doc_id, w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[" ".join(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[(doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    assert both(given, substrings.remove_repeats(given), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_substrings_edges(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    texts = [passage, f"pre {passage} post", "q " + " ".join(passage.split()[:34]) + " zz", "y " * 36, "k " * 35, "a b " * 40, " ".join(f"v{k}" for k in range(35)), "\n".join(f"v{k}" for k in range(35))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame).collect()} == {0: 60, 1: 60, 2: 0, 3: 36, 4: 0, 5: 80, 6: 35, 7: 35}


def plain_fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, value) rows -> id of each row's component, by all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    members: dict = {}
    for k, (doc_id, _) in enumerate(prints):
        members.setdefault(find(k), []).append(doc_id)
    return [min((m for m in members[find(k)] if m is not None), default=None) for k in range(len(prints))]


def test_simhash(given):
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in given.collect()]
    want = Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints)))
    assert both(given, simhash.near_duplicates(given), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.one_of_each(given)
    assert kept.columns == given.columns
    found = [r.doc_id for r in kept.collect()]
    named = {c for _, _, c in want}
    assert len(found) == len(named) and {d for d in found if d is not None} == named - {None}


def test_one_of_each_tells_rows_of_one_doc_id_apart(spark):
    other = "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, "one two three four five six seven"), (1, other), (2, other), (None, "x y z"), (None, "q r s t u"), (3, "q r s t u"), (None, None), (4, "same"), (4, "same")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in [(1, rows[0][1]), (1, other), (3, "q r s t u"), (4, "same"), (None, "x y z"), (None, None)])


@pytest.mark.parametrize("small_keys", [2, 64])
def test_simhash_links_large_and_small_keys(spark, small_keys):
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 2**62, 6)]
    values = {c ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centres for _ in range(40)}
    prints = sorted((k, v) for k, v in enumerate(values))
    fps = spark.createDataFrame([(v,) for _, v in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps, small_keys)).collect()}
    want = plain_components([(v, v) for _, v in prints])
    assert [roots.get(v, v) for _, v in prints] == want


def test_stars_gather_the_ends_once(spark):
    edges = spark.createDataFrame([(5, k) for k in range(6, 900)] * 2 + [(5, 3), (2, 9)], "a long, b long")
    rows = simhash._stars(edges).collect()
    assert {r.m for r in rows if r.a == 5} == {3} and [(r.ends, r.m) for r in rows if r.a == 2] == [([9], 2)]
    assert sorted(b for r in rows if r.a == 5 for b in r.ends) == [3, *range(6, 900)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(roots[k] == 0 for k in range(1, 41)) and roots[101] == 100


def test_scoring(given):
    found = scoring.pseudo_likelihood(given)
    want = Counter((r.doc_id, len(WORDS.findall(r.text or ""))) for r in given.collect())
    assert both(given, found, "doc_id", "n_words") == want
    for r in found.collect():
        assert (r.mean_log_prob is None) == (r.n_words == 0) and r.log_prob <= 0


def plain_scores(texts, model, counts):
    """Sum over the words of log P(class | two words on either side) + log P(word | class), word by word."""
    network = scoring.WindowNetwork(model.flat.astype(np.float64))
    heads = set(model.heads.tolist())
    tails = [1] * scoring.TAIL
    for w, n in counts.items():
        if w not in heads:
            tails[(w >> 40) % scoring.TAIL] += n + 1
    out = []
    for text in texts:
        words = scoring.word_numbers(text).tolist()
        inputs = [scoring.INPUTS] * 2 + [(w >> 20) % scoring.INPUTS for w in words] + [scoring.INPUTS] * 2
        total = 0.0
        for i, w in enumerate(words):
            hidden = np.tanh(sum(network.embed[k][inputs[i + 2 + p]] for k, p in enumerate(scoring.PLACES)) + network.bias)
            logits = hidden @ network.out + network.out_bias
            kind = sorted(heads).index(w) if w in heads else len(heads) + (w >> 40) % scoring.TAIL
            total += logits[kind] - np.log(np.exp(logits).sum()) + (0 if w in heads else np.log((counts.get(w, 0) + 1) / tails[(w >> 40) % scoring.TAIL]))
        out.append(total)
    return out


@pytest.fixture(scope="module")
def scored_corpus(spark, docs):
    from prismloom.llm.common import materialize

    chunks = materialize(scoring.chunk_records(docs.where("doc_id % 5 > 0")), "t-chunks")
    counts = materialize(scoring.word_counts(chunks), "t-counts")
    return chunks, counts, {r.word % 2**64: r.n for r in counts.collect()}, scoring.fit(chunks, counts)


def test_scoring_equals_a_plain_version(spark, docs, scored_corpus):
    chunks, counts, plain_counts, model = scored_corpus
    asked = docs.where("doc_id % 5 = 0 and length(text) < 3000")
    rows = asked.collect()
    found = {r.doc_id: r.log_prob for r in scoring.score(scoring.chunk_records(asked), model, counts).collect()}
    want = plain_scores([r.text for r in rows], model, plain_counts)
    assert rows and [found[r.doc_id] for r in rows] == pytest.approx(want, rel=1e-4, abs=1e-2)


def test_scoring_beats_words_alone_on_held_out_text(docs, scored_corpus):
    chunks, counts, plain_counts, model = scored_corpus
    asked = scoring.chunk_records(docs.where("doc_id % 5 = 0"))
    total = lambda m: scoring.score(asked, m, counts).agg({"log_prob": "sum"}).first()[0]
    assert total(model) > total(scoring.untrained(counts))  # untrained, it is the model of words without their neighbours


def test_scoring_hardly_depends_on_tasks(docs):
    means = []
    for tasks in (1, 8):
        r = scoring.pseudo_likelihood(docs.repartition(tasks)).agg({"log_prob": "sum", "n_words": "sum"}).first()
        means.append(r["sum(log_prob)"] / r["sum(n_words)"])
    assert abs(means[0] - means[1]) < 0.15


def test_scoring_gradient():
    words, places = np.unique(scoring.word_numbers("a b c d e f the of the a b"), return_inverse=True)
    model = scoring.Model(words[:3], scoring.WindowNetwork.start(np.ones(3 + scoring.TAIL)))
    network = scoring.WindowNetwork(model.flat)
    network.flat = network.flat.astype(np.float64)
    network.flat[-len(model.heads) - scoring.TAIL * (scoring.WIDTH + 1) :] += np.random.default_rng(1).normal(0, 0.1, len(model.heads) + scoring.TAIL * (scoring.WIDTH + 1))
    network.embed, network.bias, network.out, network.out_bias = network.parts(network.flat)
    inputs, classes, at = model.layout(words, places, np.array([4, 0, 7]))
    grad = network.gradient(inputs, classes, at)
    for k in np.random.default_rng(0).choice(np.flatnonzero(grad), 8):
        own, step = network.flat[k], 1e-4
        network.flat[k] = own + step
        up = -network.log_p(inputs, classes, at).mean()
        network.flat[k] = own - step
        down = -network.log_p(inputs, classes, at).mean()
        network.flat[k] = own
        assert grad[k] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_scoring_tells_rare_words_from_frequent_ones(spark):
    """Words of one hash class: a frequent word scores above a rare one, a rare one above one never seen, as the counts say."""
    kind = lambda w: int(scoring.word_numbers(w)[0] >> np.uint64(40)) % scoring.TAIL
    often, rare, never = [w for w in (f"w{k}" for k in range(2000)) if kind(w) == kind("w0")][:3]
    corpus = scoring.chunk_records(spark.createDataFrame([(k, often) for k in range(60)] + [(60, rare), (61, None)], "doc_id long, text string").repartition(3))
    counts = scoring.word_counts(corpus)
    model = scoring.untrained(counts, 0)
    asked = scoring.chunk_records(spark.createDataFrame([(0, often), (1, rare), (2, never)], "doc_id long, text string"))
    found = {r.doc_id: r.log_prob for r in scoring.score(asked, model, counts).collect()}
    same = found[0] - np.log(61 / 64)
    assert found == pytest.approx({k: same + np.log(n / 64) for k, n in enumerate((61, 2, 1))}, abs=1e-6)  # 61 words, one more of 2, 1 for the rest
    head = scoring.untrained(counts)
    own = {r.doc_id: r.log_prob for r in scoring.score(corpus, head, counts).collect()}
    assert len(head.heads) == 2 and own[0] == own[59] > own[60] and own[61] == 0
