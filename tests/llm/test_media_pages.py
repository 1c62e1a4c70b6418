import html
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismloom.llm import media, pages
from prismloom.llm.common import table


def noise(seed, seconds=6):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.uniform(-0.4, 0.4, seconds * 16), 1).tolist()


def test_recordings_align_with_their_offset(spark):
    tune = noise(1, 8)
    whole = media.read_wav(media.tune(tune))[0]
    cut = media.write_wav(whole[20 * media.HOP :])
    noisy = media.write_wav(whole + np.random.default_rng(2).normal(0, 0.01, len(whole)))
    rows = [(50, cut), (100, media.tune(noise(9))), (1, media.tune(tune)), (2, media.tune(tune)), (3, noisy), (4, None), (5, b"no wav"), (6, media.write_wav(np.zeros(10))), (150, None), (None, noisy)]
    found = {r.rec_id: r for r in media.align(spark.createDataFrame(rows, "rec_id long, media binary")).collect()}
    assert len(found) == len(rows)
    assert found[50].match_id in (1, 3) and found[50].match_offset == 20 and found[50].bit_error < 0.1 and found[50].n_links == 2
    assert found[100].n_links == 0 and found[100].match_id is None
    assert found[2].class_id == 1 and found[1].n_links is None
    assert found[4].class_id == found[5].class_id == found[6].class_id == 4 and found[150].n_links == 0


def test_recordings_long_silent_and_clashing(spark):
    """A long recording that holds a query's tune, silences of different lengths, ties of matches, columns named like the operator's own."""
    tune = noise(1, 8)
    part = media.read_wav(media.tune(tune))[0]
    long = np.concatenate([media.read_wav(media.tune(noise(k, 60)))[0] for k in range(20, 24)] + [np.zeros(50 * media.HOP, np.float32), part])
    quiet = [media.write_wav(np.zeros(n * media.HOP)) for n in (60, 61, 62)]
    rows = [(50, media.write_wav(part)), (7, media.write_wav(long)), (100, quiet[0]), (8, quiet[1]), (9, quiet[2]), (3, media.write_wav(part * 0.5)), (2, media.write_wav(part * 0.25))]
    frame = spark.createDataFrame([(*r, 1, [1], "x", 2) for r in rows], "rec_id long, media binary, class_id long, items array<long>, digest string, offset int")
    found = {r.rec_id: r for r in media.align(frame).collect()}
    assert found[50].n_links >= 1 and found[50].match_id in (2, 3, 7)
    assert found[7].n_items > 3000 and found[100].n_links == 0 and found[8].n_links is None
    prints = {k: media.fingerprint(m) for k, m in rows if k in (2, 3, 7)}
    errors = {k: min(np.bitwise_count(media.fingerprint(rows[0][1]) ^ x[o : o + found[50].n_items]).sum() for o in range(len(x) - found[50].n_items + 1)) for k, x in prints.items()}
    least = min(errors.values())
    assert found[50].match_id in [k for k, e in errors.items() if e == least]


def test_recordings_empty(spark):
    assert media.align(spark.createDataFrame([], "rec_id long, media binary")).count() == 0
    assert media.tune(None) is None and media.tune([1.0, None]) is None


def test_search_recall(spark):
    """Against all pairs: at least 0.9 of the links of queries, here near copies of a few tunes."""
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.125, (6, 64))
    vectors = [(k, (base[k % 6] + rng.normal(0, 0.012, 64)).tolist()) for k in range(300)]
    prints = {k: media.fingerprint(media.tune(v)) for k, v in vectors}
    errors = {(q, k): int(np.bitwise_count(prints[q] ^ prints[k]).sum()) for q in prints if q % 50 == 0 for k in prints if k != q}
    want = {pair for pair, e in errors.items() if e <= media.MAX_BIT_ERROR * 32 * len(prints[pair[0]])}
    recordings = media.vector_recordings(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    rows = media.align(recordings).collect()
    found = sum(r.n_links or 0 for r in rows)
    assert want and found >= 0.9 * len(want)
    for r in rows:  # what is found is right: the bits that differ at offset 0, and a match among the closest that were found
        if r.match_id is not None and r.match_offset == 0:
            assert r.bit_error == pytest.approx(errors[r.rec_id, r.match_id] / (32 * r.n_items))


PAGE = """<html><body><header>Top</header><nav>Home</nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>T &amp; x</h1></header>
<p>One<br>two &nbsp; three<p>Four <b>five</b><ul><li>a<li>b</ul><section id="comments"><p>c1</p></section><aside>side</aside><div class="ad-slot"><div>x</div>y</div>
<form>f<input></form><script>var a = "<p>no</p>";</script></article></main><footer>ft</footer></body>"""


def test_article_of_a_page():
    assert pages.main_texts([pages.page_blocks(PAGE)]) == [("T & x\n\nOne two three\n\nFour five\n\na\n\nb", 0)]


def test_pages_table(spark, small):
    given = table(spark, small, "pages")
    found = {r.page_id: r for r in pages.extract(given).collect()}
    for r in given.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(x for x in parts if x)
        assert (found[r.page_id].url, found[r.page_id].text, found[r.page_id].n_chars) == (r.url, want, len(want))


def test_repeats_across_pages_of_a_host(spark):
    chrome = "<div>all rights reserved by the owner of this site</div>"
    rows = [(k, f"http://a.com/{k}", f"<body><div>only page {k} says this here {k}</div>{chrome}</body>", "x") for k in range(3)]
    rows += [(7, "http://b.com/", f"<body>{chrome}</body>", "x"), (8, None, None, None), (9, "http://[", "", None), (10, "http://c.com", "<p>twice five words here now</p><p>twice five words here now</p>", "x")]
    frame = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, blocks string, shard long, host string")
    found = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert [found[k] for k in range(3)] == [f"only page {k} says this here {k}" for k in range(3)]
    assert found[7] == "all rights reserved by the owner of this site" and found[8] == found[9] == ""
    assert found[10] == "twice five words here now\n\ntwice five words here now"
    assert pages.extract(frame.where("false")).count() == 0


def test_common_phrases_and_copies_stay(spark):
    """Five words that two pages share and pages published twice stay; blocks on most distinct pages go, inside articles too."""
    plain = [(k, f"http://a.com/{k}", f"<p>page {k} tells that on the other hand of course it rains in {k}</p><p>Share this</p>") for k in range(4)]
    article = [(10 + k, f"http://b.com/{k}", f"<article><p>story number {k // 2}</p><p>Read more here</p></article><p>ad {k}</p>") for k in range(8)]
    copies = [(20 + k, f"http://c.com/{k}", f"<article><p>the same story</p></article><p>ad {k}</p>") for k in range(4)]
    frame = spark.createDataFrame(plain + article + copies + [(30, "http://d.com", "<p>the one page of d</p>")] * 2, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert [found[k] for k in range(4)] == [f"page {k} tells that on the other hand of course it rains in {k}" for k in range(4)]
    assert [found[10 + k] for k in range(8)] == [f"story number {k // 2}" for k in range(8)]
    assert {found[20 + k] for k in range(4)} == {"the same story"} and found[30] == "the one page of d"


def plain_covered(streams, kinds, least):
    """Which tokens lie in a window of RUN tokens that stands in so many distinct pages, by comparing all windows."""
    where: dict = {}
    for k, x in enumerate(streams):
        for i in range(len(x) - pages.RUN + 1):
            where.setdefault(tuple(x[i : i + pages.RUN]), set()).add(kinds[k])
    return [[any(len(where[tuple(x[i : i + pages.RUN])]) >= least for i in range(max(0, p - pages.RUN + 1), min(p, len(x) - pages.RUN) + 1)) for p in range(len(x))] for x in streams]


def test_suffix_array_equals_all_windows():
    rng = np.random.default_rng(3)
    run = [f"r{k}" for k in range(45)]
    streams = []
    for k in range(12):
        own = [f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 90))]
        at = int(rng.integers(0, len(own) + 1))
        streams.append(own[:at] + (run[: int(rng.integers(25, 46))] if k % 3 else []) + own[at:])
    kinds = np.array([k % 10 for k in range(12)])
    for least in (2, 3, 5):
        assert [x.tolist() for x in pages.repeated_runs(streams, kinds, least)] == plain_covered(streams, kinds, least)
    assert [x.tolist() for x in pages.repeated_runs([[], ["a"]], np.array([0, 1]), 1)] == [[], [False]]


def test_repeated_runs_decide_inside_articles(spark):
    """A passage of a host inside its articles goes and what is around it in the same block stays, in shards of a hot host too; a long page is read whole."""
    passage = " ".join(f"terms{k}" for k in range(40))
    own = lambda k: " ".join(f"p{k}w{i}" for i in range(60))
    rows = [(k, "http://www.hot.com/x", f"<article><p>{own(k)} {passage} end{k}</p></article><footer>f</footer>") for k in range(120)]
    rows += [(200 + k, f"http://small.com:80/{k}", f"<div>{own(k)} {passage}</div>") for k in range(2)]
    rows += [(300, "https://long.com", "<p>" + " ".join(f"w{i}" for i in range(300_000)) + "</p>"), (301, None, "<p>one</p>"), (301, None, "<p>one</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (pages.SHARD, 20_000):
        found = pages.extract(frame, shard).collect()
        text = {r.page_id: r.text for r in found}
        assert len(found) == len(rows) and all(text[k] == f"{own(k)} end{k}" for k in range(120))
        assert text[200] == f"{own(0)} {passage}" and text[301] == "one" and len(text[300].split()) == 300_000
        assert {r.n_repeated for r in found if r.page_id < 120} == {40}


def test_a_hosts_size_does_not_decide(spark):
    """What half of a host's pages say, and less than half, is decided alike however the host is dealt; copies get one text."""
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = []
    for k in range(60):
        often = words("often", 40) if k % 2 else words(f"own{k}x", 40)
        seldom = words("seldom", 35) if k % 9 < 4 else words(f"else{k}x", 35)
        rows.append((k, f"http://a.com/{k}", f"<article><p>{words(f'p{k}w', 20)} {often} end{k}</p><p>{seldom}</p>{'<p>read more</p>' * (k % 2)}</article>"))
    rows += [(100 + k, "http://a.com/copy", f"<article><p>copied {words('c', 50)}</p></article><footer>{words('f', 40)} {k}</footer>") for k in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [sorted(map(tuple, pages.extract(frame, shard).collect())) for shard in (pages.SHARD, 5_000, 900)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert all(words("seldom", 35) in x[2] for x in found[0] if x[0] < 60 and x[0] % 9 < 4)


def test_pages_are_stored_once_and_not_shuffled(spark, monkeypatch):
    """What a host's pages share is found, however it is dealt, without the pages' texts being written or shuffled again."""
    stored = {}
    materialize = pages.materialize
    monkeypatch.setattr(pages, "materialize", lambda df, name, *more: stored.setdefault(name, materialize(df, name, *more)))
    size = lambda df: sum(Path(f.removeprefix("file:")).stat().st_size for f in df.inputFiles())
    rng = np.random.default_rng(7)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 400)) for _ in range(300)]
    rows = [(k, f"http://{'hot' if k % 3 else 'other'}.com/{k}", f"<article><p>{text}</p></article><p>about us</p>") for k, text in enumerate(own)]
    found = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 50_000)
    assert {r.page_id: r.text for r in found.collect()} == dict(enumerate(own))
    assert sum(size(x) for name, x in stored.items() if name != "op10-parsed") < 0.1 * size(stored["op10-parsed"])
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_equal_each_host_at_once(spark, seed):
    """Copies among different menus, passages in articles and outside: as main_texts of each class's first page."""
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 300, n))
    rows = []
    for name, n in (("a", 60), ("b", 7), ("c", 3), ("d", 2)):
        shared, menus, articles = [words(25), words(33), words(60)], [words(20), words(45)], []
        for k in range(n):
            if k % 3 < 2:
                own = [words(int(rng.integers(3, 60))), *(f"{words(2)} {x} {words(2)}" if rng.random() < 0.3 else x for x in shared if rng.random() < 0.6)]
                articles.append("".join(f"<p>{own[i]}</p>" for i in rng.permutation(len(own))))
            copied = articles[int(rng.integers(len(articles)))] if k % 3 == 2 else articles[-1]
            rows.append((len(rows), f"http://{name}.com/{k}", f"<nav>{menus[k % 2]}</nav><article>{copied}</article><footer>{(*menus, *shared)[int(rng.integers(5))]}</footer>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    first: dict = {}
    for r in sorted(frame.withColumn("place", F.xxhash64("page_id", "url", "html")).collect(), key=lambda r: r.place):
        blocks = pages.kept_blocks(r.html)
        first.setdefault(r.url.split("/")[2], {}).setdefault(tuple(t for z, t in blocks if z > pages.NAMED), []).append((r.page_id, blocks))
    want = {k: text for classes in first.values() for members, text in zip(classes.values(), pages.main_texts([m[0][1] for m in classes.values()]), strict=True) for k, _ in members}
    assert any(n for _, n in want.values())
    for shard in (pages.SHARD, 2_000):
        assert {r.page_id: (r.text, r.n_repeated) for r in pages.extract(frame, shard).collect()} == want


def test_inline_parts_named_as_something_else():
    assert pages.page_blocks("<article><p>one <span class='ad'>buy</span> two</p></article>") == [(pages.ARTICLE, "one two"), (pages.NAMED, "buy")]


@pytest.mark.parametrize("mess", ["<div", "<p class='x>y", "<!-- open", "<script>never closed", "</p></div>", "<a " * 3000])
def test_broken_pages(mess):
    assert isinstance(pages.page_blocks(f"<p>before</p>{mess}"), list)


SENTENCES = " ".join(f"This is sentence {k} of the story." for k in range(30))


@pytest.mark.parametrize(
    "html",
    [
        f"<body><form><nav>Home News</nav><div class='content'><p>{SENTENCES}</p></div></form></body>",
        f"<body><nav>Home</nav><div class='layout no-sidebar has-comments'><article><p>{SENTENCES}</p></article></div></body>",
        f"<body><div class='sidebar'><article><p>{SENTENCES}</p></article></div><footer>End of page</footer></body>",
        f"<body><div class='content'><p>{SENTENCES}</p></div><nav><article>Read more about that other thing</article></nav></body>",
        f"<body><div id='with-menu'><p>{SENTENCES}</p></div><div class='comments'>first one</div></body>",
    ],
)
def test_pages_that_names_hid_keep_their_text(html):
    assert [t for z, t in pages.kept_blocks(html) if z == pages.OPEN] == [SENTENCES]


def test_teasers_do_not_replace_the_page():
    html = f"<body><div class='content'><p>{SENTENCES}</p></div><ul><li><article>Read more about it</article></li></ul></body>"
    assert [t for z, t in pages.kept_blocks(html) if z == pages.OPEN] == [SENTENCES, "Read more about it"]


def test_text_of_main_before_its_article_stays():
    html = f"<body><header>Site</header><main><h1>Title of it</h1><article><p>{SENTENCES}</p></article></main><div>other words</div></body>"
    assert [t for z, t in pages.kept_blocks(html) if z == pages.OPEN] == ["Title of it", SENTENCES]


def test_comments_longer_than_the_article_stay_out():
    html = f"<body><article><p>{SENTENCES}</p></article><div class='comments'>{'I liked that a lot. ' * 200}</div></body>"
    assert [t for z, t in pages.kept_blocks(html) if z == pages.OPEN] == [SENTENCES]


def wav(samples, rate, width, channels=1):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        scaled = np.repeat(np.clip(samples, -1, 1), channels)
        if width == 1:
            f.writeframes(((scaled + 1) * 127.5).astype(np.uint8).tobytes())
        else:
            whole = (scaled * (2 ** (8 * width - 1) - 1)).astype("<i4")
            f.writeframes(whole.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return out.getvalue()


def tune(rate, seconds=12):
    at = np.arange(int(rate * seconds)) / rate
    notes = np.array([220, 330, 262, 440, 294, 392, 349, 247, 523, 587, 311, 370])[(at * 1.7).astype(int) % 12]
    return 0.5 * np.sin(2 * np.pi * np.cumsum(notes) / rate)


@pytest.mark.parametrize(("rate", "width", "channels"), [(4096, 1, 1), (4096, 3, 2), (4096, 4, 1), (8000, 2, 1), (44_100, 2, 2), (48_000, 4, 1), (22_050, 3, 1)])
def test_recordings_of_any_rate_and_width_sound_alike(rate, width, channels):
    want = media.fingerprint(wav(tune(media.RATE), media.RATE, 2))
    found = media.fingerprint(wav(tune(rate), rate, width, channels))
    assert abs(len(found) - len(want)) <= 1
    n = min(len(found), len(want))
    assert np.bitwise_count(found[:n] ^ want[:n]).sum() / (32 * n) < 0.1


def test_broken_headers_have_no_integers():
    good = bytearray(wav(tune(media.RATE, 3), media.RATE, 2))
    for at, value in ((24, b"\0\0\0\0"), (22, b"\0\0"), (34, b"\0\0"), (34, b"\x28\0"), (20, b"\3\0"), (4, b"\xff\xff\xff\x7f"), (40, b"\xff\xff\xff\xff")):
        broken = bytes(good[:at] + value + good[at + len(value) :])
        assert len(media.fingerprint(broken)) in (0, len(media.fingerprint(bytes(good))))
    assert len(media.fingerprint(bytes(good[:44]))) == 0 == len(media.fingerprint(bytes(good[:30]))) == len(media.fingerprint(b"RIFF"))
    assert len(media.fingerprint(bytes(good[:24] + b"\0\0\0\0" + good[28:]))) == 0
