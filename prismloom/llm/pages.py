"""Main text of web pages: page structure, and a suffix array of each host's pages against boilerplate.

Each page becomes blocks in page order, and each block lies in the article (article or main), in parts that are named as
something else (navigation, footers, adverts, forms, comments and the like) or in neither. A name doesn't count where it
says what others have or lack ("no-sidebar"), nor does a name or a form that wraps most of the page. What may be kept is
the article, or without one, or beside mere teasers, the blocks in neither.

Pages of a host are one class if what may be kept of them is equal, and a class counts as its first page by hash, so copies
count once and get one text. Equal runs of RUN tokens are found by sorting suffixes of the pages' token streams, all blocks
in page order, by their first RUN tokens (prefix doubling, a separator of its own after each piece). A run that stands on at
least MIN_PAGES and SHARE of the host's classes is boilerplate: whatever such runs cover is removed, inside the article too,
and so are whole blocks, also shorter ones, that repeat alike. Unique runs stay.

Pages are parsed once, stored once and not shuffled for this; the way is one for hosts of all sizes. Of each run of RUN
tokens the ANCHOR neighbours with the smallest hash are its anchor, so equal runs have equal anchors. Anchors and kept
blocks fall into MARKS numbers, and a host's pages are counted by number: a number that too few of them have holds no
boilerplate. Only what lies in runs of the remaining numbers (mostly boilerplate, on most hosts nothing) goes to the suffix
arrays. They count in shards of a host, of about SHARD characters each, on how many of its classes each run stands, by
128-bit hash, and the sums decide. Each page is then cut by its host's boilerplate; where pages of a class surround what
they share with different parts, so that other runs may cover it, what the class's first page loses is looked up. What is
looked up is broadcast up to LOOKED_UP bytes; if it is larger, the pages may be shuffled, with the same result. Which hosts
are dealt is broadcast: only those with more than 1 / MOST_HOSTS of all that the arrays get, at most MOST_HOSTS.

Defined results: a null, empty or textless page gives an empty text; a null url is a host of its own; a <br> is white
space; repeated rows give a row each; very long pages are read whole; an empty table gives no rows; pages that tie in
their hash go by their blocks. Columns but page_id, url and html are not read,
so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, materialize, row_chunks

RUN, MIN_PAGES, SHARE = 30, 3, 0.5
SHARD = 4_000_000
ANCHOR, MARKS = 6, 4096
MOST_HOSTS = 100_000
#: Bytes up to which what pages look up is broadcast, whatever Spark's own threshold.
LOOKED_UP = 16_000_000
ARTICLE, MAIN, OPEN, NAMED = 3, 2, 1, 0

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED_TAGS = frozenset("aside button canvas dialog footer form head iframe menu nav noscript object script search select style svg template textarea title".split())
SILENT_TAGS = frozenset("canvas head iframe noscript object script style svg template title".split())
NAMED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMED_CLASSES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|alerts?|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|disqus|footer|gdpr|menu|modal|nav|navbar|navigation|newsletter|notices?|notification"
    r"|pagination|popup|promo\w*|recommended|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
HEADER_CLASSES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.IGNORECASE)
#: Names of parts that others have or lack: they say nothing of the part that bears them.
ABOUT_OTHERS = re.compile(r"(?:^|(?<=\s))(?:no|non|not|without|has|have|with|hide|hides)[-_]\S*", re.IGNORECASE)
#: A named part with more than this share of a page's words is the page, or holds it: beside an article, and where there is none.
WRAPS, WRAPS_ALL = 0.5, 0.8
#: An article counts for less than the rest of the page that has no name if that has so many times its words.
TEASER = 3
CLOSED_BY_SIBLING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class _Open(NamedTuple):
    """An open element: its tag and zone, whether text in it isn't shown or lies in an article or main, and by number the open elements named as something else: all, and those with an article or main around this."""

    tag: str
    zone: int
    silent: bool
    in_article: bool
    named: tuple[int, ...]
    around_article: tuple[int, ...]


_OUTSIDE = _Open("", 1, False, False, (), ())


class _Blocks(HTMLParser):
    """Collects (zone, text) of each block. Elements are numbered as they open; those in `plain` aren't taken for something else."""

    def __init__(self, plain: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.plain = plain
        self.seen = 0
        self.open: list[_Open] = []
        self.blocks: list[tuple[int, str]] = []
        self.text: list[tuple[int, str]] = []
        self.words = self.in_article = 0
        self.of_named: dict[int, list[int]] = {}  # words of an element named as something else, and those in an article or main in it

    @property
    def zone(self) -> int:
        return self.open[-1].zone if self.open else OPEN

    def count(self, data: str) -> None:
        here = self.open[-1] if self.open else _OUTSIDE
        if here.silent or not (n := len(data.split())):
            return
        self.words += n
        self.in_article += n if here.in_article else 0
        for k in here.named:
            self.of_named[k][0] += n
        for k in here.around_article:
            self.of_named[k][1] += n

    def wrappers(self) -> frozenset[int]:
        """Elements that hold most of the page and most of it as an article, or nearly all of a page without one: their names say nothing."""
        return frozenset(k for k, (n, inside) in self.of_named.items() if n > WRAPS * self.words and (inside > WRAPS * n if self.in_article else n > WRAPS_ALL * self.words))

    def flush(self) -> None:
        if not self.text:
            return
        zone = max((z for z, _ in self.text), default=NAMED)  # inline parts may be named as something else
        for own in (zone, *([NAMED] if zone > NAMED else [])):
            if text := " ".join("".join(x for z, x in self.text if z == own or z > NAMED < own).split()):
                self.blocks.append((own, text))
        self.text = []

    def pop_to(self, names: set[str], stop: set[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in names:
                del self.open[k:]
                return
            if self.open[k].tag in stop:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
            self.pop_to({"p"}, BLOCKS - {"p"})
            if tag in CLOSED_BY_SIBLING:
                self.pop_to({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}, CLOSED_BY_SIBLING[tag])
        elif tag == "br":
            self.text.append((self.zone, " "))
        if tag in VOID:
            return
        self.seen += 1
        named = {k: v or "" for k, v in attrs}
        role, inside = named.get("role", "").lower(), self.zone
        classes = " ".join(ABOUT_OTHERS.sub("", named.get(c, "")) for c in ("class", "id"))
        hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
        by_name = tag == "form" or role in NAMED_ROLES or (tag not in ("html", "body") and bool(NAMED_CLASSES.search(classes)))
        by_name = by_name or inside < MAIN and tag not in ("html", "body") and bool(HEADER_CLASSES.search(classes))
        other = tag in NAMED_TAGS and tag != "form" or hidden or (inside < MAIN and tag == "header") or (by_name and self.seen not in self.plain)
        article = tag in ("article", "main") or role in ("article", "main")
        if inside == NAMED or other:
            zone = NAMED
        elif tag == "article" or role == "article":
            zone = ARTICLE
        elif article:
            zone = max(inside, MAIN)
        else:
            zone = inside
        above = self.open[-1] if self.open else _OUTSIDE
        named_here = above.named
        if by_name:
            self.of_named[self.seen] = [0, 0]
            named_here = (*named_here, self.seen)
        self.open.append(_Open(tag, zone, above.silent or tag in SILENT_TAGS, above.in_article or article, named_here, named_here if article else above.around_article))

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.text.append((self.zone, " "))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.pop_to({tag})
        else:
            self.pop_to({tag}, BLOCKS)

    def handle_data(self, data: str) -> None:
        self.text.append((self.zone, data))
        self.count(data)


def _parsed(html: str, plain: frozenset[int] = frozenset()) -> _Blocks:
    parser = _Blocks(plain)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def page_blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block."""
    parser = _parsed(html or "")
    if wrappers := parser.wrappers():
        parser = _parsed(html or "", wrappers)
    return parser.blocks


def kept_blocks(html: str | None) -> list[tuple[int, str]]:
    """page_blocks with but two zones: OPEN for what may be kept, NAMED for the rest.

    What may be kept is what lies in an article or main, unless the rest that isn't named as something else has over
    TEASER times its words, as beside teasers; then, and without an article, all that isn't named.
    """
    blocks = page_blocks(html)
    words = {z: sum(text.count(" ") + 1 for zone, text in blocks if zone == z) for z in (ARTICLE, MAIN, OPEN)}
    article = words[ARTICLE] + words[MAIN]
    least = MAIN if article and TEASER * article >= words[OPEN] else OPEN
    return [(OPEN if zone >= least else NAMED, text) for zone, text in blocks]


def host(url: Column) -> Column:
    """Lower-case host name of a url without www., empty where there is none."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    return F.regexp_replace(F.lower(name), r"^www\.", "")


Known = dict[str, int]


def hashes_of(tokens: list[str], known: Known, seed: int) -> np.ndarray:
    """64-bit hashes of tokens. known keeps them."""
    if len(known) > 200_000:
        known.clear()
    for t in tokens:
        if t not in known:
            known[t] = xxhash.xxh64_intdigest(t, seed)
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def rolled(hashes: np.ndarray, length: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each `length` neighbours."""
    out = np.zeros(max(len(hashes) - length + 1, 0), np.uint64)
    for k in range(length):
        out = out * np.uint64(factor) + hashes[k : k + len(out)]
    return out


def anchors(streams: list[list[str]], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of RUN tokens of the streams where it begins in its stream, the stream and the number of its anchor. known keeps hashes of tokens."""
    tokens = [t for x in streams for t in x]
    lengths = np.array([len(x) for x in streams], np.int64)
    ends = np.cumsum(lengths)
    if len(tokens) < RUN:
        return (np.zeros(0, np.int64),) * 3
    grams = rolled(hashes_of(tokens, known, 5), ANCHOR)
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    least, reach, width = grams, 1, RUN - ANCHOR + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    owner = np.repeat(np.arange(len(streams)), lengths)
    starts = np.flatnonzero(np.arange(len(least)) + RUN <= ends[owner[: len(least)]])
    owner = owner[starts]
    return starts - (ends - lengths)[owner], owner, (least[starts] % np.uint64(MARKS)).astype(np.int64)


def block_mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text, 6) % MARKS


def marks_of(pages: list[list[tuple[int, str]]], known: Known) -> list[bytes]:
    """The numbers that anchors and kept blocks of each page fall into, each once."""
    _, owner, mark = anchors([tokens_of(x) for x in pages], known)
    keys = owner * MARKS + mark
    keys = keys[np.diff(keys, prepend=-1) != 0]  # neighbours mostly share an anchor
    blocks = [k * MARKS + block_mark(text) for k, x in enumerate(pages) for zone, text in x if zone > NAMED]
    found = np.unique(np.concatenate([keys, np.array(blocks, np.int64)]))
    cuts = np.searchsorted(found, np.arange(len(pages) + 1) * MARKS).tolist()
    return [(found[a:b] % MARKS).astype(np.uint16).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


PARSED = "host string, kind binary, place long, page_id long, url string, packed string, marks binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' blocks, packed, in place of html, the hash of what may be kept, and the page's marks."""
    known: Known = {}
    for rows in row_chunks(batches, "html", 2_000_000):
        blocks = [kept_blocks(r["html"]) for r in rows]
        kinds = [hashlib.md5(json.dumps([text for zone, text in x if zone > NAMED]).encode()).digest() for x in blocks]
        packed = [json.dumps(x, ensure_ascii=False) for x in blocks]
        columns = [pa.array([r["host"] for r in rows], pa.string()), pa.array(kinds, pa.binary()), *[pa.array([r[c] for r in rows], pa.int64()) for c in ("place", "page_id")], pa.array([r["url"] for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.string()), pa.array(marks_of(blocks, known), pa.binary())], names=["host", "kind", "place", "page_id", "url", "packed", "marks"])


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host how many of the pages have each mark, in rows that others may add to."""
    counts: dict[str, np.ndarray] = {}

    def done() -> pa.RecordBatch:
        marks = [np.flatnonzero(x) for x in counts.values()]
        found = [x[k].astype(np.uint32).tobytes() for x, k in zip(counts.values(), marks, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([k.astype(np.uint16).tobytes() for k in marks], pa.binary()), pa.array(found, pa.binary())], names=["host", "marks", "n"])

    for rows in row_chunks(batches, "marks", 500_000):
        for r in rows:
            if r["host"] not in counts:
                if len(counts) >= 1000:
                    yield done()
                    counts.clear()
                counts[r["host"]] = np.zeros(MARKS, np.int64)
            counts[r["host"]][np.frombuffer(r["marks"], np.uint16)] += 1  # a page has a mark but once
    if counts:
        yield done()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _mark_counts, sorted by host: a row for each host with marks that enough of its pages have for a run of boilerplate."""
    host, classes, counts = None, 0, np.zeros(MARKS, np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        often = np.flatnonzero(counts >= max(MIN_PAGES, SHARE * classes)) if host is not None else []
        if len(often):
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([classes], pa.int64()), pa.array([often.astype(np.uint16).tobytes()], pa.binary())], names=["host", "classes", "wanted"])

    for rows in row_chunks(batches, "marks", 500_000):
        for r in rows:
            if r["host"] != host:
                yield from done()
                host, classes, counts = r["host"], r["classes"], np.zeros(MARKS, np.int64)
            counts[np.frombuffer(r["marks"], np.uint16)] += np.frombuffer(r["n"], np.uint32)
    yield from done()


def kept_places(blocks: list[tuple[int, str]]) -> np.ndarray:
    """For each token its place among the page's tokens that may be kept, -1 for others."""
    kept = np.repeat([zone > NAMED for zone, _ in blocks], [text.count(" ") + 1 for _, text in blocks]) if blocks else np.zeros(0, bool)
    return np.where(kept, np.cumsum(kept) - 1, -1)


def pieces_of(blocks: list[tuple[int, str]], starts: np.ndarray, wanted: np.ndarray) -> str:
    """What runs from the starts cover, as stretches of tokens with their kept_places in runs of neighbours, and the kept blocks that have a wanted mark."""
    tokens, kept = tokens_of(blocks), kept_places(blocks)
    edges = np.flatnonzero(np.diff(covered(starts, len(tokens)), prepend=False, append=False)).reshape(-1, 2).tolist()
    stretches = []
    for a, b in edges:
        own = kept[a:b]
        breaks = [0, *(np.flatnonzero(np.diff(own) != (own[:-1] >= 0)) + 1).tolist(), b - a]
        stretches.append([" ".join(tokens[a:b]), [[int(own[i]), j - i] for i, j in zip(breaks, breaks[1:], strict=False)]])
    return json.dumps([stretches, sorted({block_id(text).hex() for zone, text in blocks if zone > NAMED and wanted[block_mark(text)]})], ensure_ascii=False)


def stretches_of(pieces: list) -> list[tuple[list[str], np.ndarray]]:
    """Tokens and kept_places of each stretch of pieces_of."""
    return [(text.split(" "), np.concatenate([np.arange(at, at + n) if at >= 0 else np.full(n, -1) for at, n in runs])) for text, runs in pieces[0]]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' pieces, given the marks that are wanted."""
    known: Known = {}
    for rows in row_chunks(batches, "packed", 500_000):
        blocks = [json.loads(r["packed"]) for r in rows]
        wanted = np.zeros((len(rows), MARKS), bool)
        for k, r in enumerate(rows):
            wanted[k, np.frombuffer(r["wanted"], np.uint16)] = True
        starts, owner, mark = anchors([tokens_of(x) for x in blocks], known)
        hits = wanted[owner, mark]
        starts, cuts = starts[hits], np.searchsorted(owner[hits], np.arange(len(rows) + 1)).tolist()
        pieces = [pieces_of(x, starts[cuts[k] : cuts[k + 1]], wanted[k]) for k, x in enumerate(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array([r["host"] for r in rows], pa.string()), pa.array([r["kind"] for r in rows], pa.binary()), pa.array([r["place"] for r in rows], pa.int64()), pa.array(pieces, pa.string())], names=["host", "kind", "place", "pieces"])


def suffix_ranks(stream: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of the stream its rank by the first `length` numbers, equal for equal ones; prefix doubling."""
    ranks, reach = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    while reach < length:
        step = min(reach, length - reach)  # the second half may overlap the first
        ahead = np.full(len(ranks), -1, np.int64)
        ahead[: max(len(ranks) - step, 0)] = ranks[step:]
        ranks = np.unique(ranks * (len(ranks) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        reach += step
    return ranks


class Runs(NamedTuple):
    """Where in the streams, laid end to end with a separator after each, runs of RUN tokens begin, their ranks, equal for equal ones, on how many distinct ones each rank stands, and the stream of each token and end of each stream."""

    starts: np.ndarray
    ranks: np.ndarray
    holders: np.ndarray
    owner: np.ndarray
    ends: np.ndarray


def sorted_runs(streams: list[list[str]], distinct: np.ndarray) -> Runs:
    numbers: dict[str, int] = {}
    flat: list[int] = []
    for k, stream in enumerate(streams):
        flat += [numbers.setdefault(t, len(numbers)) for t in stream]
        flat.append(-1 - k)
    owner = np.repeat(np.arange(len(streams)), [len(x) + 1 for x in streams])
    ends = np.cumsum([len(x) + 1 for x in streams])
    starts = np.flatnonzero(np.arange(len(flat)) + RUN < ends[owner]) if flat else np.zeros(0, np.int64)
    if not len(starts):
        return Runs(starts, starts, starts, owner, ends)
    ranks = suffix_ranks(np.array(flat, np.int64), RUN)[starts]
    kinds = np.unique(ranks * (int(distinct.max()) + 1) + distinct[owner[starts]]) // (int(distinct.max()) + 1)
    return Runs(starts, ranks, np.bincount(kinds, minlength=int(ranks.max()) + 1), owner, ends)


def run_starts(streams: list[list[str]], distinct: np.ndarray, least: float) -> list[np.ndarray]:
    """For each stream where in it runs of RUN tokens begin that stand in at least so many distinct ones."""
    runs = sorted_runs(streams, distinct)
    if not len(runs.starts):
        return [runs.starts for _ in streams]
    hits = runs.starts[runs.holders[runs.ranks] >= least]
    cuts = np.searchsorted(hits, runs.ends).tolist()
    return [hits[a:b] - (e - len(x) - 1) for a, b, e, x in zip([0, *cuts], cuts, runs.ends.tolist(), streams, strict=False)]


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Which of so many tokens lie in a run that begins at one of the starts."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + RUN, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_runs(streams: list[list[str]], distinct: np.ndarray, least: float) -> list[np.ndarray]:
    """For each stream which of its tokens lie in a run of RUN that stands in at least so many distinct ones."""
    return [covered(s, len(x)) for s, x in zip(run_starts(streams, distinct, least), streams, strict=True)]


def tokens_of(blocks: list[tuple[int, str]]) -> list[str]:
    return [t for _, text in blocks for t in text.split(" ")]


def holders(pages: list[list[tuple[int, str]]]) -> Counter:
    """On how many of the pages each block stands that may be kept."""
    return Counter(text for blocks in pages for text in {text for zone, text in blocks if zone > NAMED})


def without(blocks: list[tuple[int, str]], gone: np.ndarray, repeated: Callable[[str], bool]) -> tuple[str, int]:
    """A page's text without the tokens that are gone and the blocks that are repeated, and how many tokens that were."""
    texts, at, removed = [], 0, 0
    for zone, text in blocks:
        tokens = text.split(" ")
        cut = gone[at : at + len(tokens)]
        at += len(tokens)
        if zone == NAMED:
            continue
        if repeated(text):
            removed += len(tokens)
        elif cut.any():
            removed += int(cut.sum())
            texts.append(" ".join(t for t, x in zip(tokens, cut.tolist(), strict=True) if not x))
        else:
            texts.append(text)
    return "\n\n".join(x for x in texts if x), removed


def main_texts(pages: list[list[tuple[int, str]]]) -> list[tuple[str, int]]:
    """The main text of each class of a host, given as its first page's blocks, and how many tokens of it were boilerplate."""
    least = max(MIN_PAGES, SHARE * len(pages))
    held = holders(pages)
    gone = repeated_runs([tokens_of(x) for x in pages], np.arange(len(pages)), least)
    return [without(x, g, lambda text: held[text] >= least) for x, g in zip(pages, gone, strict=True)]


def run_ids(tokens: list[str], known: tuple[Known, Known]) -> np.ndarray:
    """Two 64-bit hashes of each run of RUN tokens."""
    return np.stack([rolled(hashes_of(tokens, known[0], 1), RUN), rolled(hashes_of(tokens, known[1], 2), RUN, 0xD6E8FEB86659FD93)], axis=1)


def block_id(text: str) -> bytes:
    return np.array([xxhash.xxh64_intdigest(text, 3), xxhash.xxh64_intdigest(text, 4)], np.uint64).tobytes()


def found_starts(tokens: list[str], wanted: set[bytes], known: tuple[Known, Known]) -> np.ndarray:
    """Where wanted runs begin."""
    return np.array([k for k, x in enumerate(run_ids(tokens, known)) if x.tobytes() in wanted], np.int64)


def _halves(wanted: set[bytes]) -> np.ndarray:
    """The first hashes of wanted runs, among those of blocks."""
    return np.frombuffer(b"".join(wanted), np.uint64)[::2]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes' pieces sorted by host and shard: on how many of a shard's classes each run and block stands, and whether a part that may be kept is in it."""
    held: list[list] = []
    key: tuple = ()

    def done() -> pa.RecordBatch:
        stretches = [(k, *x) for k, page in enumerate(held) for x in stretches_of(page)]
        streams = [tokens for _, tokens, _ in stretches]
        runs, known, ids, counts, kept = sorted_runs(streams, np.array([k for k, _, _ in stretches], np.int64)), ({}, {}), [], [], []
        if len(runs.starts):
            ranks, first = np.unique(runs.ranks, return_index=True)
            may = np.cumsum(np.concatenate([np.append(places >= 0, False) for _, _, places in stretches]))
            touches = may[runs.starts + RUN - 1] > np.where(runs.starts > 0, may[runs.starts - 1], 0)
            counts, kept = runs.holders[ranks].tolist(), (np.bincount(runs.ranks, touches)[ranks] > 0).tolist()
            at = runs.starts[first]
            order = np.argsort(at)
            cuts, found = np.searchsorted(at[order], runs.ends).tolist(), [b""] * len(at)
            for x, end, a, b in zip(streams, runs.ends.tolist(), [0, *cuts], cuts, strict=False):
                if a < b:
                    own = run_ids(x, known)
                    for k in order[a:b].tolist():
                        found[k] = own[at[k] - (end - len(x) - 1)].tobytes()
            ids = found
        blocks = Counter(x for page in held for x in page[1])
        columns = [[key[0]] * (len(ids) + len(blocks)), [*ids, *map(bytes.fromhex, blocks)], [*counts, *blocks.values()], [*kept, *[True] * len(blocks)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["host", "id", "n", "kept"])

    for rows in row_chunks(batches, "pieces", 500_000):
        for r in rows:
            if held and (r["host"], r["shard"]) != key:
                yield done()
                held = []
            key = r["host"], r["shard"]
            held.append(json.loads(r["pieces"]))
    if held:
        yield done()


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the tokens of a class that may be kept its first page's pieces lose to the host's boilerplate, by kept_places."""
    known: tuple[Known, Known] = {}, {}
    for rows in row_chunks(batches, "pieces", 500_000):
        lost = []
        for r in rows:
            wanted = set(r["ids"])
            gone = [np.zeros(0, np.int64)]
            for tokens, places in stretches_of(json.loads(r["pieces"])):
                gone.append(places[covered(found_starts(tokens, wanted, known), len(tokens)) & (places >= 0)])
            lost.append(np.concatenate(gone).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([r["host"] for r in rows], pa.string()), pa.array([r["kind"] for r in rows], pa.binary()), pa.array(lost, pa.binary())], names=["host", "kind", "lost"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page, given its host's boilerplate and, where its class has it, what the class loses."""
    known: tuple[Known, Known] = {}, {}
    of_host: dict[str, tuple[set[bytes], np.ndarray]] = {}
    for rows in row_chunks(batches, "packed", 500_000):
        if len(of_host) > 10_000:
            of_host.clear()
        pages = [json.loads(r["packed"]) for r in rows]
        streams = [tokens_of(x) if r["ids"] else [] for r, x in zip(rows, pages, strict=True)]
        for r in rows:
            if r["ids"] and r["host"] not in of_host:
                of_host[r["host"]] = (ids := set(r["ids"])), _halves(ids)
        ends = np.cumsum([len(x) for x in streams])
        maybe = np.zeros(0, np.int64)  # runs of any page that begin as wanted ones of any host do
        if ends[-1]:
            first = np.concatenate([of_host[h][1] for h in {r["host"] for r in rows if r["ids"]}])
            maybe = np.flatnonzero(np.isin(rolled(hashes_of([t for x in streams for t in x], known[0], 1), RUN), first))
        cuts = [0, *np.searchsorted(maybe, ends).tolist()]
        texts = []
        for k, (r, blocks, tokens) in enumerate(zip(rows, pages, streams, strict=True)):
            if not r["ids"]:
                texts.append(("\n\n".join(text for zone, text in blocks if zone > NAMED), 0))
                continue
            wanted, gone, at = of_host[r["host"]][0], np.zeros(len(tokens), bool), maybe[cuts[k] : cuts[k + 1]] - (int(ends[k]) - len(tokens))
            at = at[at + RUN <= len(tokens)]
            if r["lost"] is not None:
                gone[np.flatnonzero(kept_places(blocks) >= 0)[np.frombuffer(r["lost"], np.int32)]] = True
            elif len(at):
                gone = covered(found_starts(tokens[at[0] : at[-1] + RUN], wanted, known) + at[0], len(tokens))
            texts.append(without(blocks, gone, lambda text, w=wanted: block_id(text) in w))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["page_id"] for r in rows], pa.int64()), pa.array([r["url"] for r in rows], pa.string()), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_repeated"],
        )


def _looked_up(stored: DataFrame, size: Column) -> DataFrame:
    return F.broadcast(stored) if (stored.agg(F.sum(size)).first()[0] or 0) <= LOOKED_UP else stored


def _boilerplate(classes: DataFrame, frequent: DataFrame, shard: int) -> DataFrame:
    """host and ids, the hashes of runs and blocks that are boilerplate, by the classes' pieces."""
    sizes = classes.groupBy("host").agg(F.sum(F.length("pieces")).alias("chars"))
    all_ = sizes.agg(F.sum("chars")).first()[0] or 0
    large = sizes.where(F.col("chars") > max(shard, all_ / MOST_HOSTS)).select("host", F.ceil(F.col("chars") / shard).alias("shards"))
    dealt = classes.join(F.broadcast(large), "host", "left").select("host", F.coalesce(F.pmod(F.xxhash64("kind"), "shards"), F.lit(0)).alias("shard"), "pieces")
    counts = mapped(dealt.repartition("host", "shard").sortWithinPartitions("host", "shard"), _shards, "host string, id binary, n long, kept boolean")
    sums = counts.groupBy("host", "id").agg(F.sum("n").alias("n"), F.max("kept").alias("kept")).where("kept")
    chosen = sums.join(frequent.select("host", "classes"), "host").where((F.col("n") >= MIN_PAGES) & (F.col("n") >= SHARE * F.col("classes")))
    return chosen.groupBy("host").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def extract(pages: DataFrame, shard: int = SHARD) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated (tokens that were boilerplate though their place might be kept) of every row."""
    given = pages.select(host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("place"), F.col("page_id").cast("long"), "url", "html")
    parsed = materialize(mapped(given, _parse, PARSED), "op10-parsed", "zstd")
    sizes = parsed.groupBy("host").agg(F.countDistinct("kind").alias("classes")).where(F.col("classes") >= MIN_PAGES)
    counted = mapped(parsed.select("host", "marks"), _mark_counts, "host string, marks binary, n binary").join(sizes, "host")
    frequent = materialize(mapped(counted.repartition("host").sortWithinPartitions("host"), _frequent, "host string, classes long, wanted binary"), "op10-frequent")
    reduced = mapped(parsed.join(_looked_up(frequent, F.length("host") + F.length("wanted") + 32), "host").select("host", "kind", "place", "packed", "wanted"), _reduce, "host string, kind binary, place long, pieces string")
    classes = reduced.groupBy("host", "kind").agg(F.min(F.struct("place", "pieces")).alias("first"), (F.min(F.md5("pieces")) != F.max(F.md5("pieces"))).alias("varied"))
    classes = materialize(classes.select("host", "kind", "first.pieces", "varied"), "op10-classes", "zstd")
    boilerplate = materialize(_boilerplate(classes, frequent, shard), "op10-boilerplate")
    lost = materialize(mapped(classes.where("varied").join(boilerplate, "host").select("host", "kind", "pieces", "ids"), _losses, "host string, kind binary, lost binary"), "op10-lost")
    rows = parsed.join(_looked_up(boilerplate, F.length("host") + 32 * F.size("ids")), "host", "left")
    rows = rows.join(_looked_up(lost, F.length("host") + F.length("lost") + 64), ["host", "kind"], "left").select("host", "page_id", "url", "packed", "ids", "lost")
    return mapped(rows, _cut, "page_id long, url string, text string, n_chars long, n_repeated long")
