"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Its sketch has `COORDINATES` = t places,
filled in rounds. In each of the first t rounds every element draws one place and a value; a place takes the smallest
value of the earliest round that reaches it. In round t + k every element draws place k, so no place can stay empty. The
sketch is ready as soon as all places are filled: large sets need a round or two, small ones about t log(t) draws, and two
sets agree on a place as often as their similarity says, with the concentration of independent draws.

1. Sets that are equal are one node. A node's sketch is cut into `BANDS` bands of four places; nodes that share a band are
   candidates. Of sets at least 85 % alike a pair is missed with a chance below (1 - 0.85**4)**24 = 2e-8.
2. Each node is tied to the node of its band that shares most bands with others, its hub. Components of these ties are
   families: candidates are always of one family. Families are cut into blocks of about `BLOCK` nodes or `BLOCK_BYTES`.
3. Each block is verified inside, on full sets: a matrix of shingles that occur more than once gives all intersections,
   and pairs that share a band and are alike enough are links. A family of one block is done.
4. In larger families some of the most central nodes, one of each of `HUBS` parts, meet every block. That joins most copies into one component,
   whose members need not be compared any further. A node of which more than 15 % of the shingles occur in no other node
   of the family can't have a link. What remains outside the family's main component meets the family block by block.
5. Components of the links name the classes.

No pair is emitted but links, no group of copies is gathered in one task, and only shingles of nodes in families are ever
shuffled. Lineage is cut by tables in the shared folder.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing, not even its like, and its
component is itself; fewer words than a shingle give one shingle of all; very long texts are read whole; repeated rows are
one node and share a component; an empty table gives no rows. A row whose doc_id is null takes part, but never names a
component: the component of rows that all lack a doc_id is null, and they are kept. Columns other than doc_id and text are
not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismloom.llm.common import mapped, materialize, text_chunks
from prismloom.llm.simhash import components

SHINGLE = 5
#: Sets are linked from this percentage on.
ALIKE = 85
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
BLOCK, BLOCK_BYTES = 48, 4_000_000
HUBS = 16
#: Draws of one step of a sketch, at least.
STEP = 1024
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the A-Z lower-cased words' shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total * _PRIME + codes[k : len(words) - size + 1 + k])
    return np.unique(total)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """`COORDINATES` values of a set: round in the upper bits, the smallest draw below. Equal values come from equal elements."""
    t = COORDINATES
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < t:
        rounds = np.arange(start, min(t, start + max(1, STEP // len(hashes))), dtype=np.uint64)
        draws = _mixed(hashes[None, :] + _mixed((rounds + np.uint64(1)) * _PRIME)[:, None])
        place = ((draws >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        value = (place << np.uint64(48)) | (rounds[:, None] << np.uint64(32)) | (draws & np.uint64(0xFFFFFFFF))
        value = np.sort(value.ravel())
        place = value >> np.uint64(48)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        at = place[first].astype(np.int64)
        out[at] = np.minimum(out[at], value[first] & np.uint64((1 << 48) - 1))
        start += len(rounds)
        if (out < np.iinfo(np.uint64).max).all():
            return out
    for k in np.flatnonzero(out == np.iinfo(np.uint64).max).tolist():
        draws = _mixed(hashes + _mixed(np.uint64([t + k + 1]) * _PRIME)) & np.uint64(0xFFFFFFFF)
        out[k] = (np.uint64(t + k) << np.uint64(32)) | draws.min()
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its number and its places."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIME
    for column in values.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _PRIME + column)
    return keys


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in text_chunks(batches):
        sets = [shingles(r["text"]) for r in rows]
        columns = [
            pa.array([r["doc_id"] for r in rows], pa.int64()),
            pa.array([r["text_key"] for r in rows], pa.binary()),
            pa.array([xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([bands(sketch(s)).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "set_key", "n_shingles", "bands"])


_SET = pa.schema([("node", pa.int64()), ("family", pa.int64()), ("bands", pa.list_(pa.int64())), ("hashes", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of a node becomes its set."""
    for rows in text_chunks(batches):
        sets = [shingles(r.pop("text")).astype("<u8").tobytes() for r in rows]
        yield pa.RecordBatch.from_pylist([r | {"hashes": s} for r, s in zip(rows, sets, strict=True)], schema=_SET)


def verified(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], alike: int = ALIKE) -> np.ndarray:
    """Which of left (rows) and right (columns) share a band and are alike enough; each is a set's bands and its sorted hashes."""
    sizes = [np.array([len(h) for _, h in side], np.int64) for side in (left, right)]
    every = [np.concatenate([h for _, h in side]) for side in (left, right)]
    shared = np.intersect1d(np.unique(every[0]), np.unique(every[1]), assume_unique=True)
    share_band = (np.stack([b for b, _ in left])[:, None, :] == np.stack([b for b, _ in right])[None, :, :]).any(axis=2)
    inter = np.zeros((len(left), len(right)), np.int64)
    # hashes that occur on both sides, in columns of a bounded number; sums of ones are whole numbers, exact below 2**24
    step = max(1, 8_000_000 // (len(left) + len(right)))
    places = []
    for values, n in zip(every, sizes, strict=True):
        at = np.searchsorted(shared, values)
        known = at < len(shared)
        known[known] = shared[at[known]] == values[known]
        places.append((np.repeat(np.arange(len(n)), n)[known], at[known]))
    for start in range(0, len(shared), step):
        width = min(step, len(shared) - start)
        sides = []
        for (row, at), n in zip(places, sizes, strict=True):
            here = (at >= start) & (at < start + width)
            ones = np.zeros((len(n), width), np.float32)
            ones[row[here], at[here] - start] = 1
            sides.append(ones)
        inter += (sides[0] @ sides[1].T).astype(np.int64)
    return share_band & (100 * inter >= alike * (sizes[0][:, None] + sizes[1] - inter))


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many of the pairs as connect what all of them connect."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    for x, y in pairs:
        a, b = top(x), top(y)
        if a != b:
            above[a] = b
            out.append((x, y))
    return out


def _members(rows: list[dict]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    sets = [shingles(r["text"]) if "text" in r else np.frombuffer(r["hashes"], "<u8") for r in rows]
    return np.array([r["node"] for r in rows], np.int64), [(np.array(r["bands"], np.int64), s) for r, s in zip(rows, sets, strict=True)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of links between the two lists of nodes in a row, or within its only list, as many as connect what all links connect."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            nodes, left = _members(row["left"])
            others, right = _members(row["right"]) if "right" in row else (nodes, left)
            i, j = np.nonzero(verified(left, right))
            kept = spanning(list(zip(nodes[i].tolist(), others[j].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([max(e) for e in kept], pa.int64()), pa.array([min(e) for e in kept], pa.int64())], names=["a", "b"])


def _verified(df: DataFrame) -> DataFrame:
    """Links of the rows' lists of nodes, as a table. A batch is a few rows, as each may have some megabytes."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        return materialize(mapped(df, _links, "a long, b long").distinct(), "op13-links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _counts(members: DataFrame, shingles: str) -> DataFrame:
    """family and blocks, the number of blocks its nodes and bytes ask for."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.expr(shingles)) * 8 / BLOCK_BYTES))
    return members.groupBy("family").agg(blocks.alias("blocks"))


def _blocked(members: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """family, block and list, as a table: each family's members dealt by hash over its blocks."""
    dealt = members.join(counts, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return materialize(dealt.groupBy("family", "block").agg(F.collect_list(F.struct("node", "bands", "hashes")).alias("list")), name)


def _placed(roots: DataFrame, name: str) -> DataFrame:
    """Every node of stars with its root, the root too."""
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", name)


def _each_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            hashes = np.frombuffer(batch.column("hashes")[k].as_buffer(), "<u8").view(np.int64)
            same = [pa.array(np.full(len(hashes), batch.column(c)[k].as_py(), np.int64)) for c in ("family", "node")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(hashes)], names=["family", "node", "hash"])


def _remaining(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members that may still have a link not yet found: outside their family's main component, with enough shingles that others of the family have."""
    roots = components(links, "op13-stars")
    placed = materialize(members.select("family", "node").join(_placed(roots, "root").hint("merge"), "node", "left").select("family", "node", F.coalesce("root", "node").alias("root")), "op13-placed")
    sizes = placed.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    main = materialize(sizes.groupBy("family").agg(F.max(F.struct("n", "root")).alias("m")).select("family", F.col("m.root").alias("main")), "op13-main")
    outside = placed.join(main, "family").where("root <> main").select("node")
    each = mapped(members.select("family", "node", "hashes"), _each_hash, "family long, node long, hash long")
    alone = each.groupBy("family", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    size = F.length("hashes") / 8
    able = members.join(alone.hint("merge"), "node", "left").where(100 * (size - F.coalesce("alone", F.lit(0))) >= ALIKE * size).drop("alone")
    return materialize(able.join(outside.hint("merge"), "node", "left_semi").select(*members.columns), "op13-remaining")


def families(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, family) of all nodes that share a band with another, and (node, weight), a measure of how many they share bands with; tables."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keys.join(shared.hint("merge"), "key"), "op13-met")
    weights = materialize(met.groupBy("node").agg(F.sum("n").alias("weight")), "op13-weights")
    weighed = materialize(met.join(weights.hint("merge"), "node").select("key", "node", "weight"), "op13-weighed")
    hubs = materialize(weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub")), "op13-hubs")
    ties = weighed.join(hubs.hint("merge"), "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    return materialize(_placed(components(ties, "op13-ties"), "family"), "op13-families"), weights


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of links that connect what all links connect. nodes: node, set_key, n_shingles, bands and rep; texts: rep, text."""
    in_family, weights = families(nodes)
    chosen = materialize(nodes.join(in_family.hint("merge"), "node").select("node", "family", "bands", "n_shingles", "rep"), "op13-chosen")
    counts = materialize(_counts(chosen, "n_shingles"), "op13-counts")
    with_text = chosen.drop("n_shingles").join(texts.hint("merge"), "rep").join(counts, "family")
    small = with_text.where("blocks = 1").groupBy("family").agg(F.collect_list(F.struct("node", "bands", "text")).alias("left"))
    found = _verified(small.select("left"))
    large = counts.where("blocks > 1")
    if not large.take(1):
        return found
    members = materialize(mapped(with_text.where("blocks > 1").select("node", "family", "bands", "text"), _sets, "node long, family long, bands array<long>, hashes binary"), "op13-members")
    blocks = _blocked(members, large, "op13-blocks")
    # each of HUBS parts of a family names its most central node: maxima that combine before they are sent
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.lit(HUBS))
    hubs = members.select("family", "node").join(weights.hint("merge"), "node").groupBy("family", part).agg(F.max(F.struct("weight", "node")).alias("hub")).select(F.col("hub.node").alias("node"))
    hubs = members.join(materialize(hubs, "op13-central").hint("merge"), "node", "left_semi").groupBy("family").agg(F.collect_list(F.struct("node", "bands", "hashes")).alias("left"))
    right = blocks.select("family", F.col("list").alias("right"))
    inside = _verified(blocks.select(F.col("list").alias("left")))
    star = _verified(right.join(materialize(hubs, "op13-hubs-of-families"), "family").select("left", "right"))
    first = inside.unionByName(star)
    rest = _remaining(members, first)
    again = _blocked(rest, _counts(rest, "length(hashes) / 8"), "op13-again").select("family", F.col("list").alias("left"))
    return found.unionByName(first).unionByName(_verified(again.join(right, "family").select("left", "right")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    text_key = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key")
    given = docs.select(F.col("doc_id").cast("long"), text_key, "text")
    found = materialize(mapped(given, _sketches, "doc_id long, text_key binary, set_key binary, n_shingles long, bands array<long>"), "op13-sketches")
    rep = F.min(F.struct("doc_id", "text_key")).alias("rep")
    nodes = found.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), rep, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "op13-nodes")
    texts = given.select(F.struct("doc_id", "text_key").alias("rep"), "text")
    if found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        texts = texts.dropDuplicates(["rep"])
    roots = components(links(nodes, texts), "op13-classes")
    rooted = materialize(nodes.select("set_key", "node", "first").join(_placed(roots, "root").hint("merge"), "node", "left"), "op13-rooted")
    firsts = materialize(rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("component_id")), "op13-firsts")
    named = rooted.join(firsts.hint("merge"), "root").select("set_key", "component_id").unionByName(rooted.where("root is null").select("set_key", F.col("first").alias("component_id")))
    slim = found.select("doc_id", "n_shingles", "set_key")
    with_set = slim.where("set_key is not null").join(materialize(named, "op13-named").hint("merge"), "set_key").select("doc_id", "n_shingles", "component_id")
    every = with_set.unionByName(slim.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
