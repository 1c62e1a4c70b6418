"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most `RADIUS` = 4 bits apart differ in at most 2 bits in one of their 32-bit halves, and then some
value lies within 1 bit of both of these halves. So every distinct fingerprint emits, for each half, all variants within
half of 2 bits (33 keys a half), the variants are shuffled, and fingerprints that meet on a key are candidates.

* A key with at most `SMALL` fingerprints has its pairs verified on all 64 bits.
* Fingerprints of larger keys emit their full ball of radius 2 (2,081 keys). Those that meet there are certainly within
  4 bits of each other, so each is linked to the smallest of the key and no pair is formed.

Emitting the full ball for every fingerprint would be the same method in one step, at 2,081 rows a document.

A row is named by its doc_id and the hash of its text, so rows that share a doc_id but not their text stay apart.
Joins are sort-merge joins by hint: the compressed size by which Spark would choose to broadcast says little about a
table of random numbers. Equal fingerprints are one node. Components come from alternating large-star and small-star rounds, each cut by a table
in the shared folder.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; fewer words than a
shingle give one shingle of all; repeated rows share a component; an empty table gives no rows; very long texts are read
whole. A row whose doc_id is null takes part, but never names a component. Of a component `one_of_each` keeps the row with
the smallest doc_id, of ties the smallest text hash; rows that agree in both are one row. Columns but doc_id and text
are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismloom.llm.common import delete_table, mapped, materialize, text_chunks, unused, write_table

SHINGLE = 4
SEED = 42
RADIUS = 4
SMALL = 64
BITS = 64
#: Edges of one node are dealt over this many groups, so that the centre of a large star doesn't land in one task.
PARTS = 256


def fingerprint(text: str | None) -> int:
    """Of the A-Z lower-cased words' shingles, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()[SHINGLE - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist())
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in text_chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["text_hash"] for r in rows], pa.binary()), pa.array([fingerprint(r["text"]) for r in rows], pa.int64())], names=["doc_id", "text_hash", "fp"])


def text_hash() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp of every row."""
    given = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text")
    return mapped(given, _fingerprints, "doc_id long, text_hash binary, fp long")


def _masks(bits: int, radius: int) -> list[int]:
    """All values of so many bits with at most `radius` ones (radius up to 2)."""
    one = [1 << k for k in range(bits)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(x) for x in [0, *(one if radius else []), *(two if radius > 1 else [])]]


def _explode_masks(df: DataFrame, bits: int, radius: int) -> DataFrame:
    return df.withColumn("mask", F.explode(F.array(*[F.lit(x).cast("long") for x in _masks(bits, radius)])))


def half_variants(fps: DataFrame) -> DataFrame:
    """(fp, key): for each half of fp, the values within 1 bit of it, marked with the half's number."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    mark = F.lit(1 << 32)
    around = _explode_masks(fps.select("fp"), 32, 1)
    return around.select("fp", F.explode(F.array(low.bitwiseXOR(F.col("mask")), high.bitwiseXOR(F.col("mask")) + mark)).alias("key"))


def ball_links(fps: DataFrame) -> DataFrame:
    """(a, b), a > b: every fp with the smallest fp it meets on each variant within 2 of its 64 bits."""
    ball = _explode_masks(fps.select("fp"), BITS, RADIUS // 2).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"))
    least = ball.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").drop("most")
    return ball.join(least.hint("merge"), "key").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b), a > b: links of distinct fingerprints that give the components of "at most RADIUS bits apart"."""
    # few bytes become many: without this, Spark would merge the fingerprints into a few partitions by their size
    fps = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    keys = half_variants(fps).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(half_variants(fps).join(keys.hint("merge"), "key"), "op8-met")
    groups = met.where(F.col("n") <= small).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("group")).select("group").distinct()
    close = F.expr(f"filter(transform(slice(group, i + 2, size(group)), a -> struct(a as a, b as b)), p -> bit_count(p.a ^ p.b) <= {RADIUS})")
    pairs = groups.select(F.posexplode("group").alias("i", "b"), "group").select(F.explode(close).alias("p")).select("p.a", "p.b").distinct()
    return pairs.unionByName(ball_links(met.where(F.col("n") > small).select("fp").distinct()))


def _stars(edges: DataFrame) -> DataFrame:
    """For each part of a's edges in edges(a, b), repeated ones once: a, the b's as `ends`, and m, the least of a and all its b.

    The ends are gathered once, by part, and read twice: the least of each part, then that of at most PARTS parts, comes back to them.
    """
    parts = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS))).groupBy("a", "part").agg(F.collect_set("b").alias("ends"))
    least = parts.select("a", "part", F.least(F.min(F.array_min("ends")).over(Window.partitionBy("a")), "a").alias("m"))
    return parts.join(least.hint("merge"), ["a", "part"]).drop("part")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges(a, b), root the smallest node of its component; large-star and small-star in turn."""
    spark = edges.sparkSession
    path = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = None
    for _ in range(rounds):
        stars = spark.read.schema("a long, b long").parquet(path)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both).select(F.explode(F.filter("ends", lambda b: b > F.col("a"))).alias("a"), F.col("m").alias("b"))
        ends = _stars(large).select(F.explode(F.array_append("ends", F.col("a"))).alias("a"), F.col("m").alias("b"))
        small = ends.where("a <> b").distinct()
        before, path = path, write_table(small, name)
        delete_table(spark, before)
        stars = spark.read.schema("a long, b long").parquet(path)
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp and component_id of every row, and kept: the first of its component's rows by doc_id and text hash."""
    found = materialize(fingerprints(docs), "op8-fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    fps = found.groupBy("fp").agg(first.alias("first"))
    roots = components(links(fps), "op8-stars")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    rooted = materialize(fps.join(members.hint("merge"), fps["fp"] == members["node"], "left").select("fp", "first", "root"), "op8-rooted")
    # firsts are written before the join, so that Spark can split the rows of a large component; without links a fingerprint is its own
    firsts = materialize(rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("chosen")), "op8-firsts")
    many = rooted.join(firsts.hint("merge"), "root").select("fp", "chosen")
    named = many.unionByName(rooted.where("root is null").select("fp", F.col("first").alias("chosen")))
    kept = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_hash") == F.col("chosen.text_hash"))
    return found.join(named.hint("merge"), "fp").select("doc_id", "text_hash", "fp", F.col("chosen.doc_id").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Rows without a doc_id stay only where none has one."""
    own_id, own_hash, its_id, its_hash = (unused(f"__{c}", docs.columns) for c in ("own_id", "own_hash", "id", "hash"))
    keep = classes(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias(its_id), F.col("text_hash").alias(its_hash)).distinct()
    marked = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_hash, text_hash())
    same = F.col(own_id).eqNullSafe(F.col(its_id)) & (F.col(own_hash) == F.col(its_hash))
    kept = marked.join(keep.hint("merge"), same, "left_semi").dropDuplicates([own_id, own_hash])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
