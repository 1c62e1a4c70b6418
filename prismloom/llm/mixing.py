"""Mix sources to target weights by weighted fair queueing.

Every source is a flow. Its documents stand in a shuffled order, twice over (a source may be repeated once), and each
copy in the queue gets a virtual finish time: the source's words up to and with that copy, divided by the source's target.
The queue of all copies is sorted by virtual finish time and cut where its words reach the total budget, the sum of the
targets; the copy at the cut is served for the words that still fit.

Nothing gathers a source, or the queue, in one task. Rows that agree in doc_id, source and text become one row with a
number and are dealt out again. Within a source, documents lie in `BUCKETS` ranges of the shuffled order, whose totals
get running sums. The queue is sorted globally by ranges of virtual time (1 / RANGES each, in proportion from time 2 on),
which hold about equal words by construction. Their totals get running sums: all ranges but one lie before or behind
the cut, and only the rows of that one are sorted singly.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; an empty
table gives an empty mix; repeated rows, also without a doc_id, stand in the queue each on its own; a source without
words has target 0 and takes 0; ties of finish times go by source, null first; very long texts count whole. Columns
other than doc_id, text and source are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismloom.llm.common import materialize, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BUCKETS = 4096
RANGES = 4096
#: Equal rows that are dealt out at a time.
DEAL = 10_000
#: What tells rows apart; rows that agree in all of it are interchangeable.
ROW = ("id", "flow", "text_hash")


def source_targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """totals(source, source_size) -> also weight and target: water-filling of share * all words under repeats * own words.

    A row a source. Sources sorted by cap / weight fill up first; a source is capped if the level at its turn reaches
    its cap, and the level of the first uncapped source holds for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    level = (F.lit(share) * F.col("all_size") - F.col("cap_before")) / F.col("weight_left")
    t = (
        totals.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("cap_before", F.sum("cap").over(by_fill) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_fill) + F.col("weight"))
        .withColumn("level", level)
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("final_level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("capped") | F.col("final_level").isNull(), F.col("cap")).otherwise(F.col("final_level") * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def marks(docs: DataFrame) -> dict[str, Column]:
    """id, flow, text_hash and size of a row of docs: a missing doc_id and a missing source are values of their own."""
    return {
        "id": F.coalesce(docs["doc_id"].cast("string"), F.lit("")),
        "flow": F.when(docs["source"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs["source"])),
        "text_hash": F.md5(F.coalesce(docs["text"], F.lit(""))),
        "size": word_count(docs["text"]),
    }


def dealt_out(rows: DataFrame) -> DataFrame:
    """rows(id, flow, text_hash, size) with `no`, which numbers equal ones from 1."""
    counted = rows.groupBy(*ROW, "size").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DEAL)))).repartition("flow", "text_hash", "block")
    return blocks.withColumn("no", F.explode(F.sequence(F.col("block") * DEAL + 1, F.least("n", (F.col("block") + 1) * DEAL)))).drop("n", "block")


def time_range(finish: Column) -> Column:
    """The number of the range a virtual time lies in, growing with it; -1 where there is none."""
    number = F.when(finish < 2, F.floor(finish * RANGES)).otherwise(2 * RANGES + F.floor(F.log2(finish / 2) * RANGES))
    return F.coalesce(number.cast("long"), F.lit(-1).cast("long"))


def fair_queue(rows: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, buckets=BUCKETS) -> DataFrame:
    """rows(id, flow, text_hash, size) with no, source_size, target, virtual_start, virtual_finish (of the first copy) and taken."""
    queue_key = F.md5(F.concat_ws(":", "id", "text_hash", "no"))
    bucket = F.floor(F.conv(F.substring("queue_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int")
    placed = materialize(dealt_out(rows).withColumn("queue_key", queue_key).withColumn("bucket", bucket), "op5-places")

    dealt = placed.groupBy("flow", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = dealt.groupBy("flow").agg(F.sum("bucket_size").alias("source_size"))
    name = F.when(F.col("flow") == "", F.lit(None)).otherwise(F.expr("substring(flow, 2)"))
    goals = source_targets(totals.withColumn("source", name).drop("flow"), weights, share, repeats)
    goals = goals.withColumn("flow", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))).drop("source", "weight")
    goals = materialize(goals, "op5-targets")
    before = Window.partitionBy("flow").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.withColumn("range_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size").join(goals, "flow")
    inside = Window.partitionBy("flow", "bucket").orderBy("queue_key").rowsBetween(Window.unboundedPreceding, -1)
    words_before = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    queued = placed.join(ranges, ["flow", "bucket"]).withColumn("words_before", words_before).drop("range_start", "bucket", "queue_key")

    time = lambda words: F.when(F.col("target") > 0, words / F.col("target"))
    finish = [F.when(F.col("size") > 0, time(F.col("source_size") * k + F.col("words_before") + F.col("size"))) for k in range(repeats)]
    copies = F.array(*[F.struct(F.lit(k).alias("copy"), x.alias("finish"), time_range(x).alias("range")) for k, x in enumerate(finish)])
    queued = materialize(queued.withColumn("copies", copies), "op5-queued")
    in_time = queued.select("size", F.explode("copies.range").alias("range")).where("range >= 0").groupBy("range").agg(F.sum("size").alias("range_size"))
    so_far = F.sum("range_size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range of time
    budget = goals.agg(F.floor(F.sum("target") + 0.25)).first()[0] or 0  # one number; half words are not served
    at_cut = in_time.withColumn("range_start", F.coalesce(so_far, F.lit(0))).where((F.col("range_start") < budget) & (F.col("range_start") + F.col("range_size") >= budget)).first()  # one row
    last, room = (at_cut["range"], budget - at_cut["range_start"]) if at_cut else (-2, 0)

    kept = [*ROW, "no", "size", "source_size", "target", "words_before"]
    meets = F.exists("copies", lambda c: c["range"] == last)
    whole = F.size(F.filter("copies", lambda c: (c["range"] >= 0) & (c["range"] < last))) * F.col("size")
    order = Window.partitionBy("range").orderBy("finish", "flow", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(room).cast("long") - F.coalesce(F.sum("size").over(order), F.lit(0))
    served = F.when(F.col("range") == last, F.greatest(F.lit(0).cast("long"), F.least("size", rest))).when((F.col("range") >= 0) & (F.col("range") < last), F.col("size")).otherwise(0)
    at_end = queued.where(meets).select(*kept, F.inline("copies")).withColumn("served", served).groupBy(*kept).agg(F.sum("served").alias("taken"))
    all_ = queued.where(~meets).select(*kept, whole.cast("long").alias("taken")).unionByName(at_end)
    return all_.select(*kept[:-1], time(F.col("words_before")).alias("virtual_start"), time(F.col("words_before") + F.col("size")).alias("virtual_finish"), "taken")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, virtual_start, virtual_finish and taken of every row, sorted by virtual finish time."""
    doc_id = F.when(F.col("id") != "", F.col("id")).cast(docs.schema["doc_id"].dataType)
    queue = fair_queue(docs.select(*[c.alias(name) for name, c in marks(docs).items()]))
    return queue.select(doc_id.alias("doc_id"), *[c for c in queue.columns if c not in (*ROW, "no")]).orderBy(F.col("virtual_finish").asc_nulls_last(), "doc_id")


def numbered(rows: DataFrame, parts: int = 1024) -> DataFrame:
    """rows(id, flow, text_hash, row) with `no`, which numbers those that agree from 1, by ranges of the hash of `row`."""
    parted = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    before = Window.partitionBy(*ROW).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy(*ROW, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*ROW, "part").orderBy("row"))
    return parted.join(starts, [*ROW, "part"]).withColumn("no", F.col("start") + inside).drop("part", "start")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix deals them: a row for each copy of which at least half is served, whole texts.

    Repeats come as further rows. A copy behind the cut is left out; a document without words takes no share and is left
    out. Of rows that agree in doc_id, source and text, as many stay as the mix takes.
    """
    own = {f"own_{k}": c for k, c in enumerate(docs.columns)}
    found = docs.select(*[docs[f"`{c}`"].alias(k) for k, c in own.items()], *[c.alias(k) for k, c in marks(docs).items()])
    base = materialize(found.withColumn("row", F.monotonically_increasing_id()), "op5-rows")
    copies = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size"))
    queue = fair_queue(base.where("size > 0").select(*ROW, "size")).where("size > 0").withColumn("copies", copies)
    deals = queue.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copies") >= 1).alias("once"), F.count_if(F.col("copies") >= 2).alias("twice")).where("once > 0")
    taken = materialize(base.select(*ROW, "row").join(materialize(deals, "op5-deals"), [*ROW]), "op5-dealt")
    single = taken.where("n = 1").select("row", (F.col("once") + F.col("twice")).alias("copies"))
    several = numbered(taken.where("n > 1")).select("row", ((F.col("no") <= F.col("once")).cast("long") + (F.col("no") <= F.col("twice")).cast("long")).alias("copies"))
    plan = single.unionByName(several).where("copies > 0")
    return base.join(plan, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*[F.col(k).alias(c) for k, c in own.items()])


ORACLE = r"""
with r as (select doc_id, source, md5(coalesce(text, '')) as h,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
n as (select *, row_number() over (partition by doc_id, source, h) as no from r),
d as (select *, md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), h, no)) as k from n),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0::double, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
c as (select *, (source_size * 2)::double as cap, (sum(source_size) over ())::double as all_size, sum(weight) over () as all_weight from w),
f as (select *, coalesce(sum(cap) over o, 0) as cap_before, coalesce(sum(weight) over o, 0) as weight_before from c
      window o as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (1.5 * all_size - cap_before) / (all_weight - weight_before) as level from f),
g as (select *, cap <= level * weight as capped, max(case when not cap <= level * weight then level end) over () as final_level from l),
t as (select source, source_size, case when capped or final_level is null then cap else final_level * weight end as target from g),
q as (select d.doc_id, d.source, d.h, d.no, d.size, t.source_size, t.target,
             coalesce(sum(d.size) over (partition by d.source order by d.k rows between unbounded preceding and 1 preceding), 0)::bigint as b
      from d join t on d.source is not distinct from t.source),
p as (select *, (source_size * copy + b + size) / target as finish from q, (values (0), (1)) v(copy) where size > 0),
x as (select *, coalesce(sum(size) over (order by finish, coalesce('=' || source, ''), copy rows between unbounded preceding and 1 preceding), 0)::bigint as ahead from p),
y as (select doc_id, source, h, no, sum(greatest(0, least(size, (select floor(sum(target) + 0.25)::bigint from t) - ahead)))::bigint as taken from x group by all)
select q.doc_id, q.size, source_size, target,
       case when target > 0 then b / target end as virtual_start,
       case when target > 0 then (b + q.size) / target end as virtual_finish,
       coalesce(y.taken, 0) as taken
from q left join y on q.doc_id is not distinct from y.doc_id and q.source is not distinct from y.source and q.h = y.h and q.no = y.no
"""
