"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share all words by weight; a source's target stops at MOST times its size and the excess is shared
among the others by weight. A schedule of slots of equal word counts maps the points of the golden-ratio
sequence through the cumulative targets; a source's n-th slot takes the n-th block of its stream: its documents in
the order of a hash, word after word, started anew when it ends. So any run of slots holds each source close to
its share, and a document is taken whole before any of its source is taken once more. The documents as they are mixed lie in the
order of the slots that begin them.

Running sums are two-level (by a prefix of the hash within a source, by runs of slots), so a source with a
third of all rows is spread over 4,096 groups. Only the table of sources, a row each, meets in one task; points find
their source by a join on cells of a grid that has more cells than there are sources. Built-in functions only.

Defined results: a null text has size 0, a document of size 0 is never taken; a null source is a source, the
last; rows that share a doc_id are ordered by size and text, those without one by a hash of the text; an empty table, or one without
words, gives an empty mix; a text is counted whole, however long; other columns pass untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ._common import WORD, Sealed, cut, documents, row_hash

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3  # times its size that a source gives at most
GOLDEN = 0.6180339887498949
RUN = 1 << 16  # slots in a run
BLOCK = 256  # words in a slot


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Sources fill up in order of size a weight; the common level is found where the next one does not fill.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    order = W.orderBy("fill", "rank")
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level)
    common = F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "rank", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(common * F.col("weight"), F.col("cap").cast("double")))
    return leveled.withColumn("target", target).select("source", "rank", "source_size", "weight", "target")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, nth): which source each slot draws from, and how many slots of it come before.

    targets: rank, quota (words) of the sources, all positive. Where the points leave a source short of its quota, the
    missing slots (a few, the discrepancy of the sequence) follow at the end, as slot n + nth."""
    spark = targets.sparkSession
    total, count = targets.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    n = -(-total // block)
    cells = 1 << max(12, (2 * count).bit_length())
    upto = F.sum("quota").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    share = targets.withColumn("upto", upto).select("rank", ((F.col("upto") - F.col("quota")) / F.lit(float(total))).alias("lo"), (F.col("upto") / F.lit(float(total))).alias("hi"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    share = share.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    at = F.col("id") * F.lit(GOLDEN) + 0.5
    points = spark.range(n).select(F.col("id").alias("slot"), (at - F.floor(at)).alias("u")).withColumn("cell", cell(F.col("u")))
    drawn = points.join(share, "cell").where("lo <= u and (u < hi or hi = 1)").select("slot", "rank", F.expr(f"slot div {RUN}").alias("run"))
    per = drawn.groupBy("rank", "run").agg(F.count(F.lit(1)).alias("c"))
    base = per.withColumn("base", F.coalesce(F.sum("c").over(W.partitionBy("rank").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("rank", "run").orderBy("slot")) - 1
    slots = drawn.withColumn("own", nth).join(base, ["rank", "run"]).select("slot", "rank", (F.col("base") + F.col("own")).alias("nth"))
    need = targets.select("rank", F.expr(f"(quota + {block - 1}) div {block}").alias("need"))
    have = need.join(per.groupBy("rank").agg(F.sum("c").alias("have")), "rank", "left").na.fill(0)
    short = have.where("have < need").select("rank", F.explode(F.expr("sequence(have, need - 1)")).alias("nth"))
    return slots.unionByName(short.select((F.lit(n) + F.col("nth")).alias("slot"), "rank", "nth"))


def streams(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text and others) with size, and at: the words of its source before it."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))))
    d = docs.withColumn("size", word_count(F.col("text"))).withColumn("_h", F.md5(name))
    d = d.withColumn("_b", F.substring("_h", 1, 3)).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    per = d.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
    base = per.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = W.partitionBy("_s", "_b").orderBy("_h", "doc_id", "size", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return d.join(base, ["_s", "_b"]).withColumn("at", F.col("_base") + F.col("_own")).drop("_s", "_b", "_h", "_own", "_base")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, source, text and others, of other names than those below. Returns (placed, mixture).

    placed: a row for each of docs without its text, with size, source_size, target, rank (of the source) and at (words of the source before
    it; null if size is 0); rank and at name a row of which words are taken. mixture: (slot, rank, at, copy, word, words): what the slots take,
    `words` words of a document from word `word` on, in its copy-th turn."""
    base = cut(streams(docs).drop("text"))
    targets = cut(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    quota = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    t = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target", quota.alias("quota"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    few = targets.limit(100_001).count() <= 100_000  # rows of some 40 bytes
    placed = base.withColumn("at", F.when(F.col("size") > 0, F.col("at"))).join(F.broadcast(t) if few else t, same).drop("_source")
    turns = placed.where("size > 0 and quota > at").select(
        "rank", "at", "size", "quota", F.posexplode(F.expr("transform(sequence(0L, (quota - at - 1) div source_size), e -> at + e * source_size)")).alias("copy", "first")
    )
    blocks = turns.withColumn("last", F.least(F.col("first") + F.col("size"), F.col("quota")))
    blocks = blocks.select("rank", "at", "copy", "first", "last", F.explode(F.expr(f"sequence(first div {block}L, (last - 1) div {block}L)")).alias("nth"))
    got = blocks.join(schedule(t.where("quota > 0").select("rank", "quota"), block), ["rank", "nth"])
    start, end = F.greatest("first", F.col("nth") * block), F.least("last", (F.col("nth") + 1) * block)
    return placed, got.select("slot", "rank", "at", "copy", (start - F.col("first")).alias("word"), (end - start).alias("words"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs as the mix takes them, in the order of the slots that begin them: a row for each turn of a document of which it takes at
    least half the words. Rows equal in all columns are one that is taken as often."""
    seal = Sealed(docs)
    keyed = seal.df.withColumn("r", row_hash(seal.df))
    placed, mixture = mix(keyed.select("r", *(F.col(seal[c]).alias(c) for c in ("doc_id", "source", "text"))), block=block)
    key = ["rank", "at"]
    turns = mixture.groupBy(*key, "copy").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")).join(placed, key).where("2 * words >= size")
    turns = turns.select(F.col("doc_id").alias("id"), F.col("r").alias("t"), "slot")
    once = keyed.dropDuplicates([seal["doc_id"], "r"])
    same = F.col(seal["doc_id"]).eqNullSafe(F.col("id")) & (F.col("r") == F.col("t"))
    out = once.join(turns, same).repartitionByRange("slot").sortWithinPartitions("slot")
    return seal.opened(out)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, the words that the mix takes of it, in how many turns, and the first slot that takes any."""
    placed, mixture = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    taken = mixture.groupBy("rank", "at").agg(F.sum("words").alias("taken"), (F.max("copy") + 1).alias("copies"), F.min("slot").alias("first_slot"))
    out = placed.join(taken, ["rank", "at"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "size", "source_size", "target", zero("taken"), zero("copies"), "first_slot")


OP6_SQL = rf"""
with d as (select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 rk from s),
w as (select *, [5.0, 2.0, 1.0][(rk % 3 + 1)::int]::double weight, 3 * source_size cap from r),
f as (select *, cap / weight fill from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by fill, rk rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by fill, rk rows between current row and unbounded following) lev from f),
c as (select arg_min(lev, (fill, rk)) filter (where lev < fill) common from l),
t as (select source, rk, source_size, case when common * weight < cap then common * weight else cap::double end target from l, c),
q as (select *, least(round(target)::bigint, 3 * source_size) quota from t),
h as (select rk, quota, sum(quota) over (order by rk)::bigint upto, sum(quota) over ()::bigint total from q where quota > 0),
i as (select unnest(range((select ((max(total) + {BLOCK - 1}) // {BLOCK})::bigint from h))) slot),
u as (select slot, slot * {GOLDEN}::double + 0.5::double - floor(slot * {GOLDEN}::double + 0.5::double) u from i),
a as (select slot, rk, row_number() over (partition by rk order by slot) - 1 nth from u join h on (upto - quota) / total::double <= u and (u < upto / total::double or upto = total)),
g as (select * from a union all select (select count(*) from i) + nth, rk, nth from (select h.rk, unnest(range((select count(*) from a where a.rk = h.rk), (quota + {BLOCK - 1}) // {BLOCK})) nth from h)),
p as (select doc_id, size, source_size, target, rk, quota,
  coalesce(sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, 'text ' || coalesce(text, ''))), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint pos
  from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target, (greatest(0, least(size, quota - pos)) + greatest(0, least(size, quota - pos - source_size))
  + greatest(0, least(size, quota - pos - 2 * source_size)))::bigint taken, case when size > 0 and quota > pos then (quota - pos - 1) // source_size + 1 else 0 end copies, slot first_slot
from p left join g on size > 0 and quota > pos and g.rk = p.rk and g.nth = pos // {BLOCK}
"""
