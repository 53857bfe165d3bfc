"""Mixing sources to target weights by Pareto order sampling.

Sources get word targets by water filling: weights share the total, a target stops at
``max_copies`` times its source, the excess is shared again. Inside a source documents fall
into size classes (powers of two); a class's documents are wanted in proportion to
``2^(class/2)``, so longer documents are repeated sooner than scraps, up to ``max_copies``.
That gives each class an expected number of copies e: floor(e) whole copies are certain,
and the rest is an inclusion probability p. Among the documents of a source, ranked by
Pareto's order ``(u/(1-u)) / (p/(1-p))`` with u a hash of the id, the smallest are taken
until the fixed size (the source's remaining words) is reached.

Everything that is solved (shares, class copies) lives on per-source and per-class sums.
The cut-off rank of a source is found from a histogram of the ranks, so no source, however
large, is ordered in one task: only the documents of the bin that holds the cut-off are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

BINS = 4096
BROADCAST_ROWS = 200_000


def _per_source(df: DataFrame, label: str) -> DataFrame:
    """A written table of rows by source, broadcast if its count is small: then the documents of
    a source, however many, are joined where they are."""
    df = written(df, label)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_copies: float) -> DataFrame:
    """(source, source_size, target) from per-source sums (source, source_size).

    The common level of a water filling is the largest of the levels that follow from
    filling the first j sources up, in order of source_size / weight."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("w", w).withColumn("fill", F.col("source_size") / F.col("w"))
    before = Window.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.lit(max_copies) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return named.withColumn("level", level).withColumn("target", F.round(F.least(F.lit(float(max_copies)) * F.col("source_size"), F.max("level").over(whole) * F.col("w")), 6)).select("source", "source_size", "target")


def class_copies(classes: DataFrame, targets: DataFrame, max_copies: float) -> DataFrame:
    """(source, class, source_size, target, whole, p, rest): certain copies and inclusion
    probability of each size class, and the words its source still takes by sampling."""
    joined = classes.join(targets, classes["source"].eqNullSafe(targets["source"])).select(classes["source"], "class", "words", "source_size", "target")
    want = F.sqrt(F.pow(F.lit(2.0), F.col("class")))
    longer = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("class")
    c = (F.col("target") - F.lit(max_copies) * F.coalesce(F.sum("words").over(longer), F.lit(0))) / F.sum(want * F.col("words")).over(upto)
    here = Window.partitionBy("source")
    e = F.least(F.lit(float(max_copies)), F.max("c").over(here) * want)
    return (
        joined.withColumn("c", c).withColumn("e", e).withColumn("whole", F.floor(F.col("e") + 1e-9).cast("long"))
        .withColumn("p", F.when(F.col("e") - F.col("whole") > 1e-9, F.col("e") - F.col("whole")).otherwise(F.lit(0.0)))
        .withColumn("rest", F.sum(F.col("p") * F.col("words")).over(here))
        .select("source", "class", "source_size", "target", "whole", "p", "rest")
    )


def pareto_order(doc_id: str, p: str, seed: str) -> F.Column:
    """The rank (u/(1-u)) / (p/(1-p)) mapped into (0, 1); u from the first 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / F.lit(float(1 << 52))
    q = (u / (1 - u)) / (F.col(p) / (1 - F.col(p)))
    return q / (1 + q)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_copies: int = 3, seed: str = "mix-", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), copies and
    text_hash (xxhash64).

    Null text counts 0 words and is taken 0 times. A null source is a source, last in
    order. Repeated rows are documents of their own that share their u; the order among
    rows that agree in rank, id and size is that of the written table. An empty table gives
    no rows. Columns other than the three named are ignored. Reruns agree.
    """
    if min(weights) <= 0 or max_copies < 1:
        raise ValueError("weights must be positive and max_copies at least 1")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    slim = written(slim.withColumn("class", F.length(F.bin("size")) - 1).withColumn("rid", F.monotonically_increasing_id()), "sizes")
    classes = slim.groupBy("source", "class").agg(F.sum("size").alias("words"))
    totals = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = written(source_targets(totals, weights, max_copies), "targets")
    # words of empty documents share nothing: their class is left out of the copies
    copies = class_copies(classes.where("words > 0"), targets, max_copies)
    plan = targets.join(copies.drop("source_size", "target"), targets["source"].eqNullSafe(copies["source"]), "left").select(targets["source"], "class", "source_size", "target", "whole", "p", "rest")
    plan = written(plan, "copies")
    per_source = plan.select("source", "source_size", "target", "rest").distinct()
    a, b = slim.alias("a"), _per_source(plan.select("source", "class", "whole", "p"), "class-copies").alias("b")
    ranked = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.class") == F.col("b.class")), "left").select("a.*", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("whole"), F.when((F.col("size") > 0) & (F.col("p") > 0), pareto_order("doc_id", "p", seed)).alias("v"))
    ranked = written(ranked.withColumn("bin", F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1))), "ranked")

    bins = ranked.where("v is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    s = per_source.select("source", "rest").alias("s")
    cut = bins.join(s, bins["source"].eqNullSafe(F.col("s.source"))).where("before <= rest").groupBy(bins["source"]).agg(F.max(F.struct("bin", "before")).alias("cut"))
    border = per_source.join(cut, per_source["source"].eqNullSafe(cut["source"]), "left").select(per_source["source"], "source_size", "target", "rest", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("cut_before"))
    r, t = ranked.alias("r"), _per_source(border, "borders").alias("t")
    both = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "target", "rest", "cut_bin", "cut_before")
    order = Window.partitionBy("source").orderBy("v", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    inside = both.where("v is not null and bin = cut_bin").withColumn("extra", (F.col("cut_before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("rest")).cast("long"))
    outside = both.where("v is null or bin <> cut_bin").withColumn("extra", F.coalesce((F.col("bin") < F.col("cut_bin")).cast("long"), F.lit(0)))
    sampled = written(outside.unionByName(inside), "sampled")
    # The last document rarely fills the fixed size to the word: one more is taken, or one left, where that comes nearer.
    gap = _per_source(sampled.groupBy("source").agg((F.max("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap")), "gaps").alias("g")
    move = F.col("size") * (1 - 2 * F.col("extra"))
    moves = sampled.alias("m").where("v is not null").join(gap, F.col("m.source").eqNullSafe(F.col("g.source"))).where(F.abs(F.col("gap") - move) < F.abs("gap")).groupBy("m.source").agg(F.min(F.struct(F.abs(F.col("gap") - move).alias("off"), "v", "doc_id", "size", "rid")).alias("move"))
    moved = _per_source(moves.select("source", F.col("move.rid").alias("moved")), "moves").alias("d")
    out = sampled.alias("o").join(moved, F.col("o.source").eqNullSafe(F.col("d.source")), "left")
    n = F.col("whole") + F.when(F.col("moved") == F.col("rid"), 1 - F.col("extra")).otherwise(F.col("extra"))
    return out.select("doc_id", "o.source", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), "text_hash", "rid")
