"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key scaled by its quality weight; within a source, documents are taken in key order until the
source's token budget is full. The order is never built for a whole source: keys fall into ``BINS`` bins per source, token sums per bin are
prefix-summed, and the bin in which the budget ends is cut into bins again, until it has at most ``EDGE_ROWS`` rows, which are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.session import written

BINS = 4096
#: Rows of a source that are put in order by one task.
EDGE_ROWS = 50_000


def quality_weight(text: Column, n_tokens: Column) -> Column:
    """A weight in 0.05..1: the share of letters and blanks, less for texts under 32 tokens."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), letters * F.least(F.lit(1.0), n_tokens / 32))


def _sums(rows: DataFrame) -> DataFrame:
    """Tokens, rows and keys of each bin of each source, and the tokens up to it."""
    b = rows.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    return b.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))


def _end(bins: DataFrame, plan: DataFrame) -> DataFrame:
    """The bin of each source in which its budget ends: its keys low to high, and the tokens before it."""
    at = bins.join(F.broadcast(plan), "source").withColumn("upto", F.col("upto") + F.col("start")).where(F.col("upto") > F.col("rest"))
    e = at.groupBy("source", "epochs", "rest").agg(F.min_by(F.struct((F.col("upto") - F.col("n")).alias("start"), "rows", "low", "high"), "bin").alias("e"))
    return e.select("source", "epochs", "rest", "e.*")


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 42, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the largest mixture that meets the targets.

    ``docs``: doc_id, source, n_tokens, weight; ``targets``: source, target_share, max_repeats. The total is the largest at which no source
    needs more than max_repeats copies of its tokens, with the shares of the sources that have tokens brought to sum 1. Of each source all
    documents appear in whole epochs, and once more those with the smallest keys that fit into the rest, so a source never exceeds its budget.
    Sources without a target, null sources, documents without tokens and null doc_ids are left out; a repeated doc_id counts once; a repeated
    target counts with its smallest values. Empty tables give no rows.
    """
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    t = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    t = t.groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    d = docs.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).join(t.select("source"), "source", "left_semi")
    d = d.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens", "weight")).alias("d")).select("doc_id", "d.*")
    d = d.withColumn("key", -F.log(u) / F.greatest("weight", F.lit(1e-6)))
    d = d.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * BINS), F.lit(BINS - 1)).cast("int")).select("doc_id", "source", "n_tokens", "key", "bin")
    d = written(d, "mixture")

    bins = written(_sums(d), "bins")  # at most BINS rows per source
    have = bins.groupBy("source").agg(F.sum("n").alias("all")).join(t, "source")
    share = F.col("target_share") / F.col("sum_share")
    whole = have.agg(F.sum("target_share").alias("sum_share"))
    have = have.crossJoin(whole).withColumn("share", share)  # one row against one row per source
    total = have.agg(F.min(F.col("all") * F.col("max_repeats") / F.col("share")).alias("total"))
    plan = have.crossJoin(total).select(
        "source", "all", F.floor(F.col("share") * F.col("total") + 1e-6).cast("long").alias("budget"), F.col("max_repeats").cast("long").alias("max_repeats")
    ).withColumn("epochs", F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.col("all")))).withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("all")).otherwise(F.lit(0)))

    ends = written(_end(bins, plan.select("source", "epochs", "rest", F.lit(0).cast("long").alias("start"))), "ends")  # one row per target
    while not ends.where((F.col("rows") > edge_rows) & (F.col("high") > F.col("low"))).isEmpty():
        x = d.drop("bin").join(F.broadcast(ends), "source").where(F.col("key").between(F.col("low"), F.col("high")))
        part = F.coalesce(F.floor((F.col("key") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * BINS), F.lit(0))
        x = x.withColumn("bin", F.least(part, F.lit(BINS - 1)).cast("int"))
        ends = written(_end(_sums(x.select("source", "bin", "n_tokens", "key")), ends.select("source", "epochs", "rest", "start")), "ends")
    x = d.join(F.broadcast(ends), "source")
    order = W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    inside = F.col("key").between(F.col("low"), F.col("high"))
    edge = x.where(inside).withColumn("sum", F.sum("n_tokens").over(order) + F.col("start"))
    edge = edge.withColumn("copies", F.col("epochs") + (F.col("sum") <= F.col("rest")).cast("int"))
    rest = x.where(~inside).withColumn("copies", F.col("epochs") + (F.col("key") < F.col("low")).cast("int"))
    cols = ["doc_id", "source", "n_tokens", F.col("copies").cast("int").alias("copies")]
    return rest.select(*cols).unionByName(edge.select(*cols)).where(F.col("copies") > 0)


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, n_tokens, actual_share, most_copies) per target; a target without documents has share 0."""
    m = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    m = m.withColumn("actual_share", F.col("n_tokens") / F.sum("n_tokens").over(W.partitionBy()))  # a row per source
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return targets.select("source", "target_share").join(m, "source", "left").select("source", "target_share", zero("n_docs", 0), zero("n_tokens", 0), zero("actual_share", 0.0), zero("most_copies", 0))
