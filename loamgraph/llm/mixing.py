"""Mixing sources to target weights on a low-discrepancy schedule.

Slots of the mix are numbered 0, 1, 2, ... The points frac((i + 1) / golden ratio) are spread so evenly
that, mapped through the cumulative weights, every stretch of slots has each source's share up to a
constant error. The r-th slot of a source takes the r-th block of the source, which is its documents in a
shuffled order, cut into blocks of equal tokens; each pass over a small source is shuffled anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .prefix import BUCKETS, with_running_sum

GOLDEN = 0.6180339887498949
BLOCK_TOKENS = 4096
#: How far from its target share a source may be, as a share of it, to count as met.
MET = 0.01


def quotas(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, quota, n_docs): tokens each target source is to give.

    docs: (source, doc_id, tokens); targets: (source, target_share, max_repeats). Sources without target
    have no quota. Shares are scaled to add up to 1. Without total_tokens the mix is as large as it can be
    with the shares of all sources that have documents met; a share is limited by tokens * max_repeats.
    """
    have = docs.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_docs"))
    want = (
        targets.where("source is not null and target_share > 0").groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
        .withColumn("target_share", F.col("target_share") / F.sum("target_share").over(Window.partitionBy()))
    )
    both = want.join(have, "source", "left").na.fill(0, ["available", "n_docs"])
    most = F.col("available") * F.col("max_repeats")
    if total_tokens is None:
        feasible = F.min(F.when(most > 0, most / F.col("target_share"))).over(Window.partitionBy())
        size = F.floor(F.coalesce(feasible, F.lit(0.0)) + 1e-6)
    else:
        size = F.lit(int(total_tokens))
    return both.withColumn("quota", F.least(most, F.floor(F.col("target_share") * size + 0.5)).cast("bigint"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, block, epoch, doc_id, tokens): the documents of the mix; order by slot, epoch and start.

    docs: (source, doc_id, tokens) with one row per document; null or non-positive sizes take no part. No
    document occurs more than max_repeats times. A source takes the documents of which at least half lies within its quota;
    where a large one at the border leaves a gap, documents behind it that fit fill the gap.
    """
    plan = cut(quotas(docs, targets, total_tokens).where("quota > 0"))
    # the plan has one row per target source, a short fixed list
    chosen = docs.where("tokens > 0 and doc_id is not null").join(F.broadcast(plan.select("source", "available", "quota")), "source")
    passes = chosen.select(
        "source", "doc_id", F.col("tokens").cast("bigint").alias("tokens"), "available", "quota",
        F.explode(F.expr("sequence(0, int(ceil(quota / available)) - 1)")).alias("epoch"),
    )
    h = F.xxhash64("doc_id", "epoch", F.lit("mix"))
    passes = cut(passes.withColumn("h", h).withColumn("part", F.floor((F.col("h") / 2.0**64 + 0.5) * BUCKETS).cast("int")))
    placed = with_running_sum(passes, ["source", "epoch"], "part", ["h", "doc_id"], "tokens", "before").withColumn(
        "start", F.col("before") + F.col("epoch") * F.col("available")
    )
    placed = cut(placed)
    inside = F.col("start") + F.col("tokens") / 2 < F.col("quota")
    used = placed.where(inside).groupBy("source").agg(F.sum("tokens").alias("used"))  # one row per target source
    rest = placed.where(~inside).drop("before", "start").join(F.broadcast(used), "source").where("tokens <= quota - used")
    more = with_running_sum(rest, ["source"], "part", ["h", "doc_id"], "tokens", "before").where("before + tokens <= quota - used")
    more = more.withColumn("start", F.col("used") + F.col("before")).select(*placed.columns)
    placed = placed.where(inside).unionByName(more).withColumn("block", F.floor(F.col("start") / block_tokens).cast("bigint"))
    rows = plan.select("source", "quota").orderBy("source").collect()  # one per target source
    size = sum(r["quota"] for r in rows)
    slots = max(1, -(-size // block_tokens)) + 2 * len(rows)
    point = F.expr(f"pmod((id + 1) * {GOLDEN!r}D, 1.0D)")
    upto, source = 0.0, F.lit(rows[-1]["source"] if rows else None)
    cases = []
    for r in rows[:-1]:
        upto += r["quota"] / size
        cases.append((upto, r["source"]))
    for bound, name in reversed(cases):
        source = F.when(point < bound, F.lit(name)).otherwise(source)
    plan_slots = docs.sparkSession.range(slots).select(F.col("id").alias("slot"), source.cast("string").alias("source"), F.lit(1).alias("one"), F.floor(F.col("id") * BUCKETS / slots).cast("int").alias("part"))
    ranked = with_running_sum(plan_slots, ["source"], "part", ["slot"], "one", "block").select("source", "block", "slot")
    # the few last blocks of a source for which no slot is left follow at the end
    return placed.join(ranked, ["source", "block"], "left").select(
        F.coalesce("slot", F.lit(slots) + F.col("block")).alias("slot"), "source", "block", "epoch", "doc_id", "tokens", "start"
    )


def share_report(docs: DataFrame, targets: DataFrame, mixed: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: target, attainable and actual share, tokens, documents, most uses of a document, and whether the share is met.

    The attainable share is the target among the sources that have documents to give, 0 for the others. Met means that the
    actual share is within MET of it; a source without documents, or with too few at max_repeats, is not met.
    """
    use = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    per = use.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    plan = quotas(docs, targets, total_tokens).select("source", "target_share", "max_repeats", "available")
    out = plan.join(per, "source", "left").na.fill(0, ["tokens", "n_docs", "most_uses"])
    all_ = Window.partitionBy()  # a row per target source
    actual = F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(all_), F.lit(0)), F.lit(0.0))
    gives = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    attainable = F.coalesce(F.try_divide(gives, F.sum(gives).over(all_)), F.lit(0.0))
    return out.select(
        "source", F.round("target_share", 6).alias("target_share"), F.round(attainable, 6).alias("attainable_share"), F.round(actual, 6).alias("actual_share"), "tokens", "available", "n_docs", "most_uses", "max_repeats",
        ((attainable > 0) & (F.abs(actual - attainable) <= MET * attainable)).alias("met"),
    )
