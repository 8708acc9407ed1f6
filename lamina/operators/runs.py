"""Runs of blocks: what is provisioned, what differs between two maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a share that is scanned by itself; runs that touch its edges are joined afterwards, two at most from each share.
SHARE = 1 << 16


def label_runs(blocks: DataFrame, share: int = SHARE) -> DataFrame:
    """label, start, end of the maximal runs of neighbouring blocks with one label; blocks has a row for each block."""
    own = blocks.select("label", "block", F.floor(F.col("block") / share).alias("_share"))
    order = Window.partitionBy("_share", "label").orderBy("block")
    inner = own.withColumn("_g", F.col("block") - F.row_number().over(order)).groupBy("_share", "label", "_g").agg(F.min("block").alias("start"), (F.max("block") + 1).alias("end"))
    edge = (F.col("start") % share == 0) | (F.col("end") % share == 0)
    across = Window.partitionBy("label").orderBy("start")
    cut = F.coalesce(F.col("start") != F.lag("end").over(across), F.lit(True)).cast("int")
    joined = inner.where(edge).withColumn("_cut", cut).withColumn("_g", F.sum("_cut").over(across)).groupBy("label", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return inner.where(~edge).select("label", "start", "end").unionByName(joined.select("label", "start", "end"))


def with_holes(runs: DataFrame, length: Column, hole, share: int = SHARE) -> DataFrame:
    """The runs, and those of what lies between them in 0..length, labelled `hole`. Each run's follower is looked for in its share, then
    among the shares' first runs."""
    own = runs.withColumn("_share", F.floor(F.col("start") / share))
    firsts = own.groupBy("_share").agg(F.min("start").alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.orderBy("_share"))).select("_share", "_after")
    follow = own.join(after, "_share").withColumn("_next", F.coalesce(F.lead("start").over(Window.partitionBy("_share").orderBy("start")), "_after"))
    label = F.lit(hole)
    gaps = follow.select(label.alias("label"), F.col("end").alias("start"), F.coalesce("_next", length).alias("end"))
    head = runs.agg(F.coalesce(F.min("start"), length).alias("end")).select(label.alias("label"), F.lit(0).cast("long").alias("start"), "end")
    return runs.unionByName(gaps.unionByName(head).where("start < end"))


def run_iter(blocks: DataFrame, length: Column, share: int = SHARE) -> DataFrame:
    """label (whether provisioned), start, end over 0..length."""
    return with_holes(label_runs(blocks.select(F.lit(True).alias("label"), "block"), share), length, False, share)


def dual_labels(left: DataFrame, right: DataFrame) -> DataFrame:
    """block, label (left, right, both) of the blocks in either."""
    both = left.select("block", F.lit(1).alias("s")).unionByName(right.select("block", F.lit(2).alias("s")))
    return both.groupBy("block").agg(F.bit_or("s").alias("s")).select("block", F.element_at(F.array(*map(F.lit, ("left", "right", "both"))), F.col("s")).alias("label"))


def dual_iter(left: DataFrame, right: DataFrame, length: Column, share: int = SHARE) -> DataFrame:
    """label (left, right, both, neither), start, end over 0..length."""
    return with_holes(label_runs(dual_labels(left, right), share), length, "neither", share)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """block, change of each block in either map: an addition if it is new or maps elsewhere, a removal, or unchanged."""
    value = F.struct("data_block", "time")
    both = old.select("block", value.alias("o")).join(new.select("block", value.alias("n")), "block", "full_outer")
    change = F.when(F.col("n").isNull(), "removal").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("addition")
    return both.select("block", change.alias("change"))


def delta_chunks(old: DataFrame, new: DataFrame, length: Column, block_bytes: int, share: int = SHARE) -> DataFrame:
    """kind, pos, len in bytes: what a delta reads (mapped), drops (unmapped) and takes from the old recipe (ref)."""
    changed = snapshot_diff(old, new).where("change <> 'unchanged'")
    runs = with_holes(label_runs(changed.select("block", F.when(F.col("change") == "addition", "mapped").otherwise("unmapped").alias("label")), share), length, "ref", share)
    return runs.select(F.col("label").alias("kind"), (F.col("start") * block_bytes).alias("pos"), ((F.col("end") - F.col("start")) * block_bytes).alias("len"))


def restore_actions(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """block, action: blocks of wanted (block, value; value null where it is a hole) against a device's (block, value). Equal
    data is skipped and other data written; a hole's block is discarded where the device has it and passed over where not."""
    both = wanted.select("block", F.col("value").alias("w"), F.lit(True).alias("_w")).join(present.select("block", F.col("value").alias("p"), F.lit(True).alias("_p")), "block", "full_outer")
    mapped = F.col("w").isNotNull()
    action = F.when(mapped & F.col("w").eqNullSafe(F.col("p")), "skip").when(mapped, "write").when(F.col("_p"), "discard").otherwise("forward")
    return both.select("block", action.alias("action"))
