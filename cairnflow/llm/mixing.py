"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.llm.common import broadcast_if_small, saved

#: A token of the size: a run of characters that are neither a space nor U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: The hash of a row has LEVELS digits of BITS bits; each refinement reads one digit more of the boundary bucket alone.
BITS, LEVELS = 15, 4


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the MD5 of id and text: reruns agree, whatever the partitions."""
    text = F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, shares: tuple[float, ...], weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(share, source, source_size, target) of each source and share of the total.

    Sources in order of code points, null last, have `weights` in turn. With the cap max_repeats * source_size the
    excess is reshared by weight until no source is above its cap: sources in order of cap / weight fill up first, so one
    running sum finds the level at which the others stop. A source of no words has target 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))) + 1).cast("long"))
    sources = sources.withColumn("cap", F.col("source_size") * max_repeats).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    fill = Window.partitionBy("share").orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy("share"), fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("share") * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    sources = sources.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    stop = F.max(F.when(~F.col("full"), F.col("level"))).over(every)  # that of the first source that is not full
    target = F.when(F.col("full") | stop.isNull(), F.col("cap").cast("double")).otherwise(stop * F.col("w"))
    return sources.select("share", "source", "source_size", target.alias("target"))


def _refined(sizes: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    """`bounds` with one digit more: the boundary bucket of each source and share is split, and its boundary found.

    bounds: share, source, rest (words still to take), prefix (the boundary bucket so far), below (words below it).
    """
    shift = BITS * (LEVELS - level)
    inside = sizes.withColumn("bucket", F.shiftright("hash", shift))
    edge = broadcast_if_small(bounds).alias("b")
    same = inside["source"].eqNullSafe(F.col("b.source")) & (F.shiftright("hash", shift + BITS) == F.col("b.prefix"))
    counts = inside.join(edge, same).groupBy("share", F.col("b.source").alias("source"), "rest", "below", "bucket").agg(F.sum("size").alias("n"))
    running = Window.partitionBy("share", "source").orderBy("bucket")
    counts = counts.withColumn("upto", F.col("below") + F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    # The bucket in which the rest is reached; the last one if rounding leaves it just out of reach.
    crossed = F.coalesce(F.min(F.when(F.col("upto") >= F.col("rest"), F.col("bucket"))).over(Window.partitionBy("share", "source")), F.max("bucket").over(Window.partitionBy("share", "source")))
    found = counts.withColumn("at", crossed).where("bucket = at")
    return found.select("share", "source", "rest", F.col("bucket").alias("prefix"), F.col("before").alias("below"), "upto")


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), row_hash(id_col, text_col).alias("hash"))
    return saved(rows, "mix-rows")


def mix_plan(rows: DataFrame, shares: tuple[float, ...], weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(share, of, source_size, target, whole, limit): rows of source `of` go `whole` times, and once more up to `limit`."""
    targets = source_targets(rows, shares, weights, max_repeats)
    whole = F.least(F.lit(max_repeats), F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).cast("long")
    targets = saved(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    zero = F.lit(0).cast("long")
    bounds = targets.where("rest > 0").select("share", "source", "rest", zero.alias("prefix"), zero.alias("below"))
    bounds = reduce(lambda b, level: saved(_refined(rows, b, level), "mix-bounds"), range(1, LEVELS + 1), bounds)
    # Now a bucket is one hash value.
    nearer = F.col("upto") - F.col("rest") <= F.col("rest") - F.col("below")
    limits = bounds.select(F.col("share").alias("s"), F.col("source").alias("of"), F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("limit"))
    plan = targets.join(limits, F.col("source").eqNullSafe(F.col("of")) & (F.col("share") == F.col("s")), "left")
    return saved(plan.select("share", F.col("source").alias("of"), "source_size", "target", "whole", F.coalesce("limit", F.lit(-1)).alias("limit")), "mix-plan")


def mix(docs: DataFrame, shares: tuple[float, ...] = (1.5,), weights: tuple[int, ...] = (3, 1, 2), max_repeats: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """For each row of `docs` and each share: how often the mix takes it.

    Returns share, id, source, size (words), source_size, target, copies and taken = copies * size. A source of target t
    takes all its rows t // source_size times, and once more those whose hash is up to a threshold. Thresholds come from
    histograms of words by source and hash bucket; only the bucket in which a budget ends is split further, so no rows
    are sorted, and the budgets of several shares are nested: a smaller budget's rows are a larger one's too. The row at
    the threshold is taken if that brings the source nearer to its target.

    Null texts and texts without words have size 0, null sources are a source, null ids hash as an empty id, rows equal
    in id and text go together, other columns are not read, and an empty table gives no rows.
    """
    rows = sized(docs, id_col, source_col, text_col)
    plan = broadcast_if_small(mix_plan(rows, shares, weights, max_repeats))
    taken = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).withColumn("copies", F.col("whole") + (F.col("hash") <= F.col("limit")).cast("long"))
    return taken.select("share", F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), max_repeats: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of `docs` as the mix takes them, with their columns: left out, once, or repeated.

    A row's copies follow from its source's plan and its own hash: only the few plans are joined, texts aren't shuffled.
    """
    plan = mix_plan(sized(docs, id_col, source_col, text_col), (share,), weights, max_repeats)
    plan = broadcast_if_small(plan.select(F.col("of").alias("mix_of"), F.col("whole").alias("mix_whole"), F.col("limit").alias("mix_limit")))
    copies = F.col("mix_whole") + (row_hash(id_col, text_col) <= F.col("mix_limit")).cast("long")
    joined = docs.join(plan, docs[source_col].eqNullSafe(plan["mix_of"]))
    return joined.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[docs[c] for c in docs.columns])
