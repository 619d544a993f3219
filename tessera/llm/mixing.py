"""Mixing sources to target weights with hash-threshold histograms; DataFrame operations only.

Each document has a hash of its id. A source's words are summed by hash bucket; the bucket in which the budget runs out is split again by the next hash bits, twice, so the budget becomes a hash threshold
without any sort of documents. Whole copies come first; the threshold decides who gets one copy more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, broadcast_if_small, free_names, materialize

#: Hash bits of each level: 48 in all, so that at the last level a bucket holds a single document but for chance; only the boundary bucket meets the finer levels.
BITS = (12, 18, 18)
CAP = 3.0
WEIGHTS = (1, 2, 3)
#: Up to so many sources, their limits (about 60 bytes each) are broadcast.
SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size`` to these and ``target``: shares of all words by weight, none above cap times the
    source's size, the excess reshared among the others. Weights go round in code point order, null last. One row per
    source: the windows see only those sums. Sources are capped in the order of size over weight, so one pass of
    running sums finds the fixed point."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = weighed.withColumn("total", F.sum("source_size").over(everything)).withColumn("is_capped", level > F.col("most") / F.col("weight"))
    left = F.col("total") - F.sum(F.when(F.col("is_capped"), F.col("most")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(~F.col("is_capped"), F.col("weight")).otherwise(0.0)).over(everything)
    return capped.select("source", "source_size", F.when(F.col("is_capped"), F.col("most")).otherwise(F.least("most", F.col("weight") * left / free)).alias("target"))


def _crossing(histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source with budget left: the bucket in which the running sum reaches the budget, the words before it and in it."""
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = histogram.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    b = budgets.select(F.col("source").alias("s"), "budget")
    hit = summed.join(b, F.col("source").eqNullSafe(F.col("s"))).filter("budget > 0 and before < budget and before + words >= budget")
    return hit.select("source", "bucket", "budget", "before", "words")


def _hash(id_col: str) -> Column:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, sum(BITS) // 4), 16, 10).cast("long")


def _words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix_limits(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, target, whole, threshold`` for rows of ``source, size, h``: all rows are taken ``whole``
    times, those with h under the threshold once more."""
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = materialize(targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    bucket = lambda level: F.shiftright("h", sum(BITS[level + 1 :]))
    budgets, rows = targets.select("source", "budget"), sized
    for level in range(len(BITS)):
        histogram = rows.groupBy("source", bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        cross = materialize(_crossing(histogram, budgets))
        if level < len(BITS) - 1:  # only the boundary bucket's rows go on
            edge = cross.select(F.col("source").alias("s"), F.col("bucket").alias("b"))
            rows = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (bucket(level) == F.col("b")), "left_semi")
            budgets = cross.select("source", (F.col("budget") - F.col("before")).alias("budget"))
    nearer = F.when(F.col("before") + F.col("words") - F.col("budget") <= F.col("budget") - F.col("before"), 1).otherwise(0)
    limits = cross.select(F.col("source").alias("s"), (F.col("bucket") + nearer).alias("threshold"))
    joined = targets.join(limits, F.col("source").eqNullSafe(F.col("s")), "left")
    return materialize(joined.select("source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    Size is the number of words (null text: 0). ``copies`` is how often the mix repeats the document, at most cap
    times; ``taken`` is copies times size. A source is at most half a document, the one at its threshold, off its
    target. The hash depends on the id alone, so reruns agree and repeated rows share their fate. A null id hashes as an
    empty one; a source without words has target 0 and takes nothing."""
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _words(text_col).alias("size"), _hash(id_col).alias("h")))
    limits = broadcast_if_small(mix_limits(sized, weights, cap).withColumnRenamed("source", "s"), SOURCES)
    copies = F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    joined = sized.join(limits, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: each row as often as plan_mix says, with all its columns. Only the limits, one row per source,
    join the texts, which therefore need no shuffle. Helper columns take names that the table lacks. Nulls and repeated rows are as in plan_mix."""
    sized = materialize(docs.select(F.col(source_col).alias("source"), _words(text_col).alias("size"), _hash(id_col).alias("h")))
    own = free_names(docs, "mix_source", "mix_whole", "mix_threshold", "mix_hash", "mix_copy")
    source, whole, threshold, hashed, copy = own
    limits = mix_limits(sized, weights, cap).select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("threshold").alias(threshold))
    joined = docs.withColumn(hashed, _hash(id_col)).join(broadcast_if_small(limits, SOURCES), F.col(source_col).eqNullSafe(F.col(source)))
    copies = (F.col(whole) + F.when(F.col(hashed) < F.col(threshold), 1).otherwise(0)).cast("int")
    repeats = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))
    return joined.withColumn(copy, repeats).drop(*own)
