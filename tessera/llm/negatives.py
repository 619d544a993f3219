"""Hard negatives by a full score sort for each anchor.

Anchors meet all rows in blocks. For an anchor, a task computes the integer inner products with the rows of its block, sorts them by score and id, finds each positive's upper limit by binary search
and reads the following rows of other labels down to the lower limit. What the blocks find is ranked again. Two passes: the first finds the positives, whose scores are the limits of the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, materialize

#: Rows and anchors that one task compares: 8 MB of integers in 64 dimensions. A row is sent once for each block of anchors, an anchor once for each block of rows.
BLOCK, ANCHORS = 16_384, 16_384
#: Anchors whose scores a task holds at a time.
AT_ONCE = 64
#: Up to so many widths of vectors their numbers of blocks are broadcast.
WIDTHS = 10_000
LARGEST = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """``id, label, x``: rows without nulls whose components are all finite, each component floor(256 * x); equal rows are one."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).dropna()
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine).select("id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("x")).distinct()


def shifted_label(id_col: str = "vec_id", label_col: str = "label", every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the id is divisible by ``every``."""
    label = F.col(label_col)
    return F.when(F.col(id_col) % every == 0, (label + 1) % labels).otherwise(label)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: in floating point or 64 bits where they are exact, else in Python's integers, cut to +-LARGEST."""
    largest = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    bound = largest(anchors) * largest(rows) * max(1, anchors.shape[1])
    if bound < 1 << 53:
        return np.rint(anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound <= LARGEST:
        return anchors @ rows.T
    exact = anchors.astype(object) @ rows.astype(object).T
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def ranked(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by falling score, ties by rising id."""
    return np.lexsort((ids, -score))


def first_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k places of ``ranked``, sorting only what is not below the k-th score."""
    if len(score) <= k:
        return ranked(score, ids)[:k]
    near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return near[ranked(score[near], ids[near])[:k]]


def negatives_of(score: np.ndarray, ids: np.ndarray, limits: list[int], k: int, percent: int) -> list[np.ndarray]:
    """For each positive's score the first k places with percent * positive <= 100 * score <= 100 * positive, from one full sort."""
    order = ranked(score, ids)
    falling = -score[order]
    out = []
    for limit in limits:
        at = int(np.searchsorted(falling, -limit, side="left"))
        out.append(np.array([i for i in order[at : at + k] if 100 * int(score[i]) >= percent * limit], np.int64))
    return out


class _Block:
    """The rows of a block by label and id; a label's rows lie together."""

    def __init__(self, table: pa.Table, width: int):
        ids, labels = (table[c].to_numpy() for c in ("id", "label"))
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x = ids[order], labels[order], _matrix(table, width)[order]

    def of_label(self, label: int) -> slice:
        return slice(*(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right")))


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)


def _each(anchors: pa.Table, block: _Block, width: int) -> Iterator[tuple[int, np.ndarray]]:
    x = _matrix(anchors, width)
    for at in range(0, len(x), AT_ONCE):
        yield from enumerate(scores(x[at : at + AT_ONCE], block.x), at)


PART = pa.schema([("anchor", pa.int64()), ("who", pa.int64()), ("positive", pa.int64()), ("limit", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
PART_DDL = "anchor long, who long, positive long, limit long, other long, score long"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, schema=PART)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``, their positives the first other rows of the same label, and for each positive the negatives are the first rows of other labels whose scores lie between
    ``percent`` of the positive's score and that score. Rows with a null id, label or vector, or a component that is null or not finite, take no part; zero vectors do. Equal rows are one, a row is never its own
    partner, nor one with its id. Vectors of different widths do not meet. A negative positive score has no negatives below it within the percentage, so it gives none. Components and scores beyond 64 bits are cut
    to their range. Fewer partners than asked give all, an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col, F.col("label") if label is None else label).withColumn("width", F.size("x")))
    anchor = F.col("id") % every == 0
    per_width = rows.groupBy("width").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count(F.when(anchor, 1)) / ANCHORS).cast("int").alias("parts")).filter("parts > 0")
    deal = broadcast_if_small(materialize(per_width), WIDTHS)
    dealt_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda count, salt: F.pmod(F.xxhash64("id", "label", "x", F.lit(salt)), F.col(count).cast("long")).cast("int")
    keys = ["width", "block", "part"]
    # toDF gives the columns of this side identities of their own
    blocks = rows.toDF(*rows.columns).join(deal, "width").withColumn("block", place("blocks", 1)).withColumn("part", dealt_to("parts")).select(*keys, "id", "label", "x").groupBy(*keys)
    # rows that share an id are told apart by a hash
    anchors = rows.filter(anchor).withColumn("who", F.xxhash64("id", "label", "x"))

    def spread(df: DataFrame) -> DataFrame:
        return df.join(deal, "width").withColumn("part", place("parts", 2)).withColumn("block", dealt_to("blocks"))

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            width, block = left["width"][0].as_py(), _Block(right, left["width"][0].as_py())
            for (i, score), who, me, label in zip(_each(left, block, width), left["who"].to_pylist(), left["id"].to_pylist(), left["label"].to_pylist(), strict=True):
                same = block.of_label(label)
                ids, score = block.ids[same], score[same]
                others = np.flatnonzero(ids != me)
                near = others[first_of(score[others], ids[others], positives)]
                found += [(me, who, None, None, int(ids[j]), score[j]) for j in near]
        return _table(found)

    best = Window.partitionBy("anchor", "who").orderBy(F.desc("score"), "other")
    near = spread(anchors).select(*keys, "id", "who", "label", "x").groupBy(*keys).cogroup(blocks).applyInArrow(find_positives, PART_DDL)
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    lists = near.groupBy("anchor", "who").agg(F.collect_list(F.struct("score", "other")).alias("positives"))
    asking = materialize(anchors.join(lists, (F.col("id") == F.col("anchor")) & (lists["who"] == anchors["who"])).select("width", "id", anchors["who"], "label", "x", "positives"))

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            width, block = left["width"][0].as_py(), _Block(right, left["width"][0].as_py())
            for (i, score), who, me, label, near in zip(_each(left, block, width), *(left[c].to_pylist() for c in ("who", "id", "label", "positives")), strict=True):
                same = block.of_label(label)
                ids, other = np.delete(block.ids, same), np.delete(score, same)
                ids, other = ids[ids != me], other[ids != me]
                for p, places in zip(near, negatives_of(other, ids, [p["score"] for p in near], negatives, percent), strict=True):
                    found += [(me, who, p["other"], p["score"], int(ids[j]), other[j]) for j in places]
        return _table(found)

    hard = spread(asking).select(*keys, "id", "who", "label", "x", "positives").groupBy(*keys).cogroup(blocks).applyInArrow(find_negatives, PART_DDL)
    order = Window.partitionBy("anchor", "who", "positive", "limit").orderBy(F.desc("score"), "other")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return hard.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("limit").alias("positive_score"), F.col("score").alias("negative_score"))
