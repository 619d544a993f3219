"""Exact dedup with a heavy-hitter split.

A Misra-Gries pass over the digests names the few that may fill whole partitions. Their winners are verified by an
exact count and broadcast (at most ``k`` rows), so their rows never shuffle; all other digests use one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, broadcast_if_small, materialize, worker_cache

#: Counters of a summary; also the most rows that are broadcast.
COUNTERS = 64
#: Up to so many groups, or rows that go (some 60 bytes each), are broadcast.
GROUPS = 200_000


def misra_gries(df: DataFrame, key: str, k: int = COUNTERS) -> DataFrame:
    """Candidates for keys with more than 1/(k+1) of the rows of some partition, with lower bounds of their counts.
    Summaries of partitions merge by adding; the k largest sums stay."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("dedup")
        counters: dict[bytes, int] = {}
        for batch in batches:
            for item in batch.column(0).drop_null().value_counts().to_pylist():
                counters[item["values"]] = counters.get(item["values"], 0) + item["counts"]
            if len(counters) > k:
                cut = sorted(counters.values(), reverse=True)[k]
                counters = {x: n - cut for x, n in counters.items() if n > cut}
        yield pa.record_batch([pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], ["key", "bound"])

    parts = df.select(F.col(key).alias("key")).mapInArrow(summarise, "key binary, bound long")
    return parts.groupBy("key").agg(F.sum("bound").alias("bound")).filter("bound > 1").orderBy(F.desc("bound"), "key").limit(k)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest id of a group
    stays; a null id is below all others and stays only if it is alone with nulls. Rows that repeat an id and its
    text are one document: each counts in ``group_size`` and all share ``kept``. Other columns are not read."""
    digests = materialize(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)).alias("digest")))
    frequent = misra_gries(digests, "digest", k).select(F.col("key").alias("digest"))
    winners = materialize(
        digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )  # at most k rows: exact counts of the candidates
    hot = digests.join(F.broadcast(winners), "digest")
    cold = digests.join(F.broadcast(winners), "digest", "left_anti")
    # counted with partial sums, so that a digest just below the frequent ones is no group in one task; then only groups of several rows join
    several = materialize(cold.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    joined = cold.join(broadcast_if_small(several, GROUPS), "digest", "left")
    cold = joined.select("digest", "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """The input rows that exact_dedup keeps, with all their columns. The ids and digests of those that go are broadcast if few: then no text is
    shuffled. Nulls and repeated rows are as in exact_dedup."""
    gone = exact_dedup(docs, id_col, text_col, k).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.unhex("text_sha256").alias("__gone_digest")).distinct()
    gone = broadcast_if_small(materialize(gone), GROUPS)
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone_id"]) & (digest == gone["__gone_digest"]), "left_anti")
