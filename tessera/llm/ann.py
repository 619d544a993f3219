"""Nearest neighbours by an inverted multi-index.

Two codebooks quantise the two halves of a vector apart; a cell is a pair of centroids. A query walks the pairs by summed distance with a heap until their cells
hold enough entries, the cells' entries are joined to it, and exact distances on the original vectors rank them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, materialize

#: Vectors the codebooks are fitted on, those with the smallest hashes; all vectors are indexed.
SAMPLE = 16_384
#: A query reranks at least so many entries, and at least the share of them that holds so much of the true neighbours of PROBED vectors within the sample. Vectors
#: without any structure (uniform on a sphere in 64 dimensions) need some 0.4 of the entries, clustered ones a small fraction.
RERANK, HELD, PROBED = 1_000, 0.95, 256
NEAREST = 10
#: Centroids of a half follow the square root of the entries, up to this; the counts of all cells then take 2 MB.
MOST_CENTROIDS = 512
#: Mean entries of a cell.
PER_CELL = 1.5
#: Entries and queries of a first centroid that one task compares; more are dealt into blocks of either.
BLOCK, QUERIES = 4096, 4096
#: Up to so many result lists (about 200 bytes each) are broadcast to the query ids.
LISTS = 50_000


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v``: vectors that are not null, zero or of components null or not finite."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).filter(F.coalesce(fine, F.lit(False)))


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced points of the (hash-ordered) sample."""
    k = min(k, len(points))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_centre(points, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None], 0)


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)] or [np.empty(0, int)])


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> Iterator[int]:
    """Cells (first centroid * number of second ones + second) by ascending summed distance until they hold enough: a heap of the frontier
    of the sorted halves; every pair is pushed once."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, held = [(first[a[0]] + second[b[0]], 0, 0)], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if sizes[cell]:
            held += int(sizes[cell])
            yield cell
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))


class Codebooks:
    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2 if sample.ndim == 2 else 0
        self.first, self.second = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest_centre(vectors[:, : self.half], self.first) * len(self.second) + nearest_centre(vectors[:, self.half :], self.second)


def needed_share(sample: np.ndarray, books: Codebooks, k: int, held: float = HELD) -> float:
    """The share of entries that a walk must meet to hold so much of the true neighbours, measured within the sample."""
    if len(sample) < 2:
        return 1.0
    cells = books.cells(sample)
    one, two = cells // len(books.second), cells % len(books.second)
    shares = []
    for at in np.unique(np.linspace(0, len(sample) - 1, PROBED).astype(int)):
        q = sample[at : at + 1]
        exact = ((sample - q) ** 2).sum(axis=1)
        exact[at] = np.inf
        summed = distances(q[:, : books.half], books.first)[0][one] + distances(q[:, books.half :], books.second)[0][two]
        near = np.argsort(exact, kind="stable")[: min(k, len(sample) - 1)]
        shares.append(np.searchsorted(np.sort(summed), summed[near], side="right") / len(sample))
    return float(np.quantile(np.concatenate(shares), held))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, every: int = 100, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, share: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every`` its k nearest others found.

    A query reranks at least ``rerank`` entries and ``share`` of all; without a share it is measured on the sample. Equal vectors are one entry with its k+1 smallest ids and
    queries of equal vectors one probe, so a vector that fills the table costs as much as any other. Between vectors of different widths there is no distance, so each width
    is searched by itself. Rows that repeat an id and vector are one. Fewer candidates than k give all of them; an empty table gives no rows. Distances are in double
    precision, ties go to the smaller id."""
    rows = usable(vectors, id_col, vec_col)
    widths = sorted(r["width"] for r in rows.select(F.size("v").alias("width")).distinct().collect())
    found = vectors.sparkSession.createDataFrame([], RESULT)
    for width in widths:
        found = found.unionByName(_search_width(rows.filter(F.size("v") == width), width, every, k, rerank, share, sample))
    return found


def _search_width(rows: DataFrame, width: int, every: int, k: int, rerank: int, share: float | None, sample: int) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.withColumn("key", F.concat_ws(" ", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    ranked = Window.partitionBy("key", "v").orderBy("vec_id")
    # the rank limit is applied before the shuffle too, so a vector that fills the table sends few rows
    entries = materialize(rows.withColumn("place", F.dense_rank().over(ranked)).filter(F.col("place") <= k + 1).groupBy("key", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    n = entries.count()
    learnt = np.array([r["v"] for r in entries.orderBy(F.xxhash64("key")).limit(sample).select("v").collect()])
    books = Codebooks(learnt, int(np.clip(round((n / PER_CELL) ** 0.5), 1, MOST_CENTROIDS)))
    enough = max(rerank, int(np.ceil((needed_share(learnt, books, k) if share is None else share) * n)))
    shared = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.cells(_matrix(batch.column(1), width))
            yield pa.record_batch([pa.array(cells, pa.int32()), *batch.columns], ["cell", "key", "v", "ids"])

    indexed = materialize(entries.select("key", "v", "ids").mapInArrow(assign, "cell int, key string, v array<double>, ids array<long>"))
    sizes = np.zeros(len(books.first) * len(books.second), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # a row a cell, of which there are at most MOST_CENTROIDS squared
        sizes[r["cell"]] = r["count"]
    held = spark.sparkContext.broadcast(sizes)
    wanted = rows.filter(F.col("vec_id") % every == 0)
    seconds = len(books.second)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each first centroid that the walk meets, with the second ones as bits."""
        b = shared.value
        for batch in batches:
            q = _matrix(batch.column(1), width)
            one, two = distances(q[:, : b.half], b.first), distances(q[:, b.half :], b.second)
            for i in range(len(q)):
                met = np.zeros((len(b.first), seconds), bool)
                met.reshape(-1)[list(walk(one[i], two[i], held.value, enough))] = True
                first = np.flatnonzero(met.any(axis=1))
                bits = [x.tobytes() for x in np.packbits(met[first], axis=1)]
                yield pa.record_batch([pa.array(first, pa.int32()), pa.array(bits, pa.binary()), batch.column(0).take(pa.array([i] * len(first), pa.int64()))], ["first", "bits", "query"])

    # another expression than the aggregate's key, and a given number: else Spark packs the few small rows into one task
    queries = materialize(wanted.groupBy("key").agg(F.first("v").alias("v")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("key", F.lit(1))))
    walked = materialize(queries.mapInArrow(probe, "first int, bits binary, query string"))
    asked = {r["first"]: r["count"] for r in walked.groupBy("first").count().collect()}  # at most MOST_CENTROIDS rows
    per_first = sizes.reshape(-1, seconds).sum(axis=1)
    deals = [(f, int(-(-per_first[f] // BLOCK)), int(-(-m // QUERIES))) for f, m in sorted(asked.items())]
    deal = F.broadcast(spark.createDataFrame(deals, "first int, blocks int, asking int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    probes = walked.join(deal, "first").withColumn("part", F.pmod(F.xxhash64("query", "first"), F.col("asking").cast("long")).cast("int")).withColumn("block", upto("blocks"))
    probes = probes.join(queries.select(F.col("key").alias("query"), F.col("v").alias("q")), "query").select("first", "block", "part", "bits", "query", "q")
    dealt = indexed.withColumn("first", F.floor(F.col("cell") / seconds).cast("int")).join(deal, "first").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("part", upto("asking")).select("first", "block", "part", (F.col("cell") % seconds).alias("second"), "v", "ids")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            entries, second = _matrix(right["v"].combine_chunks(), width), right["second"].to_numpy()
            ids = right["ids"].combine_chunks()
            for at in range(left.num_rows):
                q = _matrix(left["q"].slice(at, 1).combine_chunks(), width)[0]
                asked = np.flatnonzero(np.unpackbits(np.frombuffer(left["bits"][at].as_py(), np.uint8))[second])
                exact = np.sqrt(((entries[asked] - q) ** 2).sum(axis=1))
                cut = np.partition(exact, k)[k] if len(exact) > k + 1 else np.inf
                near = np.flatnonzero(exact <= cut)  # ties at the cut stay, to be settled by id
                found.append(pa.table([left["query"].take(pa.array([at] * len(near), pa.int64())), pa.array(exact[near]), ids.take(pa.array(asked[near]))], ["query", "score", "ids"]))
        return pa.concat_tables(found) if found else pa.table([pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.list_(pa.int64()))], ["query", "score", "ids"])

    keys = ["first", "block", "part"]
    close = probes.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(nearest, "query string, score double, ids array<long>")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    singles = close.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = materialize(singles.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found")))
    ids = wanted.select("vec_id", "key").distinct()
    own = ids.join(broadcast_if_small(lists, LISTS), F.col("key") == F.col("query")).withColumn("me", F.col("vec_id"))
    others = own.select("me", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("me")), 1, k).alias("found"))
    return others.select("me", F.posexplode("found").alias("pos", "x")).select(F.col("me").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
