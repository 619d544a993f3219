"""Near duplicates by word shingles: a Jaccard self join with PartEnum signatures, and its connected components.

Texts of equal shingle sets are one class. Sets are put into bands by size; two similar sets lie in one band or in neighbouring ones, so
each set signs for its own band and the next. Within a band similar sets differ in at most k shingles. The feature domain is partitioned by hash: with more
than k parts that hold anything, similar sets agree on a whole part, whose contents are the signature; for small k, subsets of k+2 parts are enumerated. A set with too few
filled parts signs again under another partition, in the end with its empty parts too, so no similar pair is lost.

A signature that few classes share makes pairs, which must agree as often as the pigeonhole principle says, and are then verified on the whole sets. A class with too many widely shared signatures
is joined by its rarest shingles instead (prefix filtering, ordered by frequency among such classes), central classes first, then what is still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, in_small_batches, materialize, text_groups, worker_cache

WIDTH = 5
NUM, DEN = 75, 100
#: Parts for each unit of k+1; the surplus leaves room for parts that are empty or widely shared.
SURPLUS = 1.5
#: Up to this k, subsets of parts are enumerated.
SUBSETS = 3
SALTS = 4
#: Signatures shared by more classes than this go the way by rare shingles.
SHARED = 16
#: Signatures of a bucket, about; a bucket is what one task compares.
PER_BUCKET = 2_000_000
#: Characters of the texts that a task works on at once.
GROUP = 1 << 20
#: Up to so many ids (8 bytes each) are broadcast.
IDS = 200_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word's bytes."""
    raw = words.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    octets = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(U) + U(1)
    sizes = np.diff(ends)
    powers = np.cumprod(np.r_[U(1), np.full(int(sizes.max(initial=1)), U(0x9E3779B97F4A7C15))])
    within = np.arange(len(octets)) - np.repeat(ends[:-1] - ends[0], sizes)
    out = np.zeros(len(sizes), U)
    filled = sizes > 0
    if filled.any():
        out[filled] = np.add.reduceat(mix(octets * powers[within]), (ends[:-1] - ends[0])[filled])
    return mix(out + sizes.astype(U))


def shingle_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text end to end, and the number of each."""
    column = pc.ascii_lower(pa.array(texts, pa.large_string()))
    for space in "\t\n\x0b\x0c\r":
        column = pc.replace_substring(column, space, " ")
    lists = pc.split_pattern(column, " ")
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    words, owner = word_hashes(coded.dictionary)[coded.indices.to_numpy()][filled], owner[filled]
    counts = np.bincount(owner, minlength=len(texts))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words of the text from here on
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
    rolled, reach = np.zeros(len(words), U), np.minimum(left, width)
    for j in range(min(width, len(words))):
        more = words[j:] * U((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64)
        rolled[: len(more)] += np.where(reach[: len(more)] > j, mix(more), U(0))
    keep = (left >= width) | (first & (left < width))
    hashes, owner = mix(rolled[keep] + reach[keep].astype(U)), owner[keep]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.empty(0, bool)
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def set_classes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits of each set; 0 for an empty one."""
    out = np.zeros(len(counts), U)
    filled = counts > 0
    if filled.any():
        out[filled] = mix(np.add.reduceat(mix(hashes ^ U(0x5851F42D4C957F2D)), (np.cumsum(counts) - counts)[filled]) + counts[filled].astype(U)) | U(1)
    return out.view(np.int64)


def bands(largest: int) -> np.ndarray:
    """The largest size of each band."""
    ends, low = [], 1
    while not ends or ends[-1] < largest:
        ends.append(low * DEN // NUM)
        low = ends[-1] + 1
    return np.array([*ends, low * DEN // NUM], np.int64)


def may_differ(sizes: np.ndarray | int) -> np.ndarray | int:
    """Shingles in which two similar sets of these sizes together differ at most."""
    return (DEN - NUM) * sizes // (DEN + NUM)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and signature, and for each set its slack: how many of its signatures may be useless before a similar set could be missed."""
    ends = bands(int(counts.max(initial=1)))
    band = np.searchsorted(ends, counts)
    starts = np.cumsum(counts) - counts
    owners, signs, slack = [], [], np.full(len(counts), np.iinfo(np.int32).max, np.int64)
    for ahead in (0, 1):
        top = ends[band + ahead]
        k = may_differ(2 * top)
        low = np.where(band + ahead > 0, ends[band + ahead - 1] + 1, 1)
        todo = np.flatnonzero((counts > 0) & (k > 0) & (counts * DEN >= NUM * low))
        for salt in range(SALTS + 1):
            if not len(todo):
                break
            sizes = counts[todo]
            member = np.repeat(starts[todo] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            row = np.repeat(np.arange(len(todo)), sizes)
            parts = np.where(k[todo] <= SUBSETS, k[todo] + 2, np.ceil(SURPLUS * (k[todo] + 1)).astype(np.int64))
            offset = np.cumsum(parts) - parts
            value = mix(hashes[member] + U((salt + 1) * 0xD1342543DE82EF95 % 2**64))
            part = offset[row] + ((value >> U(32)) * parts[row].astype(U) >> U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, begin = np.unique(part[order], return_index=True)
            content = np.zeros(parts.sum(), U)
            content[at] = np.add.reduceat(value[order], begin)
            full = np.zeros(len(content), bool)
            full[at] = True
            of = np.repeat(np.arange(len(todo)), parts)
            tag = mix(np.arange(len(content)).astype(U) - offset[of].astype(U) + (band[todo][of] + ahead).astype(U) * U(1 << 20) + U(salt) * U(1 << 40))
            filled = np.bincount(of, full, len(todo)).astype(np.int64)
            few = k[todo] <= SUBSETS
            safe = np.where(few, parts - filled < 2, filled > k[todo])
            if salt == 0:
                spare = np.where(few, np.where(safe, 1, 0), np.maximum(filled - k[todo], 0))
                slack[todo] = np.minimum(slack[todo], spare)
            take = ~few[of] & (full | ((salt == SALTS) & ~safe[of]))
            owners.append(todo[of[take]])
            signs.append(mix(content[take] + tag[take]))
            for size in range(3, SUBSETS + 3):  # sets whose parts number size: all pairs of parts
                rows = np.flatnonzero(few & (parts == size))
                for a, b in combinations(range(size), 2):
                    i, j = offset[rows] + a, offset[rows] + b
                    good = full[i] | full[j] | ((salt == SALTS) & ~safe[rows])
                    owners.append(todo[rows[good]])
                    signs.append(mix((content[i] + tag[i] + mix(content[j] + tag[j]))[good]))
            todo = todo[~safe]
    return np.concatenate([np.empty(0, np.int64), *owners]), np.concatenate([np.empty(0, U), *signs]), np.minimum(slack, 1 << 30)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tag, n_shingles, class``; class 0 has no shingles, the tag is a hash of the text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("partenum")
        for batch in batches:
            done = 0
            for texts in text_groups(batch.column(2), GROUP):
                hashes, counts = shingle_sets(texts)
                ids = [batch.column(i).slice(done, len(texts)) for i in (0, 1)]
                yield pa.record_batch([*ids, pa.array(counts, pa.int64()), pa.array(set_classes(hashes, counts))], ["doc_id", "tag", "n_shingles", "class"])
                done += len(texts)

    rows = _texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, tag long, n_shingles long, class long")


def spread(owner: np.ndarray, sign: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures without those of all but the first SHARED + 1 owners of each, and how many each class lost."""
    order = np.argsort(sign, kind="stable")
    begins = np.flatnonzero(np.r_[True, sign[order][1:] != sign[order][:-1]])
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    over = order[place > SHARED]
    keep = np.ones(len(sign), bool)
    keep[over] = False
    return owner[keep], sign[keep], np.bincount(owner[over], minlength=classes)


def signed(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Signatures dealt by bucket. A row holds, for one bucket and a group of texts, the classes with their slack and number of signatures, and
    the signatures' low 40 bits in two columns; equal classes of the group sign once. Of a signature that more than SHARED classes of the group share, SHARED + 1 go to
    its bucket, so that no bucket fills with it; the others are known to share it widely, and ``wides`` counts that in a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("partenum")
        for batch in batches:
            for texts in text_groups(batch.column(0), GROUP):
                hashes, counts = shingle_sets(texts)
                found = set_classes(hashes, counts)
                _, once = np.unique(found, return_index=True)
                once = np.sort(once)
                pick = np.repeat(np.isin(np.arange(len(counts)), once), counts)
                found, hashes, counts = found[once], hashes[pick], counts[once]
                owner, sign, slack = signatures(hashes, counts)
                if not len(owner):
                    continue
                owner, sign, wides = spread(owner, sign, len(counts))
                bucket = ((sign >> U(40)) % U(buckets)).astype(np.int64)
                order = np.lexsort((owner, bucket))
                owner, sign, bucket = owner[order], sign[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                rows = []
                for i, j in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
                    own, n = np.unique(owner[i:j], return_counts=True)
                    rows.append((int(bucket[i]), found[own].tobytes(), slack[own].astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), sign[i:j].astype(np.uint32).tobytes(), (sign[i:j] >> U(32)).astype(np.uint8).tobytes(), bytes(4 * len(own))))
                if wides.any():
                    own = np.flatnonzero(wides)
                    rows.append((int(found[own[0]].view(U) % U(buckets)), found[own].tobytes(), slack[own].astype(np.int32).tobytes(), bytes(4 * len(own)), b"", b"", wides[own].astype(np.int32).tobytes()))
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], ["bucket", "classes", "slacks", "counts", "low", "high", "wides"])

    return _texts(docs, id_col, text_col).select("text").mapInArrow(run, "bucket int, classes binary, slacks binary, counts binary, low binary, high binary, wides binary")


def collisions(rows: DataFrame) -> DataFrame:
    """``a, b, slack_a, slack_b, n``: classes that share n rarely shared signatures; and with null b, n widely shared signatures of a (at least as many as there are: a class
    whose texts lie in several groups may count one twice, which only makes it rely less on signatures)."""

    def run(table: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name].combine_chunks()])
        counts, classes, slacks, wides = whole("counts", np.int32), whole("classes", np.int64), whole("slacks", np.int32), whole("wides", np.int32)
        owner, slack = np.repeat(classes, counts), np.repeat(slacks, counts)
        sign = whole("low", np.uint32).astype(np.int64) | whole("high", np.uint8).astype(np.int64) << 32
        order = np.lexsort((owner, sign))
        owner, slack, sign = owner[order], slack[order], sign[order]
        new = np.r_[np.full(min(1, len(sign)), True), (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1])]
        owner, slack, sign = owner[new], slack[new], sign[new]
        begins = np.flatnonzero(np.r_[np.full(min(1, len(sign)), True), sign[1:] != sign[:-1]])
        sizes = np.diff(np.r_[begins, len(sign)])
        left, right = [], []
        for size in range(2, SHARED + 1):  # groups of few classes: their pairs, of which a class has less than SHARED
            at = begins[sizes == size]
            for i, j in combinations(range(size), 2) if len(at) else ():
                left.append(at + i)
                right.append(at + j)
        out = []
        if wides.any():
            at = np.flatnonzero(wides)
            out.append(pa.table([classes[at], pa.nulls(len(at), pa.int64()), slacks[at], pa.nulls(len(at), pa.int32()), wides[at].astype(np.int64)], ["a", "b", "slack_a", "slack_b", "n"]))
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            order = np.lexsort((owner[right], owner[left]))
            left, right = left[order], right[order]
            first = np.flatnonzero(np.r_[True, (owner[left][1:] != owner[left][:-1]) | (owner[right][1:] != owner[right][:-1])])
            n = np.diff(np.r_[first, len(left)])
            l, r = left[first], right[first]
            out.append(pa.table([owner[l], pa.array(owner[r]), slack[l], pa.array(slack[r]), n.astype(np.int64)], ["a", "b", "slack_a", "slack_b", "n"]))
        wide = np.repeat(sizes > SHARED, sizes)
        if wide.any():
            who, first, n = np.unique(owner[wide], return_index=True, return_counts=True)
            out.append(pa.table([who, pa.nulls(len(who), pa.int64()), slack[wide][first], pa.nulls(len(who), pa.int32()), n.astype(np.int64)], ["a", "b", "slack_a", "slack_b", "n"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())], ["a", "b", "slack_a", "slack_b", "n"])

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long, slack_a int, slack_b int, n long")


def class_sets(docs: DataFrame, representatives: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``class, n, shingles binary`` of the classes whose representative's id is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("partenum")
        for batch in batches:
            for texts in text_groups(batch.column(0), GROUP):
                hashes, counts = shingle_sets(texts)
                ends = np.cumsum(counts)
                sets = [hashes[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
                yield pa.record_batch([pa.array(set_classes(hashes, counts)), pa.array(counts, pa.int64()), pa.array(sets, pa.binary())], ["class", "n", "shingles"])

    ids = broadcast_if_small(representatives.select(F.col("doc_id").alias("__id")).distinct(), IDS)
    texts = _texts(docs, id_col, text_col)
    chosen = texts.join(ids, texts["doc_id"] == ids["__id"], "left_semi").select("text")
    return chosen.mapInArrow(run, "class long, n long, shingles binary").dropDuplicates(["class"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are similar, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("partenum")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(DEN * same >= NUM * (len(both) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("x")), sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("y"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").filter((F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM))
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``class, component``: the smallest class reachable. Rounds of taking the smallest neighbouring label and then the label's label."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), "component"), "b").groupBy(F.col("a").alias("class")).agg(F.min("component").alias("near"))
        lower = materialize(labels.join(near, "class").select("class", F.least("component", "near").alias("component"), F.col("component").alias("old")))
        # labels that are to be replaced themselves: few soon, so that a large component is seldom shuffled by its one label
        target = lower.filter("component < class").select(F.col("class").alias("component"), F.col("component").alias("jump")).join(lower.select("component").distinct(), "component", "left_semi")
        stepped = materialize(lower.join(broadcast_if_small(target, IDS), "component", "left").select("class", F.coalesce("jump", "component").alias("component"), (F.coalesce("jump", "component") != F.col("old")).alias("moved")))
        labels = stepped.select("class", "component")
        if stepped.filter("moved").isEmpty():
            return labels


def join_split(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a table of one row a key. Keys of more than a thousandth of the rows are fewer than a thousand: their rows of the table are broadcast, all
    others are shuffled."""
    total = rows.count()
    frequent = materialize(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(total) / 1000).select(key))
    hot = one.join(F.broadcast(frequent), key, "left_semi")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(frequent), key, "left_anti").join(one, key))


def by_rare_shingles(sets: DataFrame) -> DataFrame:
    """Links among the given classes by prefix filtering.

    Shingles are ordered by their frequency among these classes, rare ones first. Similar sets share one of the first shingles, and from the
    first shared one on enough must be left in both; for that the smaller set's must be among its very first ones. Each shingle's most
    central class (fewest shingles of its own) is compared with the others first; then only classes still apart are."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, n, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                hashes = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.record_batch([pa.array(np.full(len(hashes), who.as_py())), pa.array(np.full(len(hashes), n.as_py())), pa.array(hashes)], ["class", "n", "shingle"])

    each = materialize(sets.select("class", "n", "shingles").mapInArrow(split, "class long, n long, shingle long"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("df"))
    counted = each.join(shared, "shingle").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    alone = F.size(F.filter("s", lambda x: x["df"] == 1)) / F.col("n")
    probed = (F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1).cast("int")
    rare = counted.select("class", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), probed)).alias("pos", "x")).filter("x.df > 1")
    early = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * NUM) / (NUM + DEN))
    groups = materialize(rare.select("class", "n", "alone", "pos", F.col("x.shingle").alias("shingle"), early.alias("early")))

    def may_link(na: str, pa_: str, nb: str, pb: str) -> Column:
        """Sizes near enough, and enough left after the shared shingle in both."""
        a, b = F.col(na), F.col(nb)
        left = F.least(a - F.col(pa_), b - F.col(pb))
        return (a * DEN >= b * NUM) & (b * DEN >= a * NUM) & (left * (NUM + DEN) >= NUM * (a + b))

    central = groups.filter("early").groupBy("shingle").agg(F.min(F.struct("alone", "class", "n", "pos")).alias("c"))
    central = central.select("shingle", F.col("c.class").alias("a"), F.col("c.n").alias("na"), F.col("c.pos").alias("pa"))
    star = join_split(groups, materialize(central), "shingle").filter((F.col("a") != F.col("class")) & may_link("n", "pos", "na", "pa"))
    direct = materialize(verified(star.select("a", F.col("class").alias("b")).distinct(), sets))
    labels = components(direct)
    named = materialize(groups.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class")))
    split_up = materialize(named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("early").alias("any")).filter("low < high AND any").select("shingle"))
    apart = materialize(join_split(named, split_up, "shingle"))
    l = apart.filter("early").select("shingle", F.col("class").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
    r = apart.select("shingle", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    also = (F.col("na") == F.col("nb")) & (F.col("a") > F.col("b"))  # of equal sizes either may be the early one
    more = l.join(r, (l["shingle"] == r["shingle"]) & (F.col("ca") != F.col("cb")) & (smaller | also) & may_link("na", "pa", "nb", "pb"))
    return materialize(direct.union(verified(more.select("a", "b").distinct(), sets)))


def links(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b``: links between classes; enough of them to connect what is connected."""
    total = known.agg(F.sum("n_shingles").alias("n")).collect()[0]["n"] or 0
    found = materialize(collisions(signed(docs, max(1, int(total * 1.2) // PER_BUCKET + 1), id_col, text_col)))
    wide = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("wide"), F.min("slack_a").alias("slack"))
    wide = materialize(wide)
    pairs = found.filter("b is not null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("slack_a").alias("slack_a"), F.min("slack_b").alias("slack_b"))
    wa, wb = wide.select("a", F.col("wide").alias("wa")), wide.select(F.col("a").alias("b"), F.col("wide").alias("wb"))
    pairs = pairs.join(wa, "a", "left").join(wb, "b", "left")
    least = F.greatest(F.col("slack_a") - F.coalesce("wa", F.lit(0)), F.col("slack_b") - F.coalesce("wb", F.lit(0)), F.lit(1))
    pairs = materialize(pairs.filter(F.col("n") >= least).select("a", "b"))
    rest = wide.filter("wide >= slack").select(F.col("a").alias("class"))  # too few rarely shared signatures to rely on
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(rest).distinct()
    representative = known.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    sets = materialize(class_sets(docs, representative.join(needed, "class"), id_col, text_col))
    direct = materialize(verified(pairs, sets))
    if rest.isEmpty():
        return direct
    return direct.union(by_rare_shingles(sets.join(rest, "class", "left_semi")))


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, tag, n_shingles, class, component_id, main``: each row with its component's name, and the class that keeps the name."""
    known = materialize(classes(docs, id_col, text_col))
    filled = known.filter("class != 0")
    names = filled.groupBy("class").agg(F.min("doc_id").alias("name"))
    labels = components(links(docs, filled.filter("doc_id is not null"), id_col, text_col))
    named = names.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min(F.when(F.col("name").isNotNull(), F.struct("name", "class"))).alias("m"))
    of_class = materialize(named.join(lowest, "component").select("class", F.col("m.name").alias("component_id"), F.coalesce("m.class", "component").alias("main")))
    rows = known.join(of_class, "class", "left")
    return rows.withColumn("component_id", F.when(F.col("class") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per input row.

    Words are lower-cased in A-Z and split at ASCII white space; a text with fewer than five words is one shingle, one without words (or null) has none and links
    with nothing. Sets are equal and similar by 64-bit hashes of their shingles. A component is named by its smallest id. Rows that repeat an id keep
    their own rows; a null id is no name and cannot represent its class, so a class of null ids alone stays by itself with a null name."""
    return _labelled(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, without the members of each component but its smallest id.

    A row is known by its id and its text, so an id that stands under several texts loses only those that others represent; if such an id names a component that holds
    more than one of its texts, one of them stays. Rows that repeat both id and text are one document. Texts without words (null and empty ones too) all stay, as do
    rows of null id unless a row with an id represents them. The keys of rows that go are broadcast if few: then no text is shuffled."""
    rows = _labelled(docs, id_col, text_col).filter("class != 0 AND component_id IS NOT NULL")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("class") == F.col("main"))
    gone = broadcast_if_small(materialize(rows.filter(~stays).select(F.col("doc_id").alias("__gone"), F.col("tag").alias("__tag")).distinct()), IDS)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__tag"]), "left_anti")


def similar(x: Column, y: Column) -> Column:
    """The exact test on two arrays of distinct shingles."""
    both = F.size(F.array_intersect(x, y))
    return DEN * both >= NUM * (F.size(x) + F.size(y) - both)
