"""Removal of long passages that occur more than once, by recompression.

Each round names runs of equal symbols and pairs of a left and a right symbol by what they hold, so all tasks give equal strings equal names. Whether neighbours join depends on them alone: a symbol's shape follows from
its own words and those of its neighbours in each round, its support. A passage that occurs twice has the same symbols at both places, edges aside. The Spark rounds: first, which symbols (with their support) occur more
than once anywhere; then, the windows that no unshared symbol rules out are named by their words and counted in the same way, which verifies them.

Texts lie in files of packs in the shared folder. A round sends each pack's distinct names, dealt to buckets by name, and one bit comes back for each name; texts are never shuffled, and as a pack sends a name once, a
passage that a third of all documents share is no larger a group than any other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, new_folder

WINDOW = 35
#: After five rounds a symbol holds some 4 words and its support some 24, so nearly every window of 35 holds supports; windows without one are verified all the same.
ROUNDS = 5
#: Bytes of text in a pack (a longer text is a pack of its own) and names in a bucket: both bound the memory of a task.
PACK, BUCKET = 8 << 20, 2_000_000
#: Buckets at least, for parallel work.
BUCKETS = 64
#: Tasks at most; each takes its packs one after another.
TASKS = 20_000
#: Beyond the ends of a document: no window reaches there.
FAR = 1 << 40


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all of the input."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _salt(*numbers: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(repr(numbers).encode()))


class Symbols(NamedTuple):
    """Consecutive symbols of all documents of a pack: name, first word and the one behind the last, support likewise, document."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def words_as_symbols(names: np.ndarray, doc: np.ndarray) -> Symbols:
    at = np.arange(len(names))
    return Symbols(names, at, at + 1, at, at + 1, doc)


def compress_round(s: Symbols, turn: int) -> Symbols:
    """Joins runs of equal symbols, and left symbols (or runs of them) with the right ones that follow. A symbol is left or right by a bit of its name, so each join needs its two neighbours only; that a symbol does
    not join further needs one neighbour more on each side, whose support it takes over."""
    if not len(s.name):
        return s
    left = (mixed(s.name + _salt(turn)) & np.uint64(1)).astype(bool)
    same_doc = s.doc[1:] == s.doc[:-1]
    equal = s.name[1:] == s.name[:-1]
    glued = same_doc & (equal | (left[:-1] & ~left[1:]))
    first = np.r_[0, np.flatnonzero(~glued) + 1]
    last = np.r_[first[1:], len(s.name)] - 1
    size = last - first + 1
    run = np.add.reduceat((s.name == np.repeat(s.name[first], size)).astype(np.int64), first)
    # a joined symbol is a^run b^(size-run)
    salt = [_salt(turn, k) for k in range(4)]
    name = mixed(s.name[first] * (salt[0] | np.uint64(1)) + mixed(s.name[last] + salt[1]) + mixed(run.astype(np.uint64) + salt[2]) * np.uint64(3) + mixed(size.astype(np.uint64) + salt[3]) * np.uint64(5))
    name = np.where(size == 1, s.name[first], name)
    edge_low, edge_high = np.r_[True, ~same_doc][first], np.r_[~same_doc, True][last]
    low = np.where(edge_low, -FAR, s.low[np.maximum(first - 1, 0)])
    high = np.where(edge_high, FAR, s.high[np.minimum(last + 1, len(s.name) - 1)])
    return Symbols(name, s.start[first], s.end[last], np.minimum(low, s.low[first]), np.maximum(high, s.high[last]), s.doc[first])


class Prefixes:
    """Names of any stretch of words, from running sums of a polynomial with odd base modulo 2^64."""

    def __init__(self, names: np.ndarray, seed: int):
        base, one = _salt(seed, 7) | np.uint64(1), np.ones(1, np.uint64)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.cumprod(np.r_[one, np.full(len(names), base)], dtype=np.uint64)
        self.back = np.cumprod(np.r_[one, np.full(len(names), inverse)], dtype=np.uint64)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(names + _salt(seed)) * power[:-1], dtype=np.uint64)]

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + mixed((end - start).astype(np.uint64)))


class Pack:
    """The words of a pack's texts: names end to end, and where each document begins."""

    def __init__(self, table: pa.Table, window: int):
        self.ids, self.window = table.column(0), window
        self.texts, self.found = table.column(1), None
        names, sizes = [], []
        for text in self.texts:
            words = self.words(text)
            names.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            sizes.append(len(words))
        self.sizes = np.array(sizes, np.int64)
        self.names = np.concatenate([np.empty(0, np.uint64), *names])
        self.upto = np.r_[0, np.cumsum(self.sizes)]

    @staticmethod
    def words(text: pa.Scalar) -> list[bytes]:
        """bytes.split() cuts at exactly the six ASCII white space characters."""
        return (text.as_py() or "").encode().split()

    def has_window(self) -> np.ndarray:
        """For each word whether a window begins there."""
        left = np.repeat(self.upto[1:], self.sizes) - np.arange(len(self.names))
        return left >= self.window

    def supports(self, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """The supports, of at most a window, of the symbols after the rounds."""
        if self.found is not None:
            return self.found
        s = words_as_symbols(self.names, np.repeat(np.arange(len(self.sizes)), self.sizes))
        for turn in range(rounds):
            s = compress_round(s, turn)
        fits = (s.low > -FAR) & (s.high < FAR)
        low, high = s.low[fits], s.high[fits]
        fits = high - low <= self.window
        self.found = low[fits], high[fits]
        return self.found


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the stretches."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


Keys = Callable[[Pack, dict], np.ndarray]


def support_keys(pack: Pack, answers: dict) -> np.ndarray:
    """One column: the names of all supports. Names that meet by chance cost work in the next round, never a wrong result."""
    low, high = pack.supports()
    return Prefixes(pack.names, 1).name(low, high)[:, None]


def candidate_windows(pack: Pack, shared: np.ndarray) -> np.ndarray:
    """Where the windows begin that hold no support which occurs only once."""
    low, high = pack.supports()
    free = ~covered(np.maximum(high[~shared] - pack.window, 0), low[~shared] + 1, len(pack.names))
    return np.flatnonzero(pack.has_window() & free)


def window_keys(pack: Pack, answers: dict) -> np.ndarray:
    """Two columns, 128 bits: the names of the candidate windows."""
    at = candidate_windows(pack, answers["supports"])
    return np.stack([Prefixes(pack.names, seed).name(at, at + pack.window) for seed in (2, 3)], axis=1)


ROUND_KEYS: dict[str, Keys] = {"supports": support_keys, "windows": window_keys}


class Sent(NamedTuple):
    """Distinct keys in order, whether each occurs again in the pack, and the place of every key among them."""

    keys: np.ndarray
    again: np.ndarray
    place: np.ndarray


def distinct(keys: np.ndarray) -> Sent:
    order = np.lexsort(keys.T[::-1])
    ordered = keys[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)][: len(keys)]
    number = np.cumsum(new) - 1
    place = np.empty(len(keys), np.int64)
    place[order] = number
    return Sent(ordered[new], np.bincount(number, minlength=int(new.sum())) > 1, place)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the leading 32 bits, so that keys in order are buckets in order."""
    return ((keys[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def repeated(table: pa.Table) -> pa.Table:
    """The answers of a bucket: for each pack's keys, in order, whether a key occurs more than once in all."""
    again = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8)) for x in table["again"]]
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]]
    width = table["width"][0].as_py()
    keys = [k.reshape(-1, width) for k in keys]
    sizes = [len(k) for k in keys]
    found = distinct(np.concatenate(keys))
    flagged = np.concatenate([a[:n] for a, n in zip(again, sizes, strict=True)]).astype(bool)
    several = found.again.copy()
    np.logical_or.at(several, found.place, flagged)
    out = np.split(several[found.place], np.cumsum(sizes)[:-1])
    return pa.table({"pack": table["pack"], "bucket": table["bucket"], "bits": pa.array([np.packbits(x).tobytes() for x in out], pa.binary())})


def write_packs(docs: DataFrame, id_col: str, text_col: str, most: int = PACK) -> tuple[DataFrame, str]:
    """``pack, words``: files of whole texts in a shared folder. A file counts only by its row here, so what a lost task leaves behind is never read."""
    folder = new_folder(docs.sparkSession, "packs")

    def write(table: pa.Table) -> pa.RecordBatch:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        pack = uuid.uuid4().hex
        pq.write_table(table, f"{root}/{pack}", filesystem=fs, compression="zstd", use_dictionary=False)
        words = sum(len(Pack.words(t)) for t in table.column(1))
        return pa.record_batch([pa.array([pack]), pa.array([words], pa.int64())], ["pack", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(lengths, most - size + (lengths[at - 1] if at else 0), side="right"))
                upto = max(upto, at if held else at + 1)
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    size += int(lengths[upto - 1] - (lengths[at - 1] if at else 0))
                if upto < batch.num_rows:
                    yield write(pa.Table.from_batches(held))
                    held, size = [], 0
                at = upto
        if held:
            yield write(pa.Table.from_batches(held))

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(texts.mapInArrow(run, "pack string, words long")), folder


def _reader(folder: str, window: int) -> Callable[[str], Pack]:
    fs, root = pafs.FileSystem.from_uri(folder)
    return lambda pack: Pack(pq.read_table(f"{root}/{pack}", filesystem=fs), window)


def _answers(row: dict, names: list[str], pack: Pack) -> dict:
    """The bits of earlier rounds, dealt out to all keys of the pack again."""
    out = {}
    for name in names:
        sent = distinct(ROUND_KEYS[name](pack, out))
        counts = np.bincount(bucket_of(sent.keys, row["buckets"]))
        bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8))[: counts[a["bucket"]]] for a in row[name] or []]
        out[name] = np.concatenate([np.empty(0, np.uint8), *bits]).astype(bool)[sent.place]
    return out


def _spread(packs: DataFrame) -> DataFrame:
    return packs.repartitionByRange(max(1, min(packs.count(), TASKS)), "pack")


def ask(packs: DataFrame, folder: str, window: int, known: list[str], name: str) -> DataFrame:
    """The packs with the answers of one round more: a column of the bits of each bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder, window)
        for batch in batches:
            for row in batch.to_pylist():
                pack = read(row["pack"])
                sent = distinct(ROUND_KEYS[name](pack, _answers(row, known, pack)))
                bucket = bucket_of(sent.keys, row["buckets"])
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
                ends = np.r_[starts[1:], len(bucket)][: len(starts)]
                for i in range(0, len(starts), 1024):
                    some = list(zip(starts[i : i + 1024].tolist(), ends[i : i + 1024].tolist(), strict=True))
                    keys, again = [sent.keys[s:e].tobytes() for s, e in some], [np.packbits(sent.again[s:e]).tobytes() for s, e in some]
                    columns = [pa.array([row["pack"]] * len(some)), pa.array(bucket[starts[i : i + 1024]]), pa.array(keys, pa.binary()), pa.array(again, pa.binary())]
                    yield pa.record_batch([*columns, pa.array([sent.keys.shape[1]] * len(some), pa.int32())], ["pack", "bucket", "keys", "again", "width"])

    sent = _spread(packs).mapInArrow(send, "pack string, bucket long, keys binary, again binary, width int")
    found = sent.groupBy("bucket").applyInArrow(repeated, "pack string, bucket long, bits binary")
    answers = found.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias(name))
    return materialize(packs.join(answers, "pack", "left"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", pack_bytes: int = PACK) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256``: each word goes that lies in a window of so many words which occurs anywhere else too, in the same document or another; what is left is joined by single spaces.

    Windows are judged on the input. Every row gives a row, and rows that repeat are copies of each other. A null, empty or white text has no words, a text shorter than a window loses none. A run of one word longer than a
    window holds the window twice and goes. Words are told apart by 64-bit hashes, windows by 128."""
    packs, folder = write_packs(docs, id_col, text_col, pack_bytes)
    words = packs.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    packs = packs.withColumn("buckets", F.lit(int(max(BUCKETS, -(-words // BUCKET)))))
    known: list[str] = []
    for name in ROUND_KEYS:
        packs = ask(packs, folder, window, list(known), name)
        known.append(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder, window)
        for batch in batches:
            for row in batch.to_pylist():
                pack = read(row["pack"])
                answers = _answers(row, known, pack)
                at = candidate_windows(pack, answers["supports"])[answers["windows"]]
                keep = ~covered(at, at + window, len(pack.names))
                n_kept = np.diff(np.r_[0, np.cumsum(keep)][pack.upto])
                texts = (b" ".join(compress(pack.words(t), keep[s:e].tolist()) if n < e - s else pack.words(t)) for t, s, e, n in zip(pack.texts, pack.upto[:-1].tolist(), pack.upto[1:].tolist(), n_kept.tolist(), strict=True))
                kept = list(texts)
                digests = [hashlib.sha256(t).hexdigest() for t in kept]
                table = pa.table([pack.ids, pa.array(pack.sizes), pa.array(pack.sizes - n_kept), pa.array([t.decode() for t in kept], pa.string()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
                yield from table.to_batches(max_chunksize=4096)

    kind = docs.schema[id_col].dataType.simpleString()
    return _spread(packs).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
