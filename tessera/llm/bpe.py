"""Byte-level BPE with a hierarchical-bitmap rank queue.

All pieces of a batch lie end to end in one array of symbols, linked as a list whose links never cross a piece's end,
so one queue serves one piece of any length and many short ones alike. A bucket for each merge rank holds positions
whose pair had that rank when it was queued; a bitmap of ranks and a bitmap of its words find the lowest bucket that
is not empty. Entries that an earlier merge made stale are skipped when the bucket is taken.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Remembered, in_small_batches, text_groups, worker_cache

#: Pieces that a worker remembers from earlier rows, and as many old ones.
REMEMBERED = 250_000
#: Characters of the texts that a task works on at once.
GROUP = 1 << 20
#: Bytes of new pieces that are merged at once.
CHUNK = 1 << 22


def _runs(keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Of sorted keys: each distinct one, where it begins and where it ends."""
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)]


class RankQueue:
    """Buckets of positions by rank under a hierarchy of bitmaps: 64 ranks to a word, 64 words to a block.

    An entry waits at its block, moves to its word when the block is the lowest, and to its rank's bucket when the
    word is. So a push touches few lists, however many ranks it brings."""

    def __init__(self, ranks: int):
        blocks = ranks // 4096 + 1
        self.blocks = 0  # bit b: block b holds something
        self.words = [0] * blocks
        self.ranks = [0] * (blocks * 64)
        self.at_block: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(blocks)]
        self.at_word: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(blocks * 64)]
        self.at_rank: dict[int, list[np.ndarray]] = {}
        self.block = self.word = -1  # the lowest ones as of the last pop

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        for block, i, j in zip(*_runs(ranks >> 12), strict=True):
            if block == self.block:
                self._to_words(ranks[i:j], positions[i:j])
            else:
                self.at_block[block].append((ranks[i:j], positions[i:j]))
            self.blocks |= 1 << block

    def _to_words(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        for word, i, j in zip(*_runs(ranks >> 6), strict=True):
            if word == self.word:
                self._to_ranks(ranks[i:j], positions[i:j])
            else:
                self.at_word[word].append((ranks[i:j], positions[i:j]))
            self.words[word >> 6] |= 1 << (word & 63)

    def _to_ranks(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        for rank, i, j in zip(*_runs(ranks), strict=True):
            self.at_rank.setdefault(rank, []).append(positions[i:j])
            self.ranks[rank >> 6] |= 1 << (rank & 63)

    @staticmethod
    def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ranks, positions = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(ranks, kind="stable")
        return ranks[order], positions[order]

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank that has entries, and its positions in ascending order."""
        while self.blocks:
            self.block = block = (self.blocks & -self.blocks).bit_length() - 1
            if self.at_block[block]:
                self.word = -1
                self._to_words(*self._joined(self.at_block[block]))
            while bits := self.words[block]:
                self.word = word = (block << 6) + (bits & -bits).bit_length() - 1
                if self.at_word[word]:
                    self._to_ranks(*self._joined(self.at_word[word]))
                if found := self.ranks[word]:
                    rank = (word << 6) + (found & -found).bit_length() - 1
                    self.ranks[word] = found & (found - 1)
                    parts = self.at_rank.pop(rank)
                    found = np.sort(parts[0] if len(parts) == 1 else np.concatenate(parts))
                    return rank, found[np.r_[True, found[1:] != found[:-1]]]
                self.words[block] = bits & (bits - 1)
            self.blocks &= self.blocks - 1
        return None


class PairTable:
    """(left id, right id) -> rank by open addressing in numpy arrays; pairs without a merge give -1."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        todo, ranked = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(todo)
        self.probes = 0
        while len(todo):
            self.probes += 1
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.values[at[first]] = todo[first], ranked[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, ranked, at = todo[rest], ranked[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


class Codec:
    """Encoder and decoder for one file of ranks (base64 of a token's bytes, then its rank, on each line)."""

    def __init__(self, lines: Sequence[bytes], pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.table = PairTable(self.ranks)
        ids = range(max(self.tokens, default=-1) + 1)
        self.bytes_of = pa.array([self.tokens.get(i, b"") for i in ids], pa.large_binary())
        self.digits_of = pa.array([b"%d," % i for i in ids], pa.large_binary())
        self.known = Remembered(REMEMBERED)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces end to end, and the number of each. Pieces are independent; equal lowest ranks merge from the left."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        ends = np.cumsum(sizes)
        following = np.arange(1, n + 2, dtype=np.int64)
        following[ends[sizes > 0] - 1] = n  # n: no neighbour
        previous = np.arange(-1, n, dtype=np.int64)
        starts = (ends - sizes)[sizes > 0]
        previous[starts] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        pair = np.full(n + 1, -1, np.int32)  # the rank of the pair that starts here
        queue = RankQueue(max(self.tokens, default=0) + 1)
        has = np.flatnonzero(following[:n] < n)
        pair[has] = self.table.find(ids[has], ids[following[has]])
        has = has[pair[has] >= 0]
        queue.push(pair[has], has)
        while (top := queue.pop()) is not None:
            rank, at = top
            at = at[alive[at] & (pair[at] == rank)]  # the rest is stale
            if not len(at):
                continue
            after = following[at]
            if len(at) > 1 and (chained := np.r_[False, after[:-1] == at[1:]]).any():
                # a run like aaaa: every second pair, counted from where the run starts
                index = np.arange(len(at))
                run = np.maximum.accumulate(np.where(chained, 0, index))
                keep = (index - run) % 2 == 0
                at, after = at[keep], after[keep]
            ids[at] = rank
            alive[after] = False
            beyond = following[after]
            following[at] = beyond
            inner = beyond < n
            previous[beyond[inner]] = at[inner]
            before = previous[at]
            left = before[before < n]
            touched = np.concatenate([left, at])  # some twice: the queue drops doubles
            touched = touched[alive[touched]]
            right = following[touched]
            ok = right < n
            pair[touched[~ok]] = -1
            touched, right = touched[ok], right[ok]
            pair[touched] = found = self.table.find(ids[touched], ids[right])
            queue.push(found[found >= 0], touched[found >= 0])
        at = np.flatnonzero(alive[:n])
        return ids[at], np.diff(np.r_[0, np.searchsorted(at, ends)])

    def _learn(self, pieces: list[str]) -> None:
        while pieces:
            size, count = 0, 0
            while count < len(pieces) and (size < CHUNK or not count):
                size += len(pieces[count])
                count += 1
            self.known.add(pieces[:count], *self.merge([p.encode() for p in pieces[:count]]))
            pieces = pieces[count:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and the number of each."""
        found = [self.pattern.findall(text) for text in texts]
        pieces = list(chain.from_iterable(found))
        self._learn(self.known.absent(list(dict.fromkeys(pieces))))
        ids, sizes = self.known.get(self.known.places(pieces))
        upto = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]]
        return ids, np.diff(upto)


def written(ids: np.ndarray, counts: np.ndarray, strings: pa.Array) -> Iterator[memoryview]:
    """For each document, whose ids lie end to end, the strings of its ids one after another."""
    taken = strings.take(pa.array(ids))
    upto = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1][np.r_[0, np.cumsum(counts)]].tolist()
    raw = memoryview(taken.buffers()[2] or b"")
    for start, end in zip(upto, upto[1:], strict=False):
        yield raw[start:end]


def _codec(shared) -> Codec:
    """One codec for each worker process and vocabulary."""
    lines, pattern = shared.value
    kept = worker_cache("bpe")
    if (key := hash((pattern, lines))) not in kept:
        kept[key] = Codec(lines.splitlines(), pattern)
    return kept[key]


def _vocabulary(df: DataFrame, path: str, pattern: str):
    with open(path, "rb") as file:  # a parameter of the driver; under 1 MB, its size does not follow the data
        return df.sparkSession.sparkContext.broadcast((file.read(), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for each row; a null or empty text has no ids. The whole text is encoded, piece by
    piece of ``pattern``; rows may repeat. Ids equal those of the rank file's own library."""
    shared = _vocabulary(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            done = 0
            for group in text_groups(batch.column(1), GROUP):
                ids, counts = codec.encode(group)
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([batch.column(0).slice(done, len(group)), lists], ["doc_id", "ids"])
                done += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, bytes binary``: the bytes that the ids stand for; null ids give no bytes."""
    shared = _vocabulary(encoded, path, r"\X")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _codec(shared).bytes_of
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            out = [bytes(x) for x in written(batch.column(1).flatten().to_numpy(), counts, strings)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return in_small_batches(encoded).select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, bytes binary")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the encoder's ids and of the bytes decoded from each document's ids, in one
    pass: texts, ids and bytes never leave the task. Null text counts as empty; every row gives a row."""
    shared = _vocabulary(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            done = 0
            for group in text_groups(batch.column(1), GROUP):
                ids, counts = codec.encode(group)
                listed = [hashlib.sha256(x[:-1]).hexdigest() for x in written(ids, counts, codec.digits_of)]  # without the last comma
                decoded = [hashlib.sha256(x).hexdigest() for x in written(ids, counts, codec.bytes_of)]
                yield pa.record_batch([batch.column(0).slice(done, len(group)), pa.array(counts), pa.array(listed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
