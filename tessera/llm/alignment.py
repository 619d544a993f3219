"""Alignment of two tokenizers by byte-owner arrays.

The tokens of A and B are spread over the bytes they stand for (``np.repeat`` of token numbers). Consecutive distinct owner pairs are the overlaps; where both owners change at once, both tokenizers cut.
Texts are split at single spaces between other characters, where both tokenizers cut whatever stands around, and each distinct part is aligned once while a worker remembers it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import written
from tessera.llm.common import Remembered, store, text_groups, worker_cache

#: Before a space and after it: no white space, nor what either tokenizer may take for one.
_OTHER = r"[^\s\u180e\u2581]"
CUT = re.compile(f"(?<={_OTHER})(?= {_OTHER})")
REGULAR = re.compile(f" {_OTHER}(?:.*{_OTHER})?", re.DOTALL)
#: Parts that a worker remembers (twice as many with the older ones), some 200 bytes each; characters encoded at once; characters of the texts taken together.
MOST, ROW, GROUP = 200_000, 4_000, 1 << 21
B_SIDE, LOST = np.uint32(1 << 31), np.uint32((1 << 32) - 1)


class Alignment(NamedTuple):
    a_ends: np.ndarray  # tokens of A before each cut
    b_ends: np.ndarray
    overlaps: np.ndarray  # pairs of token numbers that share bytes, in order


def owners(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Alignment:
    """Cuts and overlaps of two rows of tokens over the same bytes. A token without bytes owns none: it joins the group that follows, or the last."""
    a, b = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
    if not len(a):
        return Alignment(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.int64))
    new_a, new_b = np.diff(a) != 0, np.diff(b) != 0
    cut = np.r_[np.flatnonzero(new_a & new_b), len(a) - 1]
    first = np.r_[0, np.flatnonzero(new_a | new_b) + 1]
    a_ends, b_ends = a[cut] + 1, b[cut] + 1
    a_ends[-1], b_ends[-1] = len(a_sizes), len(b_sizes)
    return Alignment(a_ends, b_ends, np.stack([a[first], b[first]], axis=1))


class Aligned(NamedTuple):
    """The texts of a group end to end: ids, sizes and number for each text of both sides, and the alignment of all. Both owners change between texts."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    found: Alignment

    def upto(self, of_a: np.ndarray, right: bool = True) -> np.ndarray:
        """How many of rising places (numbers of A's tokens, or ends of theirs) lie before the end of each text, and 0 first."""
        return np.r_[0, np.searchsorted(of_a, np.cumsum(self.n_a), side="right" if right else "left")]


class Aligner:
    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json.decode()), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        byte_of = _byte_level()
        a_vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(a_vocab.values()) + 1)
        for token, i in a_vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        # the cuts hold only where no piece of B reaches over a space; else whole texts are parts
        self.cuts = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        digits = [f"{i}{mark}" for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for mark in marks for i in range(n)]
        self.digits = pa.array(digits, pa.large_string())
        self.known = Remembered(MOST)

    def parts(self, text: str) -> list[str]:
        """The text behind a space, in parts that each begin with one."""
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, strings: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides for strings that begin with a space, which B adds itself."""
        return [x.ids for x in self.a.encode_batch_fast(strings, add_special_tokens=False)], self.b.encode([s[1:] for s in strings], num_threads=1)

    def same_bytes(self, text: str, a: list[int], b: list[int]) -> bool:
        want = text.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want

    def learn(self, parts: list[str]) -> None:
        """Remembers the ids of new parts: those of A, then those of B with the highest bit set; LOST alone where the bytes do not come back. Parts that may stand next to each other are encoded in rows of some
        thousand characters and cut again by their bytes."""
        rows: list[list[str]] = [[]]
        size = 0
        for part in parts:
            inner = REGULAR.fullmatch(part) is not None and self.cuts
            if rows[-1] and (not inner or size > ROW):
                rows.append([])
                size = 0
            rows[-1].append(part)
            size = size + len(part) if inner else ROW + 1
        joined = ["".join(row) for row in rows if row]
        lists = []
        for row, text, a, b in zip(rows, joined, *self.encode(joined), strict=True):
            if not self.same_bytes(text, a, b):
                for part, *pair in zip(row, *self.encode(row), strict=True):
                    fine = self.same_bytes(part, *pair)
                    lists += [np.array(pair[0], np.uint32), np.array(pair[1], np.uint32) | B_SIDE] if fine else [np.array([LOST]), np.empty(0, np.uint32)]
                continue
            ends = np.cumsum([len(part.encode()) for part in row])
            ids = [np.array(a, np.uint32), np.array(b, np.uint32)]
            cuts = [np.searchsorted(np.cumsum(sizes[x]), ends, side="right") for sizes, x in zip((self.a_sizes, self.b_sizes), ids, strict=True)]
            a_split, b_split = np.split(ids[0], cuts[0][:-1]), np.split(ids[1] | B_SIDE, cuts[1][:-1])
            lists += [x for pair in zip(a_split, b_split, strict=True) for x in pair]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.known.add(parts, np.concatenate(lists), sizes[0::2] + sizes[1::2])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, marked as in ``learn``, and how many each has; none for a text that is empty or not given back."""
        split = [self.parts(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        if new := self.known.absent(list(dict.fromkeys(flat))):
            self.learn(new)
        ids, sizes = self.known.get(self.known.places(flat))
        upto = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]]
        counts = np.diff(upto)
        lost = np.unique(np.searchsorted(upto, np.flatnonzero(ids == LOST), side="right") - 1)
        if len(lost):
            pieces = np.split(ids, upto[1:-1])
            for i in lost.tolist():  # what the parts lose might still come out right together, so the whole text decides
                whole = " " + texts[i]
                (a,), (b,) = self.encode([whole])
                pieces[i] = np.r_[np.array(a, np.uint32), np.array(b, np.uint32) | B_SIDE] if self.same_bytes(whole, a, b) else np.empty(0, np.uint32)
            ids, counts = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        return ids, counts

    def align(self, texts: list[str]) -> Aligned:
        ids, counts = self.ids(texts)
        of_b = ids >= B_SIDE
        n_b = np.diff(np.r_[0, np.cumsum(of_b)][np.r_[0, np.cumsum(counts)]])
        a, b = ids[~of_b].astype(np.int64), (ids[of_b] ^ B_SIDE).astype(np.int64)
        a_sizes = self.a_sizes[a]
        return Aligned(a, b, a_sizes, counts - n_b, n_b, owners(a_sizes, self.b_sizes[b]))

    def written(self, x: Aligned) -> Iterator[memoryview]:
        """The groups of each text as text: ids with commas, a bar after the last of A, a semicolon after the last of B."""
        a_ends, b_ends = x.found.a_ends, x.found.b_ends
        a_group, b_group = (np.repeat(np.arange(len(e)), np.diff(np.r_[0, e])) for e in (a_ends, b_ends))
        a_last, b_last = (np.isin(np.arange(e[-1]) + 1, e, assume_unique=True) if len(e) else np.empty(0, bool) for e in (a_ends, b_ends))
        out = np.empty(len(x.a) + len(x.b), np.int64)
        out[np.arange(len(x.a)) + np.r_[0, b_ends][a_group]] = x.a + len(self.a_bytes) * a_last
        out[np.arange(len(x.b)) + a_ends[b_group]] = 2 * len(self.a_bytes) + x.b + len(self.b_bytes) * b_last
        return written(out, x.n_a + x.n_b, self.digits)


def _byte_level() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable Latin-1 ones stand for themselves, the other bytes for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def _files(spark, a_path: str, b_path: str):
    """Both vocabularies, parameters of the driver whose size does not follow the data."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def _aligner(shared) -> Aligner:
    kept = worker_cache("alignment")
    if (key := hash(shared.value)) not in kept:
        kept[key] = Aligner(*shared.value)
    return kept[key]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), docs.schema[id_col].dataType.simpleString()


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, start, end, a_ids, b_ids``: each group of each text in order, with its bytes in space+text. Texts that are null, empty or not given back by a tokenizer have no groups."""
    shared = _files(docs.sparkSession, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            done = 0
            for group in text_groups(batch.column(1), GROUP):
                x = aligner.align(group)
                a_ends, b_ends, cuts = x.found.a_ends, x.found.b_ends, x.upto(x.found.a_ends)
                whose = np.repeat(np.arange(len(group)), np.diff(cuts))
                ends = np.cumsum(x.a_sizes)[a_ends - 1] if len(a_ends) else np.empty(0, np.int64)
                before = np.r_[0, ends][cuts[:-1]][whose]
                lists = [pa.ListArray.from_arrays(np.r_[0, e].astype(np.int32), pa.array(i.astype(np.int32))) for e, i in ((a_ends, x.a), (b_ends, x.b))]
                numbers = [pa.array((np.arange(len(ends)) - cuts[whose]).astype(np.int32)), pa.array(np.r_[0, ends][:-1] - before), pa.array(ends - before)]
                yield pa.record_batch([batch.column(0).take(pa.array(done + whose)), *numbers, *lists], ["doc_id", "place", "start", "end", "a_ids", "b_ids"])
                done += len(group)

    texts, kind = _texts(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {kind}, place int, start long, end long, a_ids array<int>, b_ids array<int>")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256`` and the distinct links of each text (``links, times``). Every row gives a row, repeated ones too; texts that are null, empty or not given
    back by a tokenizer have zeros, no links and '' as digest. Each cut links the two tokens that end there."""
    shared = _files(docs.sparkSession, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            done = 0
            for group in text_groups(batch.column(1), GROUP):
                x = aligner.align(group)
                cuts, laps = x.upto(x.found.a_ends), x.upto(x.found.overlaps[:, 0], right=False)
                links = np.split(x.a[x.found.a_ends - 1] * len(aligner.b_bytes) + x.b[x.found.b_ends - 1], cuts[1:-1])
                distinct = [np.unique(codes, return_counts=True) for codes in links]
                digests = [hashlib.sha256(t[:-1]).hexdigest() if len(t) else "" for t in aligner.written(x)]  # without the last semicolon
                upto = pa.array(np.r_[0, np.cumsum([len(codes) for codes, _ in distinct])].astype(np.int32))
                lists = [pa.ListArray.from_arrays(upto, pa.array(np.concatenate([d[k] for d in distinct]).astype(kind))) for k, kind in ((0, np.int64), (1, np.int32))]
                numbers = [pa.array(n) for n in (x.n_a, x.n_b, np.diff(cuts), np.diff(laps), np.diff(cuts))]
                yield pa.record_batch([batch.column(0).slice(done, len(group)), *numbers, pa.array(digests), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups_sha256", "links", "times"])
                done += len(group)

    texts, kind = _texts(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string, links array<long>, times array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """``link, count`` over all texts. Tokens are linked only if the bytes of one end with those of the other, so the vocabularies bound the rows, not the texts: some 600,000 for the given two."""
    return aligned.select(F.explode(F.arrays_zip("links", "times")).alias("x")).groupBy(F.col("x.links").alias("link")).agg(F.sum("x.times").alias("count"))


def link_strengths(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``align`` without the lists, with ``n_best`` (links whose pair is the most frequent of its id of B over all texts, ties included) and ``count_sum`` (the counts of all links). Texts are encoded once: their
    distinct links are written, counted over all texts, and read again against the counts, which are broadcast (see ``link_counts`` for their bound)."""
    spark = docs.sparkSession
    aligned = store(align(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = link_counts(aligned).toArrow()
    order = np.argsort(counts["link"].to_numpy())
    codes, often = counts["link"].to_numpy()[order], counts["count"].to_numpy()[order]
    from sentencepiece import SentencePieceProcessor

    of_b = codes % SentencePieceProcessor(model_file=b_path).get_piece_size()
    most = np.zeros(int(of_b.max()) + 1 if len(of_b) else 0, np.int64)
    np.maximum.at(most, of_b, often)
    shared = spark.sparkContext.broadcast((codes, often, often == most[of_b]))
    names = ["n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, often, best = shared.value
        for batch in batches:
            at = np.searchsorted(codes, batch.column("links").flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            upto = np.r_[0, np.cumsum(pc.list_value_length(batch.column("links")).to_numpy())]
            summed = [np.r_[0, np.cumsum(x)] for x in (times * best[at], times * often[at])]
            yield pa.record_batch([batch.column(c) for c in ["doc_id", *names]] + [pa.array(s[upto[1:]] - s[upto[:-1]]) for s in summed], ["doc_id", *names, "n_best", "count_sum"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in names[:-1])}, groups_sha256 string, n_best long, count_sum long")
