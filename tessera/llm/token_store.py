"""Token ids in a compact binary file format.

Ids are replaced by their rank in the order of corpus frequency, so that common ids take one byte. A block holds whole documents: a directory, then
control bytes (two bits for each value: its bytes less one, four values to a control byte), then the values' bytes, least first. Decoding looks the lengths
up by control byte in a table and gathers the value bytes with numpy.

File: magic, then blocks; each block is a header of five uint32 (documents, null ids among them, ids, control bytes, data bytes), the int64 doc ids, the
null flags, the uint32 id counts, the control bytes and the data bytes. ``ranks.bin`` beside the shards lists the ids by rank as uint32.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Remembered, materialize, new_folder, one_a_task, store, text_groups, worker_cache

MAGIC = b"RANKVB01"
BLOCK = 1 << 20  # ids after which a block ends with its document
SHARD = 1 << 26  # ids of a shard, about
#: Parts of words that a worker remembers from earlier rows, and as many old ones.
REMEMBERED = 300_000
#: All white space that splits words for certain in any Unicode reading: what the tokenizer also drops and never joins over.
SPACES = " \t\n\x0b\x0c\r"

#: For each control byte the lengths of its four values.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 values."""
    sizes = np.ones(len(values), np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        if len(values) and int(values.max()) > limit:
            sizes += values > limit
    control = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    control[: len(values)] = sizes - 1
    control = control[0::4] | control[1::4] << 2 | control[2::4] << 4 | control[3::4] << 6
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    data = np.empty(int(at[-1]) + int(sizes[-1]) if len(values) else 0, np.uint8)
    data[at] = values & 0xFF
    for k in range(1, int(sizes.max(initial=1))):
        more = np.flatnonzero(sizes > k)
        data[at[more] + k] = values[more] >> np.uint32(8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The uint32 values; a table gives the lengths behind each control byte."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    octets = np.frombuffer(data, np.uint8)
    values = octets[at].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        more = np.flatnonzero(sizes > k)
        values[more] |= octets[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def flat_ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column end to end, without copying, and where each row's end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind), (ends[1:] - ends[0]) // size


#: Letters and digits after which a text may be cut before ASCII punctuation: normalised and lower-cased, each still ends with a letter or digit.
CUT_AFTER = r"A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{45F}\x{4E00}-\x{9FFF}"
#: Fixed values, as a tokenizer file writes them: the normaliser and the splitter under which texts may be cut into parts.
PARTED_BY = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Words that the library gets at once.
TOGETHER = 1024


class _Words:
    """Ids of white-space separated words by the tokenizers library. The file's normaliser and splitter treat each such word by itself, so equal words
    have equal ids wherever they stand. Between most letters or digits and ASCII punctuation the splitter parts too, so texts are cut there as well (but for
    texts that hold a special token, which would fall apart); parts that are all ASCII are looked up in lower case, and the library sees each
    distinct part once. All this holds for files with the normaliser and splitter of PARTED_BY; of any other file the library gets whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would crowd out other tasks
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()  # whole texts, each by itself
        self.tokenizer.no_padding()
        added_tokens = self.tokenizer.get_added_tokens_decoder().values()
        added = {t.content for t in added_tokens}
        self.special = "|".join(re.escape(t) for t in sorted(added)) or r"[^\s\S]"
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.parts = Remembered(REMEMBERED)
        self.parted = self._may_part(added_tokens)

    def _may_part(self, added_tokens) -> bool:
        """Whether the file is one whose texts may be cut: its normaliser and splitter are known, a token ends each word, and added tokens match as they stand, not in normalised
        text."""
        settings = json.loads(self.tokenizer.to_str())
        plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added_tokens)
        steady = settings["model"]["type"] == "BPE" and not settings["model"].get("dropout")
        return plain and steady and self.ends_word.any() and all(settings[k] == v for k, v in PARTED_BY.items())

    def _call(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Words of letters alone go to the library as one text and are told apart by the ids that end a word: each has at least one such id, so as
        many of them as words means one for each. All other words go one by one."""
        plain, rest = [], []
        for part in new:
            (plain if part.isalpha() else rest).append(part)
        for i in range(0, len(plain), TOGETHER):
            some = plain[i : i + TOGETHER]
            ids = np.array(self._call([" ".join(some)])[0], np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                self.parts.add(some, ids, np.diff(np.r_[0, ends]))
            else:
                rest += some
        for i in range(0, len(rest), 4096):
            found = self._call(rest[i : i + 4096])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.parts.add(rest[i : i + 4096], np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and the number of each text."""
        if not self.parted:
            found = self._call(texts)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
        column = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(column, self.special)
        parted = pc.if_else(whole, column, pc.replace_substring_regex(column, rf"([{CUT_AFTER}])([!-/:-@\[-`{{-~])", r"\1 \2"))
        for space in SPACES[1:]:
            parted = pc.replace_substring(parted, space, " ")
        lists = pc.split_pattern(parted, " ")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        lower = pc.ascii_lower(distinct)
        fold = pc.and_not(pc.string_is_ascii(distinct), pc.match_substring_regex(lower, self.special))
        parts = pc.if_else(fold, lower, distinct).to_numpy(zero_copy_only=False).tolist()
        self.learn(self.parts.absent(list(dict.fromkeys(parts))))
        ids, sizes = self.parts.get(self.parts.places(parts)[coded.indices.to_numpy()])
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]])


def id_kind(tokenizer: str, end_id: int) -> str:
    """The narrowest numpy type for the ids between the steps: two bytes where the vocabulary allows."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "<u4", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids binary`` (integers of numpy type kind) of each row's whole text and the end id; a null text is
    empty. The tokenizer's file is read on each worker from the installed path."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("words")
        if tokenizer not in kept:
            kept[tokenizer] = _Words(tokenizer)
        words = kept[tokenizer]
        for batch in batches:
            done = 0
            for texts in text_groups(batch.column(1)):
                ids, sizes = words.encode(texts)
                ends = np.cumsum(sizes + 1)
                out = np.full(len(ids) + len(texts), end_id, kind)
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = ids
                offsets = pa.py_buffer(np.r_[0, ends * size].astype(np.int32).tobytes())
                yield pa.record_batch([batch.column(0).slice(done, len(texts)), pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(out.tobytes())])], ["doc_id", "ids"])
                done += len(texts)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, ids binary")


def id_counts(encoded: DataFrame, kind: str = "<u4") -> DataFrame:
    """``id, n`` over all rows; each task sends a row for each id it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("store")  # the words have served
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(flat_ids(batch.column(0), kind)[0])
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _block(doc_ids: list[int | None], counts: np.ndarray, values: np.ndarray) -> bytes:
    control, data = pack(values)
    known = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    nulls = bytes(d is None for d in doc_ids)
    header = struct.pack("<5I", len(doc_ids), sum(nulls), len(values), len(control), len(data))
    return b"".join([header, known, nulls, counts.astype("<u4").tobytes(), control, data])


def write_store(encoded: DataFrame, folder: str, shards: int | None = None, kind: str = "<u4", id_col: str = "doc_id") -> DataFrame:
    """Write the files and return their manifest: ``shard, path, documents, tokens, start``.

    Shards hold ranges of ascending ids (nulls first) of integral type, rows that repeat an id in any order, so that they too may spread over shards. Their number
    follows the tokens. A task writes its file under a name of its own and then moves it to the
    shard's name, so a task that runs again leaves one whole file. The rank table has a row for each id of the vocabulary."""
    spark = encoded.sparkSession
    counted = id_counts(encoded, kind).orderBy(F.desc("n"), "id").collect()  # at most the vocabulary
    by_rank = np.array([r["id"] for r in counted], np.uint32)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["n"] for r in counted) // SHARD + 1)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(by_rank.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_cache("store")  # the words have served
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/shard-{task.partitionId():06d}.bin"
        own = f"{path}.{task.taskAttemptId()}"
        documents = tokens = 0
        with fs.open_output_stream(own) as out:
            out.write(MAGIC)
            for batch in batches:
                ids, ends = flat_ids(batch.column(1), kind)
                doc_ids, begin = batch.column(0).to_pylist(), 0
                while begin < len(doc_ids):  # whole documents, up to BLOCK ids or one document
                    start = int(ends[begin - 1]) if begin else 0
                    end = max(begin + 1, int(np.searchsorted(ends, start + BLOCK, side="right")))
                    values = table.value[ids[start : ends[end - 1]]]
                    out.write(_block(doc_ids[begin:end], np.diff(np.r_[start, ends[begin:end]]), values))
                    documents, tokens, begin = documents + end - begin, tokens + len(values), end
        fs.move(own, path)
        yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([f"shard-{task.partitionId():06d}.bin"]), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "path", "documents", "tokens"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), "ids", F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = materialize(ranged.select("doc_id", "ids").mapInArrow(write, "shard int, path string, documents long, tokens long"))
    # a row for each shard: the running sum sees no documents
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_blocks(stream, by_rank: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Doc ids, counts and ids of each block."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while header := stream.read(20):
        documents, _, values, control, data = struct.unpack("<5I", header)
        known = np.frombuffer(stream.read(8 * documents), "<i8").tolist()
        doc_ids = [None if null else d for d, null in zip(known, stream.read(documents), strict=True)]
        counts = np.frombuffer(stream.read(4 * documents), "<u4")
        yield doc_ids, counts, by_rank[unpack(stream.read(control), stream.read(data), values)]


def read_store(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files in file order; one task a shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("store")  # the words have served
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{root}/ranks.bin") as file:
            by_rank = np.frombuffer(file.read(), "<u4")
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{path}") as stream:
                    for doc_ids, counts, ids in read_blocks(stream, by_rank):
                        ends = np.cumsum(counts.astype(np.int64))
                        raw = memoryview(ids.astype("<u4").tobytes())
                        sums = [zlib.crc32(raw[4 * int(e - c) : 4 * int(e)]) for e, c in zip(ends, counts.astype(np.int64), strict=True)]
                        yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1]) if len(ends) else 0

    return one_a_task(manifest.select("path", "start"), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encode, write, read back. Each row of the input, repeated ones too, is a document of the files; among equal ids the order is open.
    An empty table gives a store without documents. Other columns are not read."""
    spark = docs.sparkSession
    kind = id_kind(tokenizer, end_id)
    encoded = store(encode(docs, tokenizer, end_id, kind), "ids")
    folder = new_folder(spark, "tokens")
    return read_store(spark, folder, materialize(write_store(encoded, folder, shards, kind)))
