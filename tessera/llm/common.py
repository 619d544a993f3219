"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def is_held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id's text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local
    master gets a temporary folder; a cluster without the setting is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/tessera/{kind}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove the working folders of all operators below the shared folder: only when no result that reads them is needed any more."""
    fs, root = pafs.FileSystem.from_uri(f"{shared_dir(spark)}/tessera")
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, kind: str) -> DataFrame:
    """Write as Parquet in the shared folder and reread: for wide rows, which checkpoint() would not compress."""
    path = new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only after counting: at most limit rows, else Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it new to the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def one_a_task(files: DataFrame, name: str) -> DataFrame:
    """Rows of a materialised table that each name a file, dealt to as many tasks by ranges of names. The number is given, so Spark does not
    pack the few small rows, behind which large files lie, into one task."""
    return files.repartitionByRange(max(1, files.count()), name)


#: Bytes of rows that go to a Python worker at once, and what Spark sends where nobody chose: 64 MB, of which the JVM's vectors, their doubled copy as they grow, the pipe and the
#: worker hold one each for every task, all counted against the executor.
BATCH = 8 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def in_small_batches(df: DataFrame) -> DataFrame:
    """The table itself, after its session was set to send rows to Python in batches of about BATCH bytes; a size that someone chose stays. No result depends on where a batch ends."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH))
    return df


def text_groups(column: pa.Array, most: int = 1 << 22) -> Iterator[list[str]]:
    """The texts of an Arrow column in order, in groups of about so many characters, so that working memory follows
    neither the batch nor the text column as a whole; a null is empty."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


_CACHES: dict[str, dict] = {}
_LAST = [""]


def give_back() -> None:
    """Return to the system what this worker has freed: Arrow's pool and the C library keep it otherwise, the latter up to 64 MB."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worker_cache(operator: str) -> dict:
    """What an operator keeps in a Python worker between tasks. Spark uses workers again, so what other operators kept there goes first: their stages are over, and a
    worker's memory counts against its executor."""
    for name in _CACHES:
        if name != operator:
            _CACHES[name].clear()
    if _LAST[0] != operator:
        _LAST[0] = operator
        give_back()
    return _CACHES.setdefault(operator, {})


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """The array, grown by half at least if it is shorter than size."""
    return held if len(held) >= size else np.r_[held, np.zeros(max(size - len(held), len(held) // 2), held.dtype)]


class IdLists:
    """Lists of token ids by string: a number for each string, and all ids end to end."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.upto = np.zeros(1, np.int64)  # where each begins, and the last ends

    def add(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, used = len(self.number), int(self.upto[len(self.number)])
        self.number.update(zip(new, range(first, first + len(new)), strict=True))
        self.upto = _room(self.upto, len(self.number) + 1)
        self.flat = _room(self.flat, used + len(ids))
        self.upto[first + 1 : first + 1 + len(new)] = used + np.cumsum(sizes)
        self.flat[used : used + len(ids)] = ids

    def places(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, strings), np.int64, len(strings))

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings numbered at, end to end, and the number of each."""
        starts, sizes = self.upto[at], self.upto[at + 1] - self.upto[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


class Remembered(IdLists):
    """Lists that a worker remembers from earlier rows. Beyond a number of them they become the old ones, from which those that are met again
    return; the old ones before go. Memory only, never the result."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, IdLists()

    def absent(self, strings: list[str]) -> list[str]:
        """Those of distinct strings that must be learnt."""
        if len(self.number) > self.most:
            self.old = IdLists()
            self.old.number, self.old.flat, self.old.upto = self.number, self.flat, self.upto
            super().__init__()
        new = [s for s in strings if s not in self.number]
        if back := [s for s in new if s in self.old.number]:
            self.add(back, *self.old.get(self.old.places(back)))
            new = [s for s in new if s not in self.old.number]
        return new
