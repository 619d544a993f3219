"""WARC archives: writing, normalising a monolithic gzip stream into one member a record, and reading by an offset index.

Each writing task makes one file that is a single gzip stream. The normaliser inflates such a file once, front to back, writes every record as a gzip
member of its own and a sidecar index (offset, length, record id, type on each line). Readers then fetch records by offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, materialize, new_folder, one_a_task

DATE = "2024-01-01T00:00:00Z"  # pages carry no time; reruns write the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_PAGE = "<urn:x-page>"
PIECE = 1 << 20
#: Up to so many payloads that occur more than once (about 60 bytes each) are broadcast.
REPEATED = 200_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: object) -> str:
    """A record's name. Ids are percent-encoded, so blanks, line ends or brackets in one neither break a header nor the index; a null id has a
    name of its own."""
    return NO_PAGE if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>"


def page_of(name: str) -> str | None:
    return None if name in ("", NO_PAGE) else unquote(name[12:-1])


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One uncompressed WARC record: a response, or a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Record-ID: " + urn(page_id), f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~"))
    if refers_to is not None:
        head += ["WARC-Refers-To: " + urn(refers_to), f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, a piece at a time; an error where it ends before a member's trailer does. An empty file has no content."""
    engine, waiting, begun = zlib.decompressobj(31), b"", False
    while True:
        if not waiting:
            waiting = stream.read(PIECE)
            if not waiting:
                break
        if engine.eof:
            engine = zlib.decompressobj(31)
        begun = True
        yield engine.decompress(waiting, PIECE * 4)
        waiting = engine.unused_data if engine.eof else engine.unconsumed_tail
    yield engine.flush()
    if begun and not engine.eof:
        raise ValueError("the archive ends within a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Split a stream of WARC content into whole records, holding one record at a time."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                found = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(held[:end]))
                if not found:
                    raise ValueError("a record without Content-Length")
                need = end + 4 + int(found[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends within a record")


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of at least ``least`` bytes the largest page id is the
    response (null refers_to), the others revisit it. Repeated rows of that largest id are all responses; rows without an id refer to it, or
    are responses where no equal payload has an id."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(payload, 256).alias("payload"), F.octet_length(payload).alias("size"))
    repeated = rows.filter(F.col("size") >= least).groupBy("payload").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").select("payload", "newest")
    joined = rows.join(broadcast_if_small(materialize(repeated), REPEATED), "payload", "left")
    refers = F.when(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(classified: DataFrame, folder: str) -> DataFrame:
    """``path`` of each archive, one for each task with rows: a monolithic gzip stream. A file is written under a name of the attempt and then
    moved, so a task that runs again leaves one whole archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/part-{task.partitionId():06d}.mono.warc.gz"
        own, out = f"{path}.{task.taskAttemptId()}", None
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or fs.open_output_stream(own)
                out.write(engine.compress(record(page_id, url, (html or "").encode(), refers_to)))
        if out:
            out.write(engine.flush())
            out.close()
            fs.move(own, path)
            yield pa.record_batch([pa.array([path.rpartition("/")[2]])], ["path"])

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return classified.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member a record and an index beside it: ``path, index, records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                path = name.replace(".mono.warc.gz", ".warc.gz")
                index, at, count = f"{path}.idx", 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream, fs.open_output_stream(f"{root}/{path}.{attempt}", compression=None) as out, fs.open_output_stream(f"{root}/{index}.{attempt}") as lines:
                    for raw in records(inflate(stream)):
                        headers, _ = parse(raw)
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        out.write(member)
                        lines.write(f"{at} {len(member)} {headers['warc-record-id']} {headers['warc-type']}\n".encode())
                        at, count = at + len(member), count + 1
                fs.move(f"{root}/{path}.{attempt}", f"{root}/{path}")
                fs.move(f"{root}/{index}.{attempt}", f"{root}/{index}")
                yield pa.record_batch([pa.array([path]), pa.array([index]), pa.array([count], pa.int64())], ["path", "index", "records"])

    return one_a_task(archives, "path").mapInArrow(run, "path string, index string, records long")


def read_archives(archives: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """A row for each record, fetched by its offset in the index: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``. A
    response's digest is computed anew from its payload and must equal its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(f"{root}/{path}") as archive, fs.open_input_stream(f"{root}/{index}") as lines:
                    for line in lines.read().decode().splitlines():
                        at, length, record_id, kind = line.split(" ")
                        headers, block = parse(zlib.decompress(archive.read_at(int(length), int(at)), 31))
                        if headers["warc-record-id"] != record_id:
                            raise ValueError(f"the index of {path} is wrong at {at}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (size != len(payload) or payload_digest(payload) != digest):
                            raise ValueError(f"a damaged payload in {path} at {at}")
                        rows.append((page_of(record_id), headers["warc-target-uri"], size, digest, kind, page_of(headers.get("warc-refers-to", ""))))
                        if len(rows) == 4096:
                            yield pa.record_batch([pa.array(c, pa.int64() if i == 2 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64() if i == 2 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names)

    found = one_a_task(archives.select("path", "index"), "path").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write, normalise, read back: a row for each input row. A null html is an empty payload, a null url about:blank, a
    null id an empty one; repeated rows each get a record. An empty table gives no archives and no rows."""
    folder = new_folder(pages.sparkSession, "warc")
    mono = materialize(write_archives(classify(pages, id_col, url_col, html_col, least), folder))
    return read_archives(materialize(normalise(mono, folder)), folder, pages.schema[id_col].dataType.simpleString())
