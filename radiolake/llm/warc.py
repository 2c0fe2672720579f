"""WARC archives: a writer, the normaliser of monolithic gzip files, and an index reader.

Crawlers at times leave archives compressed as one gzip stream, in which no record can be
reached without inflating all before it. ``normalise`` inflates each such file once, as a
stream, rewrites every record as a gzip member of its own and writes a sidecar index of
member offsets; ``read_records`` then reaches every record through that index.

Spark deals out the work: a task writes, normalises or reads whole archives, records stream
through it in bounded memory, and only file names and index rows travel between tasks. Files
are written under a name of the attempt and moved to their final name when complete, so a
task that runs again after the loss of an executor leaves the same files.

Defined cases: a null html is an empty payload; pages with equal id *and* payload count as
one record written twice and get the same type; a page without id can only be a revisit (of
a page that has one) or a response; columns beyond ``page_id``, ``url`` and ``html`` are
ignored; an empty table gives no archives and no rows; a file without bytes has no records; a
gzip stream that ends before its trailer, wherever it is cut, is an error, not a short archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.shared import new_dir, stage_table, table

CHUNK = 1 << 20
FILES = "path string, records long"
INDEX = "archive string, offset long, length long, warc_type string, page_id long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, offset long, length long"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head only, with the payload's length."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    return {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Inflated:
    """Byte stream of a gzip file, of one member or many, inflated a chunk at a time."""

    def __init__(self, source):
        self.source, self.buffer, self.inflater, self.fed, self.ended = source, bytearray(), zlib.decompressobj(31), False, False

    def _more(self) -> bool:
        while not self.ended:
            data = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            data = data or self.source.read(CHUNK)
            if not data:
                if self.fed and not self.inflater.eof:
                    raise EOFError("the gzip stream is cut short")
                self.ended = True
                return False
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            self.fed = True
            got = self.inflater.decompress(data, CHUNK)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes through the next ``mark``; empty at the end of the stream."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("bytes after the last record")
                return b""
        out = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.buffer and not self._more():
                raise EOFError("a record is cut short")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def opened(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path, compression=None)


class Replaced:
    """A file that appears under its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = pa.fs.FileSystem.from_uri(uri)
        self.partial = f"{self.path}.{TaskContext.get().taskAttemptId()}.partial"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.partial, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            if self.fs.get_file_info(self.path).type == pa.fs.FileType.File:
                self.fs.delete_file(self.path)
            self.fs.move(self.partial, self.path)
        else:
            self.fs.delete_file(self.partial)


def write_monolithic(pages: DataFrame, out_dir: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files of one gzip stream each.

    Of pages with equal payloads of at least ``min_bytes``, the one with the smallest page_id is
    written as response and the others as revisits of it. Only the digests that occur more than
    once are joined back; they are staged, so the planner broadcasts them only if they are small.
    Returns (path, records), one row a file.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = stage_table(repeated.filter("n > 1").select("digest", "first"), "warc-repeated")
    rows = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, n = f"{out_dir}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        with Replaced(uri) as out:
            while first is not None:
                for row in zip(*(c.to_pylist() for c in first.columns), strict=True):
                    out.write(gz.compress(record_bytes(*row)))
                    n += 1
                first = next(batches, None)
            out.write(gz.flush())
        yield pa.RecordBatch.from_pydict({"path": [uri], "records": [n]})

    return stage_table(rows.mapInArrow(write, FILES), "warc-files")


def _one_task_each(files: DataFrame) -> DataFrame:
    """Each file in a partition of its own. Only names are numbered in one task."""
    name = files.columns[0]
    numbered = files.withColumn("__n", F.row_number().over(Window.orderBy(name)) - 1)
    return numbered.repartitionById(max(1, files.count()), "__n").drop("__n")


def normalise(files: DataFrame, out_dir: str, level: int = 6) -> DataFrame:
    """Rewrite each archive of ``files(path)`` with one gzip member a record, and index it.

    The index is a sidecar ``<archive>.idx`` of JSON lines (offset, length, type, page id); the
    same rows are returned as a table. A record of any size passes through in pieces.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (p for b in batches for p in b.column("path").to_pylist()):
            to, index = f"{out_dir}/{uri.rpartition('/')[2]}", []
            with opened(uri) as source, Replaced(to) as out:
                stream, offset = Inflated(source), 0
                while raw := stream.until(b"\r\n\r\n"):
                    raw = raw.lstrip(b"\r\n")
                    if not raw.startswith(b"WARC/"):
                        raise ValueError(f"{uri}: not a WARC record: {raw[:40]!r}")
                    fields = headers(raw[:-4])
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    length = out.write(gz.compress(raw))
                    for piece in stream.pieces(int(fields["Content-Length"])):
                        length += out.write(gz.compress(piece))
                    if b"".join(stream.pieces(4)) != b"\r\n\r\n":
                        raise ValueError(f"{uri}: a record's length is wrong")
                    length += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    page = fields.get("Page-ID")
                    index.append({"archive": to, "offset": offset, "length": length, "warc_type": fields["WARC-Type"], "page_id": None if page is None else int(page)})
                    offset += length
            with Replaced(f"{to}.idx") as out:
                out.write("".join(json.dumps(x) + "\n" for x in index).encode())
            for at in range(0, len(index), 10_000):
                yield pa.RecordBatch.from_pylist(index[at : at + 10_000], schema=pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("warc_type", pa.string()), ("page_id", pa.int64())]))

    return stage_table(_one_task_each(files.select("path")).mapInArrow(rewrite, INDEX), "warc-index")


def read_records(archives: DataFrame) -> DataFrame:
    """Read every record of ``archives(archive)`` through its sidecar index.

    Each member is inflated by itself; a response's digest is computed from the payload found
    and must equal the header's. Returns the columns of ``RECORDS``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for uri in (p for b in batches for p in b.column("archive").to_pylist()):
            fs, path = pa.fs.FileSystem.from_uri(uri)
            with opened(f"{uri}.idx") as f:
                index = [json.loads(x) for x in f.read().splitlines()]
            rows = []
            with fs.open_input_file(path) as f:
                for at in index:
                    f.seek(at["offset"])
                    raw = zlib.decompress(f.read(at["length"]), 31)
                    end = raw.index(b"\r\n\r\n")
                    fields = headers(raw[:end])
                    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
                    split = block.index(b"\r\n\r\n")
                    payload, http = block[split + 4 :], headers(block[:split])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = fields.get("Refers-To-Page-ID")
                    if refers is None and base32_sha1(payload) != digest:
                        raise ValueError(f"{uri} at {at['offset']}: the payload does not match its digest")
                    page = fields.get("Page-ID")
                    rows.append((None if page is None else int(page), fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, fields["WARC-Type"], None if refers is None else int(refers), uri, at["offset"], at["length"]))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])
    return _one_task_each(archives).mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, min_bytes: int = 0, out_dir: str | None = None) -> DataFrame:
    """Write pages to monolithic archives, normalise them, read them back. See ``read_records``."""
    out_dir = out_dir or new_dir(pages.sparkSession, "warc")
    for sub in ("monolithic", "records"):
        _make(pages.sparkSession, f"{out_dir}/{sub}")
    files = write_monolithic(pages, f"{out_dir}/monolithic", min_bytes)
    index = normalise(files, f"{out_dir}/records")
    return read_records(index.filter("offset = 0").select("archive"))


def _make(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
