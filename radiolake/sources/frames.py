"""Recorded broker frames as a replayable streaming source.

A recording has a folder for each broker, and in it segments: files of one JSON frame a line (``seq``, ``ts_us``, ``topic``, ``body`` in base64),
in folders whose names rise. An offset is, for each broker, the segment and the byte up to which it has been read; segments before it have been read whole. So an
offset's size is that of the brokers' list, and a query that starts again from its checkpoint reads on at the byte where it ended. Only whole
lines count, so a segment may still be written to. A batch is cut into parts of ``part_bytes``, each read by its own task: a line belongs to the part it begins in. A batch
that would have more than ``PARTS`` of them has larger ones, of up to ``PART_BYTES``, as each part costs a task and a file of its sink.

A line that is no frame is a row with ``error`` and its text as ``body``, not the end of the query.
"""

from __future__ import annotations

import base64
import binascii
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, ts_us long, topic string, body binary, broker string, segment string, at long, error string"
COLUMNS = pa.schema([("seq", pa.int64()), ("ts_us", pa.int64()), ("topic", pa.string()), ("body", pa.binary()), ("broker", pa.string()), ("segment", pa.string()), ("at", pa.int64()), ("error", pa.string())])
PART_BYTES = 32 << 20
PARTS = 64


def topic_fits(topic: str, wanted: str) -> bool:
    """Whether a topic falls under a filter: ``+`` stands for one level, a last ``#`` for any number of them."""
    levels, parts = wanted.split("/"), topic.split("/")
    if levels[-1] == "#":
        levels, parts = levels[:-1], parts[: max(len(levels) - 1, 0)]
        if len(parts) < len(levels):
            return False
    return len(levels) == len(parts) and all(a in ("+", b) for a, b in zip(levels, parts, strict=True))


@dataclass
class Part(InputPartition):
    broker: str
    segment: str
    start: int
    end: int


class Recording:
    """What both readers share; it is sent to tasks, so it holds options only."""

    def __init__(self, options: dict[str, str]):
        self.path, self.part_bytes = options["path"].rstrip("/"), int(options.get("part_bytes", PART_BYTES))
        self.topics = [t for t in options.get("topics", "").split(",") if t]

    def root(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def segments(self) -> dict[str, list[tuple[str, int]]]:
        """(segment, bytes) of each broker, in order."""
        files, base = self.root()
        out: dict[str, list[tuple[str, int]]] = {}
        for f in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            name = f.path[len(base) :].strip("/")
            if f.type == fs.FileType.File and "/" in name and not name.rpartition("/")[2].startswith(("_", ".")):
                broker, _, segment = name.partition("/")
                out.setdefault(broker, []).append((segment, f.size))
        return {b: sorted(s) for b, s in sorted(out.items())}

    def whole(self, broker: str, segment: str, size: int) -> int:
        """The end of a segment's last whole line."""
        files, base = self.root()
        with files.open_input_file(f"{base}/{broker}/{segment}") as f:
            while size:
                at = max(0, size - (1 << 16))
                f.seek(at)
                cut = f.read(size - at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                size = at
        return 0

    def newest(self) -> dict[str, list]:
        return {b: [s[-1][0], self.whole(b, *s[-1])] for b, s in self.segments().items()}

    def between(self, start: dict[str, list], end: dict[str, list]) -> list[Part]:
        spans = []
        for broker, segments in self.segments().items():
            if broker not in end:
                continue
            (last, stop), (first, begin) = end[broker], start.get(broker, ["", 0])
            for segment, size in segments:
                if first <= segment <= last:
                    lo, hi = begin if segment == first else 0, stop if segment == last else size
                    spans.append((broker, segment, lo, hi))
        even = -(-sum(hi - lo for *_, lo, hi in spans) // PARTS)
        step = max(self.part_bytes, min(even, PART_BYTES))
        return [Part(broker, segment, at, min(at + step, hi)) for broker, segment, lo, hi in spans for at in range(lo, hi, step)]

    def lines(self, part: Part) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the lines that begin in a part."""
        files, base = self.root()
        with files.open_input_file(f"{base}/{part.broker}/{part.segment}") as f:
            at = max(part.start - 1, 0)
            f.seek(at)
            lines = io.BufferedReader(f, 1 << 20)
            if part.start:
                at += len(lines.readline())  # the end of a line that begins before
            while at < part.end and (line := lines.readline()):
                yield at, line.rstrip(b"\r\n")
                at += len(line)

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for at, line in self.lines(part):
            try:
                frame = json.loads(line)
                topic = str(frame["topic"])
                seq, ts_us = int(frame["seq"]), int(frame["ts_us"])
                if max(abs(seq), abs(ts_us)) >> 63:
                    raise OverflowError
                row = (seq, ts_us, topic, base64.b64decode(frame.get("body") or "", validate=True))
                if self.topics and not any(topic_fits(topic, t) for t in self.topics):
                    continue
                out.append((*row, part.broker, part.segment, at, None))
            except (ValueError, TypeError, KeyError, binascii.Error, OverflowError) as e:
                out.append((None, None, None, line, part.broker, part.segment, at, type(e).__name__))
            if len(out) == 5000:
                yield self.batch(out)
                out = []
        if out:
            yield self.batch(out)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


class FrameStream(DataSourceStreamReader):
    def __init__(self, recording: Recording):
        self.recording = recording

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.recording.newest()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.recording.between(start, end)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.recording.rows(partition)


class FrameTable(DataSourceReader):
    def __init__(self, recording: Recording):
        self.recording = recording

    def partitions(self) -> list[Part]:
        return self.recording.between({}, self.recording.newest()) or [Part("", "", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.recording.rows(partition) if partition.end else iter(())


class Frames(DataSource):
    """Options: ``path``, ``topics`` (filters, by commas; none: all topics), ``part_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "broker_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameTable(Recording(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameStream(Recording(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Frames)


def record(messages: DataFrame, path: str, broker: str, folder: str) -> None:
    """Write messages as a folder of segments of a broker; later folders need names that sort behind earlier ones."""
    body = F.replace(F.base64(F.col("body").cast("binary")), F.lit("\r\n"), F.lit(""))
    messages.select(F.to_json(F.struct("seq", "ts_us", "topic", body.alias("body"))).alias("value")).write.text(f"{path}/{broker}/{folder}")
