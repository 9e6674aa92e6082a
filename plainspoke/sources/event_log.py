"""A data source of event files, in batch and as a stream: ``spark.readStream.format("event_log")``.

A folder of files of lines, one JSON object each. Files follow each other in order
of name, and only the last one may still grow, so a place in the log is one file's
name and a byte in it: an offset stays as small after a million files. Only whole
lines of the last file are taken; whatever stands behind its last line end waits.

Every range between two offsets is cut into partitions of about ``partitionBytes``,
within files too: a partition has the lines that begin in its bytes. Executors read
bytes by place and hold about a megabyte of lines. Lines are parsed by Spark.

``maxBytes`` bounds a trigger, to the next line end. Spark asks a Python source for
its latest place without telling where the query stands. With ``position``, a shared
folder of the query's own, each place is noted before Spark hears of it, so a restart
goes on from there and never back; without it, the first trigger of each start takes
all that is there, still in partitions of ``partitionBytes``. ``availableNow`` asks
for one place only: leave ``maxBytes`` out there. A folder of positions that is older
than the checkpoint fails the query rather than give a line twice.

Defined results: an empty folder gives no rows; empty lines are left out; a file
whose name begins with "_" or "." is none of the log's, nor is one whose name comes
before a place that was read already.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LINES = "file string, at long, line string"
EVENT = "session_id string, event_name string, event_json string"
_BLOCK = 1 << 20


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin in the bytes from ``lo`` to ``hi``; ``begin`` is a byte where a line is known to begin."""

    file: str
    begin: int
    lo: int
    hi: int


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Log:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options["maxBytes"]) if options.get("maxBytes") else None
        self.piece = int(options.get("partitionBytes", 64 << 20))
        self.position = options.get("position")

    def _notes(self) -> tuple[pafs.FileSystem, str, list[str]]:
        fs, root = _fs(self.position)
        return fs, root, sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("at-"))

    def noted(self) -> dict | None:
        """The last place noted; the log's begin if there is none, and None where none are kept."""
        if not self.position:
            return None
        fs, root, names = self._notes()
        for name in reversed(names):
            with fs.open_input_file(f"{root}/{name}") as f:
                body = f.read()
            if body.endswith(b"\n"):  # else the driver ended while it wrote: Spark has not heard of that place
                return json.loads(body)
        return {"file": "", "at": 0}

    def note(self, at: dict) -> None:
        if self.position:
            fs, root, names = self._notes()
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/at-{int(names[-1][3:]) + 1 if names else 0:020d}") as f:
                f.write(json.dumps(at).encode() + b"\n")
            for name in names[:-1]:  # the one before stays until the next
                fs.delete_file(f"{root}/{name}")

    def files(self, since: str = "") -> list[tuple[str, int]]:
        """(name, bytes) of the log's files from ``since`` on, in order of name."""
        fs, root = _fs(self.path)
        own = [(i.base_name, i.size) for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.is_file]
        return sorted((n, s) for n, s in own if n >= since and n[0] not in "._")

    def whole(self, name: str, size: int) -> int:
        """Where the last whole line of a file ends."""
        fs, root = _fs(self.path)
        with fs.open_input_file(f"{root}/{name}") as f:
            hi = size
            while hi > 0:
                lo = max(0, hi - _BLOCK)
                end = f.read_at(hi - lo, lo).rfind(b"\n")
                if end >= 0:
                    return lo + end + 1
                hi = lo
        return 0

    def line_end(self, name: str, at: int, size: int) -> int:
        """The first line end at or after ``at``, or the file's end."""
        fs, root = _fs(self.path)
        with fs.open_input_file(f"{root}/{name}") as f:
            while at < size:
                end = f.read_at(min(_BLOCK, size - at), at).find(b"\n")
                if end >= 0:
                    return at + end + 1
                at += _BLOCK
        return size

    def latest(self, start: dict | None) -> dict:
        """The place to read to from ``start``; with no start known, without a bound."""
        at = start or {"file": "", "at": 0}
        files = self.files(at["file"])
        room = self.most if start is not None else None
        for i, (name, size) in enumerate(files):
            lo = at["at"] if name == at["file"] else 0
            hi = self.whole(name, size) if i + 1 == len(files) else size
            if room is not None and hi - lo > room:
                return {"file": name, "at": self.line_end(name, lo + max(room, 1) - 1, hi)}
            room = None if room is None else room - max(0, hi - lo)
            if hi >= lo:
                at = {"file": name, "at": hi}
            if room == 0:
                break
        return at

    def pieces(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for name, size in self.files(start["file"]):
            if name > end["file"]:
                break
            lo, hi = (start["at"] if name == start["file"] else 0), (end["at"] if name == end["file"] else size)
            out += [Piece(name, lo, a, min(a + self.piece, hi)) for a in range(lo, hi, self.piece)]
        return out

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(self.path)
        with fs.open_input_file(f"{root}/{piece.file}") as f:
            size = f.size()
            at = piece.lo if piece.lo == piece.begin else self.line_end(piece.file, piece.lo - 1, size)
            lines, places, held = [], [], 0
            while at < piece.hi:
                block, parts = b"", []
                place = at
                while b"\n" not in block and at < size:  # at least one whole line, however long
                    block = f.read_at(min(_BLOCK, size - at), at)
                    parts.append(block)
                    at += len(block)
                data = b"".join(parts)
                ends = data.rfind(b"\n") + 1 or len(data)
                at = place + ends
                for line in data[:ends].split(b"\n"):
                    if place >= piece.hi:
                        break
                    if line.strip():
                        lines.append(line.decode("utf-8", "replace"))
                        places.append(place)
                        held += len(line)
                    place += len(line) + 1
                if held >= _BLOCK:
                    yield _batch(piece.file, places, lines)
                    lines, places, held = [], [], 0
            if lines:
                yield _batch(piece.file, places, lines)


def _batch(file: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])


class _Reader(DataSourceReader):
    def __init__(self, log: _Log):
        self.log = log

    def partitions(self) -> list[Piece]:
        return self.log.pieces({"file": "", "at": 0}, self.log.latest(None))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, log: _Log):
        self.log, self.at = log, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.at is None:
            self.at = self.log.noted()
        at = self.log.latest(self.at)
        if at != self.at:
            self.log.note(at)
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if (end["file"], end["at"]) < (start["file"], start["at"]):
            raise ValueError(f"the positions in {self.log.position} are older than the query's checkpoint")
        if self.at is None:  # a restarted query repeats a batch that was not finished
            self.at = end
        return self.log.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.log.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to free: the log's files are its owner's."""


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Log(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Log(self.options))


def events(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """(file, at, the event's columns, broken) of the source's lines; a line that is no object has nulls and is marked."""
    got = lines.select("file", "at", F.from_json("line", schema).alias("_e"), F.get_json_object("line", "$").startswith("{").alias("_o"))
    return got.select("file", "at", "_e.*", (~F.coalesce("_o", F.lit(False))).alias("broken"))


def read_events(spark: SparkSession, path: str, stream: bool = True, schema: str = EVENT, **options: object) -> DataFrame:
    """``events`` of the log at ``path``; ``options``: maxBytes, partitionBytes, position."""
    spark.dataSource.register(EventLog)
    reader = (spark.readStream if stream else spark.read).format("event_log").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return events(reader.load(), schema)
