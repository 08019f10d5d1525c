"""Streaming sources for files that are still growing: lines of ledgers, frames of captures.

The file stream reads a file once, so it only suits finished ones. These keep, per file, its
identity and the byte up to which it was read. A micro-batch covers bytes added since, cut
into ranges that executors read; the driver only looks at sizes. What a range gives are the
lines whose end, or the frames whose closing blank line, lies in it, however far back they
began: a line or frame still open when a batch is cut comes whole with a later one, and
nothing has to be carried from batch to batch. The paths must be visible to every executor,
as on a shared mount.

With ``maxBytesPerTrigger`` a batch covers no more bytes than that. Sources share them, those
with less to read leaving the rest to the others, and a source's files come in the order of
their paths. Spark does not tell a source where a restarted query stands, so what has been
planned is kept in a small file at ``progressPath``, beside the query's checkpoint.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from planes.sources.ranges import FRAME_BYTES, RANGE_BYTES, frame_batch, line_batch

# Offsets have the number of the batch under this name, which no file has.
ROUND = ""


class ByteRange(InputPartition):
    def __init__(self, path: str, file_id: int, start: int, end: int):
        self.path, self.file_id, self.start, self.end = path, file_id, start, end


def first_unread(then: dict | None, now: dict) -> int:
    """Byte to go on from in a file that stood at ``then`` and stands at ``now``.

    A changed identity (both known) or a smaller size means the file was replaced and is
    read from the top.
    """
    if then is None or now["to"] < then["to"]:
        return 0
    if then["id"] and now["id"] and then["id"] != now["id"]:
        return 0
    return then["to"]


def shares(wants: dict[str, int], budget: int) -> dict[str, int]:
    """``budget`` dealt evenly, what some do not want going to the others. Everyone who wants
    anything gets a byte at least."""
    given, left = {}, budget
    for n, (name, want) in enumerate(sorted(wants.items(), key=lambda x: (x[1], x[0]))):
        given[name] = min(want, max(1, left // (len(wants) - n)))
        left -= given[name]
    return given


class GrowingReader(DataSourceStreamReader):
    """Offsets are ``{path: {"id": identity, "to": byte}}``.

    Without a limit they follow from the files alone, so a restarted query needs nothing but
    its checkpoint; a replayed micro-batch always reads the same bytes.
    """

    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"]
        self.source = re.compile(options.get("sourcePattern", r"([^/]+)/[^/]*$"))
        self.span = int(options.get("rangeBytes", RANGE_BYTES))
        self.budget = int(options.get("maxBytesPerTrigger", 0))
        self.progress = options.get("progressPath", "")
        if self.budget and not self.progress:
            raise ValueError("maxBytesPerTrigger needs a progressPath")
        # Files as they are when the query starts are all that is read.
        self.until_now = options.get("untilNow", "false") == "true"
        self.goal: dict[str, dict] | None = None
        self.planned: dict[str, dict] | None = None

    def source_of(self, path: str) -> str:
        found = self.source.search(path)
        return found.group(1) if found else ""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        there = self.goal
        if there is None:
            there = {}
            for path in glob.glob(self.pattern):
                stat = os.stat(path)
                there[path] = {"id": stat.st_ino, "to": stat.st_size}
            if self.until_now:
                self.goal = there
        if self.planned is None:
            self.planned = self._load() if self.budget else {}
        # A file that is gone for a moment keeps its place.
        admitted = self._admitted(there) if self.budget else there
        if self.budget and any(self.planned.get(p) != now for p, now in admitted.items()):
            admitted[ROUND] = {"id": 0, "to": self.planned.get(ROUND, {"to": 0})["to"] + 1}
            self._store({**self.planned, **admitted})
        self.planned = {**self.planned, **admitted}
        return dict(sorted(self.planned.items()))

    def _admitted(self, there: dict) -> dict:
        """Where the files that get a part of the budget stand after this batch."""
        start = {path: first_unread(self.planned.get(path), now) for path, now in there.items()}
        wants: dict[str, int] = {}
        for path, now in there.items():
            if now["to"] > start[path]:
                name = self.source_of(path)
                wants[name] = wants.get(name, 0) + now["to"] - start[path]
        left, admitted = shares(wants, self.budget), {}
        for path, now in sorted(there.items()):
            name = self.source_of(path)
            take = min(left.get(name, 0), now["to"] - start[path])
            if take > 0 or now["to"] == start[path]:
                admitted[path] = {"id": now["id"], "to": start[path] + take}
                left[name] = left.get(name, 0) - take
        return admitted

    def _file(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.progress if "://" in self.progress else os.path.abspath(self.progress))

    def _load(self) -> dict:
        store, path = self._file()
        try:
            with store.open_input_stream(path) as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return {}

    def _store(self, planned: dict) -> None:
        store, path = self._file()
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path + ".new") as file:
            file.write(json.dumps(planned).encode())
        store.move(path + ".new", path)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        # The file may be a batch ahead of the checkpoint, never behind it.
        if end.get(ROUND, {"to": 0})["to"] < start.get(ROUND, {"to": 0})["to"]:
            raise ValueError(f"{self.progress} is older than the checkpoint; it was lost or belongs to another query")
        return [
            ByteRange(path, now["id"], at, min(at + self.span, now["to"]))
            for path, now in end.items()
            if path != ROUND
            for at in range(first_unread(start.get(path), now), now["to"], self.span)
        ]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        path = partition.path
        # A file replaced since the range was planned took its unread bytes with it.
        if not os.path.exists(path) or os.stat(path).st_ino != partition.file_id:
            return
        yield self.batch(self.source_of(path), path, partition.start, partition.end)

    def batch(self, source: str, path: str, start: int, end: int) -> pa.RecordBatch:
        raise NotImplementedError


class TailReader(GrowingReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.max_line = int(options.get("maxLineBytes", RANGE_BYTES))

    def batch(self, source: str, path: str, start: int, end: int) -> pa.RecordBatch:
        return line_batch(source, path, start, end, self.max_line)


class FrameReader(GrowingReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.max_frame = int(options.get("maxFrameBytes", FRAME_BYTES))

    def batch(self, source: str, path: str, start: int, end: int) -> pa.RecordBatch:
        return frame_batch(source, path, start, end, self.max_frame)


class TailSource(DataSource):
    """``spark.readStream.format("planes_tail").option("path", "/mnt/*/usage.jsonl")``"""

    @classmethod
    def name(cls) -> str:
        return "planes_tail"

    def schema(self) -> str:
        return "source_id string, path string, offset long, line_end long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


class FrameSource(DataSource):
    """Frames of captured server-sent events, as they are closed:
    ``spark.readStream.format("planes_frames").option("path", "/mnt/*/events.sse")``"""

    @classmethod
    def name(cls) -> str:
        return "planes_frames"

    def schema(self) -> str:
        return "city string, path string, offset long, frame_end long, line string"

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(self.options)
