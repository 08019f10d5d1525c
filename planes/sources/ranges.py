"""Byte ranges of line files, read where they are assigned.

Only the bytes between a cursor and the end of a file are read, and every line comes with
its place. Paths must be visible to every executor, as on a shared mount.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planes.functions.jsonl import LINE_SPACE

# Bytes per range and thus per task, and the bytes a line must stay below.
RANGE_BYTES = 8 << 20
# Bytes a frame of a capture must stay below.
FRAME_BYTES = 32 << 20
# Bytes of ranges one task should read.
TASK_BYTES = 128 << 20
# Step in which the start of a line is looked for before its range.
BACK_BYTES = 1 << 16

LINES = "source_id string, path string, offset long, line_end long, line string"


def read_ranges(ledgers: DataFrame, *, span: int = RANGE_BYTES, max_line: int = RANGE_BYTES) -> DataFrame:
    """Complete lines in bytes ``[read_from, read_to)`` of each row's ``path``.

    Columns source_id, path, offset, line_end (the offset after the line) and line. Files
    are cut into ranges first, so one long file is read by many tasks. A last line that no
    newline ends is left for later and one of ``max_line`` bytes or more is skipped. Rows
    with a true ``gone``, where there is that column, have no lines; any other path must be
    there, for a range passed over in silence would be lost once later ones are settled.
    """
    unread = ledgers.filter(F.col("read_from") < F.col("read_to"))
    if "gone" in ledgers.columns:
        unread = unread.filter(~F.coalesce("gone", F.lit(False)))
    # Rows are tiny and stand for much more than they weigh, so the number of tasks comes
    # from the bytes to read and not from the size of this table.
    total = unread.agg(F.sum(F.col("read_to") - F.col("read_from"))).first()[0] or 0
    tasks = max(int(total // TASK_BYTES), ledgers.sparkSession.sparkContext.defaultParallelism)
    ranges = (
        unread.select(
            "source_id",
            "path",
            "read_to",
            F.explode(F.sequence(F.col("read_from"), F.col("read_to") - 1, F.lit(span))).alias("start"),
        )
        .select("source_id", "path", "start", F.least(F.col("start") + span, "read_to").alias("end"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield line_batch(row["source_id"], row["path"], row["start"], row["end"], max_line)

    # Round robin spreads the ranges of one file over many tasks.
    return ranges.repartition(tasks).mapInArrow(read, LINES)


def line_batch(source_id: str, path: str, start: int, end: int, max_line: int) -> pa.RecordBatch:
    lines = list(lines_ending_in(path, start, end, max_line))
    return pa.RecordBatch.from_pydict({
        "source_id": pa.array([source_id] * len(lines), pa.string()),
        "path": pa.array([path] * len(lines), pa.string()),
        "offset": pa.array([offset for offset, _ in lines], pa.int64()),
        "line_end": pa.array([offset + len(line) + 1 for offset, line in lines], pa.int64()),
        "line": pa.array([line.decode("utf-8", "replace") for _, line in lines], pa.string()),
    })


def lines_ending_in(path: str, start: int, end: int, max_line: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of each line whose newline lies in the byte range.

    A line that began before the range is read from its start; bytes after the last
    newline belong to a later range. Lines of ``max_line`` bytes or more are skipped.
    """
    with open(path, "rb") as file:
        data, back = b"", start
        while back > 0 and start - back < max_line and b"\n" not in data[:BACK_BYTES]:
            back = max(0, back - BACK_BYTES)
            file.seek(back)
            data = file.read(start - back)
        file.seek(start)
        inside = len(data)
        data += file.read(end - start)
    cut = data.rfind(b"\n", 0, inside) + 1
    too_long = cut == 0 and back > 0
    while (stop := data.find(b"\n", max(cut, inside))) >= 0:
        if not too_long and stop - cut < max_line:
            yield back + cut, data[cut:stop]
        cut, too_long = stop + 1, False


def frame_batch(city: str, path: str, start: int, end: int, max_frame: int) -> pa.RecordBatch:
    frames = list(frames_closing_in(path, start, end, max_frame))
    return pa.RecordBatch.from_pydict({
        "city": pa.array([city] * len(frames), pa.string()),
        "path": pa.array([path] * len(frames), pa.string()),
        "offset": pa.array([offset for offset, _, _ in frames], pa.int64()),
        "frame_end": pa.array([stop for _, stop, _ in frames], pa.int64()),
        "line": pa.array([line for _, _, line in frames], pa.string()),
    })


def frames_closing_in(path: str, start: int, end: int, max_frame: int) -> Iterator[tuple[int, int, str]]:
    """(offset, end, data) of each frame whose closing blank line ends in the byte range.

    The rules are those of ``sse.frames``: the last ``data:`` line of a frame wins, an empty one
    clears it, other lines do not count and lines may end in CR. A frame that began before the
    range is read from its start. One of ``max_frame`` bytes or more is skipped.
    """
    with open(path, "rb") as file:
        data, back = b"", start
        # Back to the end of the blank line before the range.
        while back > 0 and start - back < max_frame and _after_blank(data) is None:
            back = max(0, back - BACK_BYTES)
            file.seek(back)
            data = file.read(start - back)
        begin = _after_blank(data)
        file.seek(start)
        inside = len(data)
        data += file.read(end - start)
    # Without a blank line nor the start of the file, the first frame is too long to be read.
    whole = begin is not None or back == 0
    at = first = begin or 0
    found = ""
    while (stop := data.find(b"\n", at)) >= 0:
        line = data[at:stop].removesuffix(b"\r")
        if back + at == 0:
            line = line.removeprefix(b"\xef\xbb\xbf")
        at = stop + 1
        if not line:
            if stop >= inside and found and whole and at - first < max_frame:
                yield back + first, back + at, found
            first, found, whole = at, "", True
        elif line.startswith(b"data:"):
            found = line[5:].decode("utf-8", "replace").strip(LINE_SPACE)


def _after_blank(data: bytes) -> int | None:
    """Where what follows the last blank line of ``data`` begins."""
    found = [at + len(blank) for blank in (b"\n\n", b"\n\r\n") if (at := data.rfind(blank)) >= 0]
    return max(found, default=None)
