"""Captured server-sent event streams to frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from planes.functions.jsonl import LINE_SPACE
from planes.sources.textlines import read_lines

DATA = "data:"


def frames(
    lines: DataFrame, keys: Sequence[str], order: Sequence[str], *, chunk: Sequence[str]
) -> DataFrame:
    """One row per dispatched frame: ``keys``, ``frame_no`` and its data as ``line``.

    A blank line dispatches the frame before it; the frame's last ``data:`` line wins and
    an empty one clears it. A frame that no blank line closes is still being written and
    is held back. ``chunk`` cuts a capture into bounded pieces, so that counting blank
    lines never needs a whole capture in one task.
    """
    keys, chunk, order = list(keys), list(chunk), list(order)
    # Only blank and data lines matter; a line may end in CR.
    line = F.col("line")
    text = F.when(line.endswith("\r"), F.left(line, F.length(line) - 1)).otherwise(line)
    place = list(dict.fromkeys([*chunk, *order]))
    kept = lines.select(*keys, *place, text.alias("line")).filter(
        (F.col("line") == "") | F.col("line").startswith(DATA)
    )
    blank = F.col("line") == ""

    blanks = kept.groupBy(*keys, *chunk).agg(F.count_if(blank).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    bases = blanks.select(
        *keys,
        *chunk,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias("_closed"),
    )
    before = Window.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = kept.withColumn("_local", F.coalesce(F.count_if(blank).over(before), F.lit(0)))
    # Joined in the window's order, and without the blank lines it has counted.
    numbered = local.filter(~blank).join(bases, [*keys, *chunk]).withColumn(
        "frame_no", F.col("_base") + F.col("_local")
    )
    closed = numbered.filter(F.col("frame_no") < F.col("_closed"))
    value = F.btrim(F.substring("line", len(DATA) + 1, 1 << 30), F.lit(LINE_SPACE))
    last = closed.groupBy(*keys, "frame_no").agg(F.max_by(value, F.struct(*place)).alias("line"))
    return last.filter(F.col("line") != "")


def read_sse(spark: SparkSession, paths: str | list[str], city_pattern: str) -> DataFrame:
    """Frames of all captures under ``paths``, tagged with their ``city``.

    ``city_pattern`` is a regular expression whose first group finds the city in a file's
    path. One scan covers every city.
    """
    lines = read_lines(spark, paths).withColumn("city", F.regexp_extract("file_path", city_pattern, 1))
    return frames(lines, ["city", "file_path"], ["line_id"], chunk=["block_start"])
