"""Usage ledgers: append-only JSON-lines files, one directory tree for many sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from planes.operators.usage import READ_WINDOW
from planes.sources.textlines import complete_lines, existing, read_lines

# Order of a line within its source, and the bounded pieces that order falls into.
LEDGER_ORDER = ["file_path", "block_start", "line_id"]
LEDGER_CHUNK = ["file_path", "block_start"]


def read_ledgers(
    spark: SparkSession, paths: str | list[str], source_pattern: str, *, sealed: bool = False
) -> DataFrame:
    """Complete lines of every ledger under ``paths`` that exists, tagged ``source_id``.

    ``source_pattern`` is a regular expression whose first group finds the source in a
    file's path. A source's files are read in order of their paths. Blank lines and lines
    no read window could hold are skipped. A last line without its newline is held back;
    ``sealed=True`` says the files are finished and saves the pass that looks for one.
    """
    found = existing(spark, [paths] if isinstance(paths, str) else paths)
    if not found:
        return spark.createDataFrame(
            [], "source_id string, file_path string, block_start long, line_id long, line string"
        )
    lines = read_lines(spark, found)
    if not sealed:
        lines = complete_lines(lines)
    kept = lines.filter((F.trim("line") != "") & (F.octet_length("line") < READ_WINDOW))
    return kept.select(
        F.regexp_extract("file_path", source_pattern, 1).alias("source_id"),
        "file_path",
        "block_start",
        "line_id",
        "line",
    )
