"""Usage plane: ledger lines to numbered, batched model facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from planes.functions.jsonl import decode_lines
from planes.functions.outcomes import batch_outcome
from planes.operators.numbering import (
    assemble_batches,
    before_first_held,
    first_held,
    number_rows,
)
from planes.schemas import USAGE_FACT, USAGE_LINE, USAGE_SCHEMA_VERSION

KIND_MODEL = "model"
BATCH_MAX = 1000
PASS_BATCHES = 50
READ_WINDOW = 8 << 20


def decode_usage(lines: DataFrame, *, line: str = "line", strict: bool = True) -> DataFrame:
    """Ledger lines to the closed set of usage fields; undecodable lines vanish."""
    return decode_lines(lines, USAGE_LINE, line=line, strict=strict)


def model_facts(usage: DataFrame) -> DataFrame:
    return usage.filter(F.col("kind") == KIND_MODEL)


def number_facts(
    facts: DataFrame,
    order: Sequence[str],
    *,
    cursors: DataFrame | None = None,
    chunk: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Assign each source's facts their seq, going on from ``cursors.next_seq``.

    Seqs depend only on the order of the lines and the cursor, so a replay from the same
    cursor assigns the same ones.
    """
    starts = None if cursors is None else cursors.select("source_id", F.col("next_seq").alias("first"))
    return number_rows(facts, ["source_id"], order, chunk=chunk, starts=starts, limit=limit)


def after_cursor(facts: DataFrame, cursors: DataFrame, position: str) -> DataFrame:
    """Rows at or past each source's committed offset; unknown sources start at 0."""
    at = cursors.select("source_id", F.col("offset").alias("_offset"))
    joined = facts.join(at, "source_id", "left")
    return joined.filter(F.col(position) >= F.coalesce("_offset", F.lit(0))).drop("_offset")


def usage_batches(
    numbered: DataFrame,
    *,
    batch_max: int = BATCH_MAX,
    fields: Sequence[str] = tuple(USAGE_FACT.names),
) -> DataFrame:
    """Batches of at most ``batch_max`` facts per source, in seq order."""
    batches = assemble_batches(numbered, "source_id", fields, batch_max=batch_max, out="facts")
    return batches.withColumn("schema_version", F.lit(USAGE_SCHEMA_VERSION))


def pass_bound(batches: DataFrame, limit: int = PASS_BATCHES) -> DataFrame:
    """Batches a single pass may deliver per source."""
    return batches.filter(F.col("batch_no") < limit)


def receipt_outcomes(receipts: DataFrame) -> DataFrame:
    return receipts.withColumn("outcome", batch_outcome(F.col("http_status")))


def next_cursors(
    lines: DataFrame,
    numbered: DataFrame,
    batches: DataFrame,
    receipts: DataFrame,
    *,
    position: str,
    cursors: DataFrame | None = None,
) -> DataFrame:
    """Cursor per source after delivery: the next seq and the last line passed.

    ``lines`` holds every complete line, forwarded or not. A source whose batches are all
    confirmed passes its trailing lines too; otherwise it stops at the last fact before
    the first held batch. Sources that confirmed nothing have no row and stay put.
    """
    confirmed = batch_outcome(F.col("http_status")) == "advance"
    stops = first_held(batches, receipts, "source_id", confirmed)
    done = before_first_held(numbered.select("source_id", "seq", position), stops, "source_id", "seq")
    partial = done.groupBy("source_id").agg(
        F.max("seq").alias("_seq"), F.max(position).alias("_fact_position")
    )
    seen = lines.groupBy("source_id").agg(F.max(position).alias("_line_position"))
    ends = seen.join(partial, "source_id", "left").join(
        stops.select("source_id", F.lit(True).alias("_held")), "source_id", "left"
    )
    moved = ends.withColumn(
        "last_position",
        F.when(F.col("_held"), F.col("_fact_position")).otherwise(F.col("_line_position")),
    ).filter(F.col("last_position").isNotNull())
    prior = F.lit(1).cast("long")
    if cursors is not None:
        moved = moved.join(cursors.select("source_id", F.col("next_seq").alias("_prior")), "source_id", "left")
        prior = F.greatest("_prior", prior)
    return moved.select(
        "source_id", F.coalesce(F.col("_seq") + 1, prior).alias("next_seq"), "last_position"
    )


def ledger_ranges(manifest: DataFrame) -> DataFrame:
    """What to read of each ledger: its size and identity against its cursor.

    A changed identity (both known) or a size below the offset means the file was
    replaced: read it from the top, keeping ``next_seq``. A file cut short and grown past
    the offset again under the same identity cannot be told apart from appending.
    """
    file_id, cur_id = F.coalesce("file_id", F.lit(0)), F.coalesce("cur_file_id", F.lit(0))
    offset = F.coalesce("cur_offset", F.lit(0)).cast("long")
    rotated = ((file_id != 0) & (cur_id != 0) & (file_id != cur_id)) | (F.col("size") < offset)
    start = F.when(rotated, F.lit(0).cast("long")).otherwise(offset)
    return manifest.select(
        "source_id",
        rotated.alias("rotated"),
        start.alias("read_from"),
        F.greatest("size", start).alias("read_to"),
        (start < F.col("size")).alias("has_new"),
        F.greatest(F.coalesce("next_seq", F.lit(1)), F.lit(1)).cast("long").alias("next_seq"),
        F.when(file_id != 0, file_id).otherwise(cur_id).alias("file_id"),
    )
