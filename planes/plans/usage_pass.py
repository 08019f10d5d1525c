"""One usage pass over ledgers at rest: what to deliver, and how far the cursors move."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from planes.operators import usage
from planes.operators.numbering import BYTE_CHUNK_BITS
from planes.schemas import USAGE_CURSOR
from planes.sources.outbox import read_epoch, store_epoch
from planes.sources.ranges import read_ranges
from planes.sources.state import StateTable


@dataclass(frozen=True)
class UsagePass:
    """Folders of a usage plane: cursors, and per pass its lines, facts and outbox."""

    spark: SparkSession
    root: str
    batch_max: int = usage.BATCH_MAX
    # A bound on the batches of a pass is a choice; what lies beyond it is read again.
    max_batches: int | None = None

    @property
    def state(self) -> StateTable:
        return StateTable(self.spark, f"{self.root}/state", USAGE_CURSOR)

    def _stored(self, rows: DataFrame, kind: str, epoch: int) -> DataFrame:
        return store_epoch(rows, self.root, kind, epoch)

    def plan(self, manifest: DataFrame, epoch: int) -> DataFrame:
        """Write and return the epoch's batches.

        ``manifest`` has one row per source: source_id, path, file_id, size. Only bytes
        past each cursor are read, once. Planning an epoch again gives the same batches.
        """
        cursors = self.state.read(before=epoch)
        known = cursors.select(
            "source_id",
            F.col("offset").alias("cur_offset"),
            # A cursor that never numbered a fact does not vouch for its file.
            F.when(F.col("next_seq") > 0, F.col("file_id")).alias("cur_file_id"),
            "next_seq",
        )
        joined = manifest.join(known, "source_id", "left")
        ranges = self._stored(
            usage.ledger_ranges(joined).join(manifest.select("source_id", "path"), "source_id"),
            "ranges",
            epoch,
        )
        lines = self._stored(read_ranges(ranges), "lines", epoch)
        facts = self._stored(
            usage.model_facts(usage.decode_usage(lines)).withColumn(
                "_block", F.shiftright("offset", BYTE_CHUNK_BITS)
            ),
            "facts",
            epoch,
        )
        numbered = self._stored(
            usage.number_facts(
                facts, ["offset"], chunk=["_block"], cursors=ranges,
                limit=None if self.max_batches is None else self.batch_max * self.max_batches,
            ),
            "numbered",
            epoch,
        )
        return self._stored(usage.usage_batches(numbered, batch_max=self.batch_max), "outbox", epoch)

    def settle(self, epoch: int, receipts: DataFrame) -> DataFrame:
        """Move the cursors over the epoch's confirmed batches; returns the new cursors.

        ``receipts`` has source_id, batch_no, http_status.
        """
        read = lambda kind: read_epoch(self.spark, self.root, kind, epoch)
        ranges, lines, facts, numbered = (read(k) for k in ("ranges", "lines", "facts", "numbered"))
        # A source with more facts than one pass takes stops at the last one taken.
        per_source = facts.groupBy("source_id").agg(F.count(F.lit(1)).alias("_all"))
        taken = numbered.groupBy("source_id").agg(
            F.count(F.lit(1)).alias("_taken"), F.max("line_end").alias("_taken_end")
        )
        cut = per_source.join(taken, "source_id").filter("_all > _taken").select("source_id", "_taken_end")
        passed = lines.join(cut, "source_id", "left").filter(
            F.col("_taken_end").isNull() | (F.col("line_end") <= F.col("_taken_end"))
        )
        moved = usage.next_cursors(
            passed, numbered, read("outbox"), receipts, position="line_end", cursors=ranges
        ).select("source_id", F.col("last_position").alias("_offset"), F.col("next_seq").alias("_next"))
        at_file = moved.join(ranges.select("source_id", F.col("file_id").alias("_file")), "source_id")
        old = self.state.lookup(at_file, before=epoch, name="_old")
        changed = old.select(
            "source_id",
            F.coalesce("_offset", "_old.offset").alias("offset"),
            F.coalesce("_next", "_old.next_seq").alias("next_seq"),
            F.coalesce("_file", "_old.file_id").alias("file_id"),
        )
        self.state.upsert(changed, epoch)
        return self.state.read()
