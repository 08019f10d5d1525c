"""One recall pass over transcript files: what to send, and what became of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from planes.functions.text import starts_with_key_block
from planes.operators import recall
from planes.schemas import SNAPSHOT_STATE
from planes.sources.files import read_content
from planes.sources.outbox import read_epoch, store_epoch
from planes.sources.state import StateTable

# Content bytes one task should read; a single file may exceed it.
TASK_BYTES = 512 << 20

LISTING = ["source_id", "root", "path", "provider", "size", "mtime_ms"]


@dataclass(frozen=True)
class RecallPass:
    """Folders of a recall plane: snapshot state, and one outbox epoch per pass."""

    spark: SparkSession
    root: str
    strict: bool = False
    max_bytes: int = recall.MAX_BYTES

    @property
    def state(self) -> StateTable:
        return StateTable(self.spark, f"{self.root}/state", SNAPSHOT_STATE)

    def plan(self, listing: DataFrame, epoch: int) -> DataFrame:
        """Write and return the epoch's decisions; those to send carry their content.

        Names and places are checked first, then time and size against the state. Only
        files that pass both are opened, once. Planning an epoch again gives the same.
        """
        if "root_no" not in listing.columns:
            listing = listing.withColumn("root_no", F.lit(0))
        # Filtered before anything is shuffled. A path counts once, under the first root
        # it passes for. Only the listing is shuffled to meet the state, which stays in place.
        found = recall.dedupe_paths(recall.candidates(listing, strict=self.strict))
        to_read = recall.unread(self.state.lookup(found, before=epoch), self.max_bytes).select(
            *LISTING,
            F.col("prior.status").alias("prior_status"),
            F.col("prior.sha256_hex").alias("prior_sha256"),
        )
        # Bytes to open are added up while the rows are written, not by a job of their own.
        seen = Observation()
        planned = store_epoch(to_read, self.root, "to_read", epoch, observe=seen, metrics=[F.sum("size").alias("bytes")])
        tasks = max((seen.get["bytes"] or 0) // TASK_BYTES + 1, self.spark.sparkContext.defaultParallelism)
        spread = planned.repartition(int(tasks), "path")
        opened = read_content(spread, max_bytes=self.max_bytes)
        opened = opened.filter(~starts_with_key_block(F.col("head"))).drop("head")
        # The prior record travels with the row, so content is never joined or shuffled;
        # its time and size have already been compared.
        unknown = F.lit(None).cast("long")
        prior = F.struct(
            F.col("prior_status").alias("status"),
            F.col("prior_sha256").alias("sha256_hex"),
            unknown.alias("mtime_ms"),
            unknown.alias("size"),
        )
        decided = opened.withColumn("prior", prior).withColumn(
            "action", recall.diff_action(self.max_bytes)
        )
        sent = F.when(F.col("action") == "send", F.col("content"))
        outbox = decided.drop("prior", "prior_status", "prior_sha256").withColumn("content", sent)
        return store_epoch(outbox, self.root, "outbox", epoch)

    def settle(self, epoch: int, receipts: DataFrame) -> DataFrame:
        """Fold the epoch's receipts into the state; returns the pass's statistics.

        A pass that sent, failed and skipped nothing leaves the state as it was.
        """
        decided = read_epoch(self.spark, self.root, "outbox", epoch).drop("content")
        settled = recall.settle(decided, receipts)
        stats = recall.scan_stats(settled, [])
        if any(stats.first()):
            # Only the records that change are read and written.
            changing = recall.changing(settled)
            old = self.state.lookup(changing.select("path"), before=epoch).filter("prior is not null")
            self.state.upsert(recall.next_state(old.select("path", "prior.*"), changing), epoch)
        return stats
