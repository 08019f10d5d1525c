"""The planes as streaming queries, one query and one checkpoint each.

A micro-batch writes its outbox epoch and its state version under the epoch's number and
only then is committed. If it dies, or delivery refuses, it runs again from the same
offsets and the same earlier state, so it assigns the same seqs and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from threading import Thread

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from planes.operators import consumer, events, recall, usage
from planes.operators.events import Redaction, TypePolicy
from planes.operators.numbering import BYTE_CHUNK_BITS
from planes.plans.recall_pass import RecallPass
from planes.schemas import EVENT_CURSOR, HIGH_WATER, LISTING, USAGE_CURSOR
from planes.session import shared_dir
from planes.sources.files import from_manifest
from planes.sources.ledger import LEDGER_CHUNK, LEDGER_ORDER
from planes.sources.outbox import store_epoch
from planes.sources.sse import frames
from planes.sources.state import StateTable
from planes.sources.textlines import stream_lines, with_line_id
from planes.streaming import replays
from planes.streaming.tail_source import FrameSource, TailSource

USAGE_SECONDS, USAGE_FLOOR = 5, 1
EVENT_SECONDS, EVENT_FLOOR = 5, 1
RECALL_SECONDS, RECALL_FLOOR = 60, 5

# Takes the batches of one epoch; raising keeps the epoch uncommitted.
Deliver = Callable[[DataFrame], None]


@dataclass(frozen=True)
class Folders:
    """Everything a query keeps. Checkpoint and state belong together: epochs count both."""

    root: str

    @classmethod
    def shared(cls, spark: SparkSession, name: str) -> Folders:
        """Folders below the one the cluster shares between executors."""
        return cls(f"{shared_dir(spark)}/{name}")

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    @property
    def state(self) -> str:
        return f"{self.root}/state"

    @property
    def outbox(self) -> str:
        return f"{self.root}/outbox"

    def stored(self, rows: DataFrame, kind: str, epoch: int) -> DataFrame:
        return store_epoch(rows, self.root, kind, epoch)


def cadence(seconds: float | None, default: int, floor: int) -> dict:
    """Arguments for ``trigger``: every so many seconds, never below the floor."""
    return {"processingTime": f"{max(seconds or default, floor)} seconds"}


def _start(
    stream: DataFrame, folders: Folders, name: str, step: Callable[[DataFrame, int], None], trigger: dict
) -> StreamingQuery:
    # Names of running queries must differ, also between two fleets.
    writer = stream.writeStream.queryName(f"{name} {folders.root}")
    writer = writer.option("checkpointLocation", folders.checkpoint).foreachBatch(step)
    if trigger != DRAIN:
        return writer.trigger(**trigger).start()
    query = writer.trigger(processingTime="0 seconds").start()
    Thread(target=_stop_when_drained, args=(query,), daemon=True).start()
    return query


# Batch after batch until there is nothing left to read. Spark's own trigger for that asks a
# Python source once, which is one batch where its batches are limited.
DRAIN = {"drain": True}


def _once(growing: bool, options: dict[str, str]) -> dict:
    return DRAIN if growing and "maxBytesPerTrigger" in options else {"availableNow": True}


def _stop_when_drained(query: StreamingQuery) -> None:
    try:
        query.processAllAvailable()
    except Exception:  # noqa: BLE001 - the query keeps its error for those who wait for it
        return
    query.stop()


def _growing(
    spark: SparkSession, source: type, path: str, pattern: str, folders: Folders, options: dict[str, str], once: bool
) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).option("progressPath", f"{folders.root}/progress.json")
    # Options of the caller come last; a limited pass reads what is there when it starts.
    limited = once and "maxBytesPerTrigger" in options
    reader = reader.option("sourcePattern", pattern).option("untilNow", str(limited).lower())
    return reader.options(**options).load(path)


def start_usage(
    spark: SparkSession,
    path: str,
    folders: Folders,
    *,
    source_pattern: str = r"([^/]+)/[^/]*$",
    growing: bool = False,
    batch_max: int = usage.BATCH_MAX,
    seconds: float | None = None,
    once: bool = False,
    deliver: Deliver | None = None,
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Ledgers to numbered batches in the outbox.

    ``growing`` tails files that are still written to; otherwise ``path`` holds finished
    segments. ``options`` are the source's, such as ``maxBytesPerTrigger`` of growing files.
    """
    options = options or {}
    if growing:
        lines = _growing(spark, TailSource, path, source_pattern, folders, options, once)
    else:
        lines = stream_lines(spark, path, **options).withColumn(
            "source_id", F.regexp_extract("file_path", source_pattern, 1)
        )

    def step(micro_batch: DataFrame, epoch: int) -> None:
        state = StateTable(micro_batch.sparkSession, folders.state, USAGE_CURSOR)
        cursors = state.read(before=epoch)
        if growing:
            order = ["path", "offset"]
            chunk = ["path", "_block"]
            rows = micro_batch.withColumn("_block", F.shiftright("offset", BYTE_CHUNK_BITS))
        else:
            order, chunk = LEDGER_ORDER, LEDGER_CHUNK
            rows = with_line_id(micro_batch).filter(F.octet_length("line") < usage.READ_WINDOW)
        facts = usage.model_facts(usage.decode_usage(rows))
        numbered = usage.number_facts(
            folders.stored(facts, "facts", epoch), order, chunk=chunk, cursors=cursors
        )
        written = folders.stored(usage.usage_batches(numbered, batch_max=batch_max), "outbox", epoch)
        if deliver is not None:
            deliver(written)
        ends = written.groupBy("source_id").agg((F.max("last_seq") + 1).alias("_next"))
        moved = state.lookup(ends, before=epoch, name="_old").select(
            "source_id",
            F.coalesce("_old.offset", F.lit(0)).alias("offset"),
            F.col("_next").alias("next_seq"),
            F.coalesce("_old.file_id", F.lit(0)).alias("file_id"),
        )
        state.upsert(moved, epoch)

    trigger = _once(growing, options) if once else cadence(seconds, USAGE_SECONDS, USAGE_FLOOR)
    return _start(lines, folders, "usage", step, trigger)


def start_events(
    spark: SparkSession,
    path: str,
    folders: Folders,
    policy: TypePolicy,
    redaction: Redaction,
    *,
    city_pattern: str = r"([^/]+)/[^/]*$",
    growing: bool = False,
    batch_max: int = events.BATCH_MAX,
    seconds: float | None = None,
    once: bool = False,
    deliver: Deliver | None = None,
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Stream captures to redacted batches in the outbox.

    ``growing`` tails captures that are still written to: a frame comes once its blank line is
    there. Otherwise ``path`` holds finished captures. ``options`` are the source's.
    """
    options = options or {}
    if growing:
        stream = _growing(spark, FrameSource, path, city_pattern, folders, options, once)
    else:
        stream = stream_lines(spark, path, **options).withColumn(
            "city", F.regexp_extract("file_path", city_pattern, 1)
        )

    def step(micro_batch: DataFrame, epoch: int) -> None:
        state = StateTable(micro_batch.sparkSession, folders.state, EVENT_CURSOR)
        cursors = state.read(before=epoch)
        framed = micro_batch
        if not growing:
            lines = with_line_id(micro_batch)
            framed = frames(lines, ["city", "file_path"], ["line_id"], chunk=["block_start"])
        decoded = events.decode_events(
            framed.select("city", "line"), content=redaction.emit_content
        )
        fresh = events.resume(decoded, cursors)
        envelopes = folders.stored(
            events.redact(fresh, policy, redaction, keep_dropped=True), "envelopes", epoch
        )
        batches = events.event_batches(envelopes.filter("exported"), batch_max=batch_max)
        written = folders.stored(batches, "outbox", epoch)
        if deliver is not None:
            deliver(written)
        seen = envelopes.groupBy("city").agg(F.max("seq").alias("seq"))
        newest = state.lookup(seen, before=epoch, name="_old").select(
            "city", F.greatest("seq", "_old.seq").alias("seq")
        )
        state.upsert(newest, epoch)

    trigger = _once(growing, options) if once else cadence(seconds, EVENT_SECONDS, EVENT_FLOOR)
    return _start(stream, folders, "events", step, trigger)


def start_recall(
    spark: SparkSession,
    manifests: str,
    folders: Folders,
    *,
    strict: bool = False,
    max_bytes: int = recall.MAX_BYTES,
    seconds: float | None = None,
    once: bool = False,
    deliver: Callable[[DataFrame], DataFrame] | None = None,
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Listings, as they arrive in folder ``manifests``, to snapshots in the outbox.

    ``deliver`` takes an epoch's snapshots and returns their receipts (path, http_status),
    which are settled before the epoch is committed. Without it the outbox is left for
    ``RecallPass.settle``.
    """
    plane = RecallPass(spark, folders.root, strict, max_bytes)
    listings = spark.readStream.schema(LISTING).options(**(options or {})).parquet(manifests)

    def step(micro_batch: DataFrame, epoch: int) -> None:
        outbox = plane.plan(from_manifest(micro_batch), epoch)
        if deliver is not None:
            plane.settle(epoch, deliver(outbox.filter(F.col("action") == "send")))

    trigger = {"availableNow": True} if once else cadence(seconds, RECALL_SECONDS, RECALL_FLOOR)
    return _start(listings, folders, "recall", step, trigger)


def start_ingest(
    spark: SparkSession,
    outbox: str,
    folders: Folders,
    *,
    seconds: float | None = None,
    once: bool = False,
) -> StreamingQuery:
    """The receiving side of usage batches: each source's facts once, above its high water."""
    schema = spark.read.parquet(outbox).schema
    batches = spark.readStream.schema(schema).parquet(outbox)

    def step(micro_batch: DataFrame, epoch: int) -> None:
        state = StateTable(micro_batch.sparkSession, folders.state, HIGH_WATER)
        marks = state.read(before=epoch)
        checked = consumer.validate(consumer.facts_of(micro_batch))
        fresh = consumer.drop_replays(checked.filter(F.col("verdict") == "accepted"), marks)
        spend = folders.stored(consumer.spend_rows(fresh.drop("verdict")), "outbox", epoch)
        # Rows above a mark are all that is left, so what is new is higher than it.
        state.upsert(consumer.next_high_water(marks.limit(0), spend), epoch)

    trigger = {"availableNow": True} if once else cadence(seconds, USAGE_SECONDS, USAGE_FLOOR)
    return _start(batches, folders, "ingest", step, trigger)


def start_ingest_unordered(
    spark: SparkSession,
    outbox: str,
    folders: Folders,
    *,
    span_bits: int = replays.SPAN_BITS,
    expiry_days: float = replays.EXPIRY_DAYS,
    seconds: float | None = None,
    once: bool = False,
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """``start_ingest`` for batches that may arrive in any order: each fact once, by state that
    the query keeps itself. An epoch costs what it touches and rewrites no table."""
    schema = spark.read.parquet(outbox).schema
    batches = spark.readStream.schema(schema).options(**(options or {})).parquet(outbox)
    checked = consumer.validate(consumer.facts_of(batches)).filter(F.col("verdict") == "accepted")
    spend = consumer.spend_rows(replays.first_of_each(checked.drop("verdict"), span_bits, expiry_days))

    def step(micro_batch: DataFrame, epoch: int) -> None:
        folders.stored(micro_batch, "outbox", epoch)

    trigger = {"availableNow": True} if once else cadence(seconds, USAGE_SECONDS, USAGE_FLOOR)
    before = {key: spark.conf.get(key, None) for key in replays.SETTINGS}
    for key, value in replays.SETTINGS.items():
        spark.conf.set(key, value)
    try:
        return _start(spend, folders, "ingest", step, trigger)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


Starter = Callable[[], StreamingQuery]


def start_all(starters: dict[str, Starter]) -> dict[str, StreamingQuery | Exception]:
    """Start each query on its own; one that cannot start leaves its error in its place."""
    running: dict[str, StreamingQuery | Exception] = {}
    for name, starter in starters.items():
        try:
            running[name] = starter()
        except Exception as error:  # noqa: BLE001 - one plane must not stop another
            running[name] = error
    return running


def restart_failed(
    running: dict[str, StreamingQuery | Exception], starters: dict[str, Starter]
) -> dict[str, StreamingQuery | Exception]:
    """Start again what failed and leave the others alone."""
    failed = {
        name: starters[name]
        for name, q in running.items()
        if isinstance(q, Exception) or (not q.isActive and q.exception() is not None)
    }
    return {**running, **start_all(failed)}
