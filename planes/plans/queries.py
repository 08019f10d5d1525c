"""One query per operator, over the views of ``planes.plans.views``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planes.functions.text import (
    actor_hash,
    city_names,
    fingerprint,
    starts_with_key_block,
)
from planes.operators import consumer, events, leaks, recall, usage
from planes.operators.numbering import with_span_chunk
from planes.plans.views import (
    POLICY,
    REDACTION,
    SALT,
    event_frames,
    sse_lines,
    usage_lines,
    view,
)
from planes.schemas import COST
from planes.sources.sse import frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Small caps so that several batches and files fall on either side at test scale.
USAGE_BATCH = 25
EVENT_BATCH = 1000
MAX_BYTES = 4000

USAGE_VIEW_FIELDS = (
    "seq", "run_id", "session_id", "step_id", "kind", "model",
    "input_tokens", "output_tokens", "cost_usd_estimate",
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --- usage ---------------------------------------------------------------------------


@query
def usage_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.decode_usage(usage_lines(spark, sf_dir))


@query
def usage_model_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.model_facts(view(spark, sf_dir, "v_usage"))


def _numbered(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    facts = usage.model_facts(view(spark, sf_dir, "v_usage"))
    return usage.number_facts(facts, ["line_no"], **kw)


@query
def usage_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = view(spark, sf_dir, "v_usage_cursor")
    return _numbered(spark, sf_dir, cursors=cursors).select("source_id", "line_no", "seq", "run_id")


@query
def usage_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = view(spark, sf_dir, "v_usage_cursor")
    rest = usage.after_cursor(
        usage.model_facts(view(spark, sf_dir, "v_usage")), cursors, "line_no"
    )
    taken = usage.number_facts(rest, ["line_no"], cursors=cursors, limit=USAGE_BATCH)
    return taken.select("source_id", "line_no", "seq", "run_id")


def _usage_batches(spark: SparkSession, sf_dir: str, batch_max: int = USAGE_BATCH) -> DataFrame:
    return usage.usage_batches(
        _numbered(spark, sf_dir), batch_max=batch_max, fields=USAGE_VIEW_FIELDS
    )


@query
def usage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.transform(
        "facts",
        lambda f: F.concat_ws(
            "|", f["seq"], f["run_id"], f["session_id"], f["step_id"], f["model"],
            f["input_tokens"], f["output_tokens"], f["cost_usd_estimate"].cast(COST),
        ),
    )
    return _usage_batches(spark, sf_dir).select(
        "source_id", "batch_no", "schema_version", "n", "first_seq", "last_seq",
        F.concat_ws(";", body).alias("body"),
    )


@query
def usage_pass_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded = usage.pass_bound(_usage_batches(spark, sf_dir, 2), limit=5)
    return bounded.select("source_id", "batch_no", "n", "first_seq", "last_seq")


@query
def usage_receipt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("batch_no") % 7
    status = (
        F.when(code == 0, 200).when(code == 1, 204).when(code == 2, 429).when(code == 3, 503)
        .when(code == 4, 400).when(code == 5, 302)
    )
    receipts = _usage_batches(spark, sf_dir, 3).select(
        "source_id", "batch_no", status.cast("int").alias("http_status")
    )
    return usage.receipt_outcomes(receipts)


def _held_after(batches: DataFrame, key: str, skip: int, all_ok: int) -> DataFrame:
    """Receipts where key number k holds its batch k and confirms all others."""
    k = F.substring(key, skip, 9).cast("int")
    status = F.when(k == all_ok, 201).when(F.col("batch_no") == k, F.when(k == 1, 422)).otherwise(200)
    return batches.select(key, "batch_no", status.cast("int").alias("http_status"))


@query
def usage_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = _usage_batches(spark, sf_dir)
    return usage.next_cursors(
        view(spark, sf_dir, "v_usage"),
        _numbered(spark, sf_dir),
        batches,
        _held_after(batches, "source_id", 6, 3),
        position="line_no",
    )


@query
def ledger_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.ledger_ranges(view(spark, sf_dir, "v_ledger"))


# --- events --------------------------------------------------------------------------


@query
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = with_span_chunk(sse_lines(spark, sf_dir), "pos")
    return frames(lines, ["city"], ["pos"], chunk=["_chunk"]).select(
        "city", "frame_no", F.col("line").alias("data")
    )


@query
def event_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = events.decode_events(event_frames(spark, sf_dir), content=True)
    return decoded.withColumn("ts_micros", micros("ts")).drop("ts")


@query
def event_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = events.resume(view(spark, sf_dir, "v_events"), view(spark, sf_dir, "v_cursor"))
    return kept.select("city", "seq", "type")


@query
def event_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.allow(view(spark, sf_dir, "v_events"), POLICY).select("city", "seq", "type", "ts")


def _envelopes(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return events.redact(view(spark, sf_dir, "v_events"), POLICY, replace(REDACTION, **kw))


@query
def event_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelopes(spark, sf_dir)


@query
def event_ref_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = _envelopes(spark, sf_dir).select(F.lit(True).alias("export_ref"), "city", "seq", "ref")
    off = _envelopes(spark, sf_dir, export_ref=False).select(
        F.lit(False).alias("export_ref"), "city", "seq", "ref"
    )
    return on.unionByName(off)


@query
def event_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ["city", "seq", "run_id", "session_id", "step_id"]
    on = _envelopes(spark, sf_dir).select(F.lit(True).alias("emit_correlation"), *ids)
    off = _envelopes(spark, sf_dir, emit_correlation=False).select(
        F.lit(False).alias("emit_correlation"), *ids
    )
    return on.unionByName(off)


@query
def event_content_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifted = _envelopes(spark, sf_dir, emit_content=True)
    return lifted.select("city", "seq", "title", "formula", "run_id", "step_id")


@query
def event_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifted = events.lift_content(view(spark, sf_dir, "v_events"))
    return lifted.select("city", "seq", "formula")


@query
def event_id_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifted = events.lift_content(view(spark, sf_dir, "v_events"))
    return lifted.select("city", "seq", "run_id", "step_id", "session_id")


@query
def event_actor_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_events")
    return v.select("city", "seq", actor_hash(F.col("actor"), SALT).alias("actor_hash"))


@query
def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = events.event_batches(_envelopes(spark, sf_dir), batch_max=EVENT_BATCH)
    body = F.transform(
        "events",
        lambda e: F.concat_ws(
            "|", e["seq"], e["type"], F.date_format(e["ts"], "yyyy-MM-dd HH:mm:ss"),
            e["actor_hash"], e["ref"], e["run_id"], e["session_id"], e["step_id"],
        ),
    )
    return batches.select(
        F.col("city").alias("city_id"), "batch_no", "schema_version", "n", "first_seq",
        "last_seq", F.concat_ws(";", body).alias("body"),
    )


@query
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = events.event_batches(_envelopes(spark, sf_dir), batch_max=EVENT_BATCH // 10)
    receipts = _held_after(batches, "city", 2, 4)
    return events.next_event_cursors(view(spark, sf_dir, "v_events"), batches, receipts)


@query
def event_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "v_events")
    actors = raw.select("actor")
    forbidden = ("@corp.example", "slug ")
    clean = events.audit_envelopes(_envelopes(spark, sf_dir), actors, REDACTION, forbidden)
    # The same audit over envelopes nobody redacted, to see it count.
    naked = raw.select(
        "city", "seq", "type", "ts", F.col("actor").alias("actor_hash"), F.col("subject").alias("ref"),
        F.concat(F.lit(" "), "run_id").alias("run_id"), "session_id", "step_id",
        F.lit("a title").alias("title"), F.lit("").alias("formula"),
    )
    leaky = events.audit_envelopes(naked, actors, REDACTION, forbidden)
    return clean.withColumn("variant", F.lit("redacted")).unionByName(
        leaky.withColumn("variant", F.lit("raw"))
    )


@query
def event_leak_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw actors and their names before the @, anywhere in what leaves."""
    raw = view(spark, sf_dir, "v_events")
    names = raw.select(F.explode(F.array("actor", F.substring_index("actor", "@", 1))).alias("name"))
    clean = _envelopes(spark, sf_dir)
    # Some run ids that have a name in them, to see it found.
    actors = raw.select("city", "seq", "actor")
    planted = clean.join(actors, ["city", "seq"]).withColumn(
        "run_id",
        F.when(F.col("seq") % 97 == 0, F.concat(F.lit("run-"), F.substring_index("actor", "@", 1), F.lit("-7")))
        .when(F.col("seq") % 97 == 1, F.concat("actor", F.lit("/"), "run_id"))
        .otherwise(F.col("run_id")),
    )
    return leaks.search_envelopes(clean, names).withColumn("variant", F.lit("redacted")).unionByName(
        leaks.search_envelopes(planted.drop("actor"), names).withColumn("variant", F.lit("planted"))
    )


@query
def city_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_city_config")
    return v.select("c_custkey", F.concat_ws("|", city_names(F.col("raw"))).alias("cities"))


# --- recall --------------------------------------------------------------------------


def _snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_snap")


@query
def snap_deny_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")
    return _snap(spark, sf_dir).filter(~recall.denied(base, globs=())).select("doc_id", "base")


@query
def snap_deny_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")
    return _snap(spark, sf_dir).filter(~recall.denied(base)).select("doc_id", "base")


@query
def snap_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snap(spark, sf_dir).filter(recall.is_transcript(F.col("base"))).select("doc_id", "base")


@query
def snap_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_odd_paths")
    return v.select("doc_id", recall.contained(F.col("root"), F.col("path")).alias("contained"))


@query
def snap_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_odd_paths")
    found = v.select("doc_id", "path", recall.provider_of(F.col("path")).alias("provider"))
    return found.filter(F.col("provider").isNotNull())


@query
def snap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.candidates(_snap(spark, sf_dir).drop("provider", "content"))
    return found.select("doc_id", "source_id", "root", "path", "provider", "size", "mtime_ms")


@query
def snap_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.candidates(_snap(spark, sf_dir).drop("provider", "content"), strict=True)
    return found.select("doc_id", "path", "provider")


@query
def snap_strict_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.listed(_snap(spark, sf_dir).drop("provider", "content"))
    return recall.strict_dropped(found, ["source_id"])


@query
def snap_pem_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 2 == 0, "\ufeff \t\r\n").otherwise("")
    key = F.concat(head, F.lit("-----BEGIN PRIVATE KEY-----\n"), "content")
    content = F.when(F.col("doc_id") % 23 == 0, key).otherwise(F.col("content"))
    v = view(spark, sf_dir, "v_files").withColumn("content", content)
    kept = v.filter(~starts_with_key_block(F.col("content").cast("binary")))
    return kept.select("doc_id", "path")


@query
def snap_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.within_cap(view(spark, sf_dir, "v_files"), MAX_BYTES).select("doc_id", "path", "size")


@query
def snap_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_files")
    return v.select("path", fingerprint(F.col("content").cast("binary")).alias("sha256"))


@query
def snap_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.snapshot_manifest(recall.candidates(_snap(spark, sf_dir).drop("provider")))


@query
def snap_path_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _snap(spark, sf_dir).select("doc_id", "path", "root")
    outer = F.struct(F.lit(0).alias("root_no"), F.regexp_extract("root", "^(.*)/[^/]*$", 1).alias("root"))
    inner = F.struct(F.lit(1).alias("root_no"), F.col("root"))
    roots = F.when(F.col("doc_id") % 3 == 0, F.array(inner, outer)).otherwise(F.array(inner))
    listed = v.select("path", F.inline(roots))
    return recall.dedupe_paths(listed)


def _diffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "v_files").drop("content")
    return recall.diff(files, view(spark, sf_dir, "v_state"), max_bytes=MAX_BYTES)


@query
def snap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffed(spark, sf_dir).select("path", "action", "size")


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.settle(_diffed(spark, sf_dir), view(spark, sf_dir, "v_receipt"))


@query
def snap_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = _settled(spark, sf_dir)
    return settled.filter(F.col("outcome").isNotNull()).select("path", "http_status", "outcome")


@query
def snap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.scan_stats(_settled(spark, sf_dir))


def _state_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.next_state(view(spark, sf_dir, "v_state"), _settled(spark, sf_dir))


@query
def snap_state_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_next(spark, sf_dir)


@query
def snap_no_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass in which every file was touched but none changed."""
    touched = view(spark, sf_dir, "v_files").drop("content").withColumn(
        "mtime_ms", F.col("mtime_ms") + 5
    )
    again = recall.diff(touched, _state_next(spark, sf_dir), max_bytes=MAX_BYTES)
    return again.select("path", "action")


@query
def roots_unscoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.unscoped_roots(view(spark, sf_dir, "v_roots"))


# --- consumer ------------------------------------------------------------------------


@query
def usage_hwm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts delivered up to three times, some with the invalid seq 0."""
    facts = _numbered(spark, sf_dir).select("source_id", "seq", "run_id")
    times = F.sequence(F.lit(0), F.col("seq") % 3)
    delivered = facts.select("source_id", "seq", "run_id", F.explode(times).alias("_t")).drop("_t")
    invalid = facts.filter(F.col("seq") % 10 == 0).withColumn("seq", F.lit(0).cast("long"))
    return consumer.drop_replays(delivered.unionByName(invalid), view(spark, sf_dir, "v_hwm"))


@query
def usage_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("line_no") % 9 == 0, 2).otherwise(1)
    facts = view(spark, sf_dir, "v_usage").withColumn("schema_version", version)
    return consumer.validate(facts).select("source_id", "line_no", "verdict")


@query
def spend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = consumer.facts_of(_usage_batches(spark, sf_dir))
    return consumer.spend_rows(facts).select(
        "source_id", "seq", "run_id", "session_id", "step_id", "model",
        "input_tokens", "output_tokens", "cost_usd", "source",
    )


@query
def step_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = view(spark, sf_dir, "v_events").select(
        F.regexp_replace("run_id", "^mc-run", "run-").alias("run_id"),
        F.regexp_replace("step_id", "^step", "step-").alias("step_id"),
    )
    spend = consumer.spend_rows(usage.model_facts(view(spark, sf_dir, "v_usage")))
    return consumer.step_spend(steps, spend)
