"""Events plane: decoded events to redacted, batched envelopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from planes.functions.jsonl import decode_lines, zero_filled
from planes.functions.outcomes import batch_outcome
from planes.functions.text import actor_hash, formula_of_ref, rfc3339
from planes.operators.numbering import (
    assemble_batches,
    before_first_held,
    first_held,
    number_rows,
)
from planes.schemas import ENVELOPE, EVENT_LINE, EVENT_LINE_WITH_PAYLOAD, EVENT_SCHEMA_VERSION, S

BATCH_MAX = 1000

# An opaque id: the shape a subject or correlation id must have to leave.
OPAQUE_REF = r"^[a-z]{2,}-[a-z0-9-]+$"
OPAQUE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"

POLICY_MAX_TYPES = 10_000

# Payload metadata keys.
META_RUN, META_STEP = "gc.root_bead_id", "gc.step_id"
META_FORMULA, META_STEP_REF = "gc.formula_name", "gc.step_ref"

_PAYLOAD = "struct<bead:struct<title:variant,metadata:map<string,variant>>,_bad:string>"


@dataclass(frozen=True)
class TypePolicy:
    """Which event types leave, and which of them carry an actor hash or a ref."""

    allowed: tuple[str, ...]
    emit_actor: tuple[str, ...] = ()
    emit_ref: tuple[str, ...] = ()

    @classmethod
    def from_table(cls, table: DataFrame) -> TypePolicy:
        """Read a (type, emit_actor, emit_ref) table, refusing one that is not small."""
        rows = table.select("type", "emit_actor", "emit_ref").take(POLICY_MAX_TYPES + 1)
        if len(rows) > POLICY_MAX_TYPES:
            raise ValueError(f"type policy has more than {POLICY_MAX_TYPES} rows")
        return cls.from_mapping({r.type: (r.emit_actor, r.emit_ref) for r in rows})

    @classmethod
    def from_mapping(cls, policy: Mapping[str, tuple[bool, bool]]) -> TypePolicy:
        return cls(
            tuple(sorted(policy)),
            tuple(sorted(t for t, (actor, _) in policy.items() if actor)),
            tuple(sorted(t for t, (_, ref) in policy.items() if ref)),
        )


@dataclass(frozen=True)
class Redaction:
    """What an envelope may carry beyond seq, type and ts."""

    salt: str
    export_ref: bool = False
    emit_correlation: bool = True
    emit_content: bool = False
    ref_pattern: str = OPAQUE_REF
    id_pattern: str = OPAQUE_ID


def decode_events(
    frames: DataFrame, *, line: str = "line", content: bool = False, strict: bool = True
) -> DataFrame:
    """Frames to events with a parsed ``ts``; malformed ones and bad times vanish.

    Only ``content=True`` reads the payload.
    """
    schema = EVENT_LINE_WITH_PAYLOAD if content else EVENT_LINE
    events = decode_lines(
        frames, schema, line=line, unsigned=("seq",), raw_json=("payload",), strict=strict
    )
    return events.withColumn("ts", rfc3339(F.col("ts"))).filter(F.col("ts").isNotNull())


def resume(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events past each city's cursor; a city without one starts from the first."""
    # One row per city; AQE broadcasts it when its measured size allows and splits a
    # city that holds a large share of the events when it does not.
    at = cursors.select("city", F.col("seq").alias("_cursor"))
    joined = events.join(at, "city", "left")
    return joined.filter(F.col("seq") > F.coalesce("_cursor", F.lit(0))).drop("_cursor")


def allow(events: DataFrame, policy: TypePolicy) -> DataFrame:
    """Events whose type may leave. Cursors pass the others all the same."""
    return events.filter(F.col("type").isin(*policy.allowed))


def gated_ref(policy: TypePolicy, redaction: Redaction) -> Column:
    """The subject where it is an opaque id and its type may carry one."""
    if not redaction.export_ref:
        return F.lit("")
    opaque = F.col("type").isin(*policy.emit_ref) & F.col("subject").rlike(redaction.ref_pattern)
    return F.when(opaque, F.col("subject")).otherwise("")


def gated_id(name: str, redaction: Redaction) -> Column:
    if not redaction.emit_correlation:
        return F.lit("")
    return F.when(F.col(name).rlike(redaction.id_pattern), F.col(name)).otherwise("")


def lift_content(events: DataFrame) -> DataFrame:
    """Add title and formula from the payload, and its ids where the envelope has none.

    Best effort: an absent or malformed payload, or one whose title or any metadata value
    is not a string, gives empties. A payload that is itself JSON text inside a string is
    read as that JSON.
    """

    def is_text(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("STRING", "VOID")

    def sound(parsed: Column) -> Column:
        values = F.map_values(parsed["bead"]["metadata"])
        return (
            parsed["_bad"].isNull()
            & is_text(parsed["bead"]["title"])
            & F.coalesce(F.forall(values, is_text), F.lit(True))
        )

    def text(v: Column) -> Column:
        return zero_filled(F.try_variant_get(v, "$", "string"), S)

    # Generated from an array of one or none, so that each payload is parsed once.
    parsed = F.array(F.from_json("payload", _PAYLOAD, {"columnNameOfCorruptRecord": "_bad"}))
    rows = events.select("*", F.inline_outer(F.filter(parsed, sound)))
    meta = F.col("bead.metadata")
    return rows.withColumns({
        "title": text(F.col("bead.title")),
        "formula": formula_choice(text(meta[META_FORMULA]), text(meta[META_STEP_REF])),
        "run_id": first_filled(F.col("run_id"), text(meta[META_RUN])),
        "step_id": first_filled(F.col("step_id"), text(meta[META_STEP])),
    }).drop("bead", "_bad")


def formula_choice(name: Column, step_ref: Column) -> Column:
    return first_filled(name, formula_of_ref(step_ref))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def redact(
    events: DataFrame, policy: TypePolicy, redaction: Redaction, *, keep_dropped: bool = False
) -> DataFrame:
    """Allowed events as envelopes, tagged with their city.

    ``keep_dropped`` keeps the others too, as rows with nothing but city and seq and with
    ``exported`` false, for those who count what was seen.
    """
    allowed = F.col("type").isin(*policy.allowed)
    rows = events if keep_dropped else events.filter(allowed)
    content = {"title": F.lit(""), "formula": F.lit("")}
    if redaction.emit_content:
        rows = lift_content(rows)
        content = {"title": F.col("title"), "formula": F.col("formula")}
    hashed = F.when(F.col("type").isin(*policy.emit_actor), actor_hash(F.col("actor"), redaction.salt))
    columns = {
        "type": F.col("type"),
        "ts": F.col("ts"),
        "actor_hash": F.coalesce(hashed, F.lit("")),
        "ref": gated_ref(policy, redaction),
        "run_id": gated_id("run_id", redaction),
        "session_id": gated_id("session_id", redaction),
        "step_id": gated_id("step_id", redaction),
        **content,
    }
    if not keep_dropped:
        return rows.select("city", "seq", *[c.alias(n) for n, c in columns.items()])
    blanked = [F.when(allowed, c).alias(n) for n, c in columns.items()]
    return rows.select("city", "seq", *blanked, allowed.alias("exported"))


def event_batches(
    envelopes: DataFrame,
    *,
    batch_max: int = BATCH_MAX,
    fields: Sequence[str] = tuple(ENVELOPE.names),
) -> DataFrame:
    """Batches of at most ``batch_max`` envelopes per city, in seq order."""
    numbered = number_rows(envelopes, ["city"], ["seq"])
    batches = assemble_batches(numbered, "city", fields, batch_max=batch_max, out="events")
    return batches.withColumn("schema_version", F.lit(EVENT_SCHEMA_VERSION))


def next_event_cursors(events: DataFrame, batches: DataFrame, receipts: DataFrame) -> DataFrame:
    """Highest seq seen per city before its first held batch, dropped events included."""
    confirmed = batch_outcome(F.col("http_status")) == "advance"
    stops = first_held(batches, receipts, "city", confirmed)
    done = before_first_held(events.select("city", "seq"), stops, "city", "seq")
    return done.groupBy("city").agg(F.max("seq").alias("seq"))


def audit_envelopes(
    envelopes: DataFrame, actors: DataFrame, redaction: Redaction, forbidden: Sequence[str] = ()
) -> DataFrame:
    """Rows of (check, n) over outgoing envelopes; every n but ``envelopes`` is 0 if nothing leaks.

    ``actors`` lists raw actor names, none of which may appear as a value. ``forbidden``
    are substrings no value may contain.
    """
    texts = [f.name for f in ENVELOPE.fields if f.dataType == S and f.name != "type"]
    # One row per distinct outgoing value, so that common values are counted before the
    # join instead of meeting in one task.
    values = (
        envelopes.select(F.explode(F.array(*texts)).alias("value"))
        .filter(F.col("value") != "")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    raw = actors.select(F.col("actor").alias("value")).filter(F.col("value") != "").distinct()
    marked = values.join(raw.withColumn("_raw", F.lit(True)), "value", "left")
    piece = F.lit(False)
    for text in forbidden:
        piece = piece | F.col("value").contains(text)

    def uses(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("uses")).otherwise(0)), F.lit(0))

    def bad(name: str, pattern: str) -> Column:
        return (F.col(name) != "") & ~F.col(name).rlike(pattern)

    ids = bad("run_id", redaction.id_pattern)
    for name in ("session_id", "step_id"):
        ids = ids | bad(name, redaction.id_pattern)
    content = F.lit(False)
    if not redaction.emit_content:
        content = (F.col("title") != "") | (F.col("formula") != "")

    by_value = marked.agg(
        uses(F.col("_raw")).alias("raw_actors"), uses(piece).alias("forbidden_text")
    )
    by_row = envelopes.agg(
        F.count(F.lit(1)).alias("envelopes"),
        F.count_if(bad("actor_hash", "^[0-9a-f]{16}$")).alias("bad_hashes"),
        F.count_if(bad("ref", redaction.ref_pattern)).alias("bad_refs"),
        F.count_if(ids).alias("bad_ids"),
        F.count_if(content).alias("content_fields"),
    )
    return _as_checks(by_row).unionByName(_as_checks(by_value))


def _as_checks(counts: DataFrame) -> DataFrame:
    return counts.unpivot([], counts.columns, "check", "n")
