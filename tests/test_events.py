"""Stream captures, redaction, batching and cursors of the events plane."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from planes.operators import events
from planes.operators.events import Redaction, TypePolicy
from planes.sources.sse import frames, read_sse

POLICY = TypePolicy.from_mapping({
    "bead.closed": (True, True), "order.completed": (True, True), "mail.sent": (False, False),
})
SALT = "0123456789abcdef"
REDACTION = Redaction(salt=SALT, export_ref=True)
BY_NAME = r"([^/]+)\.sse$"


def event(seq, kind, actor="a", subject="", **more):
    return {"seq": seq, "type": kind, "ts": f"2026-06-21T10:00:{seq:02d}Z", "actor": actor, "subject": subject, **more}


def decode(spark, items, **kw):
    rows = [("c1", json.dumps(i) if isinstance(i, dict) else i) for i in items]
    return events.decode_events(spark.createDataFrame(rows, "city string, line string"), **kw)


SECRETS = {"message": "a private remark", "payload": "token=tk-5512"}
FOUR = [
    event(1, "bead.closed", "alice@corp.example", "mc-ab-12", **SECRETS),
    event(2, "bead.updated", "bob", "mc-2", **SECRETS),
    event(3, "order.completed", "carol", "Nightly Sweep slug", **SECRETS),
    event(4, "mail.sent", "dave@x", "re: secret thread", message=SECRETS["message"]),
]


def test_four_events_are_allowed_redacted_and_pass_the_cursor(spark):
    decoded = decode(spark, FOUR)
    batches = events.event_batches(events.redact(decoded, POLICY, REDACTION), batch_max=2)
    rows = batches.orderBy("batch_no").collect()
    sent = [e for b in rows for e in b.events]
    assert [(e.seq, e.type) for e in sent] == [(1, "bead.closed"), (3, "order.completed"), (4, "mail.sent")]
    assert [e.ref for e in sent] == ["mc-ab-12", "", ""]
    assert [len(e.actor_hash) for e in sent] == [16, 16, 0]
    assert all(b.city == "c1" and b.schema_version == 1 for b in rows)

    wire = "".join(batches.toJSON().collect())
    for text in ("remark", "tk-5512", "token=", "alice", "bob", "carol", "dave", "Sweep", "secret thread",
                 '"message"', '"payload"'):
        assert text not in wire

    receipts = spark.createDataFrame([("c1", 0, 204), ("c1", 1, 204)], "city string, batch_no long, http_status int")
    after = lambda r: [tuple(x) for x in events.next_event_cursors(decoded, batches, r).collect()]
    assert after(receipts) == [("c1", 4)]
    assert after(receipts.filter("batch_no = 0")) == [("c1", 3)]
    assert after(receipts.filter("batch_no = 1")) == []


def test_trailing_dropped_event_moves_the_cursor(spark):
    decoded = decode(spark, [event(1, "bead.closed"), event(5, "bead.updated")])
    batches = events.event_batches(events.redact(decoded, POLICY, REDACTION))
    receipts = spark.createDataFrame([("c1", 0, 200)], "city string, batch_no long, http_status int")
    assert [tuple(r) for r in events.next_event_cursors(decoded, batches, receipts).collect()] == [("c1", 5)]


def audit(spark, envelopes, **kw):
    actors = spark.createDataFrame([("alice@corp.example",), ("bob",)], "actor string")
    return {r.check: r.n for r in events.audit_envelopes(envelopes, actors, replace(REDACTION, **kw), ("@",)).collect()}


def test_audit_finds_what_redaction_would_have_removed(spark):
    clean = events.redact(decode(spark, FOUR), POLICY, REDACTION)
    counts = audit(spark, clean)
    assert counts.pop("envelopes") == 3 and set(counts.values()) == {0}
    leaky = clean.withColumn("actor_hash", F.lit("alice@corp.example")).withColumn("ref", F.lit("bob")).withColumn(
        "title", F.lit("T"))
    assert audit(spark, leaky) == {
        "envelopes": 3, "bad_hashes": 3, "bad_refs": 3, "bad_ids": 0, "content_fields": 3,
        "raw_actors": 6, "forbidden_text": 3,
    }
    assert audit(spark, leaky, emit_content=True)["content_fields"] == 0


@pytest.mark.parametrize("item, content, ids", [
    (event(1, "x", run_id="mc-root", session_id="mc-sess", step_id="syn"), False, ("mc-root", "mc-sess", "syn")),
    (event(2, "x", payload={"bead": {"title": "T", "metadata": {"gc.root_bead_id": "mc-f", "gc.step_id": "apply"}}}),
     True, ("mc-f", "", "apply")),
    (event(3, "x", run_id="mc-env", step_id="env",
           payload={"bead": {"metadata": {"gc.root_bead_id": "mc-p", "gc.step_id": "p"}}}), True, ("mc-env", "", "env")),
    (event(4, "x"), False, ("", "", "")),
])
def test_ids_come_from_the_envelope_then_the_payload(spark, item, content, ids):
    got = decode(spark, [item], content=content)
    if content:
        got = events.lift_content(got)
    row = got.first()
    assert (row.run_id, row.session_id, row.step_id) == ids


def test_correlation_gate_and_no_content_without_opt_in(spark):
    item = event(1, "bead.closed", run_id="mc-root", session_id="mc-sess", step_id="syn",
                 payload={"bead": {"title": "T", "metadata": {"gc.formula_name": "f"}}})
    on = events.redact(decode(spark, [item]), POLICY, REDACTION).first()
    assert (on.run_id, on.session_id, on.step_id, on.title, on.formula) == ("mc-root", "mc-sess", "syn", "", "")
    off = events.redact(decode(spark, [item]), POLICY, replace(REDACTION, emit_correlation=False)).first()
    assert (off.run_id, off.session_id, off.step_id) == ("", "", "")
    full = replace(REDACTION, emit_content=True)
    lifted = events.redact(decode(spark, [item], content=True), POLICY, full).first()
    assert (lifted.title, lifted.formula) == ("T", "f")
    unsafe = event(1, "bead.closed", run_id="free text here")
    assert events.redact(decode(spark, [unsafe]), POLICY, REDACTION).first().run_id == ""


def test_default_plan_does_not_decode_the_payload(spark):
    plan = events.redact(decode(spark, FOUR), POLICY, REDACTION)._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" not in plan and "message" not in plan


def test_ref_needs_the_flag_and_an_opaque_subject(spark):
    decoded = decode(spark, [event(1, "bead.closed", subject="mc-1"), event(2, "bead.closed", subject="A b")])
    on = events.redact(decoded, POLICY, REDACTION).orderBy("seq").collect()
    assert [r.ref for r in on] == ["mc-1", ""]
    off = events.redact(decoded, POLICY, replace(REDACTION, export_ref=False)).collect()
    assert {r.ref for r in off} == {""}


def test_policy_table_must_be_small(spark):
    table = spark.createDataFrame([("bead.closed", True, False)], "type string, emit_actor boolean, emit_ref boolean")
    assert TypePolicy.from_table(table) == TypePolicy(("bead.closed",), ("bead.closed",), ())
    big = spark.range(10_001).selectExpr("cast(id as string) type", "true emit_actor", "true emit_ref")
    with pytest.raises(ValueError):
        TypePolicy.from_table(big)


def test_resume_starts_after_the_cursor_or_at_the_first(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "city string, seq long")
    cursors = spark.createDataFrame([("a", 1), ("z", 9)], "city string, seq long")
    assert sorted(map(tuple, events.resume(df, cursors).collect())) == [("a", 2), ("b", 1)]


CAPTURE = (
    ": connected\n\n"
    "data: {not json}\n\n"
    "retry: 1000\n\n"
    'id: 7\ndata: old\ndata: {"seq":7,"type":"session.woke","ts":"2026-06-21T10:00:00Z","actor":"sys"}\n\n'
    'data:{"seq":8,"type":"t","ts":"2026-06-21T10:00:00Z"} \r\n\r\n'
    "data: cleared\ndata:\n\n"
    "event: x\n\n\n"
    'data: {"seq":9,"type":"t","ts":"2026-06-21T10:00:00Z"}\n'
)


def test_capture_to_events(spark, tmp_path):
    (tmp_path / "c1.sse").write_bytes(CAPTURE.encode())
    (tmp_path / "c2.sse").write_bytes(CAPTURE.replace('"seq":7', '"seq":70').encode() + b"\n")
    framed = read_sse(spark, f"{tmp_path}/*.sse", BY_NAME)
    got = events.decode_events(framed.select("city", "line"))
    assert sorted((r.city, r.seq) for r in got.collect()) == [
        ("c1", 7), ("c1", 8), ("c2", 8), ("c2", 9), ("c2", 70),
    ]
    assert "session.woke" in [r.type for r in got.collect()]


def by_hand(lines):
    out, data = [], ""
    for line in lines:
        line = line.removesuffix("\r")
        if line == "":
            if data:
                out.append(data)
            data = ""
        elif line.startswith("data:"):
            data = line[5:].strip()
    return out


def test_frames_do_not_depend_on_where_a_capture_is_cut(spark):
    pieces = ["", "", "data: a", "data: b\r", "data:", ": c", "id: 1", "\r", "data:  z "]
    lines = [pieces[(i * i + 3 * i) % 9 if i % 4 else (i * 7) % 9] for i in range(400)] + ["data: open"]
    df = spark.createDataFrame(
        [(c, i, line) for c in ("x", "y") for i, line in enumerate(lines)], "city string, pos long, line string"
    ).repartition(6)
    for bits in (0, 2, 5, 20):
        cut = df.withColumn("piece", F.shiftright("pos", bits))
        got = frames(cut, ["city"], ["pos"], chunk=["piece"]).orderBy("city", "frame_no").collect()
        assert [r.line for r in got if r.city == "x"] == by_hand(lines)
        assert [r.line for r in got if r.city == "y"] == by_hand(lines)
