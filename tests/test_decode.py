"""Strict decoding, timestamps and the other column functions, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from planes.functions import outcomes, text
from planes.functions.jsonl import decode_lines
from planes.operators import events, usage
from planes.schemas import EVENT_LINE


def one_column(spark, values, name="line"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def each(spark, cases, column):
    """Pairs of each case's text and what the column makes of it."""
    got = one_column(spark, [case[0] for case in cases]).select("line", column).collect()
    return [tuple(r) for r in got]


GOOD = {
    "run_id": "r", "session_id": "s", "kind": "model", "model": "m", "provider": "p",
    "input_tokens": 10, "output_tokens": 5, "cost_usd_estimate": 0.001, "at": 1700000000000,
}


LINES = [
    (json.dumps(GOOD), True),
    (json.dumps(GOOD, separators=(",", ":")), True),
    (" \t" + json.dumps(GOOD) + " \r", True),
    ("\x0b\xa0" + json.dumps(GOOD) + "\x0c", True),
    (json.dumps({**GOOD, "input_tokens": "7"}), False),
    (json.dumps({**GOOD, "input_tokens": 1.0}), False),
    (json.dumps(GOOD).replace("10", "1e3"), False),
    (json.dumps(GOOD).replace("10", "9223372036854775808"), False),
    (json.dumps({**GOOD, "unpriced": "true"}), False),
    (json.dumps({**GOOD, "run_id": 5}), False),
    (json.dumps({**GOOD, "run_id": ["a"]}), False),
    (json.dumps({**GOOD, "worker": {"a": 1}}), False),
    (json.dumps({**GOOD, "worker": True}), False),
    (json.dumps({**GOOD, "step_id": 5}).replace("step_id", "step\\u005fid"), False),
    (json.dumps({**GOOD, "run_id": None, "at": None, "unpriced": None}), True),
    (json.dumps({**GOOD, "extra": {"run_id": 5}}), True),
    (json.dumps({**GOOD, "model": 'x "run_id": 5'}), True),
    (json.dumps(GOOD) + " trailing", False),
    (json.dumps(GOOD) + " trailing}", False),
    (json.dumps(GOOD) + json.dumps(GOOD), False),
    (json.dumps(GOOD) + "," + json.dumps(GOOD), False),
    (json.dumps(GOOD) + "}", False),
    (json.dumps(GOOD) + "]} garbage", False),
    (json.dumps(GOOD) + "]}", False),
    (json.dumps(GOOD) + ']}{"z":[{', False),
    (json.dumps(GOOD) + ']}{"z":[{}', False),
    (json.dumps(GOOD) + '],"d":[' + json.dumps(GOOD), False),
    (json.dumps(GOOD) + ',1],"d":[' + json.dumps(GOOD), False),
    (json.dumps({**GOOD, "extra": [1, [2], {"d": [{"x": "]}"}]}]}), True),
    (json.dumps(GOOD).replace("0.001", "NaN"), False),
    (json.dumps(GOOD).replace("0.001", "1e999"), False),
    (json.dumps(GOOD).replace('"', "'"), False),
    ("[" + json.dumps(GOOD) + "]", False),
    ("not json at all", False),
    ("null", False),
    ("", False),
    ("  ", False),
]


def test_lines_are_kept_or_dropped_whole(spark):
    df = spark.createDataFrame([(n, line) for n, (line, _) in enumerate(LINES)], "n int, line string")
    got = {r.n for r in usage.model_facts(usage.decode_usage(df)).select("n").collect()}
    assert [line for n, (line, kept) in enumerate(LINES) if (n in got) != kept] == []


def test_absent_and_null_are_zero_values_and_unknown_fields_vanish(spark):
    line = '{"run_id":null,"kind":"model","idempotency_key":"x","city":"c","runtime":"r"}'
    got = usage.decode_usage(one_column(spark, [line])).collect()[0].asDict()
    assert got == {
        "run_id": "", "session_id": "", "step_id": "", "worker": "", "kind": "model",
        "model": "", "provider": "", "input_tokens": 0, "output_tokens": 0,
        "cache_read_tokens": 0, "cache_creation_tokens": 0, "cost_usd_estimate": 0.0,
        "unpriced": False, "upstream_req_id": "", "at": 0,
    }


def test_last_of_repeated_keys_wins(spark):
    got = usage.decode_usage(one_column(spark, ['{"run_id":"a","at":1,"run_id":"b","at":2}'])).first()
    assert (got.run_id, got.at) == ("b", 2)


def test_loose_decoding_lets_numbers_into_string_fields(spark):
    df = one_column(spark, ['{"run_id":5,"kind":"model"}'])
    assert usage.decode_usage(df, strict=False).first().run_id == "5"
    assert usage.decode_usage(df).count() == 0


def test_unsigned_fields_reject_negatives(spark):
    df = one_column(spark, ['{"seq":-1}', '{"seq":3}'])
    assert [r.seq for r in decode_lines(df, EVENT_LINE, unsigned=("seq",)).collect()] == [3]


STAMPS = [
    ("2026-06-21T10:00:00Z", 1782036000000000),
    ("2026-06-21T10:00:00.123456789Z", 1782036000123456),
    ("2026-06-21T10:00:00,5Z", 1782036000500000),
    ("2026-06-21T15:30:00+05:30", 1782036000000000),
    ("2026-06-21", None),
    ("2026-06-21 10:00:00", None),
    ("2026-06-21T10:00:00", None),
    ("2026-06-21 10:00:00Z", None),
    ("2026-02-30T10:00:00Z", None),
    ("2026-06-21T25:00:00Z", None),
    ("0001-01-01T00:00:00Z", None),
    ("", None),
]


def test_timestamps(spark):
    parsed = F.unix_micros(text.rfc3339(F.col("line")))
    assert each(spark, STAMPS, parsed) == STAMPS


REFS = [
    ("mol-night-shift-check.apply", "night-shift-check"),
    ("mol-sweep.sweep", "sweep"),
    ("mol-night-shift-check.close-the-day", "night-shift-check"),
    ("mol-single", "single"),
    ("no-mol-ref", ""),
    ("", ""),
]


def test_formula_of_ref(spark):
    assert each(spark, REFS, text.formula_of_ref(F.col("line"))) == REFS


HEADS = [
    (b"-----BEGIN PRIVATE KEY-----\n...", True),
    (b"\n  -----BEGIN RSA PRIVATE KEY-----", True),
    (b"\xef\xbb\xbf-----BEGIN PRIVATE KEY-----\n", True),
    (b"\xef\xbb\xbf\v\f\x00 -----BEGIN EC PRIVATE KEY-----", True),
    (b'{"type":"user","content":"hi"}', False),
    (b'\xef\xbb\xbf{"type":"user"}', False),
    (b"\xef\xbb\xbf\xef\xbb\xbf-----BEGIN", False),
    (b" " * 60 + b"-----BEGIN", False),
]


def test_key_block_sniff(spark):
    df = spark.createDataFrame([(bytearray(head),) for head, _ in HEADS], "c binary")
    got = df.select("c", text.starts_with_key_block(F.col("c"))).collect()
    assert [(bytes(c), is_key) for c, is_key in got] == HEADS


GLOBS = [
    ("mcp.json", "*mcp*.json", True),
    ("foo-mcp-bar.json", "*mcp*.json", True),
    ("mcp.jsonl", "*mcp*.json", False),
    ("settings.json", "settings*.json", True),
    ("settings-local.json", "settings*.json", True),
    ("my.env", "*.env", True),
    ("a/b.env", "*.env", True),
    ("x-token-y.json", "*token*.json", True),
    ("secret.json", "*secret*.json", True),
    ("apikey.json", "*key*.json", True),
    ("transcript.jsonl", "*mcp*.json", False),
    ("abc", "a?c", True),
    ("ac", "a?c", False),
    ("a.env\n", "*.env", False),
]


def test_globs(spark):
    for glob in sorted({g for _, g, _ in GLOBS}):
        cases = [(name, matches) for name, g, matches in GLOBS if g == glob]
        assert each(spark, cases, F.col("line").rlike(text.glob_regex((glob,)))) == cases


def test_city_names_keep_first_positions(spark):
    raw = "north, harbor north\nmill,, harbor"
    got = one_column(spark, [raw]).select(text.city_names(F.col("line"))).first()[0]
    assert got == ["north", "harbor", "mill"]


def test_actor_hash_needs_a_salt_and_leaves_no_actor_empty(spark):
    with pytest.raises(ValueError):
        text.actor_hash(F.lit("alice"), "short")
    df = one_column(spark, ["alice", ""]).select(text.actor_hash(F.col("line"), "0123456789abcdef").alias("h"))
    hashed, none = [r.h for r in df.collect()]
    assert len(hashed) == 16 and int(hashed, 16) >= 0 and none == ""


OUTCOMES = [
    (200, "sent", "advance"), (201, "sent", "advance"), (204, "failed", "advance"),
    (422, "rejected", "hold"), (409, "rejected", "hold"), (429, "failed", "hold"),
    (503, "failed", "hold"), (302, "failed", "hold"), (None, "failed", "hold"),
]


def test_outcomes(spark):
    df = spark.createDataFrame([(status,) for status, *_ in OUTCOMES], "s int")
    got = df.select("s", outcomes.snapshot_outcome(F.col("s")), outcomes.batch_outcome(F.col("s")))
    assert [tuple(r) for r in got.collect()] == OUTCOMES


LIFT = '{"bead":{"id":"mc-1","title":"Spike [HIGH]","metadata":{%s}}}'


LIFTED = [
    (LIFT % '"gc.step_id":"syn","gc.root_bead_id":"mc-m8","gc.step_ref":"mol-a-b.apply"',
     "Spike [HIGH]", "mc-m8", "syn", "a-b"),
    (LIFT % '"gc.formula_name":"explicit","gc.step_ref":"mol-other.x"', "Spike [HIGH]", "", "", "explicit"),
    (LIFT % '"gc.formula_name":"","gc.step_ref":"mol-other.x"', "Spike [HIGH]", "", "", "other"),
    (LIFT % '"gc.step_id":"syn","n":5', "", "", "", ""),
    (LIFT % '"gc.step_id":"syn","n":null', "Spike [HIGH]", "", "syn", ""),
    ('{"bead":{"title":4,"metadata":{"gc.step_id":"s"}}}', "", "", "", ""),
    ('{"bead":{"title":"t"}}', "t", "", "", ""),
    ("", "", "", "", ""),
    ("{", "", "", "", ""),
    ('{"bead":null}', "", "", "", ""),
    ('{"bead":"text"}', "", "", "", ""),
    ("[]", "", "", "", ""),
    (None, "", "", "", ""),
]


def test_content_lift(spark):
    df = spark.createDataFrame([("", "", row[0]) for row in LIFTED], "run_id string, step_id string, payload string")
    got = events.lift_content(df).select("payload", "title", "run_id", "step_id", "formula")
    assert [tuple(r) for r in got.collect()] == LIFTED


