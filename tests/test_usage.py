"""Ledger scanning, numbering, batching and cursors."""

import json
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from planes.operators import usage
from planes.operators.numbering import number_rows
from planes.plans.usage_pass import UsagePass
from planes.sources.ledger import LEDGER_CHUNK, LEDGER_ORDER, read_ledgers
from planes.schemas import USAGE_CURSOR
from planes.sources.ranges import lines_ending_in, read_ranges
from planes.sources.state import StateTable
from planes.streaming.tail_source import first_unread

BY_PARENT = r"([^/]+)/[^/]*$"


def fact(run, model="m", **more):
    return json.dumps({
        "run_id": run, "session_id": "s", "kind": "model", "model": model, "provider": "p",
        "input_tokens": 10, "output_tokens": 5, "cost_usd_estimate": 0.001,
        "upstream_req_id": f"{run}-r", "at": 1700000000000, **more,
    }) + "\n"


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, newline="") as f:
        f.write(text)
    return str(path)


def facts(spark, paths, cursors=None, limit=None, **kw):
    lines = read_ledgers(spark, paths, BY_PARENT, **kw)
    numbered = usage.number_facts(
        usage.model_facts(usage.decode_usage(lines)), LEDGER_ORDER, chunk=LEDGER_CHUNK,
        cursors=cursors, limit=limit,
    )
    return [(r.source_id, r.seq, r.run_id) for r in numbered.orderBy("source_id", "seq").collect()]


def test_two_facts_are_numbered_from_one(spark, tmp_path):
    p = write(f"{tmp_path}/a/usage.jsonl", fact("r1") + fact("r2"))
    assert facts(spark, p) == [("a", 1, "r1"), ("a", 2, "r2")]


def test_partial_last_line_waits_until_it_is_complete(spark, tmp_path):
    p = write(f"{tmp_path}/a/usage.jsonl", fact("r1") + fact("r2")[:-1])
    assert facts(spark, p) == [("a", 1, "r1")]
    assert facts(spark, p, sealed=True) == [("a", 1, "r1"), ("a", 2, "r2")]
    write(p, "\n", "a")
    assert facts(spark, p) == [("a", 1, "r1"), ("a", 2, "r2")]


def test_partial_line_after_a_byte_order_mark(spark, tmp_path):
    p = write(f"{tmp_path}/a/usage.jsonl", "\ufeff" + fact("r1") + fact("r2")[:-1])
    assert facts(spark, p) == [("a", 1, "r1")]


def test_junk_compute_and_blank_lines_take_no_seq(spark, tmp_path):
    compute = '{"kind":"compute","wall_seconds":3,"run_id":"r","at":1}\n'
    p = write(f"{tmp_path}/a/usage.jsonl", fact("r1") + "not json\n" + compute + "\n \n" + fact("r2"))
    assert facts(spark, p) == [("a", 1, "r1"), ("a", 2, "r2")]


def test_take_is_bounded_and_continues(spark, tmp_path):
    p = write(f"{tmp_path}/a/usage.jsonl", fact("r1") + fact("r2") + fact("r3"))
    assert facts(spark, p, limit=2) == [("a", 1, "r1"), ("a", 2, "r2")]


def test_next_seq_carries_over_to_a_rotated_ledger(spark, tmp_path):
    p = write(f"{tmp_path}/a/usage.jsonl", fact("n1") + fact("n2"))
    cursors = spark.createDataFrame([("a", 0, 3), ("b", 0, 0)], "source_id string, offset long, next_seq long")
    assert facts(spark, p, cursors) == [("a", 3, "n1"), ("a", 4, "n2")]


def test_missing_ledgers_are_no_lines(spark, tmp_path):
    p = write(f"{tmp_path}/a/usage.jsonl", fact("r1"))
    assert facts(spark, f"{tmp_path}/nope/usage.jsonl") == []
    assert facts(spark, [f"{tmp_path}/nope/*.jsonl", p]) == [("a", 1, "r1")]


def test_over_long_line_is_skipped(spark, tmp_path):
    long = fact("big", model="x" * usage.READ_WINDOW)
    p = write(f"{tmp_path}/a/usage.jsonl", fact("r1") + long + fact("r2"))
    assert facts(spark, p) == [("a", 1, "r1"), ("a", 2, "r2")]


def test_line_order_holds_over_many_splits_and_replays(spark, tmp_path):
    for source in ("a", "b"):
        for part in range(2):
            text = "".join(
                fact(f"{part}-{i}") if i % 3 else "junk\n" for i in range(4000)
            )
            write(f"{tmp_path}/{source}/usage.{part}.jsonl", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        pattern = f"{tmp_path}/*/usage.*.jsonl"
        assert read_ledgers(spark, pattern, BY_PARENT).select("block_start").distinct().count() > 5
        once, again = facts(spark, pattern), facts(spark, pattern)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = [f"{part}-{i}" for part in range(2) for i in range(4000) if i % 3]
    assert once == [(s, n + 1, run) for s in ("a", "b") for n, run in enumerate(expected)]
    assert once == again


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 400)), unique=True, max_size=80),
       st.integers(1, 30))
def test_numbering_equals_a_plain_count(spark, rows, limit):
    df = spark.createDataFrame(rows or [("z", 1)], "k string, pos long").repartition(5)
    df = df.withColumn("piece", F.shiftright("pos", 3))
    starts = spark.createDataFrame([("a", 7)], "k string, first long")
    got = number_rows(df, ["k"], ["pos"], chunk=["piece"], starts=starts)
    taken = number_rows(df, ["k"], ["pos"], chunk=["piece"], starts=starts, limit=limit)
    want = []
    for k in ("a", "b", "z"):
        ordered = sorted(p for key, p in (rows or [("z", 1)]) if key == k)
        want += [(k, p, i + 1, i + (7 if k == "a" else 1)) for i, p in enumerate(ordered)]
    columns = ["k", "pos", "ordinal", "seq"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == want
    assert sorted(tuple(r) for r in taken.select(columns).collect()) == [w for w in want if w[2] <= limit]


@pytest.mark.parametrize("count", [1, 9, 10, 11, 20])
def test_batches_are_bounded_and_lossless(spark, count):
    df = spark.range(count).select(F.lit("a").alias("source_id"), F.col("id").alias("line_no"))
    numbered = usage.number_facts(df, ["line_no"])
    batches = usage.usage_batches(numbered, batch_max=10, fields=["seq", "line_no"]).orderBy("batch_no").collect()
    sizes = [b.n for b in batches]
    assert sizes == [10] * (count // 10) + ([count % 10] if count % 10 else [])
    assert [f.seq for b in batches for f in b.facts] == list(range(1, count + 1))
    assert [f.line_no for b in batches for f in b.facts] == list(range(count))
    assert all(b.schema_version == 1 for b in batches)


def cursor_after(spark, statuses, facts_n=5, trailing=2, prior=None):
    """Cursor of one source with two facts per batch and junk lines at the end."""
    lines = spark.range(facts_n + trailing).select(F.lit("a").alias("source_id"), F.col("id").alias("line_no"))
    numbered = usage.number_facts(lines.filter(F.col("line_no") < facts_n), ["line_no"], cursors=prior)
    batches = usage.usage_batches(numbered, batch_max=2, fields=["seq", "line_no"])
    receipts = spark.createDataFrame(
        [("a", n, s) for n, s in statuses], "source_id string, batch_no long, http_status int"
    )
    got = usage.next_cursors(lines, numbered, batches, receipts, position="line_no", cursors=prior)
    return [tuple(r) for r in got.collect()]


def test_cursor_moves_only_over_confirmed_batches(spark):
    assert cursor_after(spark, [(0, 200), (1, 204), (2, 201)]) == [("a", 6, 6)]
    assert cursor_after(spark, [(0, 200), (1, 503), (2, 200)]) == [("a", 3, 1)]
    assert cursor_after(spark, [(0, 200), (2, 200)]) == [("a", 3, 1)]
    assert cursor_after(spark, [(0, 400), (1, 200), (2, 200)]) == []
    assert cursor_after(spark, []) == []


def test_cursor_passes_skipped_lines_when_there_are_no_facts(spark):
    prior = spark.createDataFrame([("a", 0, 9)], "source_id string, offset long, next_seq long")
    assert cursor_after(spark, [], facts_n=0, prior=prior) == [("a", 9, 1)]
    assert cursor_after(spark, [(0, 200), (1, 200), (2, 200)], prior=prior) == [("a", 14, 6)]


def test_held_batch_is_sent_again_with_the_same_seqs(spark):
    df = spark.range(6).select(F.lit("a").alias("source_id"), F.col("id").alias("line_no"))
    cursors = spark.createDataFrame([("a", 2, 3)], "source_id string, offset long, next_seq long")
    first = usage.number_facts(df, ["line_no"]).filter("seq >= 3")
    again = usage.number_facts(usage.after_cursor(df, cursors, "line_no"), ["line_no"], cursors=cursors)
    assert sorted(tuple(r) for r in first.select("line_no", "seq").collect()) == sorted(
        tuple(r) for r in again.select("line_no", "seq").collect()
    )


def test_ledger_ranges(spark):
    rows = [
        ("grown", 7, 300, 100, 7, 4), ("same", 7, 100, 100, 7, 4), ("shrunk", 7, 50, 100, 7, 3),
        ("replaced", 8, 300, 100, 7, 3), ("no id", 0, 300, 100, 7, 3), ("new", 7, 300, None, None, None),
        ("empty", 7, 0, None, None, None), ("zero seq", 7, 300, 100, 0, 0),
    ]
    manifest = spark.createDataFrame(
        rows, "source_id string, file_id long, size long, cur_offset long, cur_file_id long, next_seq long"
    )
    got = {r.source_id: tuple(r)[1:] for r in usage.ledger_ranges(manifest).collect()}
    assert got == {
        "grown": (False, 100, 300, True, 4, 7),
        "same": (False, 100, 100, False, 4, 7),
        "shrunk": (True, 0, 50, True, 3, 7),
        "replaced": (True, 0, 300, True, 3, 8),
        "no id": (False, 100, 300, True, 3, 7),
        "new": (False, 0, 300, True, 1, 7),
        "empty": (False, 0, 0, False, 1, 7),
        "zero seq": (False, 100, 300, True, 1, 7),
    }


def test_first_unread_byte():
    assert first_unread(None, {"id": 1, "to": 50}) == 0
    assert first_unread({"id": 1, "to": 20}, {"id": 1, "to": 50}) == 20
    assert first_unread({"id": 1, "to": 60}, {"id": 1, "to": 50}) == 0
    assert first_unread({"id": 1, "to": 20}, {"id": 2, "to": 50}) == 0
    assert first_unread({"id": 0, "to": 20}, {"id": 2, "to": 50}) == 20


def test_ranges_cover_each_line_once_wherever_they_are_cut(tmp_path):
    rng = random.Random(7)
    lines = [b"x" * rng.choice([0, 1, 5, 30, 99, 100, 101, 250]) for _ in range(300)]
    path = tmp_path / "t"
    path.write_bytes(b"\n".join(lines) + b"\npartial")
    size, want, at = path.stat().st_size, [], 0
    for line in lines:
        if len(line) < 100:
            want.append((at, line))
        at += len(line) + 1
    for span in (1, 3, 64, 100, 1000, size):
        got = []
        for start in range(0, size, span):
            got += lines_ending_in(str(path), start, min(start + span, size), 100)
        assert got == want


def test_ranges_of_many_files_are_read_by_place(spark, tmp_path):
    a = write(f"{tmp_path}/a/usage.jsonl", "one\ntwo\n\nthree\nfour")
    rows = [("a", a, 4, 18, None), ("gone", f"{tmp_path}/none", 0, 9, True), ("done", a, 18, 18, False)]
    df = spark.createDataFrame(rows, "source_id string, path string, read_from long, read_to long, gone boolean")
    for span in (1, 5, 100):
        got = sorted((r.offset, r.line_end, r.line) for r in read_ranges(df, span=span).collect())
        assert got == [(4, 8, "two"), (8, 9, ""), (9, 15, "three")]


def test_a_range_that_cannot_be_read_is_no_silence(spark, tmp_path):
    df = spark.createDataFrame([("a", f"{tmp_path}/none", 0, 9)], "source_id string, path string, read_from long, read_to long")
    with pytest.raises(Exception, match="No such file"):
        read_ranges(df).collect()


def test_state_is_settled_in_order(spark, tmp_path):
    state = StateTable(spark, str(tmp_path / "state"), USAGE_CURSOR)
    rows = spark.createDataFrame([], USAGE_CURSOR)
    state.write(rows, 6)
    state.write(rows, 6)
    with pytest.raises(ValueError, match="in order"):
        state.write(rows, 5)


def test_passes_read_only_new_bytes_and_hold_what_is_not_confirmed(spark, tmp_path):
    plane = UsagePass(spark, str(tmp_path / "w"), batch_max=2, max_batches=2)
    path = write(f"{tmp_path}/a/usage.jsonl", "".join(fact(f"r{i}") for i in range(5)) + "junk\n" + fact("r5")[:9])

    def plan(epoch):
        stat = os.stat(path)
        manifest = spark.createDataFrame(
            [("a", path, stat.st_ino, stat.st_size)], "source_id string, path string, file_id long, size long")
        batches = plane.plan(manifest, epoch).orderBy("batch_no").collect()
        return [[(f.seq, f.run_id) for f in b.facts] for b in batches]

    def settle(epoch, *statuses):
        receipts = spark.createDataFrame(
            [("a", n, s) for n, s in enumerate(statuses)], "source_id string, batch_no long, http_status int")
        return [(r.offset, r.next_seq) for r in plane.settle(epoch, receipts).collect()]

    first = [[(1, "r0"), (2, "r1")], [(3, "r2"), (4, "r3")]]
    size = len(fact("r0"))
    assert plan(0) == first and plan(0) == first
    assert settle(0, 503, 200) == []
    assert plan(1) == first
    assert settle(1, 200, 503) == [(2 * size, 3)]
    assert plan(2) == [[(3, "r2"), (4, "r3")], [(5, "r4")]]
    assert settle(2, 200, 200) == [(5 * size + 5, 6)]
    assert plan(3) == []
    write(path, fact("r5")[9:], "a")
    assert plan(3) == [[(6, "r5")]]
    assert settle(3, 200) == [(6 * size + 5, 7)]
    # Replaced: the new file is read from the top and its facts get fresh seqs.
    os.rename(path, path + ".1")
    write(path, "".join(fact(f"n{i}") for i in range(9)))
    assert plan(4) == [[(7, "n0"), (8, "n1")], [(9, "n2"), (10, "n3")]]
    assert settle(4, 201, 201) == [(4 * size, 11)]
    write(path, "junk\n" * 3)
    assert plan(5) == []
    assert settle(5) == [(15, 11)]


def test_numbering_plan_never_sorts_a_whole_source(spark):
    df = spark.range(100).selectExpr("cast(id % 3 as string) as source_id", "id as line_no")
    plan = usage.number_facts(df, ["line_no"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
