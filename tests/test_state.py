"""State as bases and deltas: the same table whatever was folded, replayed or lost."""

import os
import random
import shutil

import pytest

from planes.schemas import EVENT_CURSOR, SNAPSHOT_STATE
from planes.sources.state import StateTable

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "7"}


@pytest.fixture
def plain_joins(spark):
    old = {k: spark.conf.get(k) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def put(spark, table, rows, version=None):
    return table.upsert(spark.createDataFrame(list(rows.items()), EVENT_CURSOR), version)


def test_upserts_deltas_and_bases_are_one_table(spark, tmp_path):
    rng = random.Random(3)
    table = StateTable(spark, f"{tmp_path}/it's a state", EVENT_CURSOR, buckets=3, compact_after=4)
    assert table.read().count() == 0 and table.versions() == []
    want, history = {}, []
    for version in range(11):
        history.append(dict(want))
        assert rows_of(table.read(before=version)) == want
        change = {f"c{rng.randrange(12)}": rng.randrange(1000) for _ in range(rng.randint(0, 4))}
        for _ in range(rng.choice([1, 2])):  # an epoch that runs again, with other records even
            again = {**change, "again": version}
            assert put(spark, table, again, version) == version
        want |= again
        assert rows_of(table.read()) == want
        assert rows_of(table.read(before=version)) == history[-1]
    names = sorted(n for n in os.listdir(table.path) if not n.startswith("."))
    # Two bases and the deltas after the first of them; what is older is gone.
    assert names == ["delta=0000000004", "delta=0000000005", "delta=0000000006", "delta=0000000007", "delta=0000000008", "delta=0000000009", "delta=0000000010",
                     "version=0000000003.b3", "version=0000000007.b3"]
    with pytest.raises(ValueError, match="in order"):
        put(spark, table, {}, 9)
    # A new number of buckets counts from the next base on, and a base without buckets is read too.
    wider = StateTable(spark, table.path, EVENT_CURSOR, buckets=5, compact_after=4)
    assert put(spark, wider, {"last": 1}) == 11
    assert rows_of(wider.read()) == want | {"last": 1}
    assert "version=0000000011.b5" in os.listdir(table.path)
    spark.createDataFrame([("x", 1)], EVENT_CURSOR).write.parquet(f"{table.path}/version=0000000012")
    assert rows_of(wider.read()) == {"x": 1}


def test_a_delta_has_what_changed_and_no_more(spark, tmp_path):
    table = StateTable(spark, f"{tmp_path}/s", EVENT_CURSOR)
    table.write(spark.range(5000).selectExpr("cast(id as string) as city", "id as seq"))
    put(spark, table, {"7": -1, "new": 5})
    assert spark.read.parquet(f"{table.path}/delta=0000000001").count() == 2
    assert table.read().count() == 5001 and rows_of(table.read())["7"] == -1


def test_a_crash_between_delta_and_base_loses_nothing(spark, tmp_path):
    table = StateTable(spark, f"{tmp_path}/s", EVENT_CURSOR, buckets=2, compact_after=3)
    for version in range(3):
        put(spark, table, {"a": version, f"c{version}": 1}, version)
    want = {"a": 2, "c0": 1, "c1": 1, "c2": 1}
    base = f"{table.path}/version=0000000002.b2"
    assert rows_of(table.read()) == want and os.path.exists(base)
    os.remove(f"{base}/_SUCCESS")  # as if it had died while the base was written
    assert rows_of(table.read()) == want
    # The epoch runs again and folds again; a delta that was never finished does not count.
    put(spark, table, {"a": 2, "c2": 1}, 2)
    shutil.copytree(f"{table.path}/delta=0000000002", f"{table.path}/delta=0000000003")
    os.remove(f"{table.path}/delta=0000000003/_SUCCESS")
    assert rows_of(table.read()) == want and table.versions() == [0, 1, 2]


def exchanges_over_scans(plan):
    """For each scan of files, whether an Exchange lies above it before the next join."""
    out, stack = {}, []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        stack = [x for x in stack if x[0] < depth]
        stack.append((depth, line))
        if "FileScan" in line or "Scan parquet" in line:
            above = [x for _, x in stack]
            last_join = max((i for i, x in enumerate(above) if "Join" in x), default=0)
            out[line] = any("Exchange" in x for x in above[last_join:])
    return out


def test_a_listing_meets_its_state_without_shuffling_it(spark, tmp_path, plain_joins):
    table = StateTable(spark, f"{tmp_path}/s", SNAPSHOT_STATE, buckets=8)
    known = spark.range(3000).selectExpr(
        "concat('/p/', id) as path", "'sent' as status", "'x' as sha256_hex", "id as mtime_ms", "id as size", "cast(null as int) as code")
    table.write(known)
    table.upsert(known.filter("size < 10").selectExpr("path", "'rejected' as status", "sha256_hex", "mtime_ms", "size", "422 as code"))
    spark.range(2000, 4000).selectExpr("concat('/p/', id) as path").write.parquet(f"{tmp_path}/listing")
    spark.range(5).selectExpr("concat('/p/', id) as path").write.mode("append").parquet(f"{tmp_path}/listing")
    listing = spark.read.parquet(f"{tmp_path}/listing")
    met = table.lookup(listing)
    got = {r.path: r.prior for r in met.collect()}
    assert len(got) == 2005 and got["/p/3"].status == "rejected" and got["/p/3"].code == 422
    assert got["/p/2500"].status == "sent" and got["/p/3500"] is None
    plan = met._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.find("Final Plan"):plan.find("Initial Plan")] if "Final Plan" in plan else plan
    scans = exchanges_over_scans(final)
    state = [shuffled for line, shuffled in scans.items() if "Bucketed: true" in line]
    assert state == [False], final
    assert all(shuffled for line, shuffled in scans.items() if "Bucketed: true" not in line)
