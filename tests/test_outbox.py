"""Epochs of the outbox when writers die at any point."""

import os

import pytest
from pyspark.sql import Observation, functions as F

from planes.sources import outbox
from planes.sources.outbox import read_epoch, read_outbox, store_epoch


def rows(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in values], "k string, v int")


def seen(spark, root):
    return sorted((r.k, r.v, r.epoch) for r in read_outbox(spark, f"{root}/outbox", ["k"]).collect())


class Died(Exception):
    pass


def test_an_epoch_written_again_is_replaced(spark, tmp_path):
    root = str(tmp_path)
    store_epoch(rows(spark, ("a", 1), ("b", 1)), root, "outbox", 0)
    assert seen(spark, root) == [("a", 1, 0), ("b", 1, 0)]
    back = store_epoch(rows(spark, ("a", 2)), root, "outbox", 0)
    assert [tuple(r) for r in back.collect()] == [("a", 2)] and seen(spark, root) == [("a", 2, 0)]
    store_epoch(rows(spark, ("a", 3), ("c", 3)), root, "outbox", 1)
    assert seen(spark, root) == [("a", 3, 1), ("c", 3, 1)]
    assert sorted(n for n in os.listdir(f"{root}/outbox") if not n.startswith(".")) == ["epoch=0000000000", "epoch=0000000001"]


@pytest.mark.parametrize("step, new", [("write", False), ("note", False), ("delete", True), ("rename", True), ("last", True)])
def test_readers_see_the_old_epoch_or_the_new_one_whole(spark, tmp_path, monkeypatch, step, new):
    root = str(tmp_path)
    store_epoch(rows(spark, ("a", 1), ("b", 1)), root, "outbox", 0)
    store_epoch(rows(spark, ("z", 1)), root, "outbox", 1)
    if step == "write":  # a task fails, so the write does
        bad = rows(spark, ("a", 2), ("b", 2)).withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("died")).cast("int")).otherwise(F.col("v")))
        with pytest.raises(Exception, match="died"):
            store_epoch(bad, root, "outbox", 0)
    else:
        plain = {n: getattr(outbox._Folder, n) for n in ("note", "rename", "delete")}

        def dies(name):
            def call(self, *a):
                if step == name or (step == "last" and name == "delete" and a[0].startswith("_instead")):
                    raise Died
                return plain[name](self, *a)

            return call

        with monkeypatch.context() as m:
            for name in plain:
                m.setattr(outbox._Folder, name, dies(name))
            with pytest.raises(Died):
                store_epoch(rows(spark, ("a", 2), ("b", 2)), root, "outbox", 0)
    v = 2 if new else 1
    want = [("a", v, 0), ("b", v, 0), ("z", 1, 1)]
    assert seen(spark, root) == want
    assert sorted(map(tuple, read_epoch(spark, root, "outbox", 0).collect())) == [("a", v), ("b", v)]
    # The next writer puts things right, and the epoch can be written again.
    store_epoch(rows(spark, ("y", 1)), root, "outbox", 2)
    assert seen(spark, root) == sorted([*want, ("y", 1, 2)])
    store_epoch(rows(spark, ("a", 3)), root, "outbox", 0)
    assert seen(spark, root) == [("a", 3, 0), ("y", 1, 2), ("z", 1, 1)]
    assert not [n for n in os.listdir(f"{root}/outbox") if n.startswith("_instead")]


def test_a_first_epoch_that_was_not_finished_is_not_there(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store_epoch(rows(spark, ("a", 1)), root, "outbox", 0)

    def dies(*_):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(outbox._Folder, "rename", dies)
        with pytest.raises(Died):
            store_epoch(rows(spark, ("b", 1)), root, "outbox", 1)
    assert seen(spark, root) == [("a", 1, 0)]


def test_metrics_are_taken_while_writing(spark, tmp_path):
    store = spark._jsparkSession.sharedState().statusStore()
    before, taken = store.executionsCount(), Observation()
    store_epoch(rows(spark, ("a", 5), ("b", 7)), str(tmp_path), "outbox", 0, observe=taken, metrics=[F.sum("v").alias("v"), F.count("*").alias("n")])
    assert taken.get == {"v": 12, "n": 2}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executionsCount() - before <= 1
