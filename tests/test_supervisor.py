"""Axes that fail, back off and come again, while the others move on."""

import time

from planes.streaming.axes import Folders, start_usage
from planes.streaming.supervisor import Supervisor
from tests.test_streaming import sent
from tests.test_usage import fact, write


def test_a_poison_axis_backs_off_while_the_others_move_on(spark, tmp_path):
    write(f"{tmp_path}/ledgers/a/0.jsonl", fact("r1"))
    good, bad = Folders(str(tmp_path / "g")), Folders(str(tmp_path / "b"))
    broken, tried = {"on": True}, []

    def deliver(_):
        tried.append(time.monotonic())
        if broken["on"]:
            raise RuntimeError("boom")

    starters = {
        "good": lambda: start_usage(spark, f"{tmp_path}/ledgers/*/", good, seconds=1),
        "bad": lambda: start_usage(spark, f"{tmp_path}/ledgers/*/", bad, seconds=1, deliver=deliver),
    }
    watch = Supervisor(spark, starters, first_pause=0.5, longest_pause=2).start()
    try:
        assert watch.wait(lambda axes: axes["bad"].failures >= 3, 120)
        assert watch.axes["good"].state == "running" and watch.axes["good"].failures == watch.axes["good"].restarts == 0
        assert "boom" in watch.axes["bad"].error
        # Each pause is at least twice the one before, up to the longest.
        assert tried[1] - tried[0] >= 0.5 and tried[2] - tried[1] >= 1
        first = watch.axes["good"].run
        write(f"{tmp_path}/ledgers/a/1.jsonl", fact("r2"))
        assert watch.wait(lambda _: [x[2] for x in sent(spark, good)] == ["r1", "r2"])
        broken["on"] = False
        assert watch.wait(lambda axes: axes["bad"].state == "running" and axes["bad"].failures == 0)
        assert [x[2] for x in sent(spark, bad)][:1] == ["r1"] and watch.axes["good"].run == first
        # A query somebody stops is not started again.
        watch.axes["good"].query.stop()
        assert watch.wait(lambda axes: axes["good"].state == "ended")
    finally:
        watch.stop()
    assert not any(a.query.isActive for a in watch.axes.values())


def test_an_axis_that_cannot_start_is_given_up(spark):
    def cannot():
        calls.append(1)
        raise ValueError("misconfigured")

    calls: list[int] = []
    watch = Supervisor(spark, {"never": cannot}, first_pause=0.01, longest_pause=0.05, budget=4).start()
    try:
        assert watch.wait(lambda axes: axes["never"].state == "given up", 20)
    finally:
        watch.stop()
    assert len(calls) == 5 and watch.axes["never"].error == "misconfigured"
