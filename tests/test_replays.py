"""The receiving side when batches come again, late and out of order."""

import random

import pandas as pd
import pytest

from planes.operators import usage
from planes.streaming.axes import Folders, start_ingest_unordered
from planes.streaming.replays import FirstOfEachSeq
from tests.test_streaming import finish
from tests.test_usage import fact, write



def batches_of(spark, tmp_path, facts, n):
    """Outbox rows of one source, ``n`` facts each, as a list of folders."""
    from planes.sources.ledger import LEDGER_CHUNK, LEDGER_ORDER, read_ledgers

    for source, runs in facts.items():
        write(f"{tmp_path}/ledgers/{source}/usage.jsonl", "".join(fact(run) for run in runs))
    lines = read_ledgers(spark, f"{tmp_path}/ledgers/*/usage.jsonl", r"([^/]+)/[^/]*$")
    numbered = usage.number_facts(usage.model_facts(usage.decode_usage(lines)), LEDGER_ORDER, chunk=LEDGER_CHUNK)
    return usage.usage_batches(numbered, batch_max=n)


def test_each_fact_once_over_replays_disorder_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    facts = {"a": [f"a{i}" for i in range(30)], "b": ["b0"]}
    made = batches_of(spark, tmp_path, facts, 4).cache()
    numbers = [(r.source_id, r.batch_no) for r in made.select("source_id", "batch_no").collect()]
    folders, outbox = Folders(str(tmp_path / "i")), f"{tmp_path}/outbox"
    arrivals = numbers + rng.choices(numbers, k=10)
    rng.shuffle(arrivals)
    assert [x for x in arrivals if x[0] == "a"] != sorted(x for x in arrivals if x[0] == "a")
    made.limit(0).write.parquet(f"{outbox}/epoch=0000000000")
    got = []
    for i in range(0, len(arrivals), 7):  # a restart before every seven arrivals
        for j, (source, no) in enumerate(arrivals[i : i + 7]):
            one = made.filter((made.source_id == source) & (made.batch_no == no))
            one.write.parquet(f"{outbox}/epoch={i + j + 1:010d}")
        finish(start_ingest_unordered(spark, outbox, folders, span_bits=3, once=True, options={"maxFilesPerTrigger": "4"}))
        got = sorted((r.source_id, r.seq, r.run_id) for r in spark.read.parquet(folders.outbox).collect())
        assert len(got) == len({x[:2] for x in got})
    assert got == sorted((s, i + 1, run) for s, runs in facts.items() for i, run in enumerate(runs))
    # Nothing but replays: an epoch that adds nothing.
    made.write.parquet(f"{outbox}/epoch=0000000999")
    finish(start_ingest_unordered(spark, outbox, folders, span_bits=3, once=True))
    assert spark.read.parquet(folders.outbox).count() == 31


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("span_bits", [0, 3, 13])
def test_a_span_passes_each_seq_once(span_bits):
    rng = random.Random(span_bits)
    processor = FirstOfEachSeq(span_bits, 1000)
    processor.seen = Value()
    span, seen = 1 << span_bits, []
    seqs = range(5 * span, 6 * span)
    for _ in range(6):
        frames = [pd.DataFrame({"seq": rng.choices(seqs, k=rng.randint(0, span + 2))}, dtype="int64") for _ in range(3)]
        for out in processor.handleInputRows(("a", 5), iter(frames), None):
            seen += out["seq"].tolist()
    assert len(seen) == len(set(seen)) > 0 and set(seen) <= set(seqs)
    assert len(processor.seen.value[0]) == max(1, span // 8)
