"""Each fact once, whatever arrives again, late or out of order, with state kept by Spark.

A high-water mark takes what comes late for a replay. Here every (source, span of seqs) has a
set of the seqs already seen, one bit each, in the query's state store: an epoch reads and
writes only the spans it touches, a source of any size is spread over its spans, and a restart
goes on from the checkpoint. A span not touched for ``expiry`` is forgotten, which bounds the
state; replays must come within that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

# Seqs of a span, as a power of two.
SPAN_BITS = 13
EXPIRY_DAYS = 14
SEEN = StructType([StructField("bits", BinaryType())])
# What a query with this state takes from the session when it starts. Batches without data
# would come without end, and nothing waits for them.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class FirstOfEachSeq(StatefulProcessor):
    """Passes on the rows whose seq the span has not seen. Null seqs never come here."""

    def __init__(self, span_bits: int, expiry_ms: int):
        self.span, self.expiry_ms = 1 << span_bits, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", SEEN, self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get() if self.seen.exists() else None
        bits = np.zeros(self.span, bool)
        if before is not None:
            bits[:] = np.unpackbits(np.frombuffer(bytes(before[0]), np.uint8), count=self.span)
        for batch in rows:
            at = batch["seq"].to_numpy() % self.span
            fresh = ~bits[at] & ~pd.Series(at).duplicated().to_numpy()
            bits[at] = True
            if fresh.any():
                yield batch[fresh]
        self.seen.update((np.packbits(bits).tobytes(),))

    def close(self) -> None:
        pass


def first_of_each(facts: DataFrame, span_bits: int = SPAN_BITS, expiry_days: float = EXPIRY_DAYS) -> DataFrame:
    """The rows of a stream of ``facts`` (source_id, seq, ...) whose seq comes for the first time.

    Seq 0 and null are invalid and dropped. Of rows that share source and seq the first to
    arrive stays. Needs the session's ``SETTINGS``.
    """
    spans = {"_source": F.col("source_id"), "_span": F.shiftright("seq", span_bits)}
    keyed = facts.filter(F.col("seq") > 0).withColumns(spans)
    return keyed.groupBy("_source", "_span").transformWithStateInPandas(
        statefulProcessor=FirstOfEachSeq(span_bits, int(expiry_days * 86_400_000)),
        outputStructType=facts.schema,
        outputMode="append",
        timeMode="ProcessingTime",
    )
