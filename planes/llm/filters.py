"""Sets of hashes of which every task has a copy, of a fixed size whatever is put into them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Bits of a filter, as a power of two, whatever is put into it.
FILTER_BITS = 25


class Filter:
    """A set of hashes; it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for word, bit in _places(codes, len(self.bits)):
            found &= (self.bits[word] & bit) != 0
        return found


def _places(codes: np.ndarray, size: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    for shift in (0, 32):
        at = (codes >> np.uint64(shift)) % np.uint64(size * 64)
        yield (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def filter_of_hashes(hashes: DataFrame, bits: int = FILTER_BITS):
    """A broadcast filter of ``code``. It has 2^bits bits, whatever the number of hashes; no more
    than one row for every 64 of them is brought to the driver."""
    size = 1 << (bits - 6)

    def run(batches):
        for batch in batches:
            places = list(_places(batch.column("code").to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p for p, _ in places])), pa.array(np.concatenate([b for _, b in places]).view(np.int64))], ["word", "bits"]
            )

    rows = hashes.select("code").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(size, np.uint64)
    filled[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(filled.tobytes())


def opened(shared) -> Filter | None:
    """The filter that was broadcast, None for none."""
    return None if shared is None else Filter(np.frombuffer(shared.value, np.uint64))
