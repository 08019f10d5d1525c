"""Closed schemas. A source field that is not listed here is never read."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

# What a usage ledger line may carry.
USAGE_LINE = _struct(
    ("run_id", S), ("session_id", S), ("step_id", S), ("worker", S),
    ("kind", S), ("model", S), ("provider", S),
    ("input_tokens", L), ("output_tokens", L),
    ("cache_read_tokens", L), ("cache_creation_tokens", L),
    ("cost_usd_estimate", D), ("unpriced", B),
    ("upstream_req_id", S), ("at", L),
)

# A numbered usage fact, as it goes out in a batch.
USAGE_FACT = T.StructType([T.StructField("seq", L), *USAGE_LINE.fields])

# What one event frame may carry. ``payload`` is its undecoded JSON text.
EVENT_LINE = _struct(
    ("seq", L), ("type", S), ("ts", S), ("actor", S), ("subject", S),
    ("run_id", S), ("session_id", S), ("step_id", S),
)
EVENT_LINE_WITH_PAYLOAD = T.StructType([*EVENT_LINE.fields, T.StructField("payload", S)])

# A listing of transcript files, for instance made by the hosts that hold them.
LISTING = _struct(
    ("source_id", S), ("root_no", T.IntegerType()), ("root", S), ("path", S), ("size", L),
    ("mtime_ms", L), ("is_symlink", B),
)

# The redacted envelope.
ENVELOPE = _struct(
    ("seq", L), ("type", S), ("ts", T.TimestampType()), ("actor_hash", S), ("ref", S),
    ("run_id", S), ("session_id", S), ("step_id", S), ("title", S), ("formula", S),
)

# File identities are unsigned 64-bit, which does not fit a signed long.
FILE_ID = T.DecimalType(20, 0)

USAGE_CURSOR = _struct(
    ("source_id", S), ("offset", L), ("next_seq", L), ("file_id", FILE_ID)
)
EVENT_CURSOR = _struct(("city", S), ("seq", L))
SNAPSHOT_STATE = _struct(
    ("path", S), ("status", S), ("sha256_hex", S), ("mtime_ms", L), ("size", L),
    ("code", T.IntegerType()),
)
HIGH_WATER = _struct(("source_id", S), ("hwm", L))

# Money is summed as an exact decimal so totals do not depend on partitioning.
COST = T.DecimalType(38, 12)

USAGE_SCHEMA_VERSION = 1
EVENT_SCHEMA_VERSION = 1
