"""Dense numbering, batching and confirmed cursors, all without one task per key.

A source or city may hold a large share of all rows, so nothing here sorts or collects
a whole key. Rows are numbered inside bounded chunks of a key's order (a span of line
numbers, a block of a file), and a small table of chunk sizes supplies each chunk's base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows per chunk, as a power of two, where the order column is a dense integer such as a
# line number.
CHUNK_BITS = 20
# The same for byte offsets, at a few hundred bytes per row.
BYTE_CHUNK_BITS = 26

_BASE, _CHUNK, _STOP = "_base", "_chunk", "_stop"


def with_span_chunk(df: DataFrame, order: str, bits: int = CHUNK_BITS) -> DataFrame:
    """Add the chunk column for an integer order that is unique within its key."""
    return df.withColumn(_CHUNK, F.shiftright(F.col(order).cast("long"), bits))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    chunk: Sequence[str] | None = None,
    starts: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Number rows within ``keys`` by ``order``, with no gaps.

    Adds ``ordinal``, which counts 1, 2, 3, ..., and, where the rows have none, ``seq``,
    which counts on from the key's ``first`` in ``starts`` (from 1 for keys without one).

    ``chunk`` names columns that cut a key's order into bounded, consecutive pieces and
    sort like it; without them the first order column must be an integer and is cut into
    spans. With ``limit`` only each key's first ``limit`` rows are kept, and chunks beyond
    it are dropped before any row is shuffled or sorted.
    """
    spans = chunk is None
    if spans:
        df, chunk = with_span_chunk(df, order[0]), [_CHUNK]
    keys, chunk = list(keys), list(chunk)

    sizes = df.groupBy(*keys, *chunk).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn(_BASE, F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if limit is not None:
        bases = bases.filter(F.col(_BASE) < limit)
    # The start joins the chunk sizes, not the rows.
    if starts is None:
        bases = bases.withColumn("_first", F.lit(1).cast("long"))
    else:
        known = starts.select(*keys, F.greatest("first", F.lit(1)).cast("long").alias("_first"))
        bases = bases.join(known, keys, "left").withColumn("_first", F.coalesce("_first", F.lit(1)))

    place = F.row_number().over(Window.partitionBy(*keys, *chunk).orderBy(*order))
    if limit is None:
        # Numbered first: the window leaves rows sorted the way the join wants them.
        numbered = df.withColumn("_place", place).join(bases, [*keys, *chunk])
    else:
        numbered = df.join(bases, [*keys, *chunk]).withColumn("_place", place)
    numbered = numbered.withColumn("ordinal", (F.col(_BASE) + F.col("_place")).cast("long"))
    if limit is not None:
        numbered = numbered.filter(F.col("ordinal") <= limit)
    if "seq" not in df.columns:
        numbered = numbered.withColumn("seq", F.col("ordinal") + F.col("_first") - 1)
    return numbered.drop(_BASE, "_first", "_place", *([_CHUNK] if spans else []))


def assemble_batches(
    df: DataFrame,
    key: str,
    fields: Sequence[str],
    *,
    batch_max: int,
    out: str,
) -> DataFrame:
    """One row per batch: ``key``, ``batch_no`` from 0, seq range, ordered array ``out``.

    ``ordinal`` is dense within ``key``, so each batch but a key's last holds exactly
    ``batch_max`` rows. Arrays sort by the first of ``fields``, the row's seq.
    """
    batched = df.select(
        key,
        F.floor((F.col("ordinal") - 1) / batch_max).alias("batch_no"),
        F.struct(*fields).alias("_item"),
    )
    items = F.array_sort(F.collect_list("_item"))
    return (
        batched.groupBy(key, "batch_no")
        .agg(
            items.alias(out),
            F.min(f"_item.{fields[0]}").alias("first_seq"),
            F.max(f"_item.{fields[0]}").alias("last_seq"),
        )
        .withColumn("n", F.size(out))
    )


def first_held(batches: DataFrame, receipts: DataFrame, key: str, advances: Column) -> DataFrame:
    """Per key, the seq at which the first batch not yet confirmed starts.

    ``receipts`` carries (key, batch_no, http_status); a batch without one is held. Later
    batches of the key are held with it, whatever their own receipts say. Keys whose
    batches are all confirmed have no row.
    """
    joined = batches.select(key, "batch_no", "first_seq").join(
        receipts.select(key, "batch_no", "http_status"), [key, "batch_no"], "left"
    )
    held = joined.filter(~F.coalesce(advances, F.lit(False)))
    return held.groupBy(key).agg(F.min("first_seq").alias(_STOP))


def before_first_held(rows: DataFrame, stops: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of each key that lie before its first held batch."""
    # ``stops`` has one row per key; AQE broadcasts it when its measured size allows.
    joined = rows.join(stops, key, "left")
    return joined.filter(F.col(_STOP).isNull() | (F.col(seq) < F.col(_STOP))).drop(_STOP)
