"""Search of many names in many texts, as a filter join on short pieces.

A name can only be in a text that has each of the name's pieces of ``SIZE`` letters. Every name
waits at one of its pieces, the one that fewest texts have, and meets the texts that have it;
only these are searched for the whole name. No text meets all names, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from planes.schemas import ENVELOPE, S

SIZE = 3


def _pieces(text: Column, size: int | Column) -> Column:
    """All substrings of ``size`` letters, none if the text is shorter."""
    last = F.char_length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))


def search(texts: DataFrame, names: DataFrame, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """Per name found inside a value, and per ``by``: name, n_values, uses, example.

    ``texts`` has value, uses and the columns ``by``, one row per such value; ``uses`` counts how
    often it occurs. ``names`` has name. Letters must be the same, also in case. Empty names and
    null are not searched for; names shorter than a piece are, as the piece they are.
    """
    texts = texts.filter(F.col("value") != "").select(*by, "value", "uses")
    names = names.filter(F.col("name") != "").select("name").distinct()
    cuts = F.concat(*(_pieces(F.col("value"), k) for k in range(1, size + 1)))
    cut = texts.select("*", F.explode(F.array_distinct(cuts)).alias("piece"))
    wide = F.least(F.char_length("name"), F.lit(size))
    named = names.select("name", F.explode(F.array_distinct(_pieces(F.col("name"), wide))).alias("piece"))
    # Counted before they meet, so that a common piece is one row.
    counts = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    waits = (
        named.join(counts, "piece", "left")
        .groupBy("name")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("at"))
        .filter(F.col("at.n") > 0)
        .select("name", F.col("at.piece").alias("piece"))
    )
    found = cut.join(waits, "piece").filter(F.contains("value", "name"))
    return found.groupBy(*by, "name").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("uses").alias("uses"), F.min("value").alias("example")
    )


def search_envelopes(envelopes: DataFrame, names: DataFrame) -> DataFrame:
    """``search`` in every text field of outgoing envelopes: name, field, n_values, uses, example.

    Anything it returns is a leak if ``names`` lists what must not leave, such as raw actors. A
    name counts wherever it is, also inside a run id.
    """
    fields = ["city", *(f.name for f in ENVELOPE.fields if f.dataType == S)]
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields if f in envelopes.columns))
    texts = envelopes.select(F.inline(each)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("uses"))
    return search(texts, names, by=["field"])
