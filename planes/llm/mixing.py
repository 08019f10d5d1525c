"""Mixing sources to target weights along a curriculum that changes with time.

Every source has a weight, which says how many words the mix takes of it, and a schedule,
which says when: how strongly it is asked for at each time from 0 to 1, as straight lines
between given points. The schedule's integral is the share of its words that the source has
given by then; added up over the sources it is what the mix has taken, that is the training
position. A document lies somewhere in its source's words, so the time at which the integral
reaches that place, found by inverting it, gives the document its position. Documents are
then sorted by position in ranges.

Places in a source are running totals over bounded chunks of its documents, however many
rows one source has; only the small table of chunk totals is summed per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from planes.llm.common import WHITE, stage

# Weights of the sources in order of their names, again and again.
WEIGHTS = (5, 2, 1)
# (time, strength) points of each weight's schedule: early, even and late sources.
SCHEDULES = (((0.0, 3.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 3.0)))
# The mix is this part of all words, as numerator and denominator; no document is taken more
# often than MOST times.
SHARE = (3, 2)
MOST = 2
# Hex digits of a document's digest that tell its chunk.
CHUNK_DIGITS = 3

Schedule = Sequence[tuple[float, float]]


def n_words(text_col: str = "text") -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # White space before and after a text leaves an empty piece at either end of the split.
    pieces = F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), f"{WHITE}+"))
    return F.greatest(F.lit(0), pieces - 2).cast("long")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, doc_id, size, copies: distinct such rows. What the mix needs of the documents."""
    return (
        docs.select(F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("doc_id"), n_words(text_col).alias("size"))
        .groupBy("source", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("key", F.when(F.isnull("source"), F.lit("")).otherwise(F.concat(F.lit("="), "source")))
    )


def numbered_sources(rows: DataFrame) -> DataFrame:
    """key, source_size, ordinal: sources by code point, null last, counted from 0.

    Sorted in ranges; only the number of sources in each range is summed in one place.
    """
    sizes = rows.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by_name = sizes.withColumn("last", F.col("key") == "")
    ranges = by_name.repartitionByRange("last", "key").sortWithinPartitions("last", "key")
    sorted_ = stage(ranges.select("key", "source_size", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "mix-sources")
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    bases = sorted_.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).select(
        "range", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    return sorted_.join(bases, "range").select("key", "source_size", (F.col("base") + F.col("at") - F.col("first")).alias("ordinal"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> tuple[DataFrame, list[float]]:
    """``sources`` with kind (the place in ``weights``), target and capped, and the sum of
    the targets of each kind.

    Weights share what the full sources leave; each round finds the sources that become full
    by that, in whole numbers, until none does. The level rises by every round, as Newton's
    method on a sum of straight pieces, so rounds are few.
    """
    num, den = share
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int")).cast("long")
    sources = stage(sources.withColumn("weight", weight).withColumn("kind", (F.col("ordinal") % len(weights)).cast("int")), "mix-weights")
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    sums = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, full, open_weight = sums[0] or 0, 0, sums[1] or 0
    capped = F.lit(False)
    while open_weight:
        # most * size <= weight * (share * total - full) / open_weight
        capped = F.col("source_size").cast("decimal(38,0)") * big(most * den * open_weight) <= F.col("weight").cast("decimal(38,0)") * big(num * total - den * full)
        now = sources.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size") * most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if (now[0], now[1]) == (full, open_weight):
            break
        full, open_weight = now
    else:
        capped = F.lit(True)
    left, parts = num * total - den * full, den * open_weight
    target = F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(
        (F.col("weight").cast("decimal(38,0)") * big(left)).cast("double") / F.lit(float(parts or 1))
    )
    found = sources.withColumn("capped", capped).withColumn("target", target)
    sums = {
        r["kind"]: float(r["full"] or 0) + float((r["open"] or 0) * left) / float(parts or 1)
        for r in found.groupBy("kind").agg(
            F.sum(F.when(F.col("capped"), F.col("source_size") * most)).alias("full"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("open")
        ).collect()  # one row per weight
    }
    return found, [sums.get(k, 0.0) for k in range(len(weights))]


def integral(schedule: Schedule, time: Column) -> Column:
    """The part of its words that a source with this schedule has given by ``time``."""
    before, parts = 0.0, []
    whole = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(schedule, schedule[1:]))
    for (a, x), (b, y) in zip(schedule, schedule[1:]):
        d = time - F.lit(a)
        parts.append((b, (F.lit(before) + F.lit(x) * d + F.lit((y - x) / (b - a) / 2) * d * d) / F.lit(whole)))
        before += (b - a) * (x + y) / 2
    out = parts[-1][1]
    for b, part in reversed(parts[:-1]):
        out = F.when(time < b, part).otherwise(out)
    return out


def time_of(schedule: Schedule, part: Column) -> Column:
    """When a source with this schedule has given ``part`` of its words: the inverse of ``integral``."""
    whole = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(schedule, schedule[1:]))
    before, times = 0.0, []
    for (a, x), (b, y) in zip(schedule, schedule[1:]):
        rest = part * F.lit(whole) - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(x * x) + F.lit(2 * (y - x) / (b - a)) * rest))
        # A strength of 0 where nothing is left to give makes the divisor 0.
        times.append((before := before + (b - a) * (x + y) / 2, F.lit(a) + F.coalesce(F.lit(2.0) * rest / F.nullif(F.lit(x) + root, F.lit(0.0)), F.lit(0.0))))
    out = times[-1][1]
    for end, time in reversed(times[:-1]):
        out = F.when(part * F.lit(whole) < end, time).otherwise(out)
    return out


def check_schedules(weights: Sequence[int], schedules: Sequence[Schedule]) -> None:
    if len(schedules) != len(weights) or any(w <= 0 for w in weights):
        raise ValueError("weights are positive and each has a schedule")
    for points in schedules:
        times = [t for t, _ in points]
        if times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:])):
            raise ValueError("a schedule's times rise from 0 to 1")
        if any(y < 0 for _, y in points) or not any(y > 0 for _, y in points):
            raise ValueError("a schedule's strengths are not negative, and one is above 0")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    share: tuple[int, int] = SHARE,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: source, doc_id, size, source_size, target, copies.

    ``copies`` lists what the mix takes of the document: epoch, position (the word of the
    training run at which it begins) and words. The target is what the mix takes of the whole
    source; the document at which it is reached gives its first words only. Documents follow
    one another in a source by a digest of their ids.

    Sizes are numbers of words; null and empty texts have none and are never taken. A null
    source is a source, the last; null ids are ids. Rows with the same source, id and size
    are told apart by nothing and come one after another. Shares above what ``most`` allows
    take everything ``most`` times. An empty table gives no rows; other columns are not read.
    """
    check_schedules(weights, schedules)
    rows = stage(narrow(docs, id_col, text_col, source_col), "mix-rows")
    if share[0] > most * share[1]:
        share = (most, 1)
    sources, sums = targets(numbered_sources(rows), weights, share, most)

    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("digest", digest).withColumn("chunk", F.left("digest", F.lit(CHUNK_DIGITS)))
    words = F.col("size") * F.col("copies")
    earlier = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = rows.groupBy("key", "chunk").agg(F.sum(words).alias("words")).select(
        "key", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")
    ).join(sources.select("key", "source_size", "target", "kind"), "key")
    inside = W.partitionBy("key", "chunk").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        rows.join(chunks, ["key", "chunk"])
        .withColumn("start", F.col("base") + F.sum(words).over(inside) - words)
        .select("source", "doc_id", "size", "source_size", "target", "kind", F.col("start"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
        .withColumn("start", F.col("start") + (F.col("nth") - 1) * F.col("size"))
    )
    time = lambda part: F.coalesce(*(F.when(F.col("kind") == k, time_of(s, part)) for k, s in enumerate(schedules)))

    def position(at: Column) -> Column:
        when = time(at.cast("double") / F.nullif(F.col("target"), F.lit(0.0)))
        return F.floor(sum((F.lit(s) * integral(p, when) for s, p in zip(sums[1:], schedules[1:])), F.lit(sums[0]) * integral(schedules[0], when)))

    end = F.floor(F.col("target") + 0.5)

    def copy(epoch: int) -> Column:
        at = F.col("start") + F.col("source_size") * epoch
        taken = F.greatest(F.lit(0).cast("long"), F.least("size", end - at))
        return F.struct(F.lit(epoch).alias("epoch"), F.when(taken > 0, position(at)).alias("position"), taken.alias("words"))

    copies = F.filter(F.array(*(copy(e) for e in range(most))), lambda c: c.words > 0)
    return placed.select("source", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def training_order(mixed: DataFrame) -> DataFrame:
    """What ``mix`` takes, a row for each copy, sorted by position over all partitions: position,
    source, doc_id, epoch, words."""
    each = mixed.select("source", "doc_id", F.inline("copies")).select("position", "source", "doc_id", "epoch", "words")
    return by_position(each, "position", "doc_id", "epoch")


def by_position(rows: DataFrame, *columns: str) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in columns]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
