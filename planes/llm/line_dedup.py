"""Near-duplicate lines by a deletion-neighbourhood join, over words.

Two lines are near when one word replaced, put in or left out makes one of the other. Lines
emit their variants, the line with each of its words left out, as hashed keys. Variants that
are equal with the gap in the same place differ in one word there, and a variant equal to a
whole line has one word more; pairs so met are verified word by word. A line goes if an
earlier one, by document and place, equals it or is near it.

In short lines a word is too much: they are near when one character left out of either or of
both, in a word or between two, makes them equal. Their variants lack one character each.

Only distinct lines emit variants, and of these only such as have their first or last half
in common with another, as near lines must. What moves is numbers: two hashes of a line and its
halves' codes. Texts of lines are fetched from the documents for the few that go further, and
the documents are moved once, for the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planes.llm.common import slices, stage
from planes.llm.filters import filter_of_hashes, opened
from planes.llm.tokens import _BASE, _INVERSE, BLOCK, _power, mix, signed, text_bytes, words

# Lines of fewer words are near by characters and not by words.
LEAST_WORDS = 8
# A line must have so many characters, and the word so many, for one character to be a slip.
LEAST_CHARS, LEAST_IN_WORD = 10, 4


_PLACE = "doc_id long, line_no int, h1 long, h2 long"


def _breaks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the batch's texts, and for each line its row, number, begin and end."""
    data, at = text_bytes(batch.column("text"))
    breaks = np.flatnonzero(data == 10)
    begin, end = np.sort(np.concatenate((at[:-1], breaks + 1))), np.sort(np.concatenate((breaks, at[1:])))
    count = 1 + np.diff(np.searchsorted(breaks, at))
    row = np.repeat(np.arange(len(count)), count)
    return data, row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count), begin, end


def _lines(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Lines as words joined by one space, and two hashes of each."""
    whole = data.tobytes()
    texts = [b" ".join(whole[a:b].split()) for a, b in zip(begin.tolist(), end.tolist())]
    return texts, np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in texts), np.int64).reshape(-1, 2)


def _half_codes(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row for each line, words first to last: codes of its beginnings and ends by halves."""
    found = np.zeros((len(first), 4), np.uint64)
    a = 0
    while a < len(first):
        b = max(int(np.searchsorted(last, first[a] + BLOCK, "right")), a + 1)
        low, high, n = first[a:b] - first[a], last[a:b] - first[a], last[a:b] - first[a:b]
        size = int(high[-1])
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(codes[first[a] : last[b - 1]] * _power("up", _BASE, size), out=sums[1:])
        back = _power("down", _INVERSE, size + 1)
        for j, k in enumerate(((n - 1) // 2, (n + 1) // 2)):
            found[a:b, 2 * j] = mix((sums[low + k] - sums[low]) * back[low] + (2 * k).astype(np.uint64))
            found[a:b, 2 * j + 1] = mix((sums[high] - sums[high - k]) * back[high - k] + (2 * k + 1).astype(np.uint64))
        a = b
    return found


def line_table(docs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, line_no, h1, h2 of the lines with words; line, the words joined by one space, of
    the short ones, and halves, codes of beginning and end, of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, row, number, begin, end = _breaks(batch)
            w = words(batch.column("text"))
            first, last = np.searchsorted(w.begin, begin), np.searchsorted(w.begin, end)
            some = last > first
            row, number, begin, end, first, last = (x[some] for x in (row, number, begin, end, first, last))
            if not len(row):
                continue
            texts, hashes = _lines(data, begin, end)
            long = last - first >= least_words
            halves = _half_codes(w.codes, first[long], last[long]).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]),
                    pa.array([None if x else t.decode() for t, x in zip(texts, long.tolist())], pa.string()),
                    pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(4 * long))).astype(np.int32), signed(halves)),
                ],
                ["doc_id", "line_no", "h1", "h2", "line", "halves"],
            )

    return docs.mapInArrow(run, f"{_PLACE}, line string, halves array<long>")


def half_table(lines: DataFrame, kept) -> DataFrame:
    """doc_id, line_no, h1, h2, code: halves of lines, of codes in the broadcast filter alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(kept)
        for batch in batches:
            column = batch.column("halves")
            codes, row = column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            some = known.holds(codes.view(np.uint64))
            at = pa.array(row[some])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("doc_id", "line_no", "h1", "h2")), pa.array(codes[some])], ["doc_id", "line_no", "h1", "h2", "code"]
            )

    return lines.mapInArrow(run, f"{_PLACE}, code long")


def place_codes(doc_id: np.ndarray, line_no: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + line_no.astype(np.uint64))


def texts_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, line_no, line of the lines (doc_id, line_no, h1, h2), from their documents."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([signed(place_codes(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "line_no"))))], ["code"])

    kept = filter_of_hashes(places.select("doc_id", "line_no").mapInArrow(codes, "code long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(kept)
        for batch in slices(batches, "text"):
            data, row, number, begin, end = _breaks(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            some = known.holds(place_codes(ids[row], number))
            if some.any():
                texts, hashes = _lines(data, begin[some], end[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[some]]), pa.array(number[some].astype(np.int32)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([x.decode() for x in texts], pa.string())],
                    ["doc_id", "line_no", "h1", "h2", "line"],
                )

    found = docs.mapInArrow(run, f"{_PLACE}, line string")
    return found.join(places, ["doc_id", "line_no", "h1", "h2"]).select("doc_id", "line_no", "line")


def variant_table(lines: DataFrame) -> DataFrame:
    """code, kind and place (doc_id, line_no) of the variants of each line (kind 0: with the
    place of the gap in the code, 1: without it, 2: the whole line)."""

    def run(batches):
        for batch in slices(batches, "line", 1 << 20):
            w = words(batch.column("line"))
            codes, kinds, rows = [], [], []
            for r, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                n = b - a
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(w.codes[a:b] * _power("up", _BASE, n), out=sums[1:])
                gone = sums[:-1] + (sums[n] - sums[1:]) * _INVERSE
                gap = np.arange(n, dtype=np.uint64)
                code = np.concatenate([mix(gone) + mix(gap + np.uint64(1 + n * 65536)), mix(gone) + np.uint64(n - 1), mix(sums[n:]) + np.uint64(n)])
                kinds.append(np.repeat(np.arange(3, dtype=np.int32), [n, n, 1]))
                codes.append(mix(code)), rows.append(np.full(len(code), r))
            if codes:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(codes)), pa.array(np.concatenate(kinds)), batch.column("doc_id").take(row), batch.column("line_no").take(row)],
                    ["code", "kind", "doc_id", "line_no"],
                )

    return lines.mapInArrow(run, "code long, kind int, doc_id long, line_no int")


def near_pairs(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, line_no of lines (doc_id, line_no, h1, h2, halves), distinct ones of ``docs``,
    that are near an earlier one of them."""
    place = F.struct("doc_id", "line_no")
    # A line has each of its codes once.
    shared = lines.select(F.explode("halves").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("code")
    shared = stage(shared, "halves")
    likely = half_table(lines, filter_of_hashes(shared)).join(shared, "code").select("doc_id", "line_no", "h1", "h2").distinct()
    lines = stage(texts_of(docs, stage(likely, "likely")), "candidates")
    variants = stage(variant_table(lines), "variants")
    replaced = variants.where("kind = 0")
    first = replaced.groupBy("code").agg(F.min(place).alias("early"), F.max(place).alias("most")).where("early < most").select("code", "early")
    pairs = replaced.join(first, "code").select(place.alias("late"), "early").where("early < late")
    less, whole = (variants.where(f"kind = {k}").select("code", place.alias(c)) for k, c in ((1, "x"), (2, "y")))
    # One whole line has a code; of the longer lines that have it as a variant only the first
    # can make it go, and it can make each of them go.
    firsts = less.groupBy("code").agg(F.min("x").alias("x"))
    met = whole.join(firsts, "code").where("x < y").select(F.col("y").alias("late"), F.col("x").alias("early"))
    longer = less.join(whole, "code").where("y < x").select(F.col("x").alias("late"), F.col("y").alias("early"))
    pairs = stage(pairs.unionByName(met).unionByName(longer).distinct(), "pairs")
    text = lambda c: lines.select(place.alias(c), F.col("line").alias(f"line_{c}"))

    def run(batches):
        for batch in batches:
            ok = [within_one(a.split(" "), b.split(" ")) for a, b in zip(batch.column("line_late").to_pylist(), batch.column("line_early").to_pylist())]
            yield batch.select(["doc_id", "line_no"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(text("late"), "late").join(text("early"), "early").select("late.doc_id", "late.line_no", "line_late", "line_early")
    return both.mapInArrow(run, "doc_id long, line_no int").distinct()


def short_variants(line: str) -> list[str]:
    """The line, and the line without each character that can be a slip: of a word without
    digits that is not a mere label, or a space."""
    found = {line: None}
    if len(line) >= LEAST_CHARS:
        at = 0
        for word in line.split(" "):
            if len(word) >= LEAST_IN_WORD and not any(c.isdigit() for c in word):
                found.update((line[:k] + line[k + 1 :], None) for k in range(at, at + len(word)))
            at += len(word) + 1
            if at <= len(line):
                found[line[: at - 1] + line[at:]] = None
    return list(found)


def near_short(lines: DataFrame) -> DataFrame:
    """doc_id, line_no of short lines (doc_id, line_no, line) that are near an earlier one of
    them. All lines that have a variant in common are near each other, so the first tells."""

    def run(batches):
        for batch in slices(batches, "line", 1 << 20):
            found = [short_variants(x) for x in batch.column("line").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for one in found for x in one], pa.string()), batch.column("doc_id").take(row), batch.column("line_no").take(row)],
                ["variant", "doc_id", "line_no"],
            )

    place = F.struct("doc_id", "line_no")
    variants = lines.mapInArrow(run, "variant string, doc_id long, line_no int")
    variants = variants.select(F.xxhash64("variant").alias("h1"), F.xxhash64(F.lit(1), "variant").alias("h2"), place.alias("late"))
    first = variants.groupBy("h1", "h2").agg(F.min("late").alias("early"), F.max("late").alias("most")).where("early < most").drop("most")
    return variants.join(stage(first, "firsts"), ["h1", "h2"]).where("early < late").select("late.doc_id", "late.line_no").distinct()


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether at most one word replaced, put in or left out makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (lines with words), n_removed, kept (the text without the lines that go).

    Lines are what line breaks part; white space in a line does not tell lines apart. Lines
    without words stay. Null and empty texts have no lines and an empty kept. Rows with a null
    id stay whole and take nothing from others; rows that share an id share their lines'
    places. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.where("doc_id is not null")
    lines = stage(line_table(named, least_words), "places")
    first = stage(
        lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "line", "halves")).alias("f"), F.count(F.lit(1)).alias("copies"))
        .select("h1", "h2", "copies", "f.doc_id", "f.line_no", "f.line", "f.halves"),
        "lines",
    )
    near = near_pairs(named, first.where("line is null").select("doc_id", "line_no", "h1", "h2", "halves"))
    near = stage(near.unionByName(near_short(first.where("line is not null").select("doc_id", "line_no", "line"))), "near")
    # A line that is near an earlier one goes, and of equal ones all but the first.
    repeated = first.where("copies > 1").select("h1", "h2", F.col("doc_id").alias("d"), F.col("line_no").alias("n"))
    copies = lines.select("doc_id", "line_no", "h1", "h2").join(repeated, ["h1", "h2"]).where("doc_id <> d or line_no <> n")
    gone = near.unionByName(copies.select("doc_id", "line_no")).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    has = lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != ""
    drop = lambda x, i: F.coalesce(F.array_contains("gone", i), F.lit(False)) & has(x)
    # Merged whatever the sizes: texts move once, in proportion to the input.
    return docs.join(stage(gone, "gone").hint("merge"), "doc_id", "left").select(
        "doc_id",
        F.size(F.filter(parts, has)).cast("long").alias("n_lines"),
        F.size(F.filter(parts, drop)).cast("long").alias("n_removed"),
        F.array_join(F.filter(parts, lambda x, i: ~drop(x, i)), "\n").alias("kept"),
    )
