"""Collocations by Toivonen's mining of frequent phrases.

A sample of the documents proposes phrases: those frequent in it under a lowered bound. One
pass over all documents counts exactly what was proposed and its negative border, the phrases
that were not although both their parts were (all words but the last, all but the first);
words have no parts and all are counted. A phrase of the border that turns out frequent is a
failure: longer phrases may hold it that nobody has counted. Then a further pass counts each
phrase not counted yet whose parts are all either known to be frequent or not counted, until
no failure is left. Every part of a frequent phrase is frequent, so nothing is missed.

What is proposed grows with the documents; tasks know it as a filter of bits of a fixed size.
Where the filter errs a phrase too many is counted, which changes no result. Most phrases of
the border are rare, so the pass over all documents has two turns: phrases are counted by
their hashes first, and only those whose hash is frequent by themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from planes.llm.common import slices, stage
from planes.llm.filters import FILTER_BITS, Filter, filter_of_hashes, opened
from planes.llm.tokens import _BASE, _LOWER, mix, signed, span_codes, text_bytes, words

# Bytes that end a piece of a text, and bytes between the words of a piece.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 5
SUPPORT = 100
# One document of so many is in the sample, where this part of the bound, in percent, suffices.
SAMPLE, LOWERED = 8, 50
UNNAMED = "und"
# Sub-groups of a language that are ranked before the whole.
SALTS = 256
COUNTED = "lang string, phrase string, k int, f long"


def _lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _longer(total: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Running hashes of k words in a row, from those of k - 1."""
    return total[: len(codes) - k + 1] * _BASE + codes[k - 1 :]


def _sealed(total: np.ndarray, k: int, lang: np.ndarray) -> np.ndarray:
    return mix(total + np.uint64(k)) ^ lang[: len(total)]


class Pieces:
    """The words of some texts, by numpy arrays, and how many follow each in its piece."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        data, at = text_bytes(texts)
        ends = np.zeros(256, bool)
        ends[list(BREAKS)] = True
        gaps = ends.copy()
        gaps[list(BLANKS)] = True
        dark = ~gaps[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        start, stop = dark.copy(), dark.copy()
        start[1:] &= ~dark[:-1] | edge[1:-1]
        stop[:-1] &= ~dark[1:] | edge[1:-1]
        begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        breaks = np.concatenate(([0], np.cumsum(ends[data])))
        row = np.searchsorted(at, begin, "right") - 1
        self.codes = span_codes(data, begin, end, lower=True)
        # Whether the next word is in the same piece.
        self.joined = np.zeros(len(begin), bool)
        self.joined[:-1] = (row[1:] == row[:-1]) & (breaks[begin[1:]] == breaks[begin[:-1]])
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        self.names, self.lang = names, np.array([number[x] for x in langs], np.int64)[row] if len(begin) else np.zeros(0, np.int64)
        self.lang_code = np.array([_lang_code(x) for x in names], np.uint64)[self.lang]
        # Words in small letters with one space behind each, so that a phrase is a slice.
        size = end - begin
        self.to = np.cumsum(size + 1)
        self.at = self.to - size - 1
        self.flat = np.full(int(self.to[-1]) if len(size) else 0, 32, np.uint8)
        inside = np.repeat(begin - self.at, size) if len(size) else np.zeros(0, np.int64)
        spot = np.ones(len(self.flat), bool)
        spot[self.to - 1] = False
        spot = np.flatnonzero(spot)
        self.flat[spot] = _LOWER[data[spot + inside]]

    def texts(self, first: np.ndarray, k: np.ndarray) -> pa.Array:
        """The phrase of ``k`` words from each of ``first``."""
        begin = self.at[first]
        size = self.to[first + k - 1] - 1 - begin
        ends = np.cumsum(size)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        offsets = np.concatenate(([0], ends)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())).cast(pa.string())

    def chosen(self, lengths: Sequence[int], known: Filter | None, counted: Filter | None):
        """(k, first words, hashes) of the phrases to be counted.

        Without ``counted``, those whose two parts are ``known``. With it, a phrase has been
        counted if its parts are in ``counted``; the others are chosen if each of their parts
        is known or, not counted yet, chosen itself.
        """
        total, valid = self.codes.copy(), np.ones(len(self.codes), bool)
        alive = in_counted = None
        for k in range(1, max(lengths) + 1):
            if k > 1:
                if len(self.codes) < k:
                    return
                total = _longer(total, self.codes, k)
                valid = valid[: len(total)] & self.joined[k - 2 : k - 2 + len(total)]
            codes = _sealed(total, k, self.lang_code)
            if k == 1:
                may, was = valid, np.full(len(valid), counted is not None)
            else:
                may = valid & alive[: len(total)] & alive[1 : len(total) + 1]
                was = in_counted[: len(total)] & in_counted[1 : len(total) + 1] if counted is not None else np.zeros(len(total), bool)
            emit = may & ~was
            if k in lengths:
                first = np.flatnonzero(emit)
                yield k, first, codes[first]
            if k < max(lengths):
                # Only what may go on is looked up.
                alive = np.zeros(len(total), bool)
                look = np.flatnonzero(may if counted is None else may & was)
                alive[look] = known.holds(codes[look])
                if counted is not None:
                    alive |= emit
                    in_counted = np.zeros(len(total), bool)
                    look = np.flatnonzero(valid if k == 1 else valid & was)
                    in_counted[look] = counted.holds(codes[look])


def _chosen(p: Pieces, lengths: Sequence[int], known: Filter | None, counted: Filter | None, kept: Filter | None):
    """k, first word, hash and number of the distinct phrases of some texts that are to be counted."""
    found = list(p.chosen(lengths, known, counted))
    if kept is not None:
        found = [(k, first[some], codes[some]) for k, first, codes in found for some in [kept.holds(codes)]]
    k = np.concatenate([np.full(len(first), k) for k, first, _ in found] or [np.zeros(0, np.int64)])
    first = np.concatenate([first for _, first, _ in found] or [np.zeros(0, np.int64)])
    codes, one, n = np.unique(np.concatenate([c for _, _, c in found] or [np.zeros(0, np.uint64)]), return_index=True, return_counts=True)
    return k[one], first[one], codes, n


def frequent_hashes(docs: DataFrame, lengths: Sequence[int], support: int, known=None) -> DataFrame:
    """code: the hashes that phrases chosen by ``known`` have ``support`` times or more, all together."""

    def run(batches):
        a = opened(known)
        for batch in slices(batches, "text"):
            _, _, codes, n = _chosen(Pieces(batch.column("text"), batch.column("lang").to_pylist()), lengths, a, None, None)
            yield pa.RecordBatch.from_arrays([signed(codes), pa.array(n, pa.int64())], ["code", "n"])

    rows = docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return rows.where(F.col("n") >= support).select("code")


def counts(docs: DataFrame, lengths: Sequence[int], known=None, counted=None, kept=None) -> DataFrame:
    """lang, phrase, k, f: phrases of ``lengths`` chosen by ``known`` and ``counted``, and in
    ``kept`` if that is given (all broadcast filters), counted over all ``docs`` (lang, text).
    Where words are asked for, k = 0 has the number of all words, under the empty phrase."""

    def run(batches):
        a, b, c = opened(known), opened(counted), opened(kept)
        for batch in slices(batches, "text"):
            p = Pieces(batch.column("text"), batch.column("lang").to_pylist())
            k, first, _, n = _chosen(p, lengths, a, b, c)
            lang = p.lang[first]
            text = p.texts(first, k)
            if 1 in lengths:
                each = np.bincount(p.lang, minlength=len(p.names))
                lang, k, n = np.concatenate([lang, np.arange(len(each))]), np.concatenate([k, np.zeros(len(each), np.int64)]), np.concatenate([n, each])
                text = pa.concat_arrays([text, pa.array([""] * len(each), pa.string())])
            names = pa.array(p.names, pa.string()).take(pa.array(lang, pa.int64()))
            yield pa.RecordBatch.from_arrays([names, text, pa.array(k, pa.int32()), pa.array(n, pa.int64())], ["lang", "phrase", "k", "f"])

    return docs.mapInArrow(run, COUNTED).groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def filter_of(phrases: DataFrame, bits: int = FILTER_BITS):
    """A broadcast filter of (lang, phrase)."""

    def run(batches):
        for batch in batches:
            w = words(batch.column("phrase"))
            k = np.diff(w.first)
            lang = np.array([_lang_code(x) for x in batch.column("lang").to_pylist()], np.uint64)
            codes = np.zeros(len(k), np.uint64)
            for n in np.unique(k[k > 0]).tolist():
                some = np.flatnonzero(k == n)
                at, total = w.first[:-1][some], w.codes[w.first[:-1][some]].copy()
                for j in range(1, n):
                    total = total * _BASE + w.codes[at + j]
                codes[some] = _sealed(total, n, lang[some])
            yield pa.RecordBatch.from_arrays([signed(codes[k > 0])], ["code"])

    return filter_of_hashes(phrases.select("lang", "phrase").mapInArrow(run, "code long"), bits)


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, sample: int = SAMPLE, bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, k, f of all phrases of up to ``longest`` words with f >= support, exactly; with
    k = 0 and the empty phrase, the number of words of each lang. ``docs`` has doc_id, lang, text."""
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    lowered = max(1, support * LOWERED // (100 * sample))
    often = F.col("f") >= lowered
    extends = F.col("k").between(1, longest - 1)

    # The sample's proposal, in three passes over the sample: words, pairs, longer phrases.
    proposed = stage(counts(part, [1]).where(often & (F.col("k") == 1)), "phrases-proposed")
    ones = filter_of(proposed, bits)
    if longest > 2:
        proposed = proposed.unionByName(stage(counts(part, [2], ones).where(often), "phrases-proposed"))
    if longest > 3:
        longer = counts(part, range(3, longest), filter_of(proposed, bits), ones)
        proposed = proposed.unionByName(stage(longer.where(often), "phrases-proposed"))

    # Everything proposed and its negative border, counted over all documents.
    known = filter_of(proposed, bits)
    enough = (F.col("f") >= support) | (F.col("k") == 0)
    lengths = range(1, longest + 1)
    kept = filter_of_hashes(stage(frequent_hashes(docs, lengths, support, known), "phrases-hashes"), bits)
    found = stage(counts(docs, lengths, known, kept=kept).where(enough), "phrases-counted")
    new = found
    while True:
        failures = new.where(extends).join(proposed, ["lang", "phrase"], "left_anti")
        if failures.isEmpty():
            return found
        proposed = proposed.select("lang", "phrase").unionByName(failures.select("lang", "phrase"))
        more = counts(docs, range(2, longest + 1), filter_of(found.where(extends), bits), known)
        new = stage(more.where(enough), "phrases-counted")
        # What this pass chose is counted from now on, and what it found frequent is known.
        proposed = proposed.unionByName(new.where(extends).select("lang", "phrase"))
        found = found.unionByName(new)
        known = filter_of(proposed, bits)


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the phrases of two words and more, by their worst cut.

    score = floor(1000 a n / (l r)), in whole numbers of up to 38 digits; of equal cuts the first.
    """
    n = found.where("k = 0").select("lang", F.col("f").alias("n"))
    parts = found.where("k > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    split = F.split("phrase", " ")
    cuts = found.where("k > 1").select(
        "lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    ).withColumns({
        "first": F.array_join(F.slice(split, F.lit(1), F.col("cut")), " "),
        "rest": F.array_join(F.slice(split, F.col("cut") + 1, F.col("k")), " "),
    })
    with_first = cuts.join(parts.withColumnsRenamed({"part": "first", "part_f": "l"}), ["lang", "first"])
    with_both = with_first.join(parts.withColumnsRenamed({"part": "rest", "part_f": "r"}), ["lang", "rest"])
    whole = with_both.join(n, "lang").withColumn("score", _score())
    best = whole.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    return best.select("lang", "phrase", "k", "a", "worst.l", "worst.r", "n", "worst.score")


def _score() -> Column:
    big = lambda c: F.col(c).cast("decimal(38,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), big("l") * big("r")).cast("long")


def not_inside(phrases: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase, k, a) but those that lie in a longer one as frequent.

    No phrase is more frequent than a part of it, so if a longer one is as frequent, every
    one between is, and it is enough to look one word further.
    """
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    head = F.expr("substring_index(phrase, ' ', k - 1)")
    longer = phrases.where("k > 2").select("lang", F.explode(F.array(head, tail)).alias("phrase"), "a")
    return phrases.join(longer.distinct(), ["lang", "phrase", "a"], "left_anti")


def first_of_each(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each lang, with their rank: first of salted sub-groups, then of these."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    inside = W.partitionBy("lang", "salt").orderBy(*order)
    few = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(inside)).where(F.col("place") <= most)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).drop("salt", "place")


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = 2000, longest: int = LONGEST, sample: int = SAMPLE, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each lang.

    A-Z are small letters; pieces end at ``BREAKS``, and words are what blanks part in them. A
    phrase has two to ``longest`` words of one piece and occurs at least ``support`` times,
    overlaps included; phrases inside a longer one as frequent are left out. Ranked by score
    and number, then phrase by bytes. A null lang is ``und``; null and empty texts have no
    words, and each of repeated rows counts. Columns other than doc_id, lang and text are not
    read; doc_id matters for the sample alone, on which no result depends. No rows give none.
    """
    docs = docs.select("doc_id", F.coalesce("lang", F.lit(UNNAMED)).alias("lang"), "text")
    found = frequent(docs, support, longest, sample, bits)
    candidates = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    kept = scored(found).join(not_inside(candidates).select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    return first_of_each(kept, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
