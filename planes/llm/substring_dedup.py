"""Repeated passages by windows that are grouped by prefixes.

A repeat of ``min_words`` words is a node of that depth or more in the suffix tree of all
documents. Nodes of other depths and maximal repeats are not needed for what is cut, so no tree
is built: what its nodes of that depth say, which windows come again and where first, is found
group by group with a dictionary of windows.

Which windows. Of the prefixes of PREFIX words that begin inside a window of min_words
words, the one with the least hash is the window's anchor. Equal windows have equal anchors
at the same place, so a window can only be repeated if its anchor is, and an anchor found in
one document only takes its windows out of the work before any text is moved.

Groups. Windows are dealt out by prefixes of variable length: by the anchor's PREFIX words
while no more than GROUP documents have it, else by all min_words words. A group of short
prefixes so holds a bounded number of windows; one of whole windows has a single one.

In a group. Windows are put into its dictionary in the order of their documents, and one that
an earlier document has put there is repeated. Words are compared as text, not by hashes.

Passages that very many documents share are settled first inside each piece of a task,
of which one row per passage goes on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from planes.llm.common import slices, stage
from planes.llm.tokens import Words, mix, signed, window_codes, words

PREFIX = 8
GROUP = 50_000


def anchors_of(w: Words, min_words: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all prefixes, the first word of every window, and each window's anchor."""
    codes = window_codes(w.codes, prefix)
    starts = np.arange(max(0, len(w.codes) - min_words + 1))
    if len(starts):
        starts = starts[starts + min_words <= w.row_end[: len(starts)]]
    at = starts.copy()
    least = codes[starts]
    for j in range(1, min_words - prefix + 1):
        other = codes[starts + j]
        less = other < least
        at[less] = starts[less] + j
        least[less] = other[less]
    return codes, starts, at


def anchor_table(docs: DataFrame, min_words: int, prefix: int) -> DataFrame:
    """A row per document and distinct anchor. The rows of an anchor that occurs in several
    documents of one piece are known to be repeated; one of them goes on for all (known false)."""

    def run(batches):
        for batch in slices(batches, "text"):
            w = words(batch.column("text"))
            ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            codes, _, at = anchors_of(w, min_words, prefix)
            at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
            row, code = w.row[at], codes[at]
            order = np.lexsort((at, ids[row], code))
            at, row, code = at[order], row[order], code[order]
            if len(at):
                new = np.concatenate(([True], (code[1:] != code[:-1]) | (ids[row[1:]] != ids[row[:-1]]) | (tags[row[1:]] != tags[row[:-1]])))
                at, row, code = at[new], row[new], code[new]
            first = np.concatenate(([True], code[1:] != code[:-1])) if len(at) else np.zeros(0, bool)
            begins = np.flatnonzero(first)
            ends = np.append(begins[1:], len(at))
            several = ids[row[ends - 1]] > ids[row[begins]] if len(at) else np.zeros(0, bool)
            n = np.where(several, ends - begins, 1)
            known = ~first & np.repeat(several, ends - begins)
            route = np.where(known, mix(code + at.astype(np.uint64) * np.uint64(2) + np.uint64(1)), code)
            # Narrow rows: the code is named where it is not the route, place and count share a number.
            place = (at - w.first[row]).astype(np.int64) << 24 | np.where(first, np.repeat(n, ends - begins), 0)
            yield pa.RecordBatch.from_arrays(
                [signed(route), pa.array(code.view(np.int64), mask=~known), pa.array(ids[row]), pa.array(tags[row], mask=tags[row] == 0), pa.array(place)],
                ["route", "known", "doc_id", "tag", "place"],
            )

    return docs.mapInArrow(run, "route long, known long, doc_id long, tag long, place long")


def repeated_anchors(docs: DataFrame, min_words: int, prefix: int, group: int) -> DataFrame:
    """doc_id, tag, anchors (place, and whether over ``group`` documents have it)."""
    one = W.partitionBy("route")
    docs_here = F.col("place").bitwiseAND(0xFFFFFF)
    met = anchor_table(docs, min_words, prefix).select(
        "route", "known", "doc_id", "tag", "place",
        F.sum(docs_here).over(one).alias("docs"),
        F.max(docs_here).over(one).alias("most"),
        F.min("doc_id").over(one).alias("least_id"),
        F.max("doc_id").over(one).alias("most_id"),
    ).where("known is not null or most > 1 or least_id < most_id").select(
        F.coalesce("known", "route").alias("code"), "doc_id", F.coalesce("tag", F.lit(0)).alias("tag"),
        F.shiftright("place", 24).cast("int").alias("at"), F.col("known").isNotNull().alias("known"), "docs",
    )
    met = stage(met, "anchors")
    heavy = met.where((~F.col("known")) & (F.col("docs") > group)).select("code", F.lit(True).alias("heavy")).distinct()
    marked = met.join(heavy, "code", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    return marked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "heavy")).alias("anchors"))


def suffix_table(docs: DataFrame, min_words: int, prefix: int) -> DataFrame:
    """Suffixes of documents with their repeated anchors: route, doc_id, tag, start, n, words.

    A row stands for n windows in a row, from word ``start`` on. Rows without words are
    settled: their windows are in an earlier document of the same piece.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            w = words(batch.column("text"))
            ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            codes, starts, at = anchors_of(w, min_words, prefix)
            flag = np.zeros(len(w.codes) + 1, np.int8)  # of each word: its prefix is repeated, 2 when by very many
            lists = batch.column("anchors")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            place = np.repeat(w.first[:-1], sizes) + flat.field("at").to_numpy()
            many = flat.field("heavy").to_numpy(zero_copy_only=False)
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            # One place per document and anchor was kept; the same prefix elsewhere in it counts too.
            if len(place):
                wanted = np.sort(mix(codes[place] + row_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                heavy = np.unique(codes[place[many]])
                seen, inverse = np.unique(at, return_inverse=True)
                named = mix(codes[seen] + w.row[seen].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                spot = np.minimum(np.searchsorted(wanted, named), len(wanted) - 1)
                state = (wanted[spot] == named).astype(np.int8)
                state[np.isin(codes[seen], heavy) & (state == 1)] = 2
                flag = state[inverse]
            else:
                flag = np.zeros(len(at), np.int8)
            s, a, f = starts[flag > 0], at[flag > 0], flag[flag > 0]
            new = np.ones(len(s), bool)
            new[1:] = (a[1:] != a[:-1]) | (f[1:] == 2)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(s)))
            first_word, anchor, state = s[first], a[first], f[first]
            whole = window_codes(w.codes, min_words)
            route = np.where(state == 2, whole[first_word] if len(first_word) else np.zeros(0, np.uint64), codes[anchor])
            lo, hi = w.begin[first_word], w.end[first_word + n + min_words - 2]
            row = w.row[first_word]
            order = np.lexsort((first_word, ids[row])).tolist()
            made: dict[bytes, int] = {}
            raw = w.data.tobytes()
            text: list[bytes | None] = [None] * len(order)
            for i in order:
                x = b" ".join(raw[lo[i] : hi[i]].split())
                r = int(ids[row[i]])
                if made.setdefault(x, r) == r:
                    text[i] = x
            settled = np.array([x is None for x in text], bool)
            route = np.where(settled, mix(lo.astype(np.uint64) + route), route)
            yield pa.RecordBatch.from_arrays(
                [signed(route), pa.array(ids[row]), pa.array(tags[row]), pa.array((first_word - w.first[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(text, pa.binary())],
                ["route", "doc_id", "tag", "start", "n", "words"],
            )

    return docs.mapInArrow(run, "route long, doc_id long, tag long, start int, n int, words binary")


def window_repeats(suffixes: DataFrame, min_words: int) -> DataFrame:
    """doc_id, tag, start, n: the runs of windows that an earlier document has.

    Rows come sorted by group and document, so a window's first document is known when it is
    first met, and only the windows of one group are held.
    """

    def run(batches):
        group, first = None, {}
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for route, doc, tag, start, n, text in zip(*(batch.column(c).to_pylist() for c in ("route", "doc_id", "tag", "start", "n", "words"))):
                if text is None:
                    found.append((doc, tag, start, n))
                    continue
                if route != group:
                    group, first = route, {}
                path = text.split(b" ")
                begun = None
                for k in range(n):
                    window = text if n == 1 else b" ".join(path[k : k + min_words])
                    old = first.setdefault(window, doc) < doc
                    if old and begun is None:
                        begun = k
                    elif not old and begun is not None:
                        found.append((doc, tag, start + begun, k - begun))
                        begun = None
                if begun is not None:
                    found.append((doc, tag, start + begun, n - begun))
            doc, tag, start, n = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                ["doc_id", "tag", "start", "n"],
            )

    dealt = suffixes.repartition("route").sortWithinPartitions("route", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, tag long, start int, n int")


def repeats(docs: DataFrame, min_words: int = 13, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, tag, runs (start, n): the repeated windows of each document that has any.
    ``docs`` has doc_id, tag and text, no null among the first two."""
    prefix = min(prefix, min_words)
    anchors = stage(repeated_anchors(docs, min_words, prefix, group), "anchors")
    suffixes = suffix_table(docs.join(anchors, ["doc_id", "tag"]), min_words, prefix)
    found = stage(window_repeats(suffixes, min_words), "repeats")
    return found.distinct().groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and tag, which tells texts apart that share an id; 0 where ids are unique."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return docs.withColumn("tag", F.coalesce(F.xxhash64("text"), F.lit(0)) if twice else F.lit(0).cast("long"))


def cut(docs: DataFrame, min_words: int = 13, prefix: int = PREFIX, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), removed
    (spans of words, first and one past the last) of every row.

    A word goes if one of the windows of min_words words that cover it also starts in a
    document with a smaller id, judged on the texts as they came. Null and empty texts have
    no words. A row with a null id is compared with none and stays whole; rows that share an
    id take nothing from each other. An empty table gives no rows. Other columns are not read.
    """
    docs = tagged(docs, id_col, text_col)
    runs = repeats(docs.where("doc_id is not null"), min_words, prefix, group)

    def run(batches):
        for batch in slices(batches, "text"):
            w = words(batch.column("text"))
            raw = w.data.tobytes()
            total, gone, kept, spans = [], [], [], []
            for a, b, found in zip(w.first[:-1].tolist(), w.first[1:].tolist(), batch.column("runs").to_pylist()):
                if not found:
                    total.append(b - a), gone.append(0), spans.append([])
                    kept.append(b" ".join(raw[w.begin[a] : w.end[b - 1]].split()).decode() if b > a else "")
                    continue
                step = np.zeros(b - a + 1, np.int64)
                starts = np.array([x["start"] for x in found])
                np.add.at(step, starts, 1)
                np.add.at(step, starts + np.array([x["n"] for x in found]) + min_words - 1, -1)
                out = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])))).reshape(-1, 2)
                total.append(b - a), gone.append(int(out.sum())), spans.append([{"first": int(x), "end": int(y)} for x, y in edge])
                edges = [0, *edge.ravel().tolist(), b - a]
                kept.append(b" ".join(y for x in range(0, len(edges), 2) if edges[x + 1] > edges[x] for y in raw[w.begin[a + edges[x]] : w.end[a + edges[x + 1] - 1]].split()).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", "n_removed", "kept", "removed"],
            )

    with_runs = docs.join(runs, ["doc_id", "tag"], "left").select("doc_id", "text", "runs")
    return with_runs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:int,end:int>>")
