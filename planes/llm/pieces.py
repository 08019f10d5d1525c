"""SentencePiece unigram encoding and decoding.

Text is cut into the pieces whose log scores add up to most: Viterbi over the positions of a
text, with the pieces that begin at each found in a double-array trie of bytes. White space
is written as the marker U+2581, and a text gets one in front. Characters that are in no
piece fall back to byte pieces. Decoding joins the pieces, puts spaces for markers and
bytes for byte pieces.

No piece has a marker after another character, so the best path of a text is that of its
words one after another. Each distinct word of a piece of a task is solved once, many side
by side; its ids are then copied to all its places in one go.

The vocabulary file is a parameter. Where it has merge ranks instead of log scores, the log
scores are those of Zipf's law over the ranks.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from planes.llm.common import slices
from planes.llm.tokens import span_codes, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
# An unknown character scores that much less than the least piece.
UNKNOWN_PENALTY = 10.0
# Texts of up to SHORT bytes are solved side by side, TOGETHER at a time.
SHORT, TOGETHER = 48, 16384
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)


def read_model(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) by id, from a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = [
        BYTE if model.is_byte(i) else UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i) or model.is_unused(i) else NORMAL
        for i in range(model.get_piece_size())
    ]
    scores = [model.get_score(i) for i in range(len(kinds))]
    ranked = all(s == int(s) for s in scores)
    if ranked:  # 0, -1, -2, ... are ranks of merges; a piece out of the order has its place as rank
        first = next((i for i, k in enumerate(kinds) if k == NORMAL), 0)
        scores = [-log(i - first + 2) if kinds[i] == NORMAL else 0.0 for i in range(len(kinds))]
    return [(model.id_to_piece(i), s, k) for i, (s, k) in enumerate(zip(scores, kinds))]


class DoubleArray:
    """A trie of byte strings in two arrays: the child of node s by byte c is base[s] + c + 1
    if check of that place is s. value is the number of the string that ends in a node, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, number in keys:
            node = 0
            for c in key:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    value.append(-1)
            value[node] = number
        size = 2 * len(children) + 2048
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        self.value[0] = value[0]
        # The first place not used, so far in that no base is negative, and one past the last used.
        free, top = 257, 257
        todo = [(0, 0)]
        while todo:
            node, place = todo.pop()
            codes = sorted(children[node])
            if not codes:
                continue
            while used[free]:
                free += 1
            # One child fills a gap; several are looked for near the end, where there is room.
            base = (free if len(codes) == 1 else max(free, top - 1024)) - codes[0] - 1
            while any(used[base + c + 1] for c in codes):
                base += 1
            self.base[place] = base
            top = max(top, base + codes[-1] + 2)
            for c in codes:
                at = base + c + 1
                used[at] = 1
                self.check[at] = place
                self.value[at] = value[children[node][c]]
                todo.append((children[node][c], at))


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        # In texts a marker is a space until the ids are known; the trie has it so too.
        trie = DoubleArray([(p.replace(MARKER, " ").encode(), i) for i, (p, _, k) in enumerate(pieces) if k == NORMAL])
        self.lists = trie.base, trie.check, trie.value
        self.base, self.check, self.value = (np.array(x, np.int32) for x in self.lists)
        self.scores = [s for _, s, _ in pieces]
        self.score = np.array(self.scores)
        self.unknown_score = min((s for _, s, k in pieces if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        long = [p for p, _, k in pieces if k == NORMAL and len(p) > 1]
        inside = {c for p in long for c in p}
        self.breaks = np.array([b < 128 and b != 32 and chr(b) not in inside for b in range(256)])
        self.by_word = not any(MARKER in p.lstrip(MARKER) for p in long)
        said = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " \u2047 ".encode() if k == UNKNOWN else p.replace(MARKER, " ").encode() for p, _, k in pieces]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_at = np.concatenate(([0], np.cumsum([len(x) for x in said])))

    def best(self, word: bytes) -> list[int]:
        """The ids of the best path through one text, whatever its length."""
        base, check, value = self.lists
        n = len(word)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            one = at + (1 if word[at] < 0x80 else 2 if word[at] < 0xE0 else 3 if word[at] < 0xF0 else 4)
            single, node = False, 0
            for i in range(at, n):
                to = base[node] + word[i] + 1
                if check[to] != node:
                    break
                node = to
                if value[node] >= 0:
                    single = single or i + 1 == one
                    total = best[at] + self.scores[value[node]]
                    if total > best[i + 1]:
                        best[i + 1], back[i + 1] = total, (at, value[node])
            if not single and best[at] + self.unknown_score > best[one]:
                best[one], back[one] = best[at] + self.unknown_score, (at, -1)
            at = one
        ids, at = [], n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(word[start:at])]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1]

    def best_of(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best paths of many short texts side by side, as ``best`` finds each: all ids,
        and how many each text has; none for texts with a character that is no piece."""
        n, width = len(begin), int(size.max())
        text = np.zeros((n, width), np.uint8)
        spot = np.arange(width)
        inside = spot < size[:, None]
        text[inside] = data[(begin[:, None] + spot)[inside]]
        lead = inside & ((text & 0xC0) != 0x80)
        one = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full((n, width + 1), -1, np.int32)
        start = np.zeros((n, width + 1), np.int16)
        for at in range(width):
            first = np.flatnonzero(lead[:, at])
            rows, node, i = first, np.zeros(len(first), np.int32), at
            single = np.zeros(n, bool)
            while len(rows):
                to = self.base[node] + text[rows, i] + 1
                ok = self.check[to] == node
                rows, node = rows[ok], to[ok]
                v = self.value[node]
                hit = v >= 0
                r, v = rows[hit], v[hit]
                i += 1
                single[r[one[r, at] == i - at]] = True
                total = best[r, at] + self.score[v]
                more = total > best[r, i]
                r = r[more]
                best[r, i], piece[r, i], start[r, i] = total[more], v[more], at
                more = size[rows] > i
                rows, node = rows[more], node[more]
            r = first[~single[first]]
            if len(r):
                end = at + one[r, at]
                total = best[r, at] + self.unknown_score
                more = total > best[r, end]
                r, end = r[more], end[more]
                best[r, end], piece[r, end], start[r, end] = total[more], -1, at
        count, rows, end = np.zeros(n, np.int64), np.arange(n), size.astype(np.int64)
        steps = []
        while len(rows):
            got = piece[rows, end]
            count[rows[got < 0]] = -1
            rows, end, got = rows[got >= 0], end[got >= 0], got[got >= 0]
            steps.append((rows, count[rows], got))
            count[rows] += 1
            end = start[rows, end].astype(np.int64)
            rows, end = rows[end > 0], end[end > 0]
        count[count < 0] = 0
        whole = count > 0
        offset = np.cumsum(count) - count
        ids = np.zeros(count.sum(), np.int32)
        for rows, back, got in steps:
            ok = whole[rows] & (back >= 0)
            ids[(offset + count)[rows[ok]] - 1 - back[ok]] = got[ok]
        return ids, count

    def solve(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each has."""
        counts = np.zeros(len(begin), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        by_size = np.argsort(size, kind="stable")
        short = by_size[: np.searchsorted(size[by_size], SHORT, side="right")]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            ids, count = self.best_of(data, begin[some], size[some])
            counts[some] = count
            parts.append((some, ids))
        alone = np.flatnonzero((counts == 0) & (size > 0))
        if len(alone):
            solved = [self.best(data[a : a + n].tobytes()) for a, n in zip(begin[alone].tolist(), size[alone].tolist())]
            counts[alone] = [len(x) for x in solved]
            parts.append((alone, np.fromiter((i for x in solved for i in x), np.int32, counts[alone].sum())))
        offset = np.cumsum(counts) - counts
        flat = np.zeros(counts.sum(), np.int32)
        for k, (some, ids) in enumerate(parts):
            n = counts[some]
            if len(alone) and k < len(parts) - 1:
                n = np.where(np.isin(some, alone), 0, n)
            flat[np.repeat(offset[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return flat, counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where each row's begin. Texts come with their first marker as a space."""
        data, at = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        space, cut = data == 32, self.breaks[data]
        start = cut.copy()
        start[1:] |= cut[:-1]
        if self.by_word:
            start[1:] |= space[1:] & ~space[:-1]
        start[at[:-1][np.diff(at) > 0]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        _, first, word = np.unique(span_codes(data, begin, end), return_index=True, return_inverse=True)
        flat, sizes = self.solve(data, begin[first], (end - begin)[first])
        n, offset = sizes[word], (np.cumsum(sizes) - sizes)[word]
        ends = np.cumsum(n)
        ids = flat[np.repeat(offset - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(begin, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The text of each row of ids; bytes that are no UTF-8 become U+FFFD."""
        n = (self.said_at[1:] - self.said_at[:-1])[ids]
        ends = np.cumsum(n) if len(n) else np.zeros(0, np.int64)
        flat = self.said[np.repeat(self.said_at[ids] - (ends - n), n) + np.arange(n.sum())].tobytes()
        edges = np.concatenate(([0], ends))[at].tolist()
        rows = [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
        return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in rows]


_models: dict[int, Unigram] = {}


def model_of(shared) -> Unigram:
    """The model of a broadcast vocabulary, built once in each Python worker."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared.value)
    if key not in _models:
        _models.clear()
        _models[key] = Unigram(shared.value)
    return _models[key]


def broadcast_model(spark: SparkSession, path: str = MODEL):
    """The vocabulary for all executors; its size is that of the file, whatever the input."""
    return spark.sparkContext.broadcast(read_model(path))


def _added(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema if f.name != name] + [StructField(name, kind)])


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column of piece ids, in place of one of that name.

    Null and empty texts have no ids. All rows and other columns are kept as they are; an
    empty table gives no rows.
    """
    shared = broadcast_model(docs.sparkSession, path)
    schema = _added(docs, ids_col, ArrayType(IntegerType()))
    marked = "__marked"
    while marked in docs.columns:
        marked += "_"

    def run(batches):
        model = model_of(shared)
        for batch in slices(batches, marked):
            ids, at = model.encode(batch.column(marked))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), lists], schema.names)

    text = F.col(text_col)
    with_marker = docs.withColumn(marked, F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise(F.lit("")))
    return with_marker.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with a column of decoded texts, in place of one of that name; null ids give an empty text.

    A text comes back as it was; a U+2581 in it was encoded by its bytes, not as white space.
    """
    shared = broadcast_model(rows.sparkSession, path)
    schema = _added(rows, text_col, StringType())

    def run(batches):
        model = model_of(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lists = part.column(ids_col)
                at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
                texts = model.decode(lists.flatten().to_numpy(), at)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema.fields[:-1]), pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
