"""Benchmark passages in documents, found by their templates.

Words become template tokens: numbers, names and units of measure are replaced by
placeholders of their type, other words are lower-cased and lose the punctuation around
them. Template windows of the documents are hash-joined with those of the benchmark. Where
windows of an item meet a document on one alignment, the aligned words are compared as text
and the values in the slots must map one to one, the same value always to the same value; so
a question with other numbers and names is found, and text that merely has slots in the same
places is not. A capitalised word may be a name or begin a sentence, so windows are made with
it as a name and as a plain word, and the check of the slots decides. Windows with too few
plain words, and items shorter than a window, are met by their words as they are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planes.llm.common import slices, stage
from planes.llm.tokens import _BASE, Words, mix, signed, span_codes, words

WINDOW = 8
# Of a window's tokens at least this many must be plain words.
LITERALS = 5
# An item is in a document when this part of its windows is, in percent.
COVER = 50
# So many words in a row, the same as in the item, make a find whatever part of the item they are.
VERBATIM = 13
# Items of fewer words are not searched for: any text has their words.
SHORTEST = 3
# Benchmarks of up to so many bytes of text are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20
# Units of measure and of currency.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds lb lbs "
    "ounce ounces oz ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes hour "
    "hours day days week weeks month months year years percent % degree degrees cent cents dollar dollars euro euros "
    "mph kph kmh km/h m/s hz khz mhz ghz kb mb gb tb watt watts w kw volt volts v"
).split()
PLAIN, NUMBER, NAME, UNIT = (np.uint64(x) for x in (0, 0xA11CE00000000001, 0xA11CE00000000002, 0xA11CE00000000003))
EXACT = np.uint64(0xA11CE00000000005)

_DIGIT, _UPPER, _LOWER, _PUNCT, _STOP = (np.zeros(256, bool) for _ in range(5))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LOWER[97:123] = True
_LOWER[0x80:] = True
_PUNCT[[ord(c) for c in "\"'()[]{}<>.,;:!?*#$%&|-_`~"]] = True
_STOP[[ord(c) for c in ".!?:"]] = True


def _codes_of(texts: list[str]) -> np.ndarray:
    return words(pa.array([" ".join(texts)]), lower=True).codes


UNIT_CODES = np.sort(_codes_of(UNITS))


@dataclass
class Template:
    codes: np.ndarray  # a hash of each word's template token, capitalised words as plain ones
    exact: np.ndarray  # a hash of each word
    kinds: np.ndarray  # NUMBER, NAME (any capitalised word), UNIT or PLAIN
    opens: np.ndarray  # whether a sentence, line or text begins with the word

    def named(self) -> np.ndarray:
        """Whether a word is a slot whatever it is taken for."""
        return (self.kinds != PLAIN) & ~(self.opens & (self.kinds == NAME))


def template(w: Words) -> Template:
    """The template token of each word."""
    begin, end = w.begin.copy(), w.end.copy()
    if not len(begin):
        return Template(w.codes, w.codes, w.codes, np.zeros(0, bool))
    data = w.data
    for _ in range(3):  # a few signs around a word, never the whole word
        begin += (end - begin > 1) & _PUNCT[data[begin]]
        end -= (end - begin > 1) & _PUNCT[data[end - 1]]
    codes = span_codes(data, begin, end, lower=True)
    first = data[begin]
    second = data[np.minimum(begin + 1, len(data) - 1)]
    number = _DIGIT[first]
    # A capital followed by a small letter; where no sentence or line begins, it is a name.
    capital = (_UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))) & _LOWER[second] & (end - begin > 1)
    opens = np.ones(len(begin), bool)
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    opens[1:] = _STOP[data[w.end[:-1] - 1]] | (breaks[w.begin[1:]] > breaks[w.end[:-1]])
    opens[w.first[:-1][np.diff(w.first) > 0]] = True
    unit = np.zeros(len(begin), bool)
    unit[1:] = number[:-1]
    spot = np.minimum(np.searchsorted(UNIT_CODES, codes), len(UNIT_CODES) - 1)
    unit &= UNIT_CODES[spot] == codes
    exact = codes.copy()
    codes[number] = NUMBER
    codes[unit] = UNIT
    kinds = np.select([unit, number, capital], [UNIT, NUMBER, NAME], PLAIN)
    return Template(codes, exact, kinds, opens)


def _spans(what: np.ndarray, window: int) -> np.ndarray:
    """How many of ``what`` are in each window."""
    sums = np.concatenate(([0], np.cumsum(what)))
    return sums[window:] - sums[:-window]


def _totals(codes: np.ndarray, window: int) -> np.ndarray:
    total = np.zeros(len(codes) - window + 1, np.uint64)
    for j in range(window):
        total = total * _BASE + codes[j : len(total) + j]
    return total


def exact_windows(w: Words, t: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``size`` words: first word, hash of the words."""
    if len(t.codes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(len(t.codes) - size + 1)
    ok = starts + size <= w.row_end[: len(starts)]
    return starts[ok], mix(_totals(t.exact, size)[ok] + np.uint64(size) * EXACT)


def template_windows(w: Words, t: Template, window: int, literals: int, short: Iterable[int] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First word and hash of the windows. A window comes once for each way to take its
    capitalised words for names or plain words that leaves enough plain words; one with too
    few in any way comes with its words as they are, and so do runs of ``short`` words."""
    for size in short:
        yield exact_windows(w, t, size)
    if len(t.codes) < window:
        return
    starts = np.arange(len(t.codes) - window + 1)
    totals = _totals(t.codes, window)
    spare = _spans((t.kinds == PLAIN) | (t.kinds == NAME), window) - literals
    ok = (starts + window <= w.row_end[: len(starts)]) & (spare >= 0)
    yield starts[ok], mix(totals[ok] + np.uint64(window))
    poor, hashes = exact_windows(w, t, window)
    few = spare[poor] < 0
    yield poor[few], hashes[few]
    name = t.kinds == NAME
    at = np.flatnonzero(ok & (spare > 0) & (_spans(name, window) > 0))
    where = np.zeros(len(at), np.uint64)
    for j in range(window):
        where |= name[at + j].astype(np.uint64) << np.uint64(j)
    spare = np.minimum(spare[at], np.bitwise_count(where))
    power = [np.uint64(pow(int(_BASE), window - 1 - j, 1 << 64)) for j in range(window)]
    for k in range(1, window - literals + 1):
        left = spare >= k
        at, where, spare = at[left], where[left], spare[left]
        for places in combinations(range(window), k):
            mask = np.uint64(sum(1 << j for j in places))
            own = at[(where & mask) == mask]
            if len(own):
                hashes = totals[own]
                for j in places:
                    hashes = hashes + (NAME - t.codes[own + j]) * power[j]
                yield own, mix(hashes + np.uint64(window))


def item_windows(w: Words, t: Template, window: int, literals: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First word and hash of the windows of items; an item shorter than a window is one."""
    yield np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = np.diff(w.first)
    for n in range(SHORTEST, window):
        starts, hashes = exact_windows(w, t, n)
        whole = size[w.row[starts]] == n
        yield starts[whole], hashes[whole]
    yield from template_windows(w, t, window, literals)


class Index:
    """A benchmark's template windows, and its items' words for the check."""

    def __init__(self, items: list[tuple[int, str]], window: int, literals: int):
        self.window, self.literals = window, literals
        column = pa.array([t for _, t in items], pa.string())
        w = words(column)
        t = template(w)
        spans = list(zip(w.first[:-1].tolist(), w.first[1:].tolist()))
        self.items = {i: (_strings(w, a, b), t.kinds[a:b].tolist(), t.named()[a:b].tolist()) for (i, _), (a, b) in zip(items, spans)}
        self.size = {i: min(window, b - a) for (i, _), (a, b) in zip(items, spans)}
        # The windows that copies with other values have too: with enough plain words when what begins a sentence is one.
        self.rich = {i: {s for s in range(len(x[0]) - window + 1) if sum(x[2][s : s + window]) <= window - literals} for i, x in self.items.items()}
        self.windows = {i: len(x[0]) - self.size[i] + 1 if len(x[0]) >= SHORTEST else 0 for i, x in self.items.items()}
        self.short = sorted({n for n in self.size.values() if SHORTEST <= n < window})
        starts, hashes = (np.concatenate(x) for x in zip(*item_windows(w, t, window, literals)))
        row = w.row[starts] if len(starts) else starts
        order = np.argsort(hashes, kind="stable")
        self.codes = hashes[order]
        self.item = np.array([i for i, _ in items], np.int64)[row[order]] if len(order) else np.zeros(0, np.int64)
        self.at = (starts - w.first[row])[order] if len(order) else starts
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.codes >> np.uint64(44)).astype(np.int64)] = True

    def may_find(self, item: int, got: int, cover: int) -> bool:
        """Whether so many of an item's windows can make a find."""
        return got * 100 >= cover * self.need(item) or got > max(0, VERBATIM - self.window)

    def need(self, item: int) -> int:
        return len(self.rich[item]) or self.windows[item]

    def finds(self, item: int, covered: set[int], run: int, cover: int) -> bool:
        """Whether windows of an item, of them ``run`` in a row the same word for word, are the
        wanted part of all or of those that other values leave the same, or a long run."""
        rich = self.rich[item]
        if not covered:
            return False
        return (
            len(covered) * 100 >= cover * self.windows[item] or bool(rich) and len(covered & rich) * 100 >= cover * len(rich)
            or run > max(0, VERBATIM - self.window)
        )

    def meets(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places: in ``hashes``, and of this index, with equal hashes."""
        near = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.codes, hashes[near], side=s) for s in ("left", "right"))
        n = hi - lo
        return np.repeat(near, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _strings(w: Words, a: int, b: int) -> list[str]:
    if b <= a:
        return []
    raw = w.data[w.begin[a] : w.end[b - 1]].tobytes()
    return [x.decode(errors="replace") for x in raw.split()]


def _bare(word: str) -> str:
    return word.strip("\"'()[]{}<>.,;:!?*#$%&|-_`~").lower() or word


def consistent(item: tuple[list[str], list, list], doc_words: list[str], doc_kinds: list, shift: int, window: int, starts: list[int]):
    """Of the windows ``starts`` of an item that lie ``shift`` words further on in the
    document, those whose words agree and whose slots map one to one; the slots; and how many windows
    in a row are the same word for word.

    Where values contradict each other, those win that come most often, then equal ones,
    then the first. Windows that are the same word for word are good in any case."""
    theirs, kinds, named = item
    wrong: set[int] = set()
    differs: set[int] = set()
    slot: dict[int, tuple] = {}
    for k in sorted({k for s in starts for k in range(s, s + window)}):
        a, b = _bare(theirs[k]), _bare(doc_words[k + shift])
        mine, other = kinds[k], doc_kinds[k + shift]
        if a != b:
            differs.add(k)
        if mine == other and mine:
            slot[k] = (mine, a, b)
        elif a != b:
            wrong.add(k)
        elif mine or other:  # a name that is written small in one of the two
            slot[k] = (mine or other, a, b)
    count = Counter(slot.values())
    there: dict[tuple, tuple] = {}
    back: dict[tuple, tuple] = {}
    for kind, a, b in sorted(count, key=lambda x: (-count[x], x[1] != x[2])):
        if (kind, a) not in there and (kind, b) not in back:
            there[kind, a], back[kind, b] = b, a
    wrong |= {k for k, (kind, a, b) in slot.items() if there.get((kind, a)) != b}
    inside = lambda s, what: not what.isdisjoint(range(s, s + window))
    same = [s for s in starts if not inside(s, differs)]
    good = sorted({*same, *(s for s in starts if not inside(s, wrong))})
    run = longest = 0
    for n, s in enumerate(same):
        run = run + 1 if n and s == same[n - 1] + 1 else 1
        longest = max(longest, run)
    pairs = {(a, b) for k, (_, a, b) in slot.items() if k not in wrong and (named[k] or a != b)}
    return good, sorted(pairs), longest


def found_in(index: Index, ids: list, w: Words, t: Template, cover: int) -> dict[str, list]:
    by: dict[tuple, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    rows = w.row
    for starts, hashes in template_windows(w, t, index.window, index.literals, index.short):
        here, there = index.meets(hashes)
        if not len(here):
            continue
        row = rows[starts[here]]
        local = starts[here] - w.first[row]
        for r, i, p, q in zip(row.tolist(), index.item[there].tolist(), local.tolist(), index.at[there].tolist()):
            by[r, i][p - q].add(q)
    out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "n_windows", "item_windows", "first_word", "end_word", "kind", "slots")}
    for (r, i), shifts in sorted(by.items()):
        if not index.may_find(i, len({q for x in shifts.values() for q in x}), cover):
            continue
        size, longest = index.size[i], 0
        doc_words, doc_kinds = _strings(w, w.first[r], w.first[r + 1]), t.kinds[w.first[r] : w.first[r + 1]].tolist()
        covered: set[int] = set()
        slots, spans = set(), []
        # Each alignment is a copy or a part of one; parts on several alignments add up.
        for shift, at in sorted(shifts.items()):
            good, pairs, run = consistent(index.items[i], doc_words, doc_kinds, shift, size, sorted(at))
            longest = max(longest, run)
            if good:
                covered.update(good)
                slots.update(pairs)
                spans.append((len(good), min(good) + shift, max(good) + shift + size))
        if not index.finds(i, covered, longest, cover):
            continue
        _, first, end = max(spans, key=lambda x: (x[0], -x[1]))
        same = all(a == b for a, b in slots)
        for k, v in zip(out, (ids[r], i, len(covered), index.windows[i], int(first), int(end), "verbatim" if same else "reparameterised",
                              [{"item_value": a, "doc_value": b} for a, b in sorted(slots)])):
            out[k].append(v)
    return out


SCHEMA = "doc_id long, item_id long, n_windows long, item_windows long, first_word long, end_word long, kind string, slots array<struct<item_value:string,doc_value:string>>"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_windows", "item_windows", "first_word", "end_word")] + [
    ("kind", pa.string()), ("slots", pa.list_(pa.struct([("item_value", pa.string()), ("doc_value", pa.string())])))])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, cover: int = COVER,
    broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per document and benchmark item found in it: doc_id, item_id, n_windows (of the
    item's windows, those found), item_windows, first_word and end_word of the longest find,
    kind (verbatim or reparameterised), slots (values of the item and of the document).

    An item is found when ``cover`` percent of its windows are there, or of those with up to
    window - literals numbers, names and units, or VERBATIM words in a row. An item shorter
    than a window is one window of its own words; with under SHORTEST it is not searched for.
    Texts that share an item_id, also a null one, are items of their own with that id; rows of the
    benchmark repeated in id and text are one. Null and empty texts hold nothing. Rows repeated, also with a null id, are each reported.
    An empty table on either side gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text <> ''").distinct()
    # Texts are searched for under keys of their own: several may share an id, and it may be null.
    bench = bench.select(F.xxhash64("item_id", "text").alias("key"), "item_id", "text")
    keyed, names = bench.select(F.col("key").alias("item_id"), "text"), bench.select("key", F.col("item_id").alias("name"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    if size <= broadcast_bytes:
        found, names = _by_broadcast(docs, keyed, window, literals, cover), F.broadcast(names)  # no more rows than bytes
    else:
        found = _by_shuffle(docs, keyed, window, literals, cover)
    named = found.withColumnRenamed("item_id", "key").join(names, "key").withColumnRenamed("name", "item_id")
    return named.select(*_ARROW.names)


def _by_broadcast(docs: DataFrame, bench: DataFrame, window: int, literals: int, cover: int) -> DataFrame:
    items = docs.sparkSession.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in bench.collect()))

    def run(batches):
        index = Index(items.value, window, literals)
        for batch in slices(batches, "text"):
            w = words(batch.column("text"))
            yield pa.RecordBatch.from_pydict(found_in(index, batch.column("doc_id").to_pylist(), w, template(w), cover), _ARROW)

    return docs.mapInArrow(run, SCHEMA)


def window_table(rows: DataFrame, key: str, windows: Callable[[Words, Template], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """code and ``key`` of the distinct windows of each row, and n, at how many places it has them."""

    def run(batches):
        for batch in slices(batches, "text"):
            w = words(batch.column("text"))
            of = w.row
            for starts, hashes in windows(w, template(w)):
                yield pa.RecordBatch.from_arrays([signed(hashes), batch.column(key).take(pa.array(of[starts] if len(starts) else starts))], ["code", key])

    return rows.mapInArrow(run, f"code long, {key} long").groupBy("code", key).agg(F.count(F.lit(1)).alias("n"))


def needs(bench: DataFrame, window: int, literals: int) -> DataFrame:
    """item_id, need, the least number of windows that can make a part of an item, and short,
    the words of an item that is shorter than a window."""

    def run(batches):
        for batch in slices(batches, "text"):
            items = list(zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()))
            index = Index(items, window, literals)
            rows = [(i, index.need(i), index.size[i] if index.size[i] in index.short else None) for i, _ in items]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["item_id", "need", "short"])

    return bench.mapInArrow(run, "item_id long, need long, short long")


def _by_shuffle(docs: DataFrame, bench: DataFrame, window: int, literals: int, cover: int) -> DataFrame:
    """For benchmarks of any size: windows meet by a shuffle join, then each document is
    checked against the items that enough of its windows have."""
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    theirs = stage(window_table(bench, "item_id", lambda w, t: item_windows(w, t, window, literals)), "windows")
    need = stage(needs(bench, window, literals), "needs")
    short = sorted(r["short"] for r in need.where("short is not null").select("short").distinct().collect())
    # A window counts as often as it comes in the item, as it does where the benchmark is
    # broadcast; here one met in several ways counts more often, which lets more pairs be checked.
    met = window_table(docs, "row", lambda w, t: template_windows(w, t, window, literals, short)).drop("n").join(theirs, "code").groupBy("row", "item_id").agg(F.sum("n").alias("got"))
    enough = (F.col("got") * 100 >= F.col("need") * cover) | (F.col("got") > max(0, VERBATIM - window))
    pairs = stage(met.join(need, "item_id").where(enough).select("row", "item_id"), "pairs")

    def run(batches):
        for batch in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in _ARROW.names}
            for i, doc, text, theirs in zip(*(batch.column(c).to_pylist() for c in ("item_id", "doc_id", "text", "item_text"))):
                w = words(pa.array([text], pa.string()))
                for k, v in found_in(Index([(i, theirs)], window, literals), [doc], w, template(w), cover).items():
                    out[k] += v
            yield pa.RecordBatch.from_pydict(out, _ARROW)

    asked = pairs.join(bench.withColumnRenamed("text", "item_text"), "item_id")
    return docs.join(asked, "row").mapInArrow(run, SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, all columns kept.

    Rows go by their id and text: one with a null id goes if its text holds an item, and a
    clean one that shares its id with another stays. Of repeated rows all go or all stay."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    # What is searched are the rows under a key of their own, and not under their ids.
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), digest).alias("doc_id"), "text")
    found = stage(contaminated(keyed, benchmark).select(F.col("doc_id").alias("__found")).distinct(), "found")
    return docs.join(found, F.xxhash64(docs["doc_id"].cast("long"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == F.col("__found"), "left_anti")
