"""Exact dedup, n-gram join and substring dedup against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planes.llm import blocks, exact_dedup, line_dedup, ngram_join, substring_dedup
from planes.llm.components import components
from planes.llm.filters import filter_of_hashes
from planes.llm.tokens import mix
from tests.llm.helpers import WORD, corpus, docs_of, union

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    links = []
    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                links.append((a, b))
    label = union(ids, links)
    return sorted(((i, len(s), label.get(i)) for i, many in sets.items() for s in many), key=str), len(links)


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2), (2, 70, 3)])
def test_ngram_join_equals_all_pairs(spark, n, percent, seed):
    rows = corpus(seed, copies=90)
    want, links = plain_groups(rows, n, percent)
    got = ngram_join.jaccard_groups(docs_of(spark, rows), n, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert links > 20


def test_ngram_join_of_a_family_with_many_strangers(spark, monkeypatch):
    """One base with copies at every distance, and a second family inside it, in groups of all sizes."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        t = list(base)
        if i % 2:
            t[10:40] = [f"v{k}" for k in range(30)]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(t)))
    want, _ = plain_groups(rows, 3, 90)
    got = ngram_join.jaccard_groups(docs_of(spark, rows), 3, 90)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_differences_from_hubs_are_moved_in_slices(spark, monkeypatch):
    """No slice holds all differences, and all links are found."""
    monkeypatch.setattr(ngram_join, "DIFFERENCES", 200)
    totals = []

    def watched(compared, labels, percent, keys=ngram_join.strangers_and_kin):
        totals.append(compared.selectExpr("coalesce(sum(size(differ)), 0)").first()[0])
        return keys(compared, labels, percent)

    monkeypatch.setattr(ngram_join, "strangers_and_kin", watched)
    rows = corpus(9, copies=90)
    want, links = plain_groups(rows, 5, 80)
    got = ngram_join.jaccard_groups(docs_of(spark, rows), 5, 80)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert links > 20
    assert sum(totals) > 600 and max(totals) < sum(totals) * 2 // 3


def test_strangers_of_a_hub_do_not_meet_in_all_pairs(spark, monkeypatch):
    """Members of one group that differ from its hub in the same shingles, and from each other
    in too many: few pairs are made, and the links among them are found."""
    pairs = []

    def watched(df, name, stage=ngram_join.stage):
        held = stage(df, name)
        if name == "likely" or "rep_a" in df.columns:
            pairs.append(held.count())
        return held

    monkeypatch.setattr(ngram_join, "stage", watched)
    base = [f"w{i}" for i in range(160)]
    texts = [base] + [base[:60] + [f"x{i}y{k}" for k in range(20)] + base[100:] for i in range(60)]
    texts += [[f"typo{i}" if k == 70 else w for k, w in enumerate(texts[i])] for i in range(1, 7)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want, links = plain_groups(rows, 5, 80)
    got = ngram_join.jaccard_groups(docs_of(spark, rows), 5, 80)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert links == 6
    assert pairs and sum(pairs) <= len(rows)


@pytest.mark.parametrize("n,percent", [(5, 80), (3, 90)])
def test_equal_sets_are_cut_for_one_document(spark, monkeypatch, n, percent):
    """However many documents have a set, the fragments of one of them are all that is moved."""
    ids = set()

    def watched(df, name, stage=ngram_join.stage):
        held = stage(df, name)
        if name in ("met", "shared"):
            ids.update(r[0] for r in held.select("rep" if "rep" in held.columns else "doc_id").collect())
        return held

    monkeypatch.setattr(ngram_join, "stage", watched)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base if i % 4 else [*base, "end"])) for i in range(1, 61)]
    got = {r[0]: r[2] for r in ngram_join.jaccard_groups(docs_of(spark, rows).repartition(6), n, percent).collect()}
    assert got == dict.fromkeys(range(1, 61), 1)
    assert ids == {1, 4}


def test_differences_of_one_member_alone_are_not_listed(spark):
    """Of a group's differences those that several members share are moved as rows, in chosen groups alone."""
    rows = [(1, 10, [5, 6, 7]), (2, 10, [6, 8]), (3, 10, [7, 6]), (4, 20, [5, 6]), (5, 20, [5]), (6, 30, [1, 2]), (7, 30, [1, 2]), (8, 10, [])]
    compared = spark.createDataFrame(rows, "pair long, group long, differ array<long>").withColumn("group", F.xxhash64("group")).repartition(3)
    chosen = filter_of_hashes(compared.where("pair in (1, 4)").select(F.col("group").alias("code")))
    got = defaultdict(set)
    for code, pair, members in ngram_join.shared_differences(compared, chosen, 12).collect():
        got[code, members].add(pair)
    assert sorted((members, sorted(pairs)) for (_, members), pairs in got.items()) == [(2, [1, 3]), (2, [4, 5]), (3, [1, 2, 3])]


@pytest.mark.parametrize("cut,held", [(1, 1), (40, 7), (1 << 20, 1 << 19)])
def test_codes_met_in_blocks_equal_plain(monkeypatch, cut, held):
    """Codes of several ids, wherever blocks and batches end, with hot codes and ids of all sizes."""
    monkeypatch.setattr(blocks, "CUT", cut)
    monkeypatch.setattr(blocks, "SORTED", held)
    rng = random.Random(cut)
    ids = [0, -1, 2**63 - 1, -(2**63), 2**32, *(rng.getrandbits(40) for _ in range(30))]
    codes = [rng.getrandbits(64) for _ in range(200)]
    rows = [(rng.choice(codes) if rng.random() < 0.8 else codes[0], rng.choice(ids)) for _ in range(600)] + [(rng.getrandbits(64), 7) for _ in range(300)] * 2
    parts = [tuple(np.array(x, kind) for x, kind in zip(zip(*rows[a : a + 50]), (np.uint64, np.int64))) for a in range(0, len(rows), 50)]
    cuts = pa.Table.from_batches([*blocks._cut(parts[:9], 8), *blocks._cut(parts[9:], 8)]).sort_by("bucket")
    got = [r for b in blocks._met(cuts.to_batches(max_chunksize=5), 8) for r in zip(*(c.to_pylist() for c in b.columns))]
    plain = defaultdict(set)
    for code, i in rows:
        plain[code - (code >> 63 << 64)].add(i)
    assert sorted(got) == sorted((code, i, len(x)) for code, x in plain.items() if len(x) > 1 for i in x)


def test_codes_met_by_spark_equal_plain(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(400), rng.randrange(50)) for _ in range(900)]
    df = spark.createDataFrame(rows, "code long, id long").repartition(5)

    def parts(batches):
        for b in batches:
            yield mix(b.column("code").to_numpy().view(np.uint64)), b.column("id").to_numpy()

    plain = defaultdict(set)
    for code, i in rows:
        plain[int(mix(np.array([code], np.uint64)).view(np.int64)[0])].add(i)
    want = sorted((code, i, len(x)) for code, x in plain.items() if len(x) > 1 for i in x)
    assert sorted(tuple(r) for r in blocks.met_codes(df, parts, 900).collect()) == want
    assert blocks.met_codes(df.where("id < 0"), parts, 0).count() == 0


def test_long_sets_are_compared_in_segments(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SEGMENT", 16)
    rows = corpus(7, n=30, copies=40, length=(20, 120))
    want, _ = plain_groups(rows, 3, 90)
    segments = ngram_join.segment_table(docs_of(spark, rows).select("doc_id", "text"), 3)
    assert segments.where("bits > 1").count() > 0
    got = ngram_join.jaccard_groups(docs_of(spark, rows), 3, 90)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_fragments_leave_no_similar_pair_out():
    """Similar sets share a fragment whatever the sizes: many random pairs at the threshold."""
    import numpy as np

    rng = np.random.default_rng(1)
    for percent in (70, 80, 90):
        cuts = ngram_join.Cuts(percent)
        for _ in range(300):
            size = int(rng.integers(1, 60))
            x = np.sort(rng.integers(0, 2**63, size, dtype=np.uint64))
            for gone in range(size):
                for more in range(4):
                    both = size - gone
                    if both * 100 < percent * (size + more) or not both:
                        continue
                    y = np.sort(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, more, dtype=np.uint64)]))
                    codes = [
                        {c for key in (k, k + 1) for c in ngram_join._fragment_codes(s, key, *cuts.fragments(key)).tolist()}
                        for s in (x, y)
                        for k in [cuts.size_class(len(s))]
                    ]
                    assert codes[0] & codes[1], (percent, size, gone, more)
                break


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(70) if i % 10] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    nodes = {x for p in links for x in p}
    assert got == union(nodes, links)


def test_first_of_groups_keeps_columns_and_null_ids(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "other words here"), (None, "a b c d e f g h i j"), (4, None)]
    docs = docs_of(spark, rows)
    got = ngram_join.first_of_groups(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 3, 4]


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for body, g in groups.items():
        best = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        for i, t in g:
            out.append((i, best[0], len(g), i == best[0] and len(t) == len(best[1]), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_equals_plain(spark):
    rows = corpus(4)
    got = exact_dedup.groups(docs_of(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_exact(rows)


@pytest.mark.parametrize("share", [1, 2, 10**9])
def test_exact_dedup_salts_hot_texts(spark, monkeypatch, share):
    """Whatever counts as hot, also none or all, results are the same."""
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(120)] + [(i, "thesame text ") for i in range(200, 230)]
    got = exact_dedup.groups(docs_of(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_exact(rows)


def test_keep_first_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, "ab "), (3, None), (4, ""), (5, "c")]
    docs = docs_of(spark, rows)
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 3, 5]


def plain_cut(rows, n):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,group", [(13, 50_000), (13, 2), (5, 3)])
def test_substring_dedup_equals_plain(spark, n, group):
    rows = corpus(6, copies=60)
    rows += [(3, "another text with an id that is there already " * 3), (9_000, "another text with an id that is there already " * 2)]
    want = plain_cut(rows, n)
    got = substring_dedup.cut(docs_of(spark, rows), n, group=group).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[2] for r in want) > 100


def test_substring_spans_cover_what_is_removed(spark):
    rows = corpus(8)
    for r in substring_dedup.cut(docs_of(spark, rows), 13).collect():
        assert sum(s["end"] - s["first"] for s in r["removed"]) == r["n_removed"]


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert exact_dedup.groups(none).count() == 0
    assert exact_dedup.keep_first(none).count() == 0
    assert ngram_join.jaccard_groups(none).count() == 0
    assert ngram_join.first_of_groups(none).count() == 0
    assert substring_dedup.cut(none).count() == 0


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(12)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 16))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            t = list(rng.choice(base))
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[t[at]], [t[at]], ["zz"], [], [t[at], "yy"], [t[at], "yy", "xx"]])
            lines.append(rng.choice([" ", "  "]).join(t))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (None, rows[0][1])]
    seen, want = [], []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        kept, total, gone = [], 0, 0
        for line in (t or "").split("\n"):
            w = WORD.findall(line)
            total += bool(w)
            if w and any(w == o or len(w) >= 8 and len(o) >= 8 and line_dedup.within_one(w, o) for o in seen):
                gone += 1
            else:
                kept.append(line)
            if w:
                seen.append(w)
        want.append((i, total, gone, "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    assert [r[2:] for r in got if r[0] is None] == [(0, rows[0][1])]
    assert sum(r[2] for r in want) > 40
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_short_lines_are_near_by_characters(spark):
    lines = [
        "All rights reserved", "All right reserved", "All rihgts reserved", "Allrights reserved", "All rights removed",
        "Released under the MIT License", "Released under the MIT Licence", "Chapter 1 of 9", "Chapter 2 of 9", "Option A here", "Option B here",
    ]
    rows = [(r["doc_id"], r["n_removed"]) for r in line_dedup.dedup_lines(docs_of(spark, list(enumerate(lines)))).collect()]
    assert sorted(i for i, n in rows if n) == [1, 2, 3, 6]


def test_line_dedup_moves_texts_of_likely_lines_alone(spark, monkeypatch):
    """Long lines are told apart by numbers; only such as share a half are fetched as texts."""
    held = {}

    def watched(df, name, stage=line_dedup.stage):
        held[name] = stage(df, name)
        return held[name]

    monkeypatch.setattr(line_dedup, "stage", watched)
    lines = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(40)]
    near = lines[7].replace("w7x3", "typo")
    rows = [(i, f"{x}\n{lines[7] if i == 30 else ''}") for i, x in enumerate(lines)] + [(90, f"short line\n{near}"), (91, "short line")]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert {i for i, n in got.items() if n} == {30, 90, 91}
    texts = [r["line"] for name, df in held.items() if "line" in df.columns for r in df.select("line").collect() if r["line"] is not None]
    assert set(texts) == {"short line", lines[7], near}


@pytest.mark.parametrize("block", [1, 20, 1 << 18])
def test_half_codes_are_equal_where_halves_are(monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    lines = [line_dedup.mix(rng.integers(1, 4, n, dtype=np.uint64)) for n in rng.integers(8, 12, 300)]
    ends = np.cumsum([len(x) for x in lines])
    codes = line_dedup._half_codes(np.concatenate(lines), ends - [len(x) for x in lines], ends)
    named = {}
    for x, row in zip(lines, codes.tolist()):
        n = len(x)
        ks = ((n - 1) // 2, (n - 1) // 2, (n + 1) // 2, (n + 1) // 2)
        for j, (k, code) in enumerate(zip(ks, row)):
            half = tuple((x[:k] if j % 2 == 0 else x[n - k :]).tolist())
            named.setdefault(code, set()).add((j % 2, half))
    assert all(len(x) == 1 for x in named.values())
    assert len(named) == len({h for x in named.values() for h in x}) < 4 * len(lines)
