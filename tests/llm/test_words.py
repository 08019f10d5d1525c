"""Spelling variants, mixes and collocations against plain versions on odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from planes.llm import mixing, phrases, spelling
from tests.llm.helpers import CLASHING, WORD, corpus, docs_of


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    out = {}
    for w in n:
        near = sorted((x for x in n if one_edit(w, x)), key=lambda x: (-n[x], x))
        form = near[0] if near and n[near[0]] >= 10 * n[w] else None
        out[w] = [form, n[w], len(near), n[form] if form else None]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(x) for w, x in out.items()}


def variants_of(spark, n, **how):
    vocab = spark.createDataFrame(list(n.items()), "word string, n long").select("*", *(F.lit("x").alias(c) for c in CLASHING))
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(vocab, **how).collect()}


@pytest.mark.parametrize("group", [0, 3, 64])
def test_variants_equal_all_pairs_however_groups_are_split(spark, group):
    rng = random.Random(group)
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randint(3, 7))) for _ in range(250)}
    words |= {"x" * k for k in range(1, 12)} | {"listen", "silent", "enlist", "naïve", "naive", "日本語", "日本", "é", "a" * 3000, "a" * 2999 + "b", "a" * 2999}
    n = {w: rng.choice([2, 2, 3, 30, 300, 4000]) for w in words}
    got = variants_of(spark, n, group=group)
    assert got == plain_variants(n)
    assert any(v[0] and v[1] != v[0] for v in got.values())


def test_a_letter_that_all_words_share_is_split(spark):
    """Many words with the same letters: signatures alone would compare them all."""
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(400)}
    n = {w: 2 + i % 40 for i, w in enumerate(sorted(words | {w[:-1] for w in list(words)[:50]}))}
    assert variants_of(spark, n, group=8) == plain_variants(n)


def test_no_words_have_no_variants(spark):
    assert variants_of(spark, {}) == {}


def plain_words(rows, least=7, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    return {w: k for w, k in n.items() if k >= 2}


def test_words_of_texts_with_slips(spark):
    rng = random.Random(3)
    stems = ["colour", "Analyse", "BEHAVIOUR", "éclairage", "Straße", "neighbourhood"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "s", "ly", "É"]) + rng.choice([" ", "-", "9", "\n"]) for _ in range(60))) for i in range(40)]
    rows += [(None, "behaviours behaviours"), (None, None), (7, ""), rows[0], rows[0]]
    got = spelling.variants_in_texts(docs_of(spark, rows), r"A-Za-zÀ-ÿ", 7, 3)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == plain_variants(plain_words(rows, every=3))
    assert spelling.variants_in_texts(docs_of(spark, []), "a-z", 7, 31).count() == 0


def plain_targets(sizes, weights, share, most):
    """Targets as fractions: shares, the excess of the full dealt again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: Fraction(0) for s in names}
    left, open_ = Fraction(share[0], share[1]) * sum(sizes.values()), list(names)
    while open_ and left > 0:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = Fraction(0)
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                open_.remove(s)
    return target


def sourced(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).select("*", *(F.lit("x").alias(c) for c in ("size", "target", "kind", "chunk", "key", "copies", "start")))


def random_sources(seed, n=400):
    rng = random.Random(seed)
    names = ["b", "B", "a", "ß", "😀", "z", "", None]
    return [(i if i % 50 else None, rng.choice([None, "", " x ", "w " * rng.randint(1, 90)]), names[min(7, int(rng.expovariate(0.5)))]) for i in range(n)]


@pytest.mark.parametrize("weights, share, most", [((5, 2, 1), (3, 2), 2), ((1, 50), (1, 2), 1), ((3,), (9, 1), 2)])
def test_mix_meets_its_targets(spark, weights, share, most):
    rows = random_sources(len(weights))
    rows += rows[:30]
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    schedules = mixing.SCHEDULES[: len(weights)]
    mixed = mixing.mix(sourced(spark, rows), weights, schedules, share, most)
    got = mixed.collect()
    want = plain_targets(sizes, weights, min(share, (most, 1), key=lambda x: x[0] / x[1]), most)
    assert sorted((r["doc_id"], r["size"], r["source"]) for r in got if r["doc_id"] is not None and r["source"] is not None) == sorted(
        (i, size(t), s) for i, t, s in rows if i is not None and s is not None
    )
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(float(want[r["source"]])) and r["source_size"] == sizes[r["source"]]
        assert [c["epoch"] for c in r["copies"]] == list(range(len(r["copies"]))) and len(r["copies"]) <= most
        assert all(0 < c["words"] <= r["size"] for c in r["copies"])
        taken[r["source"]] += sum(c["words"] for c in r["copies"])
    assert all(abs(taken[s] - want[s]) <= Fraction(1, 2) for s in sizes)
    again = mixing.mix(sourced(spark, rows).repartition(3), weights, schedules, share, most)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_positions_follow_the_schedules(spark):
    """Word by word, documents come when the integrals of the schedules say, and are sorted so."""
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(900)]
    schedules = (((0.0, 3.0), (0.25, 0.0), (1.0, 1.0)), ((0.0, 0.0), (0.5, 4.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)))
    mixed = mixing.mix(sourced(spark, rows), schedules=schedules)
    order = mixing.training_order(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    target = {r["source"]: r["target"] for r in mixed.collect()}

    def area(points, t):
        got = 0.0
        for (a, x), (b, y) in zip(points, points[1:]):
            d = min(max(t - a, 0), b - a)
            got += d * (x + x + (y - x) * d / (b - a)) / 2
        return got

    given = Counter()
    for r in order:
        s = "abc".index(r["source"])
        part = given[r["source"]] / target[r["source"]]
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if area(schedules[s], mid) < part * area(schedules[s], 1) else (low, mid)
        want = sum(target["abc"[k]] * area(p, high) / area(p, 1) for k, p in enumerate(schedules))
        assert r["position"] == pytest.approx(want, abs=2 + 1e-3 * sum(target.values()))
        given[r["source"]] += r["words"]
    assert given == {s: round(t) for s, t in target.items()}


def test_mixes_of_nothing_and_of_many_sources(spark):
    assert mixing.mix(sourced(spark, [])).count() == 0
    empty = mixing.mix(sourced(spark, [(1, None, "a"), (None, "", None)])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in empty] == [(0, 0.0, [])] * 2
    rows = [(i, "w " * (1 + i * i % 97), f"s{i:03}") for i in range(300)]
    sizes = {s: len(t.split()) for _, t, s in rows}
    want = plain_targets(sizes, (5, 2, 1), (3, 2), 2)
    assert {r["source"]: r["target"] for r in mixing.mix(sourced(spark, rows)).collect()} == pytest.approx({s: float(t) for s, t in want.items()})
    with pytest.raises(ValueError):
        mixing.mix(sourced(spark, rows), schedules=mixing.SCHEDULES[:2])
    with pytest.raises(ValueError):
        mixing.mix(sourced(spark, rows), schedules=(((0.0, 1.0), (0.5, 1.0)),) * 3)


def plain_collocations(rows, support, most, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    inner = defaultdict(int)
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[lang, p[i : i + k]] = max(inner[lang, p[i : i + k]], a)
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if inner[lang, p] < a:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return [
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang in out for i, (s, a, p, l, r) in enumerate(sorted(out[lang])[:most])
    ]


def spoken(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "house", "big", "Éa", "ÉA", "new", "york", "city", "a b", "x", "日本", "(so", "on)"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", None, "und", ""]), text + rng.choice(["", "new york city council", " the the the the the the the the"])))
    return [*rows, (None, None), ("en", ""), ("en", "..."), ("fr", "once only"), rows[0], rows[0]]


def langs(spark, rows):
    df = spark.createDataFrame([(i if i % 9 else None, a, t) for i, (a, t) in enumerate(rows)], "doc_id long, lang string, text string")
    return df.repartition(4).select("*", *(F.lit("x").alias(c) for c in ("f", "k", "phrase", "n", "score", "source")))


# A sample that proposes nothing or everything, and filters that are full: the result is the same.
@pytest.mark.parametrize("support, sample, bits, most", [(5, 8, 25, 50), (5, 1, 20, 2000), (20, 1000000, 25, 2000), (12, 3, 7, 7)])
def test_collocations_equal_plain_counts(spark, support, sample, bits, most):
    rows = spoken(support)
    got = phrases.collocations(langs(spark, rows), support, most, sample=sample, bits=bits).collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations(rows, support, most))


def test_failures_of_the_border_are_followed(spark):
    """Documents outside the sample hold a frequent phrase of five words that the sample has no word of."""
    ids = [r["id"] for r in spark.range(4000).where(F.pmod(F.xxhash64("id"), F.lit(8)) != 0).limit(60).collect()]
    rows = [(i, "en", "rare words make one phrase and rare words make another") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = phrases.collocations(docs, support=50).collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations([r[1:] for r in rows], 50, 2000))
    assert any(r["phrase"] == "rare words make one phrase" for r in got)


def test_scores_past_64_bits_are_exact(spark):
    big = 3 * 10**15 + 7
    rows = [("en", "", 0, 10 * big), ("en", "a", 1, big), ("en", "b", 1, 101), ("en", "a b", 2, 100)]
    found = spark.createDataFrame(rows, "lang string, phrase string, k int, f long")
    assert phrases.scored(found).first()["score"] == 1000 * 100 * 10 * big // (big * 101)


def test_no_documents_have_no_phrases(spark):
    assert phrases.collocations(langs(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, corpus()[:20]), support=10**6).count() == 0
