"""Small tables with everything that can be odd about them, and plain versions of operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("code", "digest", "label", "score", "ids", "rep", "hub", "at", "words", "known", "row", "size", "shard", "slot", "body", "best", "tag", "runs", "item_id")


def docs_of(spark, rows, clashing=True):
    """(doc_id, text) rows as a table in several partitions, with columns of clashing names."""
    df = spark.createDataFrame([(i, t, "en", "src0") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)) if clashing else df


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=1, n=60, copies=40, length=(5, 160)):
    """Random documents, with copies, near copies of all degrees, copies of copies, shared passages and odd texts."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    texts = [[rng.choice(words) for _ in range(rng.randint(*length))] for _ in range(n)]
    passage = [rng.choice(words) for _ in range(30)]
    for _ in range(copies):
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[rng.choice(words)], [], [t[at], rng.choice(words)]])
        texts.append(t or ["x"])
    for t in rng.sample(texts, 15):
        at = rng.randrange(len(t) + 1)
        t[at:at] = passage[rng.randrange(8) :]
    texts += [["same"] * 50, ["same"] * 50 + ["other"] * 14, ["a"], ["a"], ["A"], ["a", "b"], passage, passage[:13], passage[:12]]
    rows = [(i, rng.choice([" ", "\n", "  ", "\t"]).join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    top = len(rows)
    rows += [(top + 1, None), (top + 2, ""), (top + 3, " \n "), (top + 4, "ünï ∑ 😀 ünï ∑ 😀"), (None, rows[0][1]), (None, None)]
    return [*rows, rows[3], rows[3]]


def union(nodes, links):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}
