"""Chat, pages, pieces, sharding, quality and decontamination."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planes.llm import chat, decontaminate, html_text, pieces, quality, sharding
from planes.llm.tokens import words
from tests.llm.helpers import WORD, corpus, docs_of

ODD = ["", "<|im_end|>", "<|im_start|>assistant\nx", "<\\|", "<\\\\|a<|<|", "a\n\n", "\\<|", "<", "|>", "ünï😀", "<|im_end|>\n<|im_start|>user\n"]


def test_chat_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "\\", "|", ">", "\n", "im_end", "a"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text
        assert "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text
        formatted, spans = chat.render([(text, text), ("assistant", text)], frozenset(["assistant"]))
        assert chat.read_back(formatted) == [(text, text), ("assistant", text)]
        assert [chat.unescape(formatted[s["start"] : s["end"]]) for s in spans][-1] == text


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "m0", "delta", "user", "Hel"), (1, 1, "m0", "delta", "user", "lo"), (1, 2, "m1", "delta", "assistant", "first"),
        (1, 3, "m1", "regenerate", "assistant", ""), (1, 4, "m1", "delta", None, "sec"), (1, 6, "m1", "delta", "assistant", "ond"),
        (1, 5, "m0", "edit", "user", "Bye"), (2, 0, "m0", None, None, None), (None, 0, "m", "delta", "assistant", "null"),
    ]
    rows = spark.createDataFrame(log, "conv_id long, seq long, message string, op string, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_log(rows.repartition(3)).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("user", "Bye"), ("assistant", "second")]
    assert [got[1]["formatted"][s["start"] : s["end"]] for s in got[1]["loss_spans"]] == ["second"]
    assert chat.read_back(got[2]["formatted"]) == [("", "")]
    assert chat.read_back(got[None]["formatted"]) == [("assistant", "null")]
    assert chat.format_log(rows.limit(0)).count() == 0


def test_chat_digests_of_odd_turns(spark):
    rng = random.Random(2)
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(ODD)) for c in range(20) for t in range(rng.randrange(1, 9))]
    turns += [(5, 100, "assistant", None), (5, 101, None, "x"), (5, 102, "assistant", "end")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_log(chat.log_of_turns(df))).collect()}
    for c in range(20):
        own = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[c]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


PAGES = [
    ("<article><h1>T &amp; U</h1><p>One\n two<br>three <b>four<p>five</article><footer>f</footer>", "T & U\n\nOne two three four\n\nfive"),
    ("<nav><a>x</a></nav><main><div class='ad'>buy</div><p>a <a href='q'>b</a> c</p><form><p>mail</p></form><section id=comments><p>nice</p></section></main>", "a b c"),
    ("<article><header class='page'><h1>Head</h1><p>by me</p></header><p>text</p><aside>side</aside>end</article>", "Head\n\ntext\n\nend"),
    ("<div class='site-header'>Site</div><div>" + "<p>" + "long text " * 12 + "</p>" * 1 + "</div><div class='sidebar'>" + "side " * 60 + "</div>", ("long text " * 12).strip()),
    ("<article><p>a &#233; &lt;b&gt; &unknown; 1 < 2</p><script>var x='</p><p>no'</script><style>p{}</style><!-- <p>no</p> --></article>", "a é <b> &unknown; 1 < 2"),
    ("<article><ul><li><a href=1>Menu one</a></li><li><a href=2>Menu two</a></li></ul><p>x</p><ul><li>point <a>l</a></li></ul></article>", "x\n\npoint l"),
    ("<article><p style='display: none'>h</p><p hidden>h</p><div class=cookie-notice>c<p>d</div><p>seen", "seen"),
    ("just words", "just words"), ("", ""), (None, ""), ("<p></p><<<>", "<<<>"), ("<title>t</title>", ""),
]


def test_pages(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("x"))
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want, PAGES[i]
        assert got[i]["n_chars"] == len(want)
    assert html_text.extract(df.limit(0)).count() == 0
    twice = html_text.extract(df.union(df).withColumn("page_id", F.lit(None).cast("long")))
    assert twice.count() == 2 * len(rows)


def test_long_and_broken_pages_end():
    assert html_text.main_text("<a " * 20_000 + "\"" * 3) is not None
    assert html_text.main_text("<div class='x" * 5_000) is not None
    assert html_text.main_text("<!--" * 5_000) == ""
    assert html_text.main_text("<article>" + "<p>word" * 20_000).count("\n\n") == 19_999


def test_text_beside_removed_elements_and_lists_of_links():
    long = "long text " * 12
    text = lambda *parts: "\n\n".join(x.strip() for x in parts)
    ad = "<div class='ad'>buy</div>"
    page = f"<div class='top'><p>Tiny</p></div>{ad}<div><p>{long}</p>{ad}<p>Short one.</p>{ad}<p>{long}</p>{ad}<p>The end.</p></div><div><p>Small print</p></div>"
    assert html_text.main_text(page) == text(long, "Short one.", long, "The end.")
    page = f"<body><p>Tiny</p>{ad}<p>{long}</p>{ad}<p>Short one.</p>{ad}<p>{long}</p>{ad}<p>Small print</p></body>"
    assert html_text.main_text(page) == text(long, "Short one.", long)
    links = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul>"
    both = ("First source", "Second source")
    assert html_text.main_text(f"<article><p>x</p>{links}<p>y</p></article>") == text("x", *both, "y")
    assert html_text.main_text(f"<article><p>x</p><h2>Sources</h2>{links}</article>") == text("x", "Sources", *both)
    assert html_text.main_text(f"<article>{links}<p>x</p>{links}</article>") == "x"


@pytest.fixture(scope="module")
def model():
    return pieces.Unigram(pieces.read_model())


TEXTS = ["", " ", "Hello world", "  two  spaces ", "a\tb\nc\r\n\nd", "ünïcödé 日本語 😀", "▁marker ▁", "x" * 3000, "123 4567", "…", "\x00\x01", "the the the", "word" * 40 + " end"]


def test_pieces_have_the_best_score(model):
    """Against Viterbi over a dict of pieces, on whole texts: the same score."""
    score = {p.replace("▁", " "): s for p, s, k in model.pieces if k == pieces.NORMAL}

    def plain(text):
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 48), end):
                s = score.get(text[start:end], model.unknown_score if end - start == 1 else None)
                if s is not None:
                    best[end] = max(best[end], best[start] + s)
        return best[-1]

    rng = random.Random(3)
    texts = TEXTS[:7] + ["".join(rng.choice("the and ingéñ%&\n") for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    marked = [" " + t if t else "" for t in texts]
    ids, at = model.encode(pa.array(marked))
    for t, a, b in zip(marked, at[:-1], at[1:]):
        kinds = [model.pieces[i][2] for i in ids[a:b]]
        got = sum(model.pieces[i][1] for i, k in zip(ids[a:b], kinds) if k == pieces.NORMAL)
        spelled = b"".join(bytes([int(model.pieces[i][0][3:5], 16)]) for i, k in zip(ids[a:b], kinds) if k == pieces.BYTE).decode()
        assert got + len(spelled) * model.unknown_score == pytest.approx(plain(t), abs=1e-6), t


def test_side_by_side_equals_alone(model):
    rng = random.Random(4)
    data = "".join(rng.choice("abcé ñ%日😀e") for _ in range(4000))
    column = pa.array([" " + data[i : i + 40] for i in range(0, 4000, 40)])
    ids, at = model.encode(column)
    for text, a, b in zip(column.to_pylist(), at[:-1], at[1:]):
        n = [sum(model.pieces[i][1] for i in x) for x in (ids[a:b].tolist(), model.best(text.encode()))]
        assert n[0] == pytest.approx(n[1], abs=1e-6)


def test_pieces_agree_with_the_library(model):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, (_, s, k) in enumerate(model.pieces):
        if k == pieces.NORMAL:
            proto.pieces[i].score = s
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [t for _, t in corpus(1) if t] + [t for t in TEXTS if "▁" not in t]
    ids, at = model.encode(pa.array([" " + t if t else "" for t in texts]))
    for t, a, b in zip(texts, at[:-1], at[1:]):
        want = library.encode(t)
        total = lambda x: sum(model.pieces[i][1] for i in x)
        assert total(ids[a:b].tolist()) == pytest.approx(total(want), abs=1e-3)  # ties apart
        assert library.decode(ids[a:b].tolist()) == library.decode(want)


def test_pieces_come_back(spark, model):
    rows = corpus(2) + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    docs = docs_of(spark, rows)
    coded = pieces.encode(docs)
    assert set(coded.columns) == set(docs.columns) and coded.count() == len(rows)
    back = pieces.decode(coded).select("text", "decoded", "ids").collect()
    for r in back:
        assert r["decoded"] == (r["text"] or "")
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0


def test_trie_finds_what_is_in_it():
    rng = random.Random(5)
    keys = list({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5))) for _ in range(3000)})
    trie = pieces.DoubleArray([(k, i) for i, k in enumerate(keys)])

    def find(key):
        node = 0
        for c in key:
            to = trie.base[node] + c + 1
            if trie.check[to] != node:
                return -1
            node = to
        return trie.value[node]

    assert all(find(k) == i for i, k in enumerate(keys))
    for _ in range(3000):
        other = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5)))
        assert find(other) == (keys.index(other) if other in keys else -1)


def test_sharding_obeys_its_law(spark):
    rows = corpus(9) * 3 + [(10_000 + i, "x" * (i * 37 % 900)) for i in range(4000)]
    got = sharding.shard(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == sizes
    total = [0] * 16
    slots = [[] for _ in range(16)]
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] is None and r["law"] == "bytes"
    assert max(total) - min(total) <= 0.01 * sum(total) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sharding.shard(docs_of(spark, [])).count() == 0
    assert sharding.shard(docs_of(spark, [(1, None)])).count() == 1


def test_sharding_of_skewed_sizes(spark):
    """One text is half a shard long, a few are a tenth."""
    rows = [(i, "x" * (i * 37 % 900)) for i in range(4000)]
    mean = sum(len(t) + 1 for _, t in rows) // 15
    rows += [(5000, "y" * (mean // 2))] + [(5001 + i, "z" * (mean // 10)) for i in range(5)]
    total = [0] * 16
    for r in sharding.shard(docs_of(spark, rows)).collect():
        total[r["shard"]] += r["size"]
    assert sum(total) == sum(len(t) + 1 for _, t in rows)
    assert max(total) - min(total) <= 0.01 * sum(total) / 16


def test_slot_map_grows_only_into_the_new_shard(spark, tmp_path):
    records = sharding.records(docs_of(spark, [(i, "y" * (i % 50)) for i in range(20_000)]))
    one = sharding.slot_map(sharding.slot_sizes(records), 4)
    sharding.store_map(one, str(tmp_path / "map"))
    sharding.store_map(sharding.grow(one, 4), str(tmp_path / "map"))
    old = {r["vslot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()}
    new = {r["vslot"]: r for r in sharding.load_map(spark, str(tmp_path / "map")).collect()}
    assert old.keys() == new.keys()
    assert all(r["shard"] in (4, old[v]) and r["version"] == 2 for v, r in new.items())
    total = [0] * 5
    for r in new.values():
        total[r["shard"]] += r["bytes"]
    assert max(total) - min(total) < 0.05 * sum(total) / 5


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality_on_held_out_rows(spark):
    sf = os.environ.get("PLANES_SF_DIR", "/root/testdata/sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.score(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").where(quality.held_out())
    got = [(r["score"], r["quality"]) for r in scored.collect()]
    assert len(got) > 50
    assert auc(*zip(*got)) > 0.97


def test_quality_is_the_vote_of_the_nearest(spark):
    rows = [(i, t) for i, t in corpus(3) if i is not None]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100, 2)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = {}
    for r in quality.score(docs, model, neighbours=5).collect():
        got.setdefault((r["doc_id"], r["text"]), r["score"])
    for (_, text), score in got.items():
        w = words(pa.array([text], pa.string()))
        x = model.project(quality.damped(quality.term_counts(w), np.diff(w.first)))[0]
        votes = sorted(((float(v @ x), float(y)) for v, y in zip(model.vectors, model.labels)), reverse=True)[:5]
        weight = [max(c, 0) ** quality.SHARPNESS for c, _ in votes]
        want = sum(a * y for a, (_, y) in zip(weight, votes)) / sum(weight) if sum(weight) else model.prior
        assert score == pytest.approx(want, abs=1e-4) and 0 <= score <= 1


def test_quality_without_labels_or_rows(spark):
    docs = docs_of(spark, corpus(3))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, none)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


BENCH = [
    (1, "A train leaves Paris at 9 with 250 kg of apples and arrives in Rome after 14 hours, so how fast does Anna travel"),
    (2, "the quick brown fox jumps over the lazy dog and then runs back home again"),
    (3, "short one"), (4, None), (None, "no id for this item so it is not searched for at all today"),
    (5, "if Bob has 3 coins and Eve has 3 coins more than Bob then how many coins does Eve have in all"),
]
CASES = [
    ("some words before it. " + BENCH[0][1] + " and more", 1, "verbatim"),
    ("A train leaves Lyon at 7 with 90 kg of apples and arrives in Oslo after 20 hours, so how fast does Kim travel", 1, "reparameterised"),
    ("noise noise THE QUICK BROWN FOX, jumps over the lazy dog; and then runs back home again!", 2, "verbatim"),
    ("the quick brown fox jumps over nothing", None, None),
    ("if Tom has 8 coins and Ida has 8 coins more than Tom then how many coins does Ida have in all", 5, "reparameterised"),
    (None, None, None), ("", None, None), ("short one", None, None),
]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_benchmark_items_are_found(spark, limit):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(100 + i, t) for i, t in corpus(5) if i is not None]
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contaminated(docs_of(spark, rows), bench, broadcast_bytes=limit).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in got} == {(i, c[1], c[2]) for i, c in enumerate(CASES) if c[1]}
    for r in got:
        w = WORD.findall(dict(rows)[r["doc_id"]])
        assert 0 <= r["first_word"] < r["end_word"] <= len(w)
    clean = decontaminate.without_contaminated(docs_of(spark, rows), bench)
    assert clean.columns == docs_of(spark, []).columns
    assert clean.count() == len(rows) - len({r["doc_id"] for r in got})


def test_rows_with_null_and_shared_ids_go_by_their_text(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    item = BENCH[1][1]
    rows = [(None, item), (None, "clean"), (None, None), (1, item), (1, "clean as well"), (2, "clean"), (2, None)]
    left = decontaminate.without_contaminated(docs_of(spark, rows), bench).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted((r for r in rows if r[1] != item), key=str)


def test_inconsistent_slots_do_not_count(spark):
    """The same value in the item stands for different ones here, so it is no re-parameterised copy."""
    rows = [(1, "if Tom has 8 coins and Ida has 5 coins more than Max then how many coins does Zoe have in all")]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contaminated(docs_of(spark, rows), bench).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_names_that_begin_sentences(spark, limit):
    item = "Anna has 3 red apples. Bob has 5 more apples than Anna. Carl gives Anna 2 apples. How many apples does Anna have now?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = "Kim has 4 red apples. Max has 7 more apples than Kim. Tom gives Kim 6 apples. How many apples does Kim have now?"
    wrong = "Kim has 4 red apples. Max has 7 more apples than Tom. Zoe gives Eve 6 apples. How many apples does Ida have now?"
    rows = [(1, other), (2, "so, " + item.lower()), (3, "it says: " + other), (4, wrong)]
    got = decontaminate.contaminated(docs_of(spark, rows), bench, broadcast_bytes=limit).collect()
    assert {(r["doc_id"], r["kind"]) for r in got} == {(1, "reparameterised"), (2, "verbatim"), (3, "reparameterised")}
    one = next(r for r in got if r["doc_id"] == 1)
    assert {("anna", "kim"), ("bob", "max")} <= {(s["item_value"], s["doc_value"]) for s in one["slots"]}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_items_full_of_slots_short_items_and_long_runs(spark, limit):
    plain = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59))
    items = [
        (1, "Add 12, 45, 78, 90 and 33 to 17, 21 and 64, then take 9 from 250."),
        (2, "On 3 May 1990 Anna Smith paid 250 dollars to John Brown in Paris on 12 June 1991 and 40 dollars to Eve Stone."),
        (3, "Who wrote the Magic Flute?"), (4, plain),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    part = plain.split(" ")
    rows = [(i, f"some text before it. {t} and more") for i, t in items[:3]]
    rows += [(4, " ".join(["x", *part[5:33], "y"])), (5, " ".join(["x", *part[5:18], "y"])), (6, " ".join(["x", *part[5:17], "y"]))]
    rows += [(7, "Add 13, 45, 79, 90 and 34 to 18, 21 and 65, then take 8 from 251."), (8, "who wrote the other flute?"), (9, "WHO WROTE THE MAGIC FLUTE")]
    got = decontaminate.contaminated(docs_of(spark, rows), bench, broadcast_bytes=limit).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (9, 3)}
    assert {r["kind"] for r in got} == {"verbatim"}
    assert next((r["first_word"], r["end_word"]) for r in got if r["doc_id"] == 3) == (4, 9)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_repeated_windows_count_as_often_as_they_come(spark, limit):
    part = "one line that is said again and again here\n" * 10
    rest = " ".join(f"other{chr(97 + i)}" for i in range(26))
    bench = spark.createDataFrame([(1, part + rest)], "item_id long, text string")
    got = decontaminate.contaminated(docs_of(spark, [(1, part), (2, rest[:40])]), bench, broadcast_bytes=limit).collect()
    assert [(r["doc_id"], r["n_windows"], r["item_windows"]) for r in got] == [(1, 83, 109)]


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs_of(spark, corpus(1)), bench.limit(0)).count() == 0


def test_classes_are_told_by_whole_names():
    page = "<article>{}<div class='{}'><p>{}</p></div></article>"
    long = "About form factors. " * 8
    for name in ("form-factor", "search-algorithms", "binary-search", "menuItemsExplained", "social_contract", "alert-fatigue study", "header-files", "commentary"):
        assert html_text.main_text(page.format("<p>x</p>", name, long)) == "x\n\n" + long.strip(), name
    for name in ("sidebar", "site-footer", "reader-comments", "commentList", "contact-form", "ad-slot-2", "cookie_notice", "MainNav", "x search", "story-sidebar", "newsletter-signup"):
        assert html_text.main_text(page.format("<p>x</p>", name, long)) == "x", name


def test_text_between_surges_and_dives_is_kept():
    """The rule, window by window, on random lines without elements that hold several of them."""
    rng = random.Random(8)
    for _ in range(300):
        lines = [("x" * n, n) if n else ("", 0) for n in (rng.choice([0, 0, 0, 1, 5, 30, 200]) for _ in range(rng.randint(0, 25)))]
        surge = rng.choice([0, 10, 80])
        sums = [sum(n for _, n in lines[i : i + html_text.WINDOW]) for i in range(len(lines))]
        least = min(surge, max(sums, default=0) // 2)
        want, inside = [], False
        for i, s in enumerate(sums):
            if inside and s == 0:
                inside = False
            elif not inside and s > least:
                inside = True
            if inside and lines[i][1]:
                want.append(lines[i][0])
        # Each line is its own container, so nothing is kept for what lies beside it.
        assert html_text.between(lines, surge, list(range(1, len(lines) + 1))) == want


def test_short_pages_and_texts_outside_articles():
    assert html_text.main_text("<p>tiny</p>") == "tiny"
    long = "long text " * 12
    assert html_text.main_text(f"<div><p>{long}</p></div><article><p>{long}</p><p>x</p></article><div><p>y</p></div>") == f"{long.strip()}\n\n{long.strip()}\n\nx"


def test_rows_that_are_alike_share_no_slot_alone(spark):
    """A third of all rows with a null id and no text, and a text of many copies."""
    rows = [(None, None)] * 5000 + [(7, "copy " * 200)] * 300 + [(i, "y" * (i % 90)) for i in range(100, 5000)]
    got = sharding.shard(docs_of(spark, rows)).collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and max(sizes.values()) < 1.05 * sum(sizes.values()) / 16
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 16
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t or "") + 1) for i, t in rows)


def test_a_stored_map_is_read_by_version_and_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, "z" * (i % 70)) for i in range(4000)]
    where = lambda docs, **how: {r["doc_id"]: (r["shard"], r["version"]) for r in sharding.shard(docs_of(spark, docs), path=path, **how).collect()}
    first = where(rows, shards=5)
    assert {v for _, v in first.values()} == {1} and {s for s, _ in first.values()} == set(range(5))
    # Other documents, and more, keep to the stored map; each has a place.
    more = where(rows[:3000] + [(i, "new") for i in range(9000, 9500)], shards=99)
    assert all(more[i] == first[i] for i in range(3000)) and len(more) == 3500 and {s for s, _ in more.values()} <= set(range(5))
    sharding.store_map(sharding.grow(sharding.load_map(spark, path), 5), path)
    grown = where(rows)
    assert all(grown[i] == (first[i][0], 2) or grown[i] == (5, 2) for i in first)
    moved = sum(i % 70 + 1 for i, (s, _) in grown.items() if s == 5) / sum(i % 70 + 1 for i in first)
    assert 0.14 < moved < 0.18  # its part of the bytes, in the smallest slots
    assert where(rows, version=1) == first


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_items_that_share_an_id_are_all_searched_for(spark, limit):
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota", "red orange yellow green blue indigo violet white black grey", "one item without an id of its own in the benchmark"]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (5, None), (None, "")], "item_id long, text string")
    rows = [(i, f"so {t} it is") for i, t in enumerate(texts)] + [(9, "nothing of this kind is in here at all today")]
    got = decontaminate.contaminated(docs_of(spark, rows), bench, broadcast_bytes=limit).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == [(0, 1), (1, 1), (2, None)]
