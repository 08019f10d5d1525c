"""Spelling variants of words by PartEnum signatures.

A word is a binary vector over its letters and how often each occurs, so one inserted,
deleted or replaced letter changes at most two places of it. The letters are partitioned,
and each word is signed with every choice of all parts but two: words at a distance of at
most two agree in the parts that neither place lies in, thus in a signature. Signatures are
equi-joined, beside the half of a word that an edit leaves alone, and pairs verified.

A signature that very many words share is split further by what is left of a word without
one letter. Its groups hold near words only, at most one per letter of the alphabet and place.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from planes.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parts of the letters; signatures are as many as there are pairs of parts.
PARTS = 4
# Places of a binary vector that one edit changes.
DISTANCE = 2
# Letters in the order in which they are dealt to the parts, which evens these out. All others
# in use are dealt by their code points, so the order matters for speed alone.
DEALT = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
# Words that share a signature and are compared with one another; more are split.
GROUP = 64
# A word is a form of another that is this many times as frequent.
RATIO = 10


def runs_of(docs: DataFrame, letters: str, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, run: the maximal runs of ``letters`` of at least ``least`` code points, A-Z as small
    letters. Null text has none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("run")).select(
        "doc_id", F.translate("run", UPPER, LOWER).alias("run")
    )


def with_slips(runs: DataFrame, every: int) -> DataFrame:
    """word: the runs, one of whose letters is left out where ``every`` divides the CRC-32 of
    ``<doc_id>:<run>``. A null id is written as nothing."""
    code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    place = (F.col("code") % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    return runs.withColumn("code", code).select(F.when(F.col("code") % every == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int, least_count: int = 2) -> DataFrame:
    """word, n: distinct words of at least so many code points and occurrences. Null is no word."""
    long = words.where(F.char_length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def with_signatures(vocab: DataFrame, parts: int = PARTS) -> DataFrame:
    """``vocab`` with the PartEnum signatures of each word: a hash of its letters in each choice of
    all parts but two."""
    sets = ["".join(DEALT[i::parts]) for i in range(1, parts)]
    others = lambda i: "".join(s for j, s in enumerate(sets, 1) if j != i)
    letters = vocab.select("*", F.array_join(F.array_sort(F.split("word", "")), "").alias("letters"))
    # What is in none of the other sets belongs to part 0.
    split = letters.select("*", F.translate("letters", "".join(sets), "").alias("part0"), *(
        F.regexp_replace(F.translate("letters", others(i), ""), f"[^{s}]+", "").alias(f"part{i}") for i, s in enumerate(sets, 1)
    ))
    chosen = combinations(range(parts), parts - DISTANCE)
    signs = F.array(*(F.xxhash64(F.lit(k), *(f"part{i}" for i in kept)) for k, kept in enumerate(chosen)))
    return split.select(*vocab.columns, signs.alias("signs"))


def halves() -> Column:
    """What an edit of ``word`` can leave alone: its first or last half, by hash, side and length.
    Of two lengths, as that of the other word may be one more or one less."""
    size = F.char_length("word")
    each = lambda h: [
        F.struct(F.xxhash64(F.lit(0), h, F.left("word", h)).alias("code"), F.lit(0).alias("side"), h.alias("same")),
        F.struct(F.xxhash64(F.lit(1), h, F.right("word", h)).alias("code"), F.lit(1).alias("side"), h.alias("same")),
    ]
    lesser, greater = each(F.floor((size - 1) / 2).cast("int")), each(F.floor(size / 2).cast("int"))
    return F.when(size % 2 == 1, F.array(*lesser)).otherwise(F.array(*lesser, *greater))


def keyed(vocab: DataFrame, parts: int = PARTS) -> DataFrame:
    """word, n, key, side, same: a row for each signature with each half."""
    signed = with_signatures(vocab, parts).select("word", "n", halves().alias("halves"), "signs")
    signed = signed.select("word", "n", "halves", F.explode("signs").alias("sign"))
    return signed.select("word", "n", "sign", F.explode("halves").alias("half")).select(
        "word", "n", F.xxhash64("sign", "half.code").alias("key"), "half.side", "half.same"
    )


def _pairs(grouped: DataFrame, may) -> DataFrame:
    """a, n_a, b, n_b with a before b: the near words among those listed in each row's ``words``."""
    one = grouped.where(F.size("words") > 1).select("words", F.explode("words").alias("x"))
    near = F.filter("words", lambda y: (y.word > F.col("x.word")) & may(F.col("x"), y) & (F.levenshtein(F.col("x.word"), y.word, 1) == 1))
    return one.select("x", F.explode(near).alias("y")).select(
        F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b")
    )


def split_keys(rows: DataFrame) -> DataFrame:
    """key, word, n, role: keys that all near words sharing the old key still share.

    The half beside the one in the key holds the edit. Of a replaced letter, both words without
    it agree (role 2); a word with one letter more, without that, is the other (roles 0 and 1).
    """
    size, same = F.char_length("word"), F.col("same")
    first = F.when(F.col("side") == 0, same + 1).otherwise(F.lit(1))
    last = F.when(F.col("side") == 0, size).otherwise(size - same)
    without = lambda p: F.concat(F.substring("word", F.lit(1), p - 1), F.substring("word", p + 1, size))
    entry = lambda text, place, role: F.struct(F.xxhash64("key", place, text).alias("key"), F.lit(role).alias("role"))
    gaps = F.sequence(first, last)
    entries = F.concat(
        F.array(entry(F.col("word"), F.lit(0), 1)),
        F.array_distinct(F.transform(gaps, lambda p: entry(without(p), F.lit(0), 0))),
        F.transform(gaps, lambda p: entry(without(p), p, 2)),
    )
    return rows.select("word", "n", F.explode(entries).alias("e")).select("word", "n", "e.key", "e.role")


def near_words(vocab: DataFrame, parts: int = PARTS, group: int = GROUP) -> DataFrame:
    """a, n_a, b, n_b with a before b: all pairs of words that one edit tells apart."""
    keys = keyed(vocab, parts)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group)
    large = stage(sizes.select("key"), "spelling-keys")
    listed = F.collect_list(F.struct("word", "n")).alias("words")
    small = _pairs(keys.join(large, "key", "left_anti").groupBy("key").agg(listed), lambda x, y: F.lit(True))
    split = split_keys(keys.join(large, "key", "left_semi")).groupBy("key").agg(F.collect_list(F.struct("word", "n", "role")).alias("words"))
    rest = _pairs(split, lambda x, y: (x.role == 2) | (x.role != y.role))
    return small.unionByName(rest).dropDuplicates(["a", "b"])


def forms_of(vocab: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n_near, form, form_n of the words that have near words."""
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
    )
    both = pairs.select(F.inline(ways))
    best = both.groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    frequent = -F.col("best.less") >= ratio * F.col("n")
    return best.select(
        "word", "n_near", F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")
    )


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of a word lead. Forms grow more frequent, so no chain comes
    back; each round doubles how far all have gone."""
    roots = stage(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage(
            roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def variants(vocab: DataFrame, parts: int = PARTS, group: int = GROUP, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``vocab`` (word, n; words are distinct): word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one the other. A
    word's form is its most frequent near word, of equal ones the first in code-point order, if
    that is ``ratio`` times as frequent; its root is where forms lead, or the word itself. Case
    and accents count as they are. Words of one code point have no half and are found as well;
    an empty vocabulary gives no rows. Other columns are not read.
    """
    vocab = vocab.select("word", F.col("n").cast("long").alias("n"))
    forms = stage(forms_of(vocab, near_words(vocab, parts, group)), "spelling-forms")
    return (
        vocab.join(forms, "word", "left")
        .join(roots_of(forms), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
    )


def variants_in_texts(docs: DataFrame, letters: str, least_length: int, slip_every: int) -> DataFrame:
    """``variants`` of the words of whole texts, with slips put in: see ``with_slips``.

    A null id is written as nothing, null and empty texts have no words, and each of repeated
    rows counts. Columns other than doc_id and text are not read.
    """
    words = with_slips(runs_of(docs, letters, least_length), slip_every)
    return variants(stage(vocabulary(words, least_length), "spelling-words"))
