"""One query per operator over its whole table, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from planes.llm import chat, decontaminate, exact_dedup, html_text, line_dedup, mixing, ngram_join, phrases, pieces, quality, sharding, spelling, substring_dedup
from planes.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


ORACLE["op8_exact_dedup"] = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
  from documents
)
select doc_id,
  first_value(doc_id) over (partition by body order by length(t) desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
  count(*) over (partition by body) as group_size,
  row_number() over (partition by body order by length(t) desc, doc_id) = 1 as kept,
  sha256(body) as text_sha256
from d
"""


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


# Links are found by the rarest shingles of each set: similar sets share one of their first.
ORACLE["op10_ngram_join"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), g as (
  select doc_id, unnest(case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as gram
  from w
), n as (select doc_id, count(*) as n from g group by 1),
f as (select gram, count(*) as df from g group by 1),
ranked as (
  select doc_id, gram, row_number() over (partition by doc_id order by df, gram) as r from g join f using (gram)
), prefix as (
  select doc_id, gram, n from ranked join n using (doc_id) where r <= n - (90 * n + 99) // 100 + 1
), pairs as (
  select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from prefix a join prefix b using (gram)
  where a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), links as (
  select p.a, p.b from pairs p join g x on x.doc_id = p.a join g y on y.doc_id = p.b and y.gram = x.gram
  group by p.a, p.b, p.na, p.nb having 100 * count(*) >= 90 * (p.na + p.nb - count(*))
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reach r join (select a, b from links union all select b, a from links) l on l.a = r.b
)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from (select a as doc_id, min(b) as component_id from reach group by 1) left join n using (doc_id)
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.cut(table(spark, sf_dir, "documents"), min_words=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op9_substring_dedup"] = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select doc_id, unnest(range(1, len(ws) - 11)) as i, ws from w
), v as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as win from s
), f as (
  select win, min(doc_id) as first_doc from v group by win
), gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as pos from v join f using (win) where first_doc < doc_id
), p as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w
), k as (
  select p.doc_id, string_agg(word, ' ' order by p.pos) as kept
  from p left join gone g on g.doc_id = p.doc_id and g.pos = p.pos where g.pos is null group by 1
), n as (select doc_id, count(*) as n from gone group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join n using (doc_id) left join k using (doc_id)
"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_log(chat.log_of_turns(turns)))


ORACLE["op1_chat_format"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), m as (
  select *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') as escaped from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn)) as loss_sha256,
  cast(sum(length('<|im_start|>') + length(role) + length(escaped) + length('<|im_end|>') + 2) as bigint) as formatted_chars
from m group by conv_id
"""


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "ids")
    return pieces.decode(coded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("same"),
    )


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants_in_texts(table(spark, sf_dir, "documents"), letters=r"A-Za-z\u00C0-\u00FF", least_length=7, slip_every=31)


# DuckDB has no CRC-32: its table of 256 entries follows from the polynomial.
ORACLE["op11_spelling"] = r"""
with recursive poly as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t
), runs as (
  select coalesce(cast(doc_id as varchar), '') || ':' as id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents
), hexed as (
  select run, hex(encode(id || run)) as x from runs where length(run) >= 7
), coded as (
  select run, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: cast('0x' || x[i:i + 1] as bigint)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295::bigint), 4294967295::bigint) as h from hexed, poly
), said as (
  select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from coded
), v as (
  select word, count(*) as n from said where length(word) >= 7 group by 1 having count(*) >= 2
), gaps as (
  select word, n, unnest(range(1, length(word) + 1)) as p from v
), cut as (
  select word, n, p, left(word, p - 1) || substr(word, p + 1) as rest from gaps
), near as (
  select a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from cut a join v b on b.word = a.rest
  union
  select b.word, b.n, a.word, a.n from cut a join v b on b.word = a.rest
), ranked as (
  select word, n, other, other_n, count(*) over (partition by word) as n_near,
    row_number() over (partition by word order by other_n desc, other) as r from near
), forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * v.n then other end as form,
    case when other_n >= 10 * v.n then other_n end as form_n
  from v left join ranked r on r.word = v.word and r.r = 1
), roots as (
  select word, word as root, 0 as far from forms
  union
  select r.word, f.form, far + 1 from roots r join forms f on f.word = r.root where f.form is not null
)
select word, form, arg_max(root, far) as root, n, n_near, form_n
from forms join roots using (word) group by word, form, n, n_near, form_n
"""


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which the mix first comes to them; position is null where it never does."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.by_position(mixed.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c.words).alias("taken"),
        F.get("copies", F.lit(0)).position.alias("position"),
    ), "position", "doc_id")


ORACLE["op12_mixing"] = r"""
with d as (
  select doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source
), k as (
  select *, i % 3 as kind, [5, 2, 1][i % 3 + 1] as w, sum(source_size) over () as total from s
), filled as (
  select *, coalesce(sum(2 * source_size) over up, 0) as before, sum(w) over () - coalesce(sum(w) over up, 0) as open from k
  window up as (order by source_size / w, i rows between unbounded preceding and 1 preceding)
), cut as (
  select word, n, p, left(word, p - 1) || substr(word, p + 1) as rest from gaps
), near as (
  select a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from cut a join v b on b.word = a.rest
  union
  select b.word, b.n, a.word, a.n from cut a join v b on b.word = a.rest
), ranked as (
  select word, n, other, other_n, count(*) over (partition by word) as n_near,
    row_number() over (partition by word order by other_n desc, other) as r from near
), forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * v.n then other end as form,
    case when other_n >= 10 * v.n then other_n end as form_n
  from v left join ranked r on r.word = v.word and r.r = 1
), roots as (
  select word, word as root, 0 as far from forms
  union
  select r.word, f.form, far + 1 from roots r join forms f on f.word = r.root where f.form is not null
)
select word, form, arg_max(root, far) as root, n, n_near, form_n
from forms join roots using (word) group by word, form, n, n_near, form_n
"""


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which the mix first comes to them; position is null where it never does."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.by_position(mixed.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c.words).alias("taken"),
        F.get("copies", F.lit(0)).position.alias("position"),
    ), "position", "doc_id")


ORACLE["op12_mixing"] = r"""
with d as (
  select doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source
), k as (
  select *, i % 3 as kind, [5, 2, 1][i % 3 + 1] as w, sum(source_size) over () as total from s
), filled as (
  select *, coalesce(sum(2 * source_size) over up, 0) as before, sum(w) over () - coalesce(sum(w) over up, 0) as open from k
  window up as (order by source_size / w, i rows between unbounded preceding and 1 preceding)
), level as (  -- the first that does not: nothing before it is left to reshare
  select coalesce(arg_min(before, open order by source_size / w, i), 0) as x from filled where false
), cut as (
  -- the sources that do not become full when all before them have
  select min(before) as f, max(open) as w from filled where 2 * source_size * 2 * open > w * (3 * total - 2 * before)
), t as (
  select k.*, coalesce(2 * source_size * 2 * cut.w <= k.w * (3 * total - 2 * cut.f), true) as capped,
    3 * total - 2 * cut.f as rest, 2 * cut.w as parts from k, cut
), u as (
  select *, case when capped then cast(2 * source_size as double) else cast(w * rest as double) / cast(parts as double) end as target from t
), sums as (
  select coalesce(sum(g) filter (kind = 0), 0) as g0, coalesce(sum(g) filter (kind = 1), 0) as g1, coalesce(sum(g) filter (kind = 2), 0) as g2
  from (
    select kind, cast(coalesce(sum(2 * source_size) filter (capped), 0) as double)
      + cast(coalesce(sum(w) filter (not capped), 0) * max(rest) as double) / cast(max(parts) as double) as g from u group by kind
  )
), placed as (
  select doc_id, size, source_size, target, kind, cast(floor(target + 0.5) as bigint) as stop,
    sum(size) over (partition by u.source order by md5(coalesce(cast(doc_id as varchar), '')), doc_id, size rows unbounded preceding) - size as start
  from d join u on d.source is not distinct from u.source
), taken as (
  select *, greatest(0, least(size, stop - start)) as first, greatest(0, least(size, stop - start - source_size)) as second,
    least(1.0::double, cast(start as double) / target) as part from placed
), timed as (
  select *, case kind when 0 then 2.0::double * (part * 2.0::double) / (3.0::double + sqrt(9.0::double + -4.0::double * (part * 2.0::double)))
    when 1 then 2.0::double * (part * 2.0::double) / (2.0::double + sqrt(4.0::double + 0.0::double * (part * 2.0::double)))
    else 2.0::double * (part * 2.0::double) / (1.0::double + sqrt(1.0::double + 4.0::double * (part * 2.0::double))) end as time from taken
)
select doc_id, size, source_size, target, cast(first + second as bigint) as taken,
  case when first > 0 then cast(floor(
    g0 * ((3.0::double * time + -1.0::double * time * time) / 2.0::double)
    + g1 * ((2.0::double * time + 0.0::double * time * time) / 2.0::double)
    + g2 * ((1.0::double * time + 1.0::double * time * time) / 2.0::double)) as bigint) end as position
from timed, sums
"""


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_phrases"] = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p
), g as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from w, (select unnest(range(1, 6)) as k) where len(ws) >= k
), n as (
  select lang, count(*) as n from g where k = 1 group by 1
), f as (
  select lang, k, phrase, count(*) as f from g group by all having count(*) >= 100
), cuts as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as ws, unnest(range(1, k)) as cut from f where k > 1
), s as (
  select c.lang, c.k, c.phrase, a, cut, x.f as l, y.f as r, n,
    cast((1000::hugeint * a * n) // (x.f::hugeint * y.f) as bigint) as score
  from cuts c join n using (lang)
  join f x on x.lang = c.lang and x.phrase = array_to_string(ws[:cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(ws[cut + 1:], ' ')
), best as (
  select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inner_parts as (
  select lang, f, string_split(phrase, ' ') as ws, k, unnest(range(2, k)) as size from f where k > 2
), inside as (
  select lang, f, array_to_string(ws[i:i + size - 1], ' ') as phrase from (select *, unnest(range(1, k - size + 2)) as i from inner_parts)
), kept as (
  select * from best b where not exists (select 1 from inside i where i.lang = b.lang and i.phrase = b.phrase and 100 * i.f >= 100 * b.a)
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000
"""
