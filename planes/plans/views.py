"""Telemetry-shaped views over the driver's tables.

Each view is a source and a list of column expressions in the SQL both engines share, so
the same text makes the Spark view and, with ``render``, the checking engine's one. The
few names that differ are tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from planes.operators.events import Redaction, TypePolicy

TOKENS = {
    "spark": {"{S}": "string", "{BYTES}": "octet_length(text)", "{SHA}": "sha2(text, 256)"},
    "duckdb": {"{S}": "varchar", "{BYTES}": "octet_length(encode(text))", "{SHA}": "sha256(text)"},
}

# name -> (source, columns, filter); a source is a table or an earlier view.
VIEWS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "v_events": (
        "events",
        {
            "city": "concat('c', cast(user_id % 5 as {S}))",
            "seq": "event_id + 1",
            "type": "case event_type when 'signup' then 'bead.created' when 'purchase' then 'bead.closed' "
            "when 'error' then 'mail.sent' when 'view' then 'order.completed' else 'bead.updated' end",
            "ts": "ts",
            "actor": "concat('user', cast(user_id as {S}), '@corp.example')",
            "subject": "case event_type when 'purchase' then concat('mc-', cast(event_id as {S})) "
            "when 'view' then concat('slug ', cast(event_id as {S})) else '' end",
            "run_id": "case when event_id % 4 = 0 then '' else concat('mc-run', cast(event_id % 97 as {S})) end",
            "session_id": "concat('mc-s', cast(user_id as {S}))",
            "step_id": "case when event_id % 6 = 0 then '' else concat('step', cast(event_id % 11 as {S})) end",
            "payload": """concat('{"bead":{"title":"T', cast(event_id as {S}), '","metadata":{"gc.root_bead_id":"mc-fb', """
            """cast(event_id % 13 as {S}), '","gc.step_id":"fs', cast(event_id % 7 as {S}), """
            """case when event_id % 10 = 0 then concat('","gc.formula_name":"named-', cast(event_id % 3 as {S})) else '' end, """
            """'","gc.step_ref":"mol-form-', cast(event_id % 9 as {S}), '.apply"}}}')""",
        },
        None,
    ),
    "v_usage": (
        "conversations",
        {
            "source_id": "concat('city-', cast(conv_id % 4 as {S}))",
            "line_no": "conv_id * 100 + turn",
            "run_id": "concat('run-', cast(conv_id as {S}))",
            "session_id": "concat('sess-', cast(conv_id as {S}))",
            "step_id": "concat('step-', cast(turn as {S}))",
            "kind": "case role when 'assistant' then 'model' else 'compute' end",
            "model": "concat('m', cast(conv_id % 3 as {S}))",
            "input_tokens": "cast(length(text) as bigint)",
            "output_tokens": "cast(turn * 7 as bigint)",
            "cost_usd_estimate": "cast(length(text) as double) / 1024",
        },
        None,
    ),
    "v_docs": (
        "documents",
        {
            "doc_id": "doc_id",
            "source_id": "source",
            "text": "text",
            "size": "cast({BYTES} as bigint)",
            "sha256_hex": "{SHA}",
            "h": "md5(cast(doc_id as {S}))",
            "provider": "case doc_id % 3 when 0 then 'claude' when 1 then 'codex' else 'gemini' end",
            "root": "case doc_id % 3 when 0 then '/home/u/.claude/projects' "
            "when 1 then '/home/u/.codex/sessions' else '/home/u/.gemini/tmp' end",
        },
        None,
    ),
    "v_named": (
        "v_docs",
        {
            "doc_id": "doc_id",
            "source_id": "source_id",
            "provider": "provider",
            "root": "root",
            "base": "case doc_id % 10 "
            "when 0 then concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12),'.jsonl') "
            "when 1 then concat('agent-', substr(h,1,10), '.jsonl') "
            "when 2 then concat('rollout-', cast(doc_id as {S}), '.jsonl') "
            "when 3 then 'settings.json' "
            "when 4 then concat('x-token-', cast(doc_id as {S}), '.JSON') "
            "when 5 then concat('weird-', cast(doc_id as {S}), '.jsonl') "
            "when 6 then concat('.hidden', cast(doc_id as {S}), '.jsonl') "
            "when 7 then concat('log', cast(doc_id as {S}), '.json') "
            "when 8 then concat('notes', cast(doc_id as {S}), '.txt') "
            "else concat('history-', cast(doc_id as {S}), '.jsonl') end",
            "content": "text",
            "size": "size",
            "sha256_hex": "sha256_hex",
        },
        None,
    ),
    "v_snap": (
        "v_named",
        {
            "doc_id": "doc_id",
            "source_id": "source_id",
            "provider": "provider",
            "root": "root",
            "path": "concat(root, '/p', cast(doc_id % 17 as {S}), '/', base)",
            "base": "base",
            "content": "content",
            "size": "size",
            "sha256_hex": "sha256_hex",
            "mtime_ms": "1700000000000 + doc_id * 1000",
        },
        None,
    ),
    # One file per path: settings files, whose name repeats, have a directory each.
    "v_files": (
        "v_snap",
        {
            c: "case when base = 'settings.json' then concat(root, '/d', cast(doc_id as {S}), '/', base) else path end" if c == "path" else c
            for c in ("doc_id", "source_id", "provider", "root", "path", "content", "size", "sha256_hex", "mtime_ms")
        },
        None,
    ),
    "v_cursor": (
        "(select distinct city from v_events)",
        {"city": "city", "seq": "1000 * (1 + cast(substr(city, 2) as bigint))"},
        "city <> 'c4'",
    ),
    "v_usage_cursor": (
        "(select distinct source_id from v_usage)",
        {
            "source_id": "source_id",
            "offset": "2000 * (1 + cast(substr(source_id, 6) as bigint))",
            "next_seq": "5 * (1 + cast(substr(source_id, 6) as bigint)) + 1",
        },
        "source_id <> 'city-3'",
    ),
    "v_hwm": (
        "(select distinct source_id from v_usage)",
        {"source_id": "source_id", "hwm": "10 * cast(substr(source_id, 6) as bigint)"},
        "source_id <> 'city-3'",
    ),
    "v_state": (
        "v_files",
        {
            "path": "path",
            "status": "case when doc_id % 7 = 0 then 'rejected' else 'sent' end",
            "sha256_hex": "case when doc_id % 5 = 0 then concat('x', sha256_hex) else sha256_hex end",
            "mtime_ms": "case when doc_id % 3 = 0 then mtime_ms - 1000 else mtime_ms end",
            "size": "size",
            "code": "case when doc_id % 7 = 0 then 422 end",
        },
        "doc_id % 4 <> 0",
    ),
    "v_receipt": (
        "v_files",
        {
            "path": "path",
            "http_status": "case doc_id % 5 when 0 then 201 when 1 then 200 when 2 then 422 "
            "when 3 then 503 else cast(null as int) end",
        },
        None,
    ),
    "v_ledger": (
        "customer",
        {
            "source_id": "concat('city-', cast(c_custkey as {S}))",
            "file_id": "c_custkey % 3",
            "size": "cast(floor(abs(c_acctbal) * 10) as bigint)",
            "cur_offset": "cast(c_nationkey as bigint) * 1000",
            "cur_file_id": "c_custkey % 2 + 1",
            "next_seq": "c_custkey % 50",
        },
        None,
    ),
    "v_roots": (
        "documents",
        {
            "doc_id": "doc_id",
            "root": "case doc_id % 6 when 0 then concat('/home/u', cast(doc_id as {S}), '/.claude/projects') "
            "when 1 then concat('/home/u', cast(doc_id as {S}), '/.codex/sessions') "
            "when 2 then concat('/home/u', cast(doc_id as {S}), '/.gemini') "
            "when 3 then concat('/tmp/random', cast(doc_id as {S})) "
            "when 4 then concat('/home/u', cast(doc_id as {S}), '/Documents') "
            "else concat('/srv/', cast(doc_id as {S}), '/.codexx/sessions') end",
        },
        None,
    ),
    "v_odd_paths": (
        "v_snap",
        {
            "doc_id": "doc_id",
            "root": "root",
            "path": "case doc_id % 7 when 0 then concat(root, '/p/', base) when 1 then concat(root, 'x/', base) "
            "when 2 then concat(root, '/../', base) when 3 then concat('/etc/', base) when 4 then root "
            "when 5 then concat(root, '/p/.gemini/tmp/.codex/q/', base) else concat('/home/u/.claudette/', base) end",
        },
        None,
    ),
    "v_city_config": (
        "customer",
        {
            "c_custkey": "c_custkey",
            "raw": "concat('c', cast(c_custkey % 7 as {S}), ', c', cast(c_custkey % 3 as {S}), ' c', "
            "cast(c_custkey % 7 as {S}), chr(10), 'd', cast(c_custkey % 5 as {S}), ',, c', cast(c_custkey % 3 as {S}))",
        },
        None,
    ),
}

POLICY = TypePolicy.from_mapping({
    "bead.created": (True, True),
    "bead.closed": (True, True),
    "order.completed": (True, False),
    "mail.sent": (False, False),
})
SALT = "planes-fixture-salt"
REDACTION = Redaction(salt=SALT, export_ref=True)


def render(text: str, engine: str) -> str:
    for token, word in TOKENS[engine].items():
        text = text.replace(token, word)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    source, columns, where = VIEWS[name]
    if source.startswith("(select distinct "):
        column, inner = source.removeprefix("(select distinct ").rstrip(")").split(" from ")
        df = view(spark, sf_dir, inner).select(column).distinct()
    else:
        df = view(spark, sf_dir, source)
    if where:
        df = df.filter(render(where, "spark"))
    return df.selectExpr(*[f"{render(e, 'spark')} as `{c}`" for c, e in columns.items()])


def view_sql(name: str) -> str:
    source, columns, where = VIEWS[name]
    body = ", ".join(f'{e} as "{c}"' for c, e in columns.items())
    alias = " as src" if source.startswith("(") else ""
    text = f"select {body} from {source}{alias}" + (f" where {where}" if where else "")
    return render(text, "duckdb")


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_usage`` as ledger lines, some of them undecodable in different ways."""
    v = view(spark, sf_dir, "v_usage")
    good = F.concat(
        F.lit('{"run_id":"'), "run_id", F.lit('","session_id":"'), "session_id",
        F.lit('","step_id":"'), "step_id", F.lit('","kind":"'), "kind",
        F.lit('","model":"'), "model", F.lit('","provider":null,"city":"dropped","input_tokens":'),
        "input_tokens", F.lit(',"output_tokens":'), "output_tokens",
        F.lit(',"cost_usd_estimate":'), "cost_usd_estimate", F.lit(',"unpriced":'),
        (F.col("line_no") % 2 == 0).cast("string"), F.lit(',"at":'), F.col("line_no") + 1700000000000,
        F.lit("}"),
    )
    line = (
        F.when(F.col("line_no") % 11 == 3, "not json at all")
        .when(F.col("line_no") % 11 == 5, F.replace(good, F.lit('"provider":null'), F.lit('"provider":5')))
        .when(F.col("line_no") % 11 == 7, F.concat(good, F.lit(" trailing}")))
        .when(F.col("line_no") % 11 == 9, " \t")
        .when(F.col("line_no") % 13 == 1, F.replace(good, F.lit('"at":'), F.lit('"at":1.5,"x":')))
        .otherwise(good)
    )
    return v.select("source_id", "line_no", line.alias("line"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_events`` as JSON frames, some malformed or with an unusable time."""
    v = view(spark, sf_dir, "v_events")
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = (
        F.when(F.col("seq") % 17 == 5, wall)
        .when(F.col("seq") % 17 == 7, "")
        .when(F.col("seq") % 17 == 8, "2024-02-30T00:00:00Z")
        .otherwise(F.concat(wall, F.lit("Z")))
    )
    sign = F.when(F.col("seq") % 17 == 9, "-").otherwise("")
    actor = F.when(F.col("seq") % 17 == 11, '{"name":"x"}').otherwise(
        F.concat(F.lit('"'), "actor", F.lit('"'))
    )
    good = F.concat(
        F.lit('{"seq":'), sign, "seq", F.lit(',"type":"'), "type", F.lit('","ts":"'), stamp,
        F.lit('","actor":'), actor, F.lit(',"subject":"'), "subject",
        F.lit('","run_id":"'), "run_id", F.lit('","session_id":"'), "session_id",
        F.lit('","step_id":"'), "step_id", F.lit('","message":"free text","payload":'), "payload", F.lit("}"),
    )
    line = F.when(F.col("seq") % 17 == 3, "{not json}").otherwise(good)
    return v.select("city", line.alias("line"))


def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_events`` as captured stream lines: comments, repeated, cleared and open frames."""
    v = view(spark, sf_dir, "v_events").select("city", "seq")
    data = F.concat(F.lit("data: e"), F.col("seq").cast("string"))
    lines = F.array(
        F.lit(": heartbeat"),
        F.concat(F.lit("id: "), F.col("seq").cast("string")),
        F.when(F.col("seq") % 5 == 0, "data: replaced"),
        F.when(F.col("seq") % 3 == 0, F.concat(data, F.lit("\r"))).otherwise(data),
        F.when(F.col("seq") % 7 == 0, "data:"),
        F.lit("retry: 1000"),
        # Without its blank line a frame runs on into the next one.
        F.when(F.col("seq") % 13 == 4, None).when(F.col("seq") % 2 == 0, "\r").otherwise(""),
    )
    exploded = v.select("city", "seq", F.posexplode(lines).alias("k", "line"))
    return exploded.filter(F.col("line").isNotNull()).select(
        "city", (F.col("seq") * 8 + F.col("k")).alias("pos"), "line"
    )
