"""The same results in SQL for an independent engine, one statement per query."""

from __future__ import annotations

import re

from planes.plans.queries import EVENT_BATCH, MAX_BYTES, USAGE_BATCH
from planes.plans.views import SALT, VIEWS, view_sql

# Views only the statements below use.
HELPERS = {
    "policy": "select * from (values ('bead.created', true, true), ('bead.closed', true, true), "
    "('order.completed', true, false), ('mail.sent', false, false)) p(type, emit_actor, emit_ref)",
    "numbered": "select *, row_number() over (partition by source_id order by line_no) as seq "
    "from v_usage where kind = 'model'",
    "usage_b": f"select *, (seq - 1) // {USAGE_BATCH} as batch_no from numbered",
    "envelopes": f"""
        select e.city, e.seq, e.type, e.ts,
          case when p.emit_actor and e.actor <> '' then substr(sha256(concat('{SALT}', e.actor)), 1, 16)
               else '' end as actor_hash,
          case when p.emit_ref and regexp_full_match(e.subject, '[a-z]{{2,}}-[a-z0-9-]+')
               then e.subject else '' end as ref,
          e.run_id, e.session_id, e.step_id, e.payload
        from v_events e join policy p on e.type = p.type""",
    "event_n": "select *, row_number() over (partition by city order by seq) - 1 as no from envelopes",
    "with_actor": "select n.*, e.actor from envelopes n join v_events e on n.city = e.city and n.seq = e.seq",
    "payloads": """
        select city, seq, run_id, session_id, step_id, type,
          payload::json->'bead'->>'title' as title,
          payload::json->'bead'->'metadata'->>'gc.root_bead_id' as root,
          payload::json->'bead'->'metadata'->>'gc.step_id' as pstep,
          coalesce(payload::json->'bead'->'metadata'->>'gc.formula_name',
            regexp_extract(payload::json->'bead'->'metadata'->>'gc.step_ref', '^mol-([^.]*)', 1)) as formula
        from v_events""",
    "listed": r"""
        select doc_id, source_id, root, path, base, size, mtime_ms, content, sha256_hex, provider
        from v_snap
        where base not like '.%' and lower(base) not in ('credentials.json', '.credentials.json',
          'auth.json', '.claude.json', 'google_accounts.json', 'settings.json', 'config.json', 'mcp.json',
          'mcp_config.json', 'mcp-needs-auth-cache.json', 'stats-cache.json', 'history.jsonl')
        and not (lower(base) like '%mcp%.json' or lower(base) like 'settings%.json' or lower(base) like '%.env'
          or lower(base) like '%token%.json' or lower(base) like '%secret%.json' or lower(base) like '%key%.json')
        and (lower(base) like '%.jsonl' or lower(base) like '%.json')""",
    "shaped": r"""
        select *, case provider
          when 'claude' then regexp_full_match(lower(base),
            '([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|agent-[0-9a-f]+)\.jsonl')
          when 'codex' then lower(base) like 'rollout-%.jsonl'
          else lower(base) like '%.json' and contains(substr(path, length(root) + 2), '/') end as fits
        from listed""",
    "diffed": f"""
        select f.*, s.status,
          case when s.mtime_ms = f.mtime_ms and s.size = f.size then 'unchanged'
               when f.size > {MAX_BYTES} then 'drop'
               when s.sha256_hex = f.sha256_hex and s.status = 'rejected' then 'skip'
               when s.sha256_hex = f.sha256_hex then 'refresh'
               else 'send' end as action
        from v_files f left join v_state s on f.path = s.path""",
    "settled": """
        select d.*, r.http_status,
          case when action <> 'send' then null
               when r.http_status in (200, 201) then 'sent'
               when r.http_status in (400, 401, 403, 404, 409, 413, 415, 422) then 'rejected'
               else 'failed' end as outcome
        from diffed d left join v_receipt r on d.path = r.path""",
    "state_next": """
        select coalesce(s.path, c.path) as path,
          coalesce(case when c.outcome in ('sent', 'rejected') then c.outcome end, s.status) as status,
          case when c.outcome in ('sent', 'rejected') then c.sha256_hex else s.sha256_hex end as sha256_hex,
          coalesce(c.mtime_ms, s.mtime_ms) as mtime_ms, coalesce(c.size, s.size) as size,
          case when c.outcome = 'rejected' then c.http_status when c.outcome = 'sent' then null
               else s.code end as code
        from v_state s full outer join
          (select * from settled where action in ('refresh', 'skip') or outcome in ('sent', 'rejected')) c
          on s.path = c.path""",
    "sent_n": "select *, no // 100 as batch_no from event_n",
}


def _held(batches: str, key: str, skip: int, all_ok: int) -> str:
    """First held seq per key under the receipts of the query of the same name."""
    return f"""
        select {key}, min(seq) as stop from {batches}
        where cast(substr({key}, {skip}) as int) <> {all_ok}
          and batch_no = cast(substr({key}, {skip}) as int)
        group by 1"""


BODIES = {
    "usage_project": """
        select source_id, line_no, run_id, session_id, step_id, '' as worker, kind, model, '' as provider,
          input_tokens, output_tokens, cast(0 as bigint) as cache_read_tokens,
          cast(0 as bigint) as cache_creation_tokens, cost_usd_estimate, line_no % 2 = 0 as unpriced,
          '' as upstream_req_id, line_no + 1700000000000 as at
        from v_usage where line_no % 11 not in (3, 5, 7, 9) and line_no % 13 <> 1""",
    "usage_model_only": "select * from v_usage where kind = 'model'",
    "usage_seq": """
        select n.source_id, n.line_no, n.seq + coalesce(c.next_seq, 1) - 1 as seq, n.run_id
        from numbered n left join v_usage_cursor c on n.source_id = c.source_id""",
    "usage_take": f"""
        select source_id, line_no, next_seq + rn - 1 as seq, run_id from (
          select u.source_id, u.line_no, u.run_id, coalesce(c.next_seq, 1) as next_seq,
            row_number() over (partition by u.source_id order by u.line_no) as rn
          from v_usage u left join v_usage_cursor c on u.source_id = c.source_id
          where u.kind = 'model' and u.line_no >= coalesce(c."offset", 0)) x
        where rn <= {USAGE_BATCH}""",
    "usage_batches": """
        select source_id, batch_no, 1 as schema_version, cast(count(*) as int) as n, min(seq) as first_seq,
          max(seq) as last_seq,
          string_agg(concat_ws('|', seq, run_id, session_id, step_id, model, input_tokens, output_tokens,
            cast(cost_usd_estimate as decimal(38, 12))), ';' order by seq) as body
        from usage_b group by 1, 2""",
    "usage_pass_bound": """
        select source_id, (seq - 1) // 2 as batch_no, cast(count(*) as int) as n, min(seq) as first_seq,
          max(seq) as last_seq
        from numbered where (seq - 1) // 2 < 5 group by 1, 2""",
    "usage_receipt_outcome": """
        select source_id, batch_no, http_status,
          case when http_status between 200 and 299 then 'advance' else 'hold' end as outcome
        from (select source_id, batch_no, case batch_no % 7 when 0 then 200 when 1 then 204 when 2 then 429
            when 3 then 503 when 4 then 400 when 5 then 302 end as http_status
          from (select distinct source_id, (seq - 1) // 3 as batch_no from numbered) b) r""",
    "usage_cursor": f"""
        select u.source_id, coalesce(max(f.seq), 0) + 1 as next_seq,
          case when max(h.stop) is null then max(u.line_no) else max(f.line_no) end as last_position
        from v_usage u left join ({_held('usage_b', 'source_id', 6, 3)}) h on u.source_id = h.source_id
          left join numbered f on u.source_id = f.source_id and u.line_no = f.line_no
            and (h.stop is null or f.seq < h.stop)
        group by 1 having max(h.stop) is null or max(f.line_no) is not null""",
    "ledger_manifest_diff": """
        select source_id, rotated, read_from, greatest(size, read_from) as read_to, read_from < size as has_new,
          greatest(next_seq, 1) as next_seq, case when file_id <> 0 then file_id else cur_file_id end as file_id
        from (select *, case when rotated then 0 else cur_offset end as read_from
          from (select *, (file_id <> 0 and cur_file_id <> 0 and file_id <> cur_file_id)
            or size < cur_offset as rotated from v_ledger) a) b""",
    # An unclosed frame's lines belong to the next blank line of the city.
    "sse_frames": """
        select city, frame_no, data from (
          select city, frame_no, max_by(case when seq % 7 = 0 then '' else concat('e', cast(seq as varchar)) end,
            seq) as data
          from (select city, seq, coalesce(sum(ends) over (partition by city order by seq
                rows between unbounded preceding and 1 preceding), 0)::bigint as frame_no,
              sum(ends) over (partition by city)::bigint as closed
            from (select city, seq, case when seq % 13 = 4 then 0 else 1 end as ends from v_events) a) b
          where frame_no < closed group by 1, 2) c
        where data <> ''""",
    "event_project": """
        select city, seq, type, epoch_us(ts) as ts_micros, actor, subject, run_id, session_id, step_id, payload
        from v_events where seq % 17 not in (3, 5, 7, 8, 9, 11)""",
    "event_resume": """
        select e.city, e.seq, e.type from v_events e left join v_cursor c on e.city = c.city
        where e.seq > coalesce(c.seq, 0)""",
    "event_allowlist": """
        select city, seq, type, ts from v_events where type in (select type from policy)""",
    "event_redact": """
        select city, seq, type, ts, actor_hash, ref, run_id, session_id, step_id, '' as title, '' as formula
        from envelopes""",
    "event_ref_gate": """
        select true as export_ref, city, seq, ref from envelopes
        union all select false, city, seq, '' from envelopes""",
    "event_correlation": """
        select true as emit_correlation, city, seq, run_id, session_id, step_id from envelopes
        union all select false, city, seq, '', '', '' from envelopes""",
    "event_content_lift": """
        select city, seq, title, formula, coalesce(nullif(run_id, ''), root) as run_id,
          coalesce(nullif(step_id, ''), pstep) as step_id
        from payloads where type in (select type from policy)""",
    "event_formula": "select city, seq, formula from payloads",
    "event_id_fallback": """
        select city, seq, coalesce(nullif(run_id, ''), root) as run_id,
          coalesce(nullif(step_id, ''), pstep) as step_id, session_id from payloads""",
    "event_actor_hash": f"""
        select city, seq, substr(sha256(concat('{SALT}', actor)), 1, 16) as actor_hash from v_events""",
    "event_batches": f"""
        select city as city_id, no // {EVENT_BATCH} as batch_no, 1 as schema_version, cast(count(*) as int) as n,
          min(seq) as first_seq, max(seq) as last_seq,
          string_agg(concat_ws('|', seq, type, strftime(ts, '%Y-%m-%d %H:%M:%S'), actor_hash, ref, run_id,
            session_id, step_id), ';' order by seq) as body
        from event_n group by 1, 2""",
    "event_cursor": f"""
        select e.city, max(e.seq) as seq
        from v_events e left join ({_held('sent_n', 'city', 2, 4)}) h on e.city = h.city
        where h.stop is null or e.seq < h.stop group by 1""",
    "event_leak_audit": """
        with vals as (
          select 'redacted' as variant, actor_hash, ref, run_id, session_id, step_id, '' as title from envelopes
          union all
          select 'raw', actor, subject, concat(' ', run_id), session_id, step_id, 'a title' from v_events),
        parts as (
          select variant, unnest([actor_hash, ref, run_id, session_id, step_id, title]) as value from vals)
        select variant, 'envelopes' as check, count(*) as n from vals group by 1
        union all select variant, 'bad_hashes', count(*) filter (where actor_hash <> ''
          and not regexp_full_match(actor_hash, '[0-9a-f]{16}')) from vals group by 1
        union all select variant, 'bad_refs', count(*) filter (where ref <> ''
          and not regexp_full_match(ref, '[a-z]{2,}-[a-z0-9-]+')) from vals group by 1
        union all select variant, 'bad_ids', count(*) filter (where (run_id <> '' and run_id like ' %')) from vals
          group by 1
        union all select variant, 'content_fields', count(*) filter (where title <> '') from vals group by 1
        union all select variant, 'raw_actors', count(*) filter (where value in (select actor from v_events))
          from parts group by 1
        union all select variant, 'forbidden_text', count(*) filter (where contains(value, '@corp.example')
          or contains(value, 'slug ')) from parts group by 1""",
    "event_leak_search": """
        with vals as (
          select 'redacted' as variant, * exclude (actor) from with_actor
          union all
          select 'planted', * exclude (actor) replace (case when seq % 97 = 0 then concat('run-', split_part(actor, '@', 1), '-7')
            when seq % 97 = 1 then concat(actor, '/', run_id) else run_id end as run_id) from with_actor),
        parts as (
          select variant, unnest(['city', 'type', 'actor_hash', 'ref', 'run_id', 'session_id', 'step_id']) as field,
            unnest([city, type, actor_hash, ref, run_id, session_id, step_id]) as value from vals),
        uses as (select variant, field, value, count(*) as uses from parts where value <> '' group by all),
        names as (select actor as name from v_events union select split_part(actor, '@', 1) from v_events)
        select variant, field, name, count(*) as n_values, cast(sum(uses) as bigint) as uses, min(value) as example
        from uses join names on contains(value, name) where name <> '' group by all""",
    "city_list": r"""
        select c_custkey, string_agg(name, '|' order by spot) as cities
        from (select c_custkey, name, min(spot) as spot
          from (select c_custkey, unnest(names) as name, generate_subscripts(names, 1) as spot
            from (select c_custkey, regexp_split_to_array(raw, '[, \t\r\n]+') as names from v_city_config) a) b
          where name <> '' group by 1, 2) c
        group by 1""",
    "snap_deny_names": """
        select doc_id, base from v_snap where base not like '.%' and lower(base) not in ('settings.json')""",
    "snap_deny_globs": """
        select doc_id, base from v_snap where base not like '.%' and lower(base) <> 'settings.json'
          and lower(base) not like '%token%.json'""",
    "snap_suffix": """
        select doc_id, base from v_snap where lower(base) like '%.json' or lower(base) like '%.jsonl'""",
    "snap_contained": """
        select doc_id, (path = root or starts_with(path, concat(root, '/')))
          and not list_contains(string_split(path, '/'), '..') as contained from v_odd_paths""",
    "snap_provider": """
        select doc_id, path, case hit when '.claude' then 'claude' when '.codex' then 'codex' else 'gemini' end
          as provider
        from (select doc_id, path, list_filter(string_split(path, '/')[:-2],
            lambda x: x in ('.claude', '.codex', '.gemini'))[-1] as hit from v_odd_paths) a
        where hit is not null""",
    "snap_candidates": "select doc_id, source_id, root, path, provider, size, mtime_ms from listed",
    "snap_strict": "select doc_id, path, provider from shaped where fits",
    "snap_strict_dropped": """
        select source_id, count(*) filter (where not fits) as strict_dropped from shaped group by 1""",
    "snap_pem_sniff": """
        select doc_id, path from v_files where doc_id % 23 <> 0
          and not starts_with(ltrim(content, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)), '-----BEGIN')""",
    "snap_size_cap": f"select doc_id, path, size from v_files where size <= {MAX_BYTES}",
    "snap_fingerprint": "select path, sha256(content) as sha256 from v_files",
    "snap_manifest": """
        select source_id, provider, concat(provider, substr(path, length(root) + 1)) as source_path,
          concat(provider, substr(path, length(root) + 1)) as provider_session_id,
          cast(octet_length(encode(content)) as bigint) as content_length, sha256(content) as observation_id,
          sha256(content) as sha256, mtime_ms as source_mtime_ms, size as source_size
        from listed where not starts_with(ltrim(content, ' ' || chr(9) || chr(10) || chr(13)), '-----BEGIN')""",
    "snap_path_dedupe": """
        select path, min(case when doc_id % 3 = 0 then 0 else 1 end) as root_no,
          case when bool_or(doc_id % 3 = 0) then regexp_extract(min(root), '^(.*)/[^/]*$', 1)
               else min(root) end as root
        from v_snap group by 1""",
    "snap_diff": "select path, action, size from diffed",
    "snap_outcome": "select path, http_status, outcome from settled where outcome is not null",
    "snap_stats": """
        select source_id, count(*) filter (where outcome = 'sent') as sent,
          count(*) filter (where outcome = 'failed') as failed, count(*) filter (where action = 'skip') as skipped
        from settled group by 1""",
    "snap_state_next": "select * from state_next",
    "snap_no_storm": f"""
        select f.path, case
          when s.mtime_ms = f.mtime_ms + 5 and s.size = f.size then 'unchanged'
          when f.size > {MAX_BYTES} then 'drop'
          when s.sha256_hex = f.sha256_hex and s.status = 'rejected' then 'skip'
          when s.sha256_hex = f.sha256_hex then 'refresh' else 'send' end as action
        from v_files f left join state_next s on f.path = s.path""",
    "roots_unscoped": """
        select doc_id, root from v_roots where doc_id % 6 in (3, 4, 5)""",
    "usage_hwm_dedup": """
        select n.source_id, n.seq, n.run_id from numbered n left join v_hwm h on n.source_id = h.source_id
        where n.seq > coalesce(h.hwm, 0)""",
    "usage_validate": """
        select source_id, line_no, case when line_no % 9 = 0 then 'schema_version'
          when kind <> 'model' then 'kind' else 'accepted' end as verdict from v_usage""",
    "spend_rows": """
        select source_id, seq, run_id, session_id, step_id, model, input_tokens, output_tokens,
          cast(cost_usd_estimate as decimal(38, 12)) as cost_usd, 'estimated' as source from numbered""",
    "step_spend": """
        select e.run_id, e.step_id, e.events, coalesce(s.facts, 0) as facts,
          coalesce(s.input_tokens, 0) as input_tokens, coalesce(s.output_tokens, 0) as output_tokens,
          coalesce(s.cost_usd, 0) as cost_usd
        from (select replace(run_id, 'mc-run', 'run-') as run_id, replace(step_id, 'step', 'step-') as step_id,
            count(*) as events from v_events where run_id <> '' and step_id <> '' group by 1, 2) e
        left join (select run_id, step_id, count(*) as facts, cast(sum(input_tokens) as bigint) as input_tokens,
            cast(sum(output_tokens) as bigint) as output_tokens,
            cast(sum(cast(cost_usd_estimate as decimal(38, 12))) as decimal(38, 12)) as cost_usd
          from v_usage where kind = 'model' group by 1, 2) s
        on e.run_id = s.run_id and e.step_id = s.step_id""",
}


def _needed(text: str) -> list[str]:
    """Views a statement uses, directly or through other views, dependencies first."""
    found: list[str] = []
    for name in re.findall(r"\w+", text):
        body = HELPERS[name] if name in HELPERS else view_sql(name) if name in VIEWS else None
        if body is not None:
            found += [v for v in _needed(body) if v not in found]
            if name not in found:
                found.append(name)
    return found


def statement(name: str) -> str:
    body = BODIES[name]
    ctes = [
        f"{v} as ({HELPERS[v] if v in HELPERS else view_sql(v)})" for v in _needed(body)
    ]
    return f"with {', '.join(ctes)} select * from ({body}) result" if ctes else body
