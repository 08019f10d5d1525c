"""Recall plane: transcript listings to snapshots worth sending, and their state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from planes.functions.outcomes import snapshot_outcome
from planes.functions.text import ancestors, base_name, fingerprint, glob_regex, starts_with_key_block

MAX_BYTES = 100 * 1024 * 1024

# Directory of each provider, transcript suffixes, and the names and name
# patterns of credential and configuration files that never leave.
PROVIDER_DIRS = {".claude": "claude", ".codex": "codex", ".gemini": "gemini"}
TRANSCRIPT_SUFFIX = r"\.jsonl?\z"
DENY_NAMES = (
    "credentials.json",
    ".credentials.json",
    "auth.json",
    ".claude.json",
    "google_accounts.json",
    "settings.json",
    "config.json",
    "mcp.json",
    "mcp_config.json",
    "mcp-needs-auth-cache.json",
    "stats-cache.json",
    "history.jsonl",
)
DENY_GLOBS = (
    "*mcp*.json",
    "settings*.json",
    "*.env",
    "*token*.json",
    "*secret*.json",
    "*key*.json",
)

# The transcript shapes of the strict allowlist, on lower-case names and,
# for gemini, the path below the root.
CLAUDE_SHAPE = r"\A([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|agent-[0-9a-f]+)\.jsonl\z"
CODEX_SHAPE = r"(?s)\Arollout-.*\.jsonl\z"
GEMINI_SHAPE = r"\.json\z"


def denied(base: Column, names: Sequence[str] = DENY_NAMES, globs: Sequence[str] = DENY_GLOBS) -> Column:
    lower = F.lower(base)
    return base.startswith(".") | lower.isin(*names) | lower.rlike(glob_regex(tuple(globs)))


def is_transcript(base: Column) -> Column:
    return F.lower(base).rlike(TRANSCRIPT_SUFFIX)


def contained(root: Column, path: Column) -> Column:
    """The path is the root or strictly below it, with no ".." on the way."""
    top = F.regexp_replace(root, "/+$", "")
    inside = (path == top) | F.startswith(path, F.concat(top, F.lit("/")))
    return inside & ~F.array_contains(F.split(path, "/"), "..")


def provider_of(path: Column) -> Column:
    """Provider of the nearest agent directory above the file, null if there is none."""
    known = F.filter(ancestors(path), lambda d: d.isin(*PROVIDER_DIRS))
    nearest = F.try_element_at(known, F.lit(-1))
    label = F.create_map(*[F.lit(x) for pair in PROVIDER_DIRS.items() for x in pair])
    return F.try_element_at(label, nearest)


def below_root(root: Column, path: Column) -> Column:
    return F.substring(path, F.length(F.regexp_replace(root, "/+$", "")) + 2, F.length(path))


def strict_shape(provider: Column, root: Column, path: Column) -> Column:
    base = F.lower(base_name(path))
    return (
        F.when(provider == "claude", base.rlike(CLAUDE_SHAPE))
        .when(provider == "codex", base.rlike(CODEX_SHAPE))
        .when(provider == "gemini", base.rlike(GEMINI_SHAPE) & below_root(root, path).contains("/"))
        .otherwise(False)
    )


def listed(files: DataFrame) -> DataFrame:
    """Files that pass every check of name and place, with their provider.

    Reads only names and paths, never content.
    """
    base = base_name(F.col("path"))
    passed = files.filter(
        ~denied(base) & is_transcript(base) & contained(F.col("root"), F.col("path"))
    )
    return passed.withColumn("provider", provider_of(F.col("path"))).filter(
        F.col("provider").isNotNull()
    )


def shaped(files: DataFrame) -> DataFrame:
    return files.filter(strict_shape(F.col("provider"), F.col("root"), F.col("path")))


def strict_dropped(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many listed files the strict allowlist drops."""
    kept = strict_shape(F.col("provider"), F.col("root"), F.col("path"))
    return files.groupBy(*keys).agg(F.count_if(~kept).alias("strict_dropped"))


def candidates(files: DataFrame, *, strict: bool = False) -> DataFrame:
    """Files in scope. Where ``files`` carries content, key files are dropped as well."""
    found = listed(files)
    if strict:
        found = shaped(found)
    if "content" in files.columns:
        found = found.filter(~starts_with_key_block(F.col("content").cast("binary")))
    return found


def dedupe_paths(files: DataFrame, rank: str = "root_no") -> DataFrame:
    """One row per path, under the first of the overlapping roots that list it.

    Of several listings of a file under one root the newest counts. Takes listings, not
    content: whole rows go through the aggregate.
    """
    # An aggregate, so that copies of a path are reduced before the shuffle.
    rest = [c for c in files.columns if c not in ("path", rank)]
    newest = [-F.col("mtime_ms")] if "mtime_ms" in files.columns else []
    first = F.min_by(F.struct(rank, *rest), F.struct(rank, *newest))
    return files.groupBy("path").agg(first.alias("_f")).select("path", "_f.*")


def within_cap(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files whose listed size and whose bytes both fit; exactly the cap still fits."""
    kept = files.filter(F.col("size") <= max_bytes)
    if "content" in files.columns:
        kept = kept.filter(F.octet_length("content") <= max_bytes)
    return kept


def with_prior(files: DataFrame, state: DataFrame) -> DataFrame:
    prior = state.select(
        "path",
        F.struct("status", "sha256_hex", "mtime_ms", "size").alias("prior"),
    )
    return files.join(prior, "path", "left")


def needs_read(files: DataFrame, state: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files whose content must be read: new or touched, and within the cap."""
    return unread(with_prior(files, state), max_bytes)


def unread(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``needs_read`` of files that carry their ``prior`` record."""
    return files.filter(~_untouched()).filter(F.col("size") <= max_bytes)


def _untouched() -> Column:
    same = (F.col("prior.mtime_ms") == F.col("mtime_ms")) & (F.col("prior.size") == F.col("size"))
    return F.coalesce(same, F.lit(False))


def diff_action(max_bytes: int = MAX_BYTES) -> Column:
    """What to do with a file, given its ``prior`` state and its ``sha256_hex``."""
    same = F.coalesce(F.col("prior.sha256_hex") == F.col("sha256_hex"), F.lit(False))
    return (
        F.when(_untouched(), "unchanged")
        .when(F.col("size") > max_bytes, "drop")
        .when(same & (F.col("prior.status") == "rejected"), "skip")
        .when(same, "refresh")
        .otherwise("send")
    )


def diff(files: DataFrame, state: DataFrame, *, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``action`` to files that carry a ``sha256_hex``."""
    return with_prior(files, state).withColumn("action", diff_action(max_bytes)).drop("prior")


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256_hex", fingerprint(F.col("content").cast("binary")))


def snapshot_manifest(files: DataFrame) -> DataFrame:
    """The metadata sent along with each snapshot."""
    relative = F.concat("provider", F.lit("/"), below_root(F.col("root"), F.col("path")))
    sent = F.octet_length("content") if "content" in files.columns else F.col("content_length")
    return files.select(
        "source_id",
        "provider",
        relative.alias("source_path"),
        relative.alias("provider_session_id"),
        sent.cast("long").alias("content_length"),
        F.col("sha256_hex").alias("observation_id"),
        F.col("sha256_hex").alias("sha256"),
        F.col("mtime_ms").alias("source_mtime_ms"),
        F.col("size").alias("source_size"),
    )


def settle(diffed: DataFrame, receipts: DataFrame) -> DataFrame:
    """Add ``outcome`` of the files that were sent; null for all others."""
    joined = diffed.join(receipts.select("path", "http_status"), "path", "left")
    outcome = F.when(F.col("action") == "send", snapshot_outcome(F.col("http_status")))
    return joined.withColumn("outcome", outcome)


def scan_stats(settled: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Sent, failed and skipped counts. Plainly unchanged files count nowhere."""
    return settled.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == "sent").alias("sent"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("action") == "skip").alias("skipped"),
    )


def _known() -> Column:
    return F.col("action").isin("refresh", "skip")


def _done() -> Column:
    return F.col("outcome").isin("sent", "rejected")


def changing(settled: DataFrame) -> DataFrame:
    """The files whose record a pass changes."""
    return settled.filter(_known() | _done())


def next_state(state: DataFrame, settled: DataFrame) -> DataFrame:
    """State after a pass.

    Content already known keeps its record with the new time and size; sent and rejected
    files replace theirs; failures change nothing; files that vanished are kept.
    """
    known, done = _known(), _done()
    changed = changing(settled).select(
        "path",
        F.when(done, F.col("outcome")).alias("new_status"),
        F.when(done, F.col("sha256_hex")).alias("new_sha256"),
        F.col("mtime_ms").alias("new_mtime"),
        F.col("size").alias("new_size"),
        F.when(F.col("outcome") == "rejected", F.col("http_status")).alias("new_code"),
    )
    if "code" not in state.columns:
        state = state.withColumn("code", F.lit(None).cast("int"))
    return state.join(changed, "path", "full_outer").select(
        "path",
        F.coalesce("new_status", "status").alias("status"),
        F.coalesce("new_sha256", "sha256_hex").alias("sha256_hex"),
        F.coalesce("new_mtime", "mtime_ms").alias("mtime_ms"),
        F.coalesce("new_size", "size").alias("size"),
        F.when(F.col("new_status").isNotNull(), F.col("new_code")).otherwise(F.col("code")).alias("code"),
    )


def unscoped_roots(roots: DataFrame) -> DataFrame:
    """Roots that are neither an agent directory nor below one."""
    parts = F.split("root", "/")
    return roots.filter(~F.exists(parts, lambda d: d.isin(*PROVIDER_DIRS)))
