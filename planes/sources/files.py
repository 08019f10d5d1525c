"""Transcript files: listings, and the content of the few files that need reading."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from planes.operators.recall import MAX_BYTES

# Bytes of content one Arrow batch may carry before it is handed on.
BATCH_BYTES = 32 << 20


def list_transcripts(spark: SparkSession, roots: list[str], source_id: str) -> DataFrame:
    """Listing of every file below ``roots``: metadata only, no content is opened.

    A file below several roots appears once per root, with the root's position. Hidden
    and underscore-prefixed names and directories are invisible to this listing and links
    look like files; where either matters use ``from_manifest``.
    """
    roots = [r.rstrip("/") for r in roots]
    # A root inside another one is listed along with it.
    outer = [r for r in roots if not any(r.startswith(f"{o}/") for o in roots)]
    known = F.array(*[F.struct(F.lit(n).alias("root_no"), F.lit(r).alias("root")) for n, r in enumerate(roots)])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(dict.fromkeys(outer)))
    listing = files.select(
        F.lit(source_id).alias("source_id"),
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
    )
    above = F.filter(known, lambda k: F.startswith(F.col("path"), F.concat(k["root"], F.lit("/"))))
    return listing.select("*", F.inline(above))


def from_manifest(manifest: DataFrame) -> DataFrame:
    """A listing made elsewhere, which may mark links with ``is_symlink``.

    The way in for many millions of files: the table is read by executors, while a
    directory walk runs on the driver.
    """
    if "is_symlink" in manifest.columns:
        manifest = manifest.filter(~F.coalesce("is_symlink", F.lit(False))).drop("is_symlink")
    return manifest


def read_content(files: DataFrame, *, max_bytes: int = MAX_BYTES, keep: bool = True) -> DataFrame:
    """Open each listed file once, in the task that holds its row.

    Adds ``content`` (unless ``keep`` is false), ``content_length``, ``sha256_hex`` and
    the first bytes as ``head``. Files that are gone or grew past the cap have no row; any
    other failure to read fails the task, which Spark tries again.
    Give it only the files that need reading: ``needs_read`` names them.
    """
    extra = "content_length long, sha256_hex string, head binary" + (", content binary" if keep else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for row in batch.to_dict("records"):
                data = _read_capped(row["path"], max_bytes)
                if data is None:
                    continue
                row |= {
                    "content_length": len(data),
                    "sha256_hex": hashlib.sha256(data).hexdigest(),
                    "head": data[:64],
                }
                if keep:
                    row["content"] = data
                    held += len(data)
                rows.append(row)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows)

    return files.mapInPandas(read, f"{schema}, {extra}")


def _read_capped(path: str, max_bytes: int) -> bytes | None:
    from pyarrow import fs

    try:
        store, where = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        info = store.get_file_info(where)
        if info.type != fs.FileType.File or info.size > max_bytes:
            return None
        with store.open_input_stream(where) as stream:
            data = stream.read(max_bytes + 1)
    except FileNotFoundError:
        return None
    return data if len(data) <= max_bytes else None
