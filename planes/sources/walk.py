"""Listings of directory trees, walked by executors.

Directories are dealt out to tasks, each of which walks its own until it has seen so many
entries; what it has not come to yet is dealt out again in the next round. So a tree of any
shape is spread over the cluster, and the driver sees the roots alone. Entries are taken as
they are: links are not followed, and names may begin with a dot or an underscore. The paths
must be visible to every executor, as on a shared mount.
"""

from __future__ import annotations

import os
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from planes.schemas import LISTING
from planes.session import shared_dir

# Entries a task looks at before it hands directories back.
ENTRIES = 200_000
# Rows per batch.
ROWS = 8192

FOUND = "root_no int, root string, path string, is_dir boolean, size long, mtime_ms long"


def list_tree(spark: SparkSession, roots: list[str], source_id: str, *, entries: int = ENTRIES, folder: str | None = None) -> DataFrame:
    """Listing of every regular file below ``roots``: metadata only, no content is opened.

    A root may be a link and counts as what it leads to; below it links, to files or to
    directories, are passed over, and a directory that is not where its path says it is, as
    when a link took its place meanwhile, is not entered. So no path leaves its root. Roots
    that are missing or no directories, entries that can't be read, and names that are not
    UTF-8 are passed over. A file below several roots appears once per root.
    """
    folder = f"{folder or shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    todo = spark.createDataFrame(list(enumerate(roots)), "root_no int, path string").select(
        "root_no", F.lit(None).cast("string").alias("root"), "path"
    )
    rounds, left = 0, len(roots)
    tasks = spark.sparkContext.defaultParallelism
    while left:
        found = todo.repartition(min(left, 4 * tasks)).mapInArrow(_walker(entries), FOUND)
        # Rounds are written, so a lost executor costs no second walk of what is listed.
        found.write.parquet(f"{folder}/round={rounds:05d}")
        done = spark.read.schema(FOUND).parquet(f"{folder}/round={rounds:05d}")
        todo = done.filter("is_dir").select("root_no", "root", "path")
        rounds, left = rounds + 1, todo.count()
    schema = f"{FOUND}, round int"
    rows = spark.read.schema(schema).parquet(folder) if rounds else spark.createDataFrame([], schema)
    files = rows.filter("not is_dir").withColumns({"source_id": F.lit(source_id), "is_symlink": F.lit(False)})
    return files.select(*LISTING.names)


def _walker(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for row in batch.to_pylist():
                root = row["root"]
                if root is None:  # a root itself
                    root = os.path.realpath(row["path"])
                    if not os.path.isdir(root):
                        continue
                todo, out = [root if row["root"] is None else row["path"]], []
                while todo:
                    if seen >= entries:
                        out += [(path, True, None, None) for path in todo]
                        break
                    for entry in _entries(todo.pop()):
                        seen += 1
                        if entry[1]:
                            todo.append(entry[0])
                        else:
                            out.append(entry)
                        if len(out) >= ROWS:
                            yield _batch(row["root_no"], root, out)
                            out = []
                yield _batch(row["root_no"], root, out)

    return run


def _entries(directory: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """(path, is_dir, size, mtime_ms) of what lies in a directory and is no link."""
    if os.path.realpath(directory) != directory:
        return
    try:
        with os.scandir(directory) as found:
            for entry in found:
                try:
                    entry.path.encode()
                    what = entry.stat(follow_symlinks=False)
                except (OSError, UnicodeEncodeError):
                    continue
                if stat.S_ISDIR(what.st_mode):
                    yield entry.path, True, None, None
                elif stat.S_ISREG(what.st_mode):
                    yield entry.path, False, what.st_size, what.st_mtime_ns // 1_000_000
    except OSError:
        return


def _batch(root_no: int, root: str, rows: list[tuple]) -> pa.RecordBatch:
    paths, dirs, sizes, times = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict({
        "root_no": pa.array([root_no] * len(rows), pa.int32()),
        "root": pa.array([root] * len(rows), pa.string()),
        "path": pa.array(paths, pa.string()),
        "is_dir": pa.array(dirs, pa.bool_()),
        "size": pa.array(sizes, pa.int64()),
        "mtime_ms": pa.array(times, pa.int64()),
    })
