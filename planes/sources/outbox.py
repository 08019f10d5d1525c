"""Outbox and receipts: what is to be delivered, and what became of it.

Delivery itself happens outside Spark. It reads the outbox and appends receipts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from planes.sources.textlines import existing


def store_epoch(rows: DataFrame, root: str, kind: str, epoch: int, *, observe: Observation | None = None, metrics: Sequence[Column] = ()) -> DataFrame:
    """Write ``rows`` as the epoch's table of that kind and read it back.

    Writing an epoch again replaces it, in two phases: the new table is written whole beside
    the old one and takes its place by one note, which readers mind. Whenever a writer dies,
    they see the old table or the new one. What several steps use is computed once, and an
    executor lost later costs only the reading of it. ``metrics`` are taken while writing.

    Folders are renamed, which must be one step, as on HDFS and shared mounts.
    """
    spark, place, name = rows.sparkSession, f"{root}/{kind}", f"epoch={epoch:010d}"
    files = _Folder(spark, place)
    _finish(files)
    for left in files.names():  # by writers that died; a kind has one writer at a time
        if left.startswith("_attempt-"):
            files.delete(left)
    attempt = f"_attempt-{epoch:010d}-{uuid.uuid4().hex}"
    writing = rows.observe(observe, *metrics) if observe is not None else rows
    writing.write.parquet(f"{place}/{attempt}")
    if files.has(name):
        files.note(f"_instead-{epoch:010d}-{attempt.rpartition('-')[2]}")  # the new table counts from here on
        _finish(files)
    else:
        files.rename(attempt, name)
    return read_epoch(spark, root, kind, epoch, rows.schema)


def read_epoch(spark: SparkSession, root: str, kind: str, epoch: int, schema: T.StructType | None = None) -> DataFrame:
    """The epoch's table of that kind, whole."""
    place, name = f"{root}/{kind}", f"epoch={epoch:010d}"
    found = dict(_tables(_Folder(spark, place))).get(epoch, name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{place}/{found}")


class _Folder:
    """Names in a folder, hidden ones included."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._at().getFileSystem(conf)

    def _at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at())) if self.fs.exists(self._at()) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def note(self, name: str) -> None:
        self.fs.create(self._at(name), False).close()

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{self.path}/{old} could not be renamed to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _instead(names: list[str]) -> dict[int, str]:
    """Epochs whose table is another folder than the epoch's, by the notes that say so."""
    notes = (n.split("-") for n in names if n.startswith("_instead-"))
    return {int(epoch): f"_attempt-{epoch}-{run}" for _, epoch, run in notes}


def _finish(files: _Folder) -> None:
    """Put tables that count by a note where they belong, after a writer has died or as one ends."""
    names = files.names()
    for epoch, attempt in _instead(names).items():
        if attempt in names:
            files.delete(f"epoch={epoch:010d}")
            files.rename(attempt, f"epoch={epoch:010d}")
        files.delete(attempt.replace("_attempt-", "_instead-"))


def _tables(files: _Folder) -> list[tuple[int, str]]:
    """(epoch, folder) of the tables that count."""
    names = files.names()
    found = {int(n.partition("=")[2]): n for n in names if n.startswith("epoch=")}
    # Between being renamed and its note's end, a table is where it belongs.
    found |= {epoch: attempt for epoch, attempt in _instead(names).items() if attempt in names}
    return sorted(found.items())


def epoch_path(root: str, kind: str, epoch: int) -> str:
    return f"{root}/{kind}/epoch={epoch:010d}"


def with_body(batches: DataFrame, key: str, name: str, items: str) -> DataFrame:
    """Add ``body``, the JSON text of each batch: its key as ``name``, version and items."""
    wire = F.struct(F.col(key).alias(name), "schema_version", items)
    return batches.withColumn("body", F.to_json(wire))


def read_outbox(
    spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Outbox rows, the newest epoch's where a key was written more than once."""
    tables = _tables(_Folder(spark, path))
    reader = lambda: spark.read if schema is None else spark.read.schema(schema)
    plain = [f"{path}/{name}" for _, name in tables if name.startswith("epoch=")]
    parts = [reader().option("basePath", path).parquet(*plain)] if plain else []
    parts += [
        reader().parquet(f"{path}/{name}").withColumn("epoch", F.lit(epoch)) for epoch, name in tables if not name.startswith("epoch=")
    ]
    if not parts:
        parts = [reader().parquet(path)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    newest = rows.groupBy(*keys).agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, [*keys, "epoch"])


def read_receipts(spark: SparkSession, path: str, keys: T.StructType) -> DataFrame:
    """Receipts by outbox key; the best status counts where delivery was tried again.

    A null status is a transport failure. No receipts at all is an empty table.
    """
    schema = T.StructType([*keys.fields, T.StructField("http_status", T.IntegerType())])
    if not existing(spark, [path]):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(path)
    good = F.min(F.when(F.col("http_status").between(200, 299), F.col("http_status")))
    return rows.groupBy(*[f.name for f in keys.fields]).agg(
        F.coalesce(good, F.max("http_status")).alias("http_status")
    )
