"""State tables: cursors and snapshot records, as bases and deltas.

A base is the whole table, bucketed by its key; a delta holds the records one pass or epoch
changed. Writing a delta costs what has changed, however large the table is. After some deltas
they are folded into a new base, and what only older passes would read is deleted. Spark leaves
``_SUCCESS`` in a base or delta once it is whole, so a write that died is never read, and
writing the same version again replaces it: a replayed micro-batch ends in the same state.

What joins a table by its key reads the base as it lies, bucket by bucket: only the other side
is shuffled.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from planes.functions.jsonl import decode_lines
from planes.sources.textlines import existing

_NAME = re.compile(r"(version|delta)=(\d+)(?:\.b(\d+))?$")


@dataclass(frozen=True)
class StateTable:
    """The key is the first column of ``schema``, and never null. ``buckets`` should grow with the table;
    another number counts from the next base on."""

    spark: SparkSession
    path: str
    schema: T.StructType
    buckets: int = 16
    compact_after: int = 16

    @property
    def key(self) -> str:
        return self.schema.fields[0].name

    def versions(self) -> list[int]:
        bases, deltas = self._listing()
        return sorted({*bases, *deltas})

    def read(self, before: int | None = None) -> DataFrame:
        """The table after the newest version, or after the newest below ``before``; none gives no rows."""
        base, changed = self._parts(before)
        if changed is None:
            return base
        return base.join(changed.select(self.key), self.key, "left_anti").unionByName(changed)

    def lookup(self, rows: DataFrame, before: int | None = None, name: str = "prior") -> DataFrame:
        """``rows``, which have the key, with their record's other columns as struct ``name``; null
        where there is none. The base is not shuffled."""
        base, changed = self._parts(before)
        rest = F.struct(*(f.name for f in self.schema.fields[1:]))
        met = rows.join(base.select(self.key, rest.alias(name)), self.key, "left")
        if changed is None:
            return met
        newer = changed.select(self.key, rest.alias("_newer"))
        return met.join(newer, self.key, "left").withColumn(name, F.coalesce("_newer", name)).drop("_newer")

    def upsert(self, rows: DataFrame, version: int | None = None) -> int:
        """Put the records ``rows``, one per key, in place of those of the same keys, as the next
        version, or as ``version``, and return its number.

        A version below the newest is refused: it would hide what the newer ones have settled.
        """
        bases, deltas = self._listing()
        version = self._next(version, bases, deltas)
        if version in bases:  # folded from the delta that is replaced now
            self._delete(self._base_dir(version, bases[version]))
        self._columns(rows).write.mode("overwrite").parquet(self._delta_dir(version))
        since = max((v for v in bases if v < version), default=-1)
        if len({v for v in deltas if v > since} | {version}) >= self.compact_after:
            self.compact()
        return version

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """Write ``rows`` as the whole table, as the next version or as ``version``; see ``upsert``.

        ``rows`` may be computed from an older version, which stays as it is.
        """
        bases, deltas = self._listing()
        version = self._next(version, bases, deltas)
        self._store_base(rows, version)
        if version in deltas:
            self._delete(self._delta_dir(version))
        return version

    def compact(self) -> None:
        """Fold all deltas into a base. The base before and the deltas after it stay, for an
        epoch that runs again; everything older is deleted."""
        bases, deltas = self._listing()
        newest = max({*bases, *deltas}, default=None)
        if newest is None or newest in bases:
            return
        self._store_base(self.read(), newest)
        kept = sorted({*bases, newest})[-2:]
        for v in sorted(bases):
            if v < kept[0]:
                self._delete(self._base_dir(v, bases[v]))
        for v in deltas:
            if v <= kept[0] and len(kept) > 1:
                self._delete(self._delta_dir(v))

    def _listing(self) -> tuple[dict[int, int], set[int]]:
        """Whole bases, with their numbers of buckets (0: none), and whole deltas."""
        jvm = self.spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/*=*/_SUCCESS")
        bases: dict[int, int] = {}
        deltas: set[int] = set()
        for f in done.getFileSystem(self._conf()).globStatus(done) or []:
            if found := _NAME.match(f.getPath().getParent().getName()):
                if found[1] == "delta":
                    deltas.add(int(found[2]))
                else:
                    bases[int(found[2])] = int(found[3] or 0)
        return bases, deltas

    def _parts(self, before: int | None) -> tuple[DataFrame, DataFrame | None]:
        """The base, and the newest records of the deltas after it."""
        bases, deltas = self._listing()
        old = lambda v: before is None or v < before
        at = max(filter(old, bases), default=None)
        base = self.spark.createDataFrame([], self.schema) if at is None else self._open(at, bases[at])
        later = sorted(v for v in deltas if old(v) and (at is None or v > at))
        if not later:
            return base, None
        columns = T.StructType([*self.schema.fields, T.StructField("delta", T.LongType())])
        reader = self.spark.read.schema(columns).option("basePath", self.path)
        rows = reader.parquet(*map(self._delta_dir, later))
        newest = F.max_by(F.struct(*self.schema.names), "delta").alias("_r")
        return base, rows.groupBy(F.col(self.key).alias("_k")).agg(newest).select("_r.*")

    def _next(self, version: int | None, bases: dict[int, int], deltas: set[int]) -> int:
        newest = max({*bases, *deltas}, default=-1)
        if version is None:
            version = newest + 1
        if version < newest:
            raise ValueError(f"version {version} comes after version {newest}; settle passes in order")
        return version

    def _columns(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields))

    def _store_base(self, rows: DataFrame, version: int) -> None:
        where, name = self._base_dir(version, self.buckets), f"planes_state_{uuid.uuid4().hex}"
        self._delete(where)
        by_key = self._columns(rows).repartition(self.buckets, self.key).write.format("parquet")
        # Only tables are bucketed; the name is needed for the writing alone.
        by_key.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", where).saveAsTable(name)
        self.spark.sql(f"drop table {name}")

    def _open(self, version: int, buckets: int) -> DataFrame:
        where = self._base_dir(version, buckets)
        if not buckets:
            return self.spark.read.schema(self.schema).parquet(where)
        name = "planes_state_" + sha256(where.encode()).hexdigest()[:32]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        # Declared anew each time, as a version that is written again has other files.
        self.spark.sql(f"drop table if exists {name}")
        self.spark.sql(
            f"create table {name} ({fields}) using parquet clustered by (`{self.key}`) sorted by (`{self.key}`) "
            f"into {buckets} buckets location '{where.replace(chr(39), chr(92) + chr(39))}'"
        )
        return self.spark.table(name)

    def _base_dir(self, version: int, buckets: int) -> str:
        return f"{self.path}/version={version:010d}" + (f".b{buckets}" if buckets else "")

    def _delta_dir(self, version: int) -> str:
        return f"{self.path}/delta={version:010d}"

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self._conf()).delete(path, True)


def read_json_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """State kept as JSON lines. A missing file is empty and a malformed line no record."""
    if not existing(spark, [path]):
        return spark.createDataFrame([], schema)
    return decode_lines(spark.read.text(path), schema, line="value")
