"""Reading tables, and tables written between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from planes.session import ship_package

WHITE = r"[\x20\x09-\x0D]"
# Lets Spark remove the shuffle files of an execution as soon as that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of a batch that goes to Python, and its setting. Rows alone, the other limit, say little
# where one row is a text.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def ready(spark: SparkSession) -> None:
    """What every query needs of a session: this package on the executors, a shared folder, and
    a limit on the bytes handed to Python at once, unless the session has one."""
    if not spark.sparkContext.master.startswith("local["):
        ship_package(spark)
    shared_folder(spark)
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(BATCH_BYTES[0], str(BATCH_BYTES[1]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="planes-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_staged: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what follows does not
    compute it twice and a lost executor costs no more than a read. The shuffle files it was
    made from are removed when it has been written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/planes-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _staged.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def staged() -> list[str]:
    """Tables staged by this process that are still there, oldest first."""
    return list(_staged)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes staged tables, once nothing reads them any more."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _staged.remove(path)


def forget(*tables: DataFrame) -> None:
    """Deletes what ``stage`` returned, once all that was made from it has been written."""
    for table in tables:
        release(table.sparkSession, [table.staged_at])


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of up to ``rows``, whose ``text`` has about ``most``
    bytes, so that the arrays made from a piece stay small; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i - start >= rows or total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
