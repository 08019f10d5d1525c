"""Text files as lines with a total order inside each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SPLIT_PINS = (
    "spark.sql.files.minPartitionNum",
    "spark.sql.leafNodeDefaultParallelism",
    "spark.default.parallelism",
)

LINE_METADATA = ["_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start as block_start"]


def pin_splits(spark: SparkSession) -> None:
    """Make file splits independent of how many executors are alive.

    Blocks number the lines inside them, and a plan may scan a file twice, so both scans
    must cut it at the same bytes.
    """
    if not any(spark.conf.get(name, None) for name in SPLIT_PINS):
        spark.conf.set(SPLIT_PINS[0], str(spark.sparkContext.defaultParallelism))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Columns file_path, file_size, block_start, line_id, line.

    Within a file lines are ordered by (block_start, line_id). Only "\\n" ends a line.
    """
    pin_splits(spark)
    return spark.read.text(paths, lineSep="\n").selectExpr(
        *LINE_METADATA, "monotonically_increasing_id() as line_id", "value as line"
    )


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of finished files as they appear; ``with_line_id`` orders a micro-batch."""
    reader = spark.readStream.option("lineSep", "\n").options(**options)
    return reader.text(path).selectExpr(*LINE_METADATA, "value as line")


def with_line_id(micro_batch: DataFrame) -> DataFrame:
    return micro_batch.withColumn("line_id", F.monotonically_increasing_id())


def complete_lines(lines: DataFrame) -> DataFrame:
    """Drop each file's last line where no newline ends it yet.

    The lines plus one newline each add up to the file's size exactly when the last line
    is ended; otherwise to one byte more. A byte-order mark, which the reader removes,
    makes either three less.
    """
    where = F.struct("block_start", "line_id")
    ends = lines.groupBy("file_path").agg(
        (F.sum(F.octet_length("line") + 1) - F.first("file_size")).alias("_excess"),
        F.max(where).alias("_last"),
    )
    open_ends = ends.filter(F.col("_excess").isin(1, -2)).select(
        "file_path", "_last.block_start", "_last.line_id"
    )
    return lines.join(open_ends, ["file_path", "block_start", "line_id"], "left_anti")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths, globs included, that match at least one file."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def matches(path: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(conf).globStatus(where)
        return found is not None and len(found) > 0

    return [p for p in paths if matches(p)]
