"""Session defaults and the shared folder for data that outlives a stage."""

from __future__ import annotations

import shutil
import tempfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession

# Sizes are per task and do not depend on the input, so they hold at any volume.
# Post-shuffle partitions start high and AQE merges the small ones.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "134217728",
}


def build_session(
    app: str = "planes", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, which byte ranges and file contents are read with."""
    package = Path(__file__).parent
    archive = Path(_local_dir()) / "planes.zip"
    if not archive.exists():
        shutil.make_archive(str(archive.with_suffix("")), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables written between passes.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset in local
    mode, as in tests, is a temporary folder made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path.rstrip('/')}/planes"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="planes-")
