"""Cutting lineage through the shared scratch folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from warung.session import scratch_path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and return it read back.

    A lost executor then costs a re-read of files that all executors share,
    never a recomputation of what came before.  Nothing reads the shuffles of
    the write again, so their files go at its end, not when the driver happens
    to collect its garbage.
    """
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._warung_path = path
    return out


def discard(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Remove tables made by ``saved`` that no later plan reads."""
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._warung_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per application,
    so that jobs run where the package is not installed."""
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.getConf().contains(ARROW_ROWS):
        spark.conf.set(ARROW_ROWS, "1000")       # rows may be whole documents: memory follows the batch
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="warung-ship-")) / "warung_ship.zip"   # read by this driver only
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
