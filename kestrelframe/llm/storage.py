"""The library's shared-folder helpers for this subpackage, which also bound Arrow batches in bytes.

By default Spark sends Python 10,000 rows at a time, whatever their size: 34 MB of
ordinary documents, and any amount of long ones. Every task holds a batch several
times over (JVM, pipe, worker), so batches of texts end at ``BATCH_BYTES`` here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import storage
from ..storage import create_text, exists, names, read_text, remove, scratch, shared_dir

BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

__all__ = ["bounded", "create_text", "exists", "materialise", "names", "read_text", "remove", "scratch", "shared_dir", "table"]


def bounded(spark: SparkSession) -> None:
    """Lower the session's limit to ``BATCH_BYTES`` unless it is lower already."""
    if int(spark.conf.get(_LIMIT, str((1 << 31) - 1))) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def materialise(df: DataFrame, label: str) -> DataFrame:
    bounded(df.sparkSession)
    return storage.materialise(df, label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return storage.table(spark, sf_dir, name)
