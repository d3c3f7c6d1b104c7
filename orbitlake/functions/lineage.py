"""Cutting the lineage of iterative jobs in a way that survives lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
#: Spark's setting by which an execution's shuffle files go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``.

    Where a session on one machine has none, a temporary folder is set; elsewhere that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """As ``cut``, for wide or long tables whose order and dealing nobody needs: columns, which take a fraction of a checkpoint's disk.

    Rows of megabytes are kept ``rows_a_file`` (1), as a reader holds many rows of a file at a time.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffles_go(job: Callable[..., T]) -> Callable[..., T]:
    """``job`` (a frame, others), in which what an execution has shuffled goes when it ends, not when the driver happens to collect its garbage.

    For jobs of many executions whose results are counts or tables that ``cut`` or ``stored``
    keeps. A frame that is run again shuffles again. What ``job`` returns runs as the session is set.
    """

    @functools.wraps(job)
    def run(df: DataFrame, *args, **named) -> T:
        conf = df.sparkSession.conf
        before = conf.get(SHUFFLES_GO, "false")
        conf.set(SHUFFLES_GO, "true")
        try:
            return job(df, *args, **named)
        finally:
            conf.set(SHUFFLES_GO, before)

    return run
