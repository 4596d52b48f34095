"""The folder that a cluster shares, and spreading what one task would read alone."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import storage

#: Input of a task that is worth no spreading.
TASK = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may do without one; it gets a temporary folder, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chunkwise-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder; what is written there, and beside it under names that begin with it, goes when the program ends."""
    if not _made:
        atexit.register(lambda: [storage.delete_all(p) for p in _made])
    _made.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def spread(table: DataFrame) -> DataFrame:
    """Rows of small files dealt out to all cores; a table with enough bytes for every core is left as it is, without an exchange.

    For tables as they are read. A file has at least a task for each of its row groups, but a small one may have a single row group.
    """
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return table.repartition(cores) if size < cores * TASK else table
