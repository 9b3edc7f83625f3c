"""Tables written between steps: they cut a plan's lineage, outlive executors, and are read by later steps as files."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_standing: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests) a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rastrix-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, which goes with the session or with drop_stored()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rastrix/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _standing.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored() -> None:
    """Deletes the tables, for when all results that read them are written."""
    while _standing:
        spark, path = _standing.pop()
        with contextlib.suppress(Exception):  # Spark may be gone
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(drop_stored)
