"""The folder that driver and executors share, and what is written there."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="imgrel-")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local_folder(context.applicationId)
    return f"{folder.rstrip('/')}/imgrel-tables-{context.applicationId}"


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: what was computed once stays, whichever executor is lost."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
