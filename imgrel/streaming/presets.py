"""Presets that may change while a stream runs: read again for each micro-batch, and a bad file keeps the ones before.

Every good version is written once and named by the digest of its file; the
table ``versions`` says in which order they came, so a stream that starts
again goes on with the last good one.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import merge_presets

SCHEMA = "name string, width long, height long, format string"
COLUMNS = ["width", "height", "format"]
_VERSIONS = "number long, digest string, folder string"


class Presets:
    """The last good version of a file of JSON lines, kept below ``state``."""

    def __init__(self, spark: SparkSession, path: str, state: str):
        self.spark, self.path, self.state = spark, path, state.rstrip("/")

    def _last(self):
        try:
            return self.spark.read.schema(_VERSIONS).parquet(f"{self.state}/versions").orderBy(F.desc("number")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _digest(self) -> str | None:
        try:
            row = self.spark.read.format("binaryFile").load(self.path).select(F.sha2("content", 256).alias("digest")).first()
        except (PySparkException, Py4JJavaError):  # no file
            return None
        return row.digest if row else None

    def _load(self, digest: str, number: int) -> bool:
        """Write the file's presets as a version; False if it is malformed, or a name is missing or comes twice."""
        folder = f"{self.state}/presets-{uuid.uuid4().hex}"
        rows = self.spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(self.path)
        try:
            rows.write.parquet(folder)
        except (PySparkException, Py4JJavaError):  # a failed task is not always wrapped
            return False
        kept = self.spark.read.schema(SCHEMA).parquet(folder)
        if not kept.groupBy("name").count().where("name IS NULL OR name = '' OR count > 1").isEmpty():
            return False
        version = self.spark.createDataFrame([(number, digest, folder)], _VERSIONS)
        version.coalesce(1).write.mode("append").parquet(f"{self.state}/versions")
        return True

    def current(self) -> tuple[str | None, DataFrame]:
        """The digest of the version that counts now, and its rows; no rows before the first good one."""
        last, digest = self._last(), self._digest()
        if digest and (last is None or digest != last.digest) and self._load(digest, last.number + 1 if last else 0):
            last = self._last()
        if last is None:
            return None, self.spark.createDataFrame([], SCHEMA)
        return last.digest, self.spark.read.schema(SCHEMA).parquet(last.folder)


def merged_stream(requests: DataFrame, presets: Presets, out: str):
    """Start writing ``requests`` (with preset, width, height, format) with their presets filled in, and ``preset_version``, to ``out``.

    A micro-batch has a folder of its own, so one that is run again replaces
    what it has written.
    """

    def write(batch: DataFrame, number: int) -> None:
        digest, rows = presets.current()
        done = merge_presets(batch, rows, COLUMNS).withColumn("preset_version", F.lit(digest).cast("string"))
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
