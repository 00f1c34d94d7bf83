"""Tables and views as streams of files, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import fresh_path
from ..sources.views import VIEWS


def stream_view(spark: SparkSession, sf_dir: str, name: str, table: str, files: int | None = None) -> DataFrame:
    """A view over one table, whose files come as a stream: ``files`` of them a micro-batch, else all."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # as a pattern, which may be of one file or of a folder of files
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{table}.parque[t]")
    source = f"stream_{uuid.uuid4().hex}"
    stream.createOrReplaceTempView(source)
    rows = spark.sql(VIEWS[name].format_map({table: source}))
    spark.catalog.dropTempView(source)
    return rows


def drained(stream: DataFrame, seconds: int = 3600) -> DataFrame:
    """All rows of an append stream once its input is read to the end, from the files that it wrote."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError("the stream did not end")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(path)
