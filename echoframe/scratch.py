"""Intermediate tables: written to a folder that the driver and all executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir. Where that is unset, a temporary one in local mode; elsewhere
    that is an error, as executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _own.setdefault(app, tempfile.mkdtemp(prefix="echoframe-"))
    return f"{named.rstrip('/')}/sequences-{app}"


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table of its own: what reads it several times computes it once, and lineage ends there. With columns to
    divide it by, what asks for a value of these reads its files alone."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
