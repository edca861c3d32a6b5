"""What several operators of this package share: shipping code, shared scratch space, Arrow passes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: White space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own_dirs: dict[str, str] = {}
_tables: list[str] = []


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this library where the repository is not on their path, and has Arrow batches of texts
    hold 2000 rows where the session leaves Spark's 10000: a batch of long texts takes that much less memory."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, "2000")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one in local mode, whose
    tasks share the driver's disk; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="echoframe-"))
    return f"{named.rstrip('/')}/echoframe-{app}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there,
    and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """materialize(), in as many buckets of `key` as the session shuffles to: joins on it do not move the table again."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").format("parquet").saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def clear_scratch(spark: SparkSession) -> None:
    """Removes what materialize() and materialize_bucketed() have written in this application."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words_lower(text):
    """Column: the words of a text with A-Z lowered; null text gives an empty array."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, rf"[{SPACE}]+"), lambda w: w != "")


def lower_ascii(s: str) -> str:
    return s.translate(_LOWER) if not s.isascii() else s.lower()


_LOWER = {c: c + 32 for c in range(65, 91)}
