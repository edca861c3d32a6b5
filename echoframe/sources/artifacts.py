"""Artifacts: a Parquet table with a one-row metadata table beside it; and other sources and sinks."""

from __future__ import annotations

import dataclasses
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import METRICS, VERSION, check_meta
from . import features


def write(df: DataFrame, path: str, meta: dict, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/data")
    text = json.dumps(meta | {"schema_version": VERSION}, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("meta string").json(f"{path}/meta").first().meta)


def read(spark: SparkSession, path: str, schema=None, **want) -> tuple[DataFrame, dict]:
    """The table and its metadata, checked against `want` before the table is opened."""
    meta = read_meta(spark, path)
    check_meta(meta, schema_version=VERSION, **want)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/data"), meta


def reuse_or_build(spark: SparkSession, path: str, build, **want) -> tuple[DataFrame, dict, bool]:
    """An artifact that fits `want`, or else the one that build() returns as (table, metadata), written first.
    The last value tells whether it was built."""
    try:
        return (*read(spark, path, **want), False)
    except Exception as e:  # noqa: BLE001  absent or other than asked for
        if not isinstance(e, ValueError) and "PATH_NOT_FOUND" not in str(e):
            raise
    df, meta = build()
    write(df, path, meta)
    return (*read(spark, path, **want), True)


def feature_files(spark: SparkSession, root: str, suffix: str = "npy") -> DataFrame:
    """(video_number, node_uid, path) of the files <root>/<video>/<uid>.<suffix>; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root).select("path")
    part = lambda k: F.regexp_extract("path", rf"/(\d+)/([^/]+)\.{suffix}$", k)
    return files.where(F.col("path").rlike(rf"/\d+/[^/.][^/]*\.{suffix}$")).select(part(1).cast("int").alias("video_number"), part(2).alias("node_uid"), "path")


def with_features(clips: DataFrame, files: DataFrame) -> DataFrame:
    return clips.join(files, ["video_number", "node_uid"], "left_semi")


def require_features(clips: DataFrame, files: DataFrame) -> None:
    missing = clips.join(files, ["video_number", "node_uid"], "left_anti").count()
    if missing:
        raise RuntimeError(f"{missing} clips have no feature file")


def read_features(files: DataFrame) -> DataFrame:
    """The listed files with their token matrices as `tokens`. Each task opens the files of its own rows and no others, so a
    listing that was filtered or joined before reads only what is left of it."""

    def decode(batches):
        for b in batches:
            found = [features.matrix(*features.open_folder(p)) for p in b.column("path").to_pylist()]
            yield b.append_column("tokens", features.as_lists(found))

    schema = T.StructType([*files.schema.fields, T.StructField("tokens", T.ArrayType(T.ArrayType(T.FloatType())))])
    return files.mapInArrow(decode, schema)


def append_metrics(spark: SparkSession, path: str, run: str, epoch: int, values: dict[str, float]) -> None:
    rows = [(run, epoch, k, float(v)) for k, v in sorted(values.items())]
    spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(path)


@dataclasses.dataclass
class Config:
    """Settings of a run. load() takes a YAML file; keys that are no field are ignored."""

    data_dir: str = "data"
    output_dir: str = "output"
    design: str = "abs_21j_coords"
    max_clips: int | None = None
    max_frames: int = 42
    pooling: str = "stats4"
    candidate_k: int = 1000
    top_k: int = 20
    eval_fraction: float = 0.1
    eval_max_clips: int = 10_000
    recall_k: tuple = (1, 5, 10, 20)
    relevance_k: int = 20
    cknna_topk: int = 10
    seed: int = 42
    tau_pred: float = 0.07
    tau_target: float = 0.5
    batch_size: int = 210
    positives_per_anchor: int = 5
    boundary_negatives_per_anchor: int = 0
    pad_policy: str = "random_train"

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            raw: dict[str, Any] = yaml.safe_load(f) or {}
        known = {f.name for f in dataclasses.fields(cls)}
        c = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known})
        root = os.environ.get("ECHOFRAME_ROOT") or os.path.dirname(os.path.abspath(path))
        for k in ("data_dir", "output_dir"):
            if not os.path.isabs(v := getattr(c, k)) and "://" not in v:
                setattr(c, k, os.path.join(root, v))
        return c
