"""Schemas of the engine's tables, and the checks that readers run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_frames = T.ArrayType(T.ArrayType(T.DoubleType()))
_hand = T.ArrayType(T.StructType([T.StructField("kpts_3d", _frames)]))

KEYPOINTS = T.StructType(
    [
        T.StructField("video_number", T.IntegerType()),
        T.StructField("node_number", T.IntegerType()),
        T.StructField("node_uid", T.StringType()),
        T.StructField("keypoints_per_frame", T.MapType(T.StringType(), T.StructType([T.StructField("L", _hand), T.StructField("R", _hand)]))),
    ]
)
CLIPS = T.StructType([T.StructField("clip_idx", T.LongType()), T.StructField("video_number", T.IntegerType()), T.StructField("node_uid", T.StringType()), T.StructField("frames", _frames), T.StructField("length", T.IntegerType())])
NEIGHBORS = T.StructType([T.StructField("clip_idx", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("neighbor_idx", T.LongType()), T.StructField("dtw_sim", T.DoubleType())])
METRICS = T.StructType([T.StructField("run", T.StringType()), T.StructField("epoch", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])

VERSION = 1


def check_schema(df: DataFrame, want: T.StructType) -> DataFrame:
    """df's columns as `want` names and types them; missing columns raise."""
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in want))


def check_meta(meta: dict, **want) -> None:
    """Raises where an artifact's metadata differ from what is asked for; top_k may be larger."""
    for key, value in want.items():
        got = meta.get(key)
        if key == "top_k":
            if got is None or got < value:
                raise ValueError(f"artifact holds top_k={got}, {value} are needed")
        elif got != value:
            raise ValueError(f"artifact has {key}={got!r}, wanted {value!r}")
