"""Feature files as a Spark data source, `clip_features`.

A folder holds <video>/<uid>.npy, each a matrix of tokens. Filters on video_number and node_uid reach the reader, so files
that these rule out are neither opened nor, where values are named, listed; and the schema that is asked for decides whether
files are opened at all. The driver lists the folders of videos; the files in them are listed and read by tasks.

    features.read(spark, root).where("video_number IN (3, 5)")
    features.read(spark, root, "video_number int, node_uid string")   # opens nothing
"""

from __future__ import annotations

import io
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

SCHEMA = "video_number int, node_uid string, path string, n_tokens int, n_dims int, tokens array<array<float>>"
#: Columns that need a file's header or contents.
INSIDE = {"n_tokens", "n_dims", "tokens"}
#: Tasks that a video's files are dealt to, and the tokens after which a task sends what it has read.
SLICES, TOKENS = 4, 20_000
_COMPARE = {ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def matrix(system: fs.FileSystem, path: str) -> np.ndarray:
    """A file's tokens as 32-bit numbers; what is no matrix raises."""
    with system.open_input_stream(path) as f:
        m = np.load(io.BytesIO(f.read()), allow_pickle=False)
    if m.ndim != 2:
        raise ValueError(f"{path} holds no matrix but an array of {m.ndim} dimensions")
    return m.astype("float32")


def as_lists(found: list[np.ndarray]) -> pa.Array:
    """Matrices as an Arrow array of lists of lists, without Python numbers between."""
    rows = [len(m) for m in found]
    widths = np.repeat([m.shape[1] for m in found], rows)
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    flat = np.concatenate([m.ravel() for m in found]) if found else np.empty(0)
    return pa.ListArray.from_arrays(ends(rows), pa.ListArray.from_arrays(ends(widths), pa.array(flat, pa.float32())))


class Share(ds.InputPartition):
    """One of `of` shares of a video's files, or the named ones."""

    def __init__(self, video: int, share: int, of: int, uids: list[str] | None):
        self.video, self.share, self.of, self.uids = video, share, of, uids


class FeatureReader(ds.DataSourceReader):
    def __init__(self, schema, options):
        self.columns = schema.fieldNames()
        self.root, self.suffix = options["path"].rstrip("/"), "." + options.get("suffix", "npy")
        self.slices = int(options.get("slices", SLICES))
        self.named = {"video_number": None, "node_uid": None}
        self.bounds = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in self.named:
                yield f
            elif isinstance(f, (ds.EqualTo, ds.In)):
                values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                values.discard(None)
                before = self.named[column]
                self.named[column] = values if before is None else before & values
            elif type(f) in _COMPARE and column == "video_number":
                self.bounds.append((_COMPARE[type(f)], f.value))
            elif not isinstance(f, ds.IsNotNull):
                yield f

    def partitions(self) -> list[Share]:
        system, root = open_folder(self.root)
        videos = {int(i.base_name) for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and _is_number(i.base_name)} if self.named["video_number"] is None else self.named["video_number"]
        videos = sorted(v for v in videos if all(test(v, bound) for test, bound in self.bounds))
        uids = self.named["node_uid"]
        if uids is not None:
            return [Share(v, 0, 1, sorted(uids)) for v in videos if uids] or [Share(-1, 0, 1, [])]
        return [Share(v, k, self.slices, None) for v in videos for k in range(self.slices)] or [Share(-1, 0, 1, [])]

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(self.root)
        batch, size = [], 0
        for uid in self._uids(system, f"{root}/{part.video}", part):
            m = matrix(system, f"{root}/{part.video}/{uid}{self.suffix}") if INSIDE & set(self.columns) else None
            batch.append((uid, m))
            size += 1 if m is None else 1 + len(m)
            if size >= TOKENS:
                yield self._batch(part.video, batch)
                batch, size = [], 0
        if batch:
            yield self._batch(part.video, batch)

    def _uids(self, system, folder: str, part: Share) -> list[str]:
        if part.uids is not None:
            there = system.get_file_info([f"{folder}/{u}{self.suffix}" for u in part.uids if u and "/" not in u])
        else:
            there = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = (i.base_name for i in there if i.type == fs.FileType.File)
        uids = sorted(n.removesuffix(self.suffix) for n in names if n.endswith(self.suffix) and not n.startswith("."))
        return [u for u in uids if zlib.crc32(u.encode()) % part.of == part.share]

    def _batch(self, video: int, rows: list) -> pa.RecordBatch:
        made = {
            "video_number": lambda: pa.array([video] * len(rows), pa.int32()),
            "node_uid": lambda: pa.array([u for u, _ in rows], pa.string()),
            "path": lambda: pa.array([f"{self.root}/{video}/{u}{self.suffix}" for u, _ in rows], pa.string()),
            "n_tokens": lambda: pa.array([m.shape[0] for _, m in rows], pa.int32()),
            "n_dims": lambda: pa.array([m.shape[1] for _, m in rows], pa.int32()),
            "tokens": lambda: as_lists([m for _, m in rows]),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


class FeatureSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "clip_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(schema, self.options)


def read(spark: SparkSession, root: str, columns: str = SCHEMA, suffix: str = "npy") -> DataFrame:
    """Feature files under a folder, with the columns of SCHEMA that are named. Turns on the session's push-down of filters to
    Python data sources. Files whose folder is no number, and those with a leading dot, are not seen; an empty folder gives
    no rows. All folders of videos and named files must be in a file system that pyarrow opens."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeatureSource)
    return spark.read.format("clip_features").schema(columns).option("suffix", suffix).load(root)


def _is_number(name: str) -> bool:
    return name.isascii() and name.isdigit() and str(int(name)) == name
