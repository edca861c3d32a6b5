"""Model inference: soft-DTW prototypes and the attention head, with weights as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def soft_dtw(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """Soft-minimum DTW on squared Euclidean costs of pairs: x [n, T, D], y [n, L, D]."""
    cost = ((x[:, :, None] - y[:, None]) ** 2).sum(-1)
    n, t, l = cost.shape
    r = np.full((t + 1, l + 1, n), np.inf)
    r[0, 0] = 0
    for i in range(1, t + 1):
        for j in range(1, l + 1):
            z = -np.stack([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]]) / gamma
            top = z.max(0)
            r[i, j] = cost[:, i - 1, j - 1] - gamma * (np.log(np.exp(z - top).sum(0)) + top)
    return r[t, l]


def prototype_activations(x: np.ndarray, w: dict, gamma: float = 0.1, eps: float = 1e-5) -> np.ndarray:
    """[n, nodes]: the negative soft-DTW distance to each prototype over the greater length, batch-normalised
    with stored statistics. x [n, T, D] is padded by repeating its last frame; no mask is used."""
    protos = w["prototypes"]
    if x.shape[2] != protos.shape[2]:
        raise ValueError(f"prototypes have {protos.shape[2]} features, clips {x.shape[2]}")
    a = np.stack([-soft_dtw(x, np.broadcast_to(p, (len(x), *p.shape)), gamma) for p in protos], 1) / max(x.shape[1], protos.shape[1])
    return (a - w["bn.mean"]) / np.sqrt(w["bn.var"] + eps) * w["bn.weight"] + w["bn.bias"]


def layer_norm(x: np.ndarray, weight, bias, eps: float = 1e-5) -> np.ndarray:
    d = x - x.mean(-1, keepdims=True)
    return d / np.sqrt((d**2).mean(-1, keepdims=True) + eps) * weight + bias


def gelu(x: np.ndarray) -> np.ndarray:
    from math import erf, sqrt

    return x * 0.5 * (1 + np.vectorize(erf, otypes=[float])(x / sqrt(2)))


def linear(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def attention(q: np.ndarray, kv: np.ndarray, w: dict, name: str, heads: int, mask: np.ndarray | None) -> np.ndarray:
    """Multi-head cross attention: q [n, Q, D], kv [n, T, D]; mask [n, T] is true for real tokens."""
    n, nq, d = q.shape
    split = lambda a: a.reshape(n, -1, heads, d // heads).transpose(0, 2, 1, 3)
    qh, kh, vh = (split(linear(a, w, f"{name}.{p}")) for a, p in ((q, "q"), (kv, "k"), (kv, "v")))
    s = qh @ kh.transpose(0, 1, 3, 2) / np.sqrt(d // heads)
    if mask is not None:
        s = np.where(mask[:, None, None], s, -np.inf)
    s = np.exp(s - s.max(-1, keepdims=True))
    out = (s / s.sum(-1, keepdims=True)) @ vh
    return linear(out.transpose(0, 2, 1, 3).reshape(n, nq, d), w, f"{name}.out")


def encoding(length: int, dim: int) -> np.ndarray:
    pos, k = np.arange(length)[:, None], np.arange(dim)
    angle = pos * 10000.0 ** (-2 * (k // 2) / dim)
    return np.where(k % 2 == 0, np.sin(angle), np.cos(angle))


def project(x: np.ndarray, mask: np.ndarray | None, w: dict, layers: int, heads: int, positions: bool = True) -> np.ndarray:
    """Unit vectors from token matrices [n, T, D] by learned queries that attend to them."""
    kv = linear(x, w, "input")
    if positions:
        kv = kv + encoding(*kv.shape[1:])
    q = np.broadcast_to(w["query"], (len(x), *w["query"].shape))
    for i in range(layers):
        q = layer_norm(q + attention(q, kv, w, f"{i}.attn", heads, mask), w[f"{i}.norm1.weight"], w[f"{i}.norm1.bias"])
        q = layer_norm(q + linear(gelu(linear(q, w, f"{i}.ffn1")), w, f"{i}.ffn2"), w[f"{i}.norm2.weight"], w[f"{i}.norm2.bias"])
    z = q.reshape(len(x), -1)
    if "combine.weight" in w:
        z = linear(z, w, "combine")
    z = linear(gelu(linear(z, w, "mlp1")), w, "mlp2")
    return z / np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-12)


def random_weights(dim_in: int, dim: int, out: int, layers: int, queries: int, seed: int = 0) -> dict:
    """Weights of the right shapes, for tests and smoke runs."""
    rng = np.random.default_rng(seed)
    w = {"query": rng.normal(size=(queries, dim))}
    shapes = {"input": (dim, dim_in), "mlp1": (dim, dim), "mlp2": (out, dim)} | ({"combine": (dim, queries * dim)} if queries > 1 else {})
    for i in range(layers):
        shapes |= {f"{i}.attn.{p}": (dim, dim) for p in ("q", "k", "v", "out")} | {f"{i}.ffn1": (2 * dim, dim), f"{i}.ffn2": (dim, 2 * dim)}
        w |= {f"{i}.norm{k}.{p}": np.ones(dim) if p == "weight" else np.zeros(dim) for k in (1, 2) for p in ("weight", "bias")}
    for name, shape in shapes.items():
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.normal(size=shape) / np.sqrt(shape[1]), np.zeros(shape[0])
    return w


def encode(clips: DataFrame, run, frames: str = "frames") -> DataFrame:
    """(clip_idx, z): run([n, T, D], mask [n, T]) over Arrow batches, clips padded with zeros to the batch's longest."""

    def each(batches):
        for b in batches:
            rows = [np.array(f, dtype=float) for f in b.column(1).to_pylist()]
            if not rows:
                continue
            t = max(map(len, rows))
            x = np.stack([np.vstack([r, np.zeros((t - len(r), r.shape[1]))]) for r in rows])
            mask = np.arange(t)[None] < np.array([len(r) for r in rows])[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(run(x, mask)), pa.list_(pa.float64()))], names=["clip_idx", "z"])

    return clips.select("clip_idx", frames).mapInArrow(each, "clip_idx long, z array<double>")


def model_input(clips: DataFrame, mode: str) -> DataFrame:
    """(clip_idx, frames) of what a model reads: trajectories or stored features."""
    columns = {"trajectory": "frames", "jepa": "tokens"}
    if mode not in columns:
        raise ValueError(f"unknown input mode {mode!r}; one of {sorted(columns)}")
    return clips.select("clip_idx", F.col(columns[mode]).alias("frames"))


def grand_mean(clips: DataFrame, frames: str = "frames", first: int | None = None) -> DataFrame:
    """(pos, value): the mean over all frames of all clips, or of the first ones by id, from which queries start."""
    clips = clips if first is None else clips.orderBy("clip_idx").limit(first)
    return clips.select(F.explode(frames).alias("f")).select(F.posexplode("f").alias("pos", "x")).groupBy("pos").agg((F.sum("x") / F.count("*")).alias("value"))


def save_weights(path: str, w: dict) -> None:
    np.savez(path, **w)


def load_weights(path: str) -> dict:
    with np.load(path) as f:
        return dict(f)
