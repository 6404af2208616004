"""Forward pass of the patch transformer in numpy: weights are a plain dict of arrays.

Names: ``in.*`` projection, ``layer{i}.*`` encoder layers (after-norm, ReLU), ``head.*`` and
``area.*``. A projection ``p`` has ``p.{n}.weight`` and ``p.{n}.bias``, with ``p.{n}.scale``
and ``p.{n}.shift`` of the norm after each hidden layer. Weights come from Parquet
(``sources.mesh_files.read_weights``) or, for tests, from a seed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_erf = np.vectorize(math.erf, otypes=[float])


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def normed(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * scale + shift


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def projected(w: dict, name: str, x: np.ndarray) -> np.ndarray:
    """A linear map, or hidden layers of linear map, norm and GELU before it."""
    n = 0
    while f"{name}.{n}.weight" in w:
        x = x @ w[f"{name}.{n}.weight"].T + w[f"{name}.{n}.bias"]
        if f"{name}.{n}.scale" in w:
            x = gelu(normed(x, w[f"{name}.{n}.scale"], w[f"{name}.{n}.shift"]))
        n += 1
    return x


def attended(w: dict, name: str, x: np.ndarray, mask: np.ndarray, heads: int) -> np.ndarray:
    """Self-attention over the real tokens of each patch."""
    b, k, d = x.shape
    q, key, v = (part.reshape(b, k, heads, d // heads).transpose(0, 2, 1, 3) for part in np.split(x @ w[f"{name}.qkv.weight"].T + w[f"{name}.qkv.bias"], 3, 2))
    score = q @ key.transpose(0, 1, 3, 2) / math.sqrt(d // heads)
    score = np.where(mask[:, None, None, :], score, -np.inf)
    score = np.exp(score - score.max(-1, keepdims=True))
    out = (score / score.sum(-1, keepdims=True)) @ v
    return out.transpose(0, 2, 1, 3).reshape(b, k, d) @ w[f"{name}.out.weight"].T + w[f"{name}.out.bias"]


def encoded(w: dict, x: np.ndarray, mask: np.ndarray, heads: int) -> np.ndarray:
    n = 0
    while f"layer{n}.qkv.weight" in w:
        p = f"layer{n}"
        x = normed(x + attended(w, p, x, mask, heads), w[f"{p}.norm1.scale"], w[f"{p}.norm1.shift"])
        hidden = np.maximum(x @ w[f"{p}.ff1.weight"].T + w[f"{p}.ff1.bias"], 0)
        x = normed(x + hidden @ w[f"{p}.ff2.weight"].T + w[f"{p}.ff2.bias"], w[f"{p}.norm2.scale"], w[f"{p}.norm2.shift"])
        n += 1
    return x


def forward(w: dict, features: np.ndarray, positions: np.ndarray, mask: np.ndarray, heads: int, gradient: bool = False, scale_patches: bool = True, scale_areas: bool = True):
    """(weights (b, k), areas (b,), scales (b,), coefficients (b, k, 3) or None) of padded patches.

    Features are divided by the patch's largest distance; areas are scaled back by its square.
    Padded tokens are never attended to, pooled or given a weight.
    """
    far = np.linalg.norm(np.where(mask[..., None], positions, 0), axis=2).max(1)
    scales = np.maximum(far, 1e-8) if scale_patches else np.ones(len(far))
    x = projected(w, "in", features / scales[:, None, None])
    x = encoded(w, x, mask, heads)
    head = projected(w, "head", x)
    if gradient:
        coefficients = np.where(mask[..., None], head, 0.0)
        weights = (coefficients**2).sum(2)
    else:
        coefficients, weights = None, np.where(mask, np.exp(head[..., 0]), 0.0)
    pooled = np.where(mask[..., None], x, 0.0).sum(1) / mask.sum(1, keepdims=True)
    areas = softplus(projected(w, "area", pooled)[:, 0])
    return weights, areas * scales**2 if scale_areas else areas, scales, coefficients


def seeded_weights(seed: int, inputs: int = 3, width: int = 16, layers: int = 2, hidden: int = 32, outputs: int = 1, in_hidden: tuple[int, ...] = (), head_hidden: tuple[int, ...] = ()) -> dict[str, np.ndarray]:
    """Small random weights of the architecture, for tests and demonstrations."""
    rng, w = np.random.default_rng(seed), {}

    def linear(name, a, b):
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.normal(size=(b, a)) / math.sqrt(a), rng.normal(size=b) * 0.1

    def projection(name, a, b, between):
        for n, h in enumerate(between):
            linear(f"{name}.{n}", a, h)
            w[f"{name}.{n}.scale"], w[f"{name}.{n}.shift"], a = np.ones(h), np.zeros(h), h
        linear(f"{name}.{len(between)}", a, b)

    projection("in", inputs, width, in_hidden)
    for i in range(layers):
        linear(f"layer{i}.qkv", width, 3 * width)
        linear(f"layer{i}.out", width, width)
        linear(f"layer{i}.ff1", width, hidden)
        linear(f"layer{i}.ff2", hidden, width)
        for norm in ("norm1", "norm2"):
            w[f"layer{i}.{norm}.scale"], w[f"layer{i}.{norm}.shift"] = np.ones(width), np.zeros(width)
    projection("head", width, outputs, head_hidden)
    projection("area", width, 1, head_hidden)
    return w


def infer(tokens: DataFrame, weights: dict[str, np.ndarray], heads: int, gradient: bool = False) -> DataFrame:
    """(mesh_id, center, rank, neighbor, w, gx, gy, gz, area) of ``operators.patches.padded`` rows.

    Patches of all meshes go through in Arrow batches; only a batch is padded, to its own
    longest patch, and patches of one size take no padding at all.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(weights)
    kind = tokens.schema["mesh_id"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                sizes = part["size"].to_numpy()
                mask = np.arange(sizes.max())[None] < sizes[:, None]
                p = np.zeros((*mask.shape, 3))
                p[mask] = [(t["px"], t["py"], t["pz"]) for row in part.tokens for t in row]
                w, areas, _, g = forward(sent.value, p, p, mask, heads, gradient)
                g = np.zeros(p.shape) if g is None else g
                yield pd.DataFrame({
                    "mesh_id": np.repeat(part.mesh_id.to_numpy(), sizes), "center": np.repeat(part.patch.to_numpy(), sizes),
                    "rank": np.concatenate([np.arange(1, n + 1) for n in sizes]), "neighbor": [t["neighbor"] for row in part.tokens for t in row],
                    "w": w[mask], **{f"g{a}": g[..., i][mask] for i, a in enumerate("xyz")}, "area": np.repeat(areas, sizes),
                })

    return tokens.select("mesh_id", "patch", "size", "tokens").mapInPandas(run, f"mesh_id {kind}, center long, rank int, neighbor long, w double, gx double, gy double, gz double, area double")
