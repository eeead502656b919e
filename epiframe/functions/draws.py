"""Reproducible random draws inside tasks, from hashes of rows: a rerun or another partitioning gives the same numbers."""

from __future__ import annotations

import numpy as np


def uniforms(keys: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """``n`` numbers between 0 and 1 for every 64-bit key, as rows."""
    lanes = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + 17)
    x = np.asarray(keys).astype(np.int64).view(np.uint64)[:, None] ^ lanes[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x2545F4914F6CDD1D)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def poisson(keys: np.ndarray, means: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """``n`` Poisson draws for every key with its mean: by inversion up to a mean of 30, beyond that a rounded normal with its skewness put right."""
    means = np.asarray(means, float)
    out = np.zeros((len(means), n))
    small = means <= 30
    u, m = uniforms(np.asarray(keys)[small], n, seed), means[small][:, None]
    k, p = np.zeros(u.shape), np.exp(-m)
    total, step = p.copy(), 0
    while (over := u > total).any() and step < 200:
        step += 1
        k += over
        p = p * m / step
        total = total + p
    out[small] = k
    if not small.all():
        a, b = (uniforms(np.asarray(keys)[~small], n, seed + s) for s in (1, 2))
        z, m = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b), means[~small][:, None]
        out[~small] = np.maximum(0, np.rint(m + z * np.sqrt(m) + (z * z - 1) / 6))
    return out


def normals(keys: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """``n`` standard normal draws for every key."""
    return np.sqrt(-2 * np.log(uniforms(keys, n, seed))) * np.cos(2 * np.pi * uniforms(keys, n, seed + 1))
