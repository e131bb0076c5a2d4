"""Reproducible noise from keys, so results never depend on partitioning."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """One md5 per tuple; 128 bits, enough for four uniforms."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def uniform(dig: Column, slot: int) -> Column:
    """Uniform in (0, 1) from eight hex digits of a digest; ``slot`` is 0..3."""
    word = F.conv(F.substring(dig, 1 + 8 * slot, 8), 16, 10).cast("double")
    return (word + 0.5) / F.lit(4294967296.0)


def normal_pair(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Two independent standard normals (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(u1))
    angle = F.lit(2.0 * math.pi) * u2
    return radius * F.cos(angle), radius * F.sin(angle)


def normals(dig: Column, k: int) -> list[Column]:
    """Up to four standard normals from one digest."""
    a, b = normal_pair(uniform(dig, 0), uniform(dig, 1))
    c, d = normal_pair(uniform(dig, 2), uniform(dig, 3))
    return [a, b, c, d][:k]


def uniforms_of(seed: int, keys: list[str | None], draws: int) -> np.ndarray:
    """keys x draws x 4: the uniforms of ``digest(seed, key, draw)``, as arrays inside a task."""
    heads = [f"{seed}|" if k is None else f"{seed}|{k}|" for k in keys]
    tails = [str(i) for i in range(draws)]
    raw = b"".join(hashlib.md5((h + t).encode(), usedforsecurity=False).digest() for h in heads for t in tails)
    return (np.frombuffer(raw, ">u4").astype(float).reshape(len(keys), draws, 4) + 0.5) / 4294967296.0


def normals_of(u: np.ndarray, k: int) -> np.ndarray:
    """Up to four standard normals from each four uniforms (last axis)."""
    radius, angle = np.sqrt(-2.0 * np.log(u[..., ::2])), 2.0 * math.pi * u[..., 1::2]
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], -1).reshape(*u.shape[:-1], 4)[..., :k]
