"""Numeric features, float layouts, learning-rate schedules and memory models, as expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

GIB = float(1 << 30)
#: Bytes per weight that every rank holds, and that are divided among the ranks.
SHARDING = {"dp": (16, 0), "zero1": (4, 12), "zero2": (2, 14), "zero3": (0, 16)}


def meaning_code(n: Column, norm: float = 1000.0, eps: float = 1e-6) -> Column:
    """Sign, log size and scaled value of a number; zeros for null."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(z(F.signum(n)).alias("sign"), z(F.log(F.abs(n) + eps)).alias("log"), z(n / norm).alias("lin"))


def group_name(c: Column) -> Column:
    """``blocks.i.sub...`` as ``block{i}.sub``; any other name as its first part."""
    p = F.split(c, "\\.")
    return F.when(c.startswith("blocks."), F.concat(F.lit("block"), p[1], F.lit("."), F.get(p, 2))).otherwise(p[0])


def decoded(a: Column, b: Column, norm: float = 1000.0, eps: float = 1e-6) -> dict[str, Column]:
    """Sum, difference, product and quotient of two numbers from their meaning codes."""
    sign = a["sign"] * b["sign"]
    return {
        "sum": (a["lin"] + b["lin"]) * norm,
        "difference": (a["lin"] - b["lin"]) * norm,
        "product": sign * F.greatest(F.exp(a["log"] + b["log"]) - eps * eps, F.lit(0.0)),
        "quotient": sign * F.exp(a["log"] - b["log"]),
    }


def byte_positions(df: DataFrame, token: str, most: int = 32) -> DataFrame:
    """Sparse byte x position code: a row per byte of the token's first ``most`` bytes. Null and empty tokens have none."""
    h = F.hex(F.encode(F.col(token), "UTF-8"))
    n = F.least(F.octet_length(F.col(token)), F.lit(most))
    x = df.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("position"))
    return x.select(token, F.conv(F.substring(h, F.col("position") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("byte"), "position", F.round(1 / F.sqrt(n), 9).alias("weight"))


def normalised_ones(n_bytes: Column, cells: int = 256 * 32) -> tuple[Column, Column]:
    """The two values of the z-normalised code of a token with so many bytes: of its ones and of its zeros."""
    v = 1 / F.sqrt(n_bytes)
    mean = n_bytes * v / cells
    sd = F.sqrt(n_bytes * v * v / cells - mean * mean)
    return (v - mean) / sd, -mean / sd


@F.pandas_udf(StringType())
def bits_float32(x: pd.Series) -> pd.Series:
    return pd.Series([format(v, "032b") for v in x.to_numpy(np.float32).view(np.uint32)])


@F.pandas_udf(StringType())
def bits_bfloat16(x: pd.Series) -> pd.Series:
    """Rounded to nearest, ties to even."""
    u = x.to_numpy(np.float32).view(np.uint32).astype(np.uint64)
    return pd.Series([format(int(v), "016b") for v in ((u + 0x7FFF + ((u >> 16) & 1)) >> 16) & 0xFFFF])


def quantised(x: Column) -> Column:
    """Nearest number (ties to even) of the 8-bit format with 4 exponent and 3 fraction bits, bounded by 448."""
    a = F.least(F.abs(x), F.lit(448.0))
    e = F.greatest(F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))), F.lit(-6))
    step = F.pow(F.lit(2.0), e - 3)
    return F.signum(x) * F.least(F.rint(a / step) * step, F.lit(448.0))


def decode_bits(bits: Column, exponent: int, bias: int) -> Column:
    """Value of a normal number from its bit string."""
    e = F.conv(F.substring(bits, 2, exponent), 2, 10).cast("double") - bias
    fraction = F.split(F.substring(bits, exponent + 2, 64), "")
    m = F.aggregate(F.transform(F.filter(fraction, lambda b: b != ""), lambda b, i: b.cast("double") * F.pow(F.lit(2.0), -(i + 1).cast("double"))), F.lit(1.0), lambda s, v: s + v)
    return F.pow(F.lit(-1.0), F.substring(bits, 1, 1).cast("double")) * m * F.pow(F.lit(2.0), e)


def cosine_rate(step: Column, peak: float, warmup: int, total: int, least: float = 0.1) -> Column:
    """Linear warm-up, then half a cosine down to ``least`` of the peak."""
    p = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(least * peak + (1 - least) * peak * 0.5 * (1 + F.cos(math.pi * p)))


def plateau_rate(step: Column, peak: float, warmup: int, total: int, decay: float = 0.2, least: float = 0.1) -> Column:
    """Linear warm-up, plateau, and a linear fall over the last ``decay`` of the steps."""
    start = int(total * (1 - decay))
    p = (step - start) / max(1, total - start)
    return F.when(step < warmup, peak * (step + 1) / warmup).when(step < start, F.lit(peak)).otherwise(peak * (least + (1 - least) * (1 - p)))


def rewarmed(rate: Column, tokens: Column, start: float, per_step: float, over: float) -> Column:
    """A rate that rises anew after a restart."""
    return rate * F.least(F.lit(1.0), (tokens - start + per_step) / over)


def bytes_per_weight(stage: str, ranks: Column) -> Column:
    whole, divided = SHARDING[stage]
    return F.lit(float(whole)) + F.lit(float(divided)) / ranks


def copies_sent(stage: str, ranks: Column) -> Column:
    """Copies of the weights that a rank sends per step, by rings: three phases if the weights are divided too, else two."""
    return F.lit(3.0 if stage == "zero3" else 2.0) * (ranks - 1) / ranks


def cache_bytes(layers: Column | float, heads: Column | float, width: Column | float, length: Column | float, size: Column | float) -> Column:
    """Keys and values of all layers."""
    return 2.0 * layers * heads * width * length * size


def cache_schemes(length: Column, size: int = 2, layers: int = 48, heads: int = 64, width: int = 128) -> dict[str, Column]:
    """Bytes per user of nine ways to keep keys and values, for one geometry."""
    grouped = lambda h, t=length, n=layers: cache_bytes(float(n), h, width, t, size)
    state = lambda n: F.lit(float(n * 16 * width * width * 4))
    latent = 512 + 64
    near = F.least(length, F.lit(128))
    compressed = lambda every: layers / 2 * latent * (F.ceil(length / every) + near) * size
    return {
        "mha": grouped(heads), "gqa": grouped(8), "mqa": grouped(1), "kivi": grouped(8) * (0.25 / size), "mla": layers * latent * length * size * F.lit(1.0),
        "swa": grouped(8, F.least(length, F.lit(4096))), "hybrid": grouped(8, length, layers / 4) + state(3 * layers / 4), "csa": (compressed(4) + compressed(128)) * F.lit(1.0), "linear": state(layers),
    }
