"""Numeric column expressions: perplexity, bands, schedule, reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cap on a loss before exp, and the band edges.
LOSS_CAP = 20.0
PERPLEXITY_FULL, PERPLEXITY_HALF = 50.0, 100.0
COMPRESSION_LOW, COMPRESSION_GOOD = 2.0, 3.0


def perplexity(loss: Column, capped: bool = True) -> Column:
    return F.exp(F.least(loss, F.lit(LOSS_CAP)) if capped else loss)


def perplexity_score(value: Column) -> Column:
    return (
        F.when(value < PERPLEXITY_FULL, 1.0)
        .when(value < PERPLEXITY_HALF, 0.5)
        .when(value.isNotNull(), 0.0)
    )


def perplexity_band(value: Column) -> Column:
    return (
        F.when(value < 50, "excellent").when(value < 100, "good").when(value < 200, "okay")
        .when(value.isNotNull(), "poor")
    )


def compression_band(ratio: Column) -> Column:
    return (
        F.when(ratio < COMPRESSION_LOW, "low")
        .when(ratio < COMPRESSION_GOOD, "moderate")
        .when(ratio.isNotNull(), "good")
    )


def clean_logit(logit: Column) -> Column:
    """NaN becomes 0, infinities become plus or minus 1e4."""
    return (
        F.when(F.isnan(logit), 0.0)
        .when(logit == float("inf"), 1e4)
        .when(logit == float("-inf"), -1e4)
        .otherwise(logit)
    )


def scheduled_lr(step: Column, base: float, warmup: int, total: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then cosine decay to ``floor`` of the base; not clamped past the end."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    cosine = 0.5 * (1.0 + F.cos(F.pi() * progress))
    ramp = step / F.lit(float(max(1, warmup)))
    return base * F.when(step < warmup, ramp).otherwise(floor + (1.0 - floor) * cosine)


def percent_gain(before: Column, after: Column) -> Column:
    """How much lower ``after`` is, in percent of ``before``."""
    return F.try_divide(before - after, before) * 100


def draw(seed: int, *keys: Column) -> Column:
    """A uniform number in [0, 1) fixed by seed and keys (52 bits of an MD5)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(float(1 << 52))
