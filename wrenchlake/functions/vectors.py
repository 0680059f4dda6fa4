"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """K1: unit length; a zero vector stays. The length is bound outside of the inner function, else it would be taken anew for every component."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n)))[0]


def cosine(a: Column, b: Column) -> Column:
    """K2: null if either has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance_score(distance: Column, legacy: bool = False) -> Column:
    """1 - distance; ``legacy`` is that up to 1 and 1 / (1 + distance) beyond."""
    return F.when(distance <= 1, 1 - distance).otherwise(1 / (1 + distance)) if legacy else 1 - distance


def clamp(x: Column) -> Column:
    """To [0, 1]; null and NaN become 0."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def sigmoid(x: Column) -> Column:
    """Of a value kept within 500 of zero."""
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0))))


def block_mean(v: Column, dims: int) -> Column:
    """K5: means of consecutive groups of size(v) div dims; shorter vectors are padded with zeros."""
    step = F.floor(F.size(v) / dims).cast("int")
    part = lambda i: F.slice(as_double(v), i * step + 1, step)
    mean = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(part(i), F.lit(0.0), lambda s, x: s + x) / step)
    padded = F.slice(F.concat(as_double(v), F.array_repeat(F.lit(0.0), dims)), 1, dims)
    return F.when(F.size(v) >= dims, mean).otherwise(padded)


def info_nce(positive: Column, negatives: Column, temperature: float = 0.05) -> Column:
    """K8: cross entropy of the positive among all similarities over the temperature."""
    logits = F.transform(F.concat(F.array(positive), negatives), lambda s: s / temperature)
    top = F.array_max(logits)
    return F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)) + top - positive / temperature


def sensor_features(sensors: Column, ranges: dict[str, tuple[float, float]], dims: int = 128, others: int = 10) -> Column:
    """Named sensors scaled to [0, 1] (missing counts as 0), then up to ten others by v / max(|v|, 1), padded by zeros."""
    known = [F.least(F.greatest((F.coalesce(sensors[k], F.lit(0.0)) - a) / (b - a), F.lit(0.0)), F.lit(1.0)) for k, (a, b) in ranges.items()]
    rest = F.map_values(F.map_filter(sensors, lambda k, _: ~k.isin(*ranges)))
    scaled = F.transform(F.slice(rest, 1, others), lambda v: v / F.greatest(F.abs(v), F.lit(1.0)))
    return F.slice(F.concat(F.array(*known), F.coalesce(scaled, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), dims)), 1, dims)


def cosine_schedule(step: Column, warmup: int, total: int) -> Column:
    """A linear rise over ``warmup`` steps, then half a cosine down to 0."""
    part = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.pi() * part))))
