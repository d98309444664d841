"""Numbers and vectors as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from corpuskit.functions.hashing import hash01


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: plain double arithmetic, alike in every engine; no negative zero."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale) + F.lit(0.0)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def softplus(c: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def log_sigmoid(c: Column) -> Column:
    return -softplus(-c)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is null or has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.transform(a, lambda x: x.cast("double") - top - F.log(total))


def top_k_filter(logits: Column, k: int, temperature: float = 1.0) -> Column:
    """Scaled logits with everything below the k-th greatest set to null; ties with it stay."""
    least = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return F.transform(logits, lambda x: F.when(x >= least, x.cast("double") / F.lit(temperature)))


def guided(unconditional: Column, conditional: Column, weight: float) -> Column:
    """u + w (c - u), element by element."""
    return F.zip_with(unconditional, conditional, lambda u, c: u + F.lit(weight) * (c - u))


def repetition_penalised(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen 0-based token ids divided by the penalty if positive, multiplied otherwise."""
    return F.transform(logits, lambda x, i: F.when(~F.array_contains(seen, i), x).when(x > 0, x / F.lit(penalty)).otherwise(x * F.lit(penalty)))


def ramp(step: Column, weight: float, start: int, length: int) -> Column:
    return F.lit(weight) * clamp((step - F.lit(start)).cast("double") / F.lit(float(length)), 0.0, 1.0)


def cosine_schedule(step: Column, base: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    done = clamp((step - F.lit(warmup)).cast("double") / F.lit(float(max(1, total - warmup))), 0.0, 1.0)
    return F.when(step < warmup, F.lit(base) * (step + 1).cast("double") / F.lit(float(max(1, warmup)))).otherwise(F.lit(base) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * done)))


def draw_token(logits: Column, *uniform_key: Column, seed: int | str = 0) -> Column:
    """0-based index drawn with the probabilities of the softmax of ``logits``; null entries are never drawn.

    The greatest of logit - ln(-ln(u)), where u is a hash of the key and the index: the draw is
    exact and depends on nothing else.
    """
    noisy = F.transform(logits, lambda x, i: F.when(x.isNotNull(), F.struct((x - F.log(-F.log(hash01(seed, *uniform_key, i) + F.lit(2.0**-33)))).alias("v"), (-i).alias("i"))))
    return -F.array_max(F.filter(noisy, lambda s: s.isNotNull()))["i"]


def recent_distinct(column: str, key: str, order: str, size: int) -> Column:
    """Sorted distinct values of the ``size`` rows before each row of its key; a key's rows are one clip's frames."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(-size, -1)
    return F.array_sort(F.array_distinct(F.collect_list(column).over(window)))
