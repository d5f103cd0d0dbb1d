"""Scalar math over probability vectors, as array expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uniform(key: Column | str, salt: str) -> Column:
    """A draw from [0, 1) that depends on the key and the salt alone, whatever the partitioning."""
    text = F.concat(F.lit(salt + "|"), _col(key).cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` names it and wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(x: Column | str) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def softmax(logits: Column | str, t: Column | float = 1.0) -> Column:
    """Max-shifted softmax at temperature ``t``; ``t`` of zero or less is an error."""
    t = F.lit(t) if isinstance(t, (int, float)) else t

    def shifted(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp((v - top) / t)))

    p = let(let(_col(logits), shifted), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))
    return F.when(t <= 0, F.raise_error(F.lit("temperature must be positive"))).otherwise(p)


def sigmoid(x: Column | str, t: Column | float = 1.0) -> Column:
    z = _col(x) / (F.lit(t) if isinstance(t, (int, float)) else t)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def normalize(x: Column | str) -> Column:
    """Non-negative weights to probabilities; an all-zero vector becomes uniform, a negative weight is an error."""

    def scaled(w: Column) -> Column:
        return let(total(w), lambda s: F.when(s > 0, F.transform(w, lambda v: v / s)).otherwise(F.transform(w, lambda v: 1.0 / F.size(w))))

    return let(_col(x), lambda w: F.when(F.exists(w, lambda v: v < 0), F.raise_error(F.lit("negative weight"))).otherwise(scaled(w)))


def entropy(p: Column | str) -> Column:
    return F.aggregate(_col(p), F.lit(0.0), lambda acc, v: acc - F.when(v > 0, v * F.ln(v)).otherwise(0.0))


def normalized_entropy(p: Column | str) -> Column:
    p = _col(p)
    return F.when(F.size(p) <= 1, 0.0).otherwise(entropy(p) / F.ln(F.size(p)))


def expectation(p: Column | str, anchors: Column | str) -> Column:
    return dot(p, anchors)


def spread(p: Column | str, anchors: Column | str) -> Column:
    """Standard deviation of the anchors under ``p``."""
    mean = expectation(p, anchors)
    return F.sqrt(F.greatest(total(F.zip_with(_col(p), _col(anchors), lambda x, v: x * (v - mean) * (v - mean))), F.lit(0.0)))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def margin(p: Column | str) -> Column:
    top = F.sort_array(_col(p), asc=False)
    return F.when(F.size(top) < 2, 1.0).otherwise(clamp(top[0] - top[1]))


def choice_confidence(p: Column | str, method: str = "entropy") -> Column:
    """Concentration of an unordered distribution: entropy, margin or rescaled maximum."""
    p = _col(p)
    if method == "entropy":
        value = clamp(1 - normalized_entropy(p))
    elif method == "margin":
        value = margin(p)
    elif method == "max":
        value = clamp((F.array_max(p) - 1.0 / F.size(p)) / (1 - 1.0 / F.size(p)))
    else:
        raise ValueError(method)
    return F.when(F.size(p) == 1, 1.0).otherwise(value)


def score_confidence(p: Column | str, anchors: Column | str) -> Column:
    """One less the spread over half the anchors' range."""
    span = F.array_max(_col(anchors)) - F.array_min(_col(anchors))
    return F.when((F.size(_col(p)) < 2) | (span <= 0), 1.0).otherwise(clamp(1 - spread(p, anchors) / (span / 2)))


def argmax(p: Column | str) -> Column:
    """Index of the largest entry, the lowest on ties."""
    return let(_col(p), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def log_loss(p: Column | str, y: Column | str) -> Column:
    return -F.ln(F.greatest(F.element_at(_col(p), _col(y).cast("int") + 1), F.lit(1e-12)))


def brier(p: Column | str, y: Column | str) -> Column:
    y = _col(y)
    return total(F.transform(_col(p), lambda v, i: F.pow(v - F.when(i == y, 1.0).otherwise(0.0), F.lit(2))))


def kl(p: Column | str, q: Column | str, floor: float = 1e-12) -> Column:
    """Divergence of ``q`` from the reference ``p`` over the support of ``p``."""
    return total(F.zip_with(_col(p), _col(q), lambda a, b: F.when(a > 0, a * F.ln(a / F.greatest(b, F.lit(floor)))).otherwise(0.0)))


def total_variation(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y))) / 2


def soft_cross_entropy(logits: Column | str, target: Column | str) -> Column:
    p = softmax(logits)
    return -total(F.zip_with(_col(target), p, lambda t, x: t * F.ln(F.greatest(x, F.lit(1e-300)))))


def cumulative(p: Column | str) -> Column:
    p = _col(p)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: total(F.slice(p, F.lit(1), n)))


def squared_emd(p: Column | str, target: Column | str) -> Column:
    return total(F.zip_with(cumulative(p), cumulative(target), lambda a, b: (a - b) * (a - b)))


def consistency(a: Column | str, b: Column | str, relation: str) -> Column:
    """Symmetric divergence of two answers that should be the same; for complements, the square of what P(yes) miss of one."""
    if relation == "same":
        return (kl(a, b) + kl(b, a)) / 2
    if relation == "complement":
        return F.pow(_col(a)[1] + _col(b)[1] - 1, F.lit(2))
    raise ValueError(relation)


def draw_label(key: Column | str, p: Column | str, salt: str = "label") -> Column:
    """A label drawn from ``p`` by the key, by inverse distribution; the last one if rounding leaves a gap."""
    c, u = cumulative(p), uniform(key, salt)
    return F.least(F.size(F.filter(c, lambda v: v <= u)), F.size(_col(p)) - 1).cast("int")


def top_k(p: Column | str, k: int) -> Column:
    """Ascending indices of the ``k`` most probable entries, lower index first on ties."""
    ranked = F.array_sort(F.transform(_col(p), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda s: s["i"]))


def lac_set(p: Column | str, threshold: Column | float) -> Column:
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    pairs = F.transform(_col(p), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.filter(pairs, lambda s: F.round(1 - s["v"], 9) <= t), lambda s: s["i"])


def aps_set(p: Column | str, threshold: Column | float) -> Column:
    """Most probable labels until their mass reaches the threshold, in ascending order of index."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    ranked = F.array_sort(F.transform(_col(p), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    before = F.transform(ranked, lambda s, k: F.struct(s["i"].alias("i"), (-total(F.transform(F.slice(ranked, F.lit(1), k), lambda x: x["v"]))).alias("mass")))
    return F.array_sort(F.transform(F.filter(before, lambda s: F.round(s["mass"], 9) < t), lambda s: s["i"]))
