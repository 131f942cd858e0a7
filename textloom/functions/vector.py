"""Vector functions on ARRAY columns, accumulated in double precision. No UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def normalize(a: Column) -> Column:
    scaled = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return let(a, lambda v: let(norm(v), lambda n: scaled(v, n)))


def add(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double") * F.lit(scale))


def low_rank(x: Column, down: Column, up: Column) -> Column:
    """x + U (D x) for matrices as arrays of rows."""
    small = F.transform(down, lambda row: dot(row, x))
    return add(x, F.transform(up, lambda row: dot(row, small)))


def one_hot(value: Column, labels: list[str]) -> Column:
    return F.array(*[F.coalesce((value == v).cast("double"), F.lit(0.0)) for v in labels])


def char_hash(word: Column, dim: int, n: int = 3) -> Column:
    """Normalised histogram of character n-grams of ^word$, dealt to buckets by digest."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n)))
    buckets = F.transform(grams, lambda g: F.conv(F.left(F.md5(g), F.lit(8)), 16, 10).cast("long") % dim)
    counts = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(held, lambda x: x == b)).cast("double"))
    return normalize(let(buckets, counts))


def flip_half(v: Column, negated: Column) -> Column:
    """The first half of the dimensions with opposite sign, where negated."""
    return F.when(negated, F.transform(v, lambda x, i: F.when(i < F.size(v) / 2, -x).otherwise(x))).otherwise(v)


def letter_counts(text: Column, letters: str = "abcdefghijklmnopqrstuvwxyzĉĝĥĵŝŭ") -> Column:
    """How often each letter stands in the text, in any case: a vector without learned weights."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in letters])


def _mean(vectors: Column) -> Column:
    """Mean of an array of vectors, null for none."""
    total = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0))), F.get(vectors, 0), lambda s, v: add(s, v))
    return F.transform(total, lambda x: x / F.size(vectors))


def compose_sum(root: Column, affixes: Column) -> Column:
    """Root plus the mean of its affixes' vectors."""
    return F.when(F.size(affixes) > 0, add(root, _mean(affixes))).otherwise(root)


def compose_gated(root: Column, affixes: Column, by_root: float, by_affix: float) -> Column:
    """Root plus the mean of the affixes, each dimension let through by a sigmoid gate of root and affix."""
    gate = lambda a: F.zip_with(root, a, lambda r, x: x / (1 + F.exp(-(by_root * r + by_affix * x))))
    return compose_sum(root, F.transform(affixes, gate))


def compose_attention(root: Column, affixes: Column) -> Column:
    """Mean of root and affixes, weighted by the softmax of their scaled products with the root."""
    parts = F.concat(F.array(root), affixes)
    scores = lambda ps: F.transform(ps, lambda p: dot(root, p) / F.sqrt(F.size(root)))
    weights = lambda ss: let(F.array_max(ss), lambda m: F.transform(ss, lambda s: F.exp(s - m)))
    total = lambda ps, ws: F.aggregate(F.zip_with(ps, ws, lambda p, w: F.transform(p, lambda x: x * w)), F.transform(root, lambda _: F.lit(0.0)), lambda s, v: add(s, v))
    share = lambda ps, ws: let(F.aggregate(ws, F.lit(0.0), lambda s, w: s + w), lambda all_: F.transform(total(ps, ws), lambda x: x / all_))
    return let(parts, lambda ps: let(scores(ps), lambda ss: let(weights(ss), lambda ws: share(ps, ws))))
