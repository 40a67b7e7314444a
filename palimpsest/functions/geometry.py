"""The Poincaré ball over array columns, with higher-order functions in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

BALL, CLIP = 0.95, 0.99
TINY = 1e-10


def _num(x: float) -> Column:
    return F.lit(float(x))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), _num(0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return let(x, lambda x: F.sqrt(dot(x, x)))


def scale(x: Column, by: Column) -> Column:
    return let(by, lambda k: F.transform(x, lambda v: v * k))


def to_ball(x: Column) -> Column:
    """Norms of 0.95 and more become 0.95."""
    return let(x, lambda x: let(norm(x), lambda n: F.when(n >= BALL, F.transform(x, lambda v: v * (_num(BALL) / n))).otherwise(x)))


def clip(x: Column) -> Column:
    """Norms above 0.99 become 0.99."""
    return let(x, lambda x: let(norm(x), lambda n: F.when(n > CLIP, F.transform(x, lambda v: v * (_num(CLIP) / n))).otherwise(x)))


def spread(features: Column) -> Column:
    """A vector's values scaled between its own least and largest; zeros where they are equal or one is missing."""

    def scaled(f: Column, low: Column, gap: Column) -> Column:
        flat = F.exists(f, lambda v: v.isNull()) | (gap <= 1e-8)
        return F.when(flat, F.transform(f, lambda _: _num(0))).otherwise(F.transform(f, lambda v: (v - low) / gap))

    return let(features, lambda f: let(F.array_min(f), lambda low: let(F.array_max(f) - low, lambda gap: scaled(f, low, gap))))


def embed(features: Column) -> Column:
    """Features in the ball; padding with zeros to a dimension changes no distance and is left out."""
    return to_ball(spread(features))


def distance(x: Column, y: Column, c: float = 1.0) -> Column:
    """Hyperbolic distance of clipped points."""

    def between(x: Column, y: Column) -> Column:
        gap = F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), _num(0), lambda s, v: s + v)
        return F.acosh(F.greatest(_num(1), 1 + 2 * c * gap / ((1 - c * dot(x, x)) * (1 - c * dot(y, y)) + TINY))) / math.sqrt(c)

    return let(clip(x), lambda a: let(clip(y), lambda b: between(a, b)))


def mobius_add(x: Column, y: Column, c: float = 1.0) -> Column:
    def added(x: Column, y: Column, d: Column) -> Column:
        bottom = 1 + 2 * c * d["xy"] + c * c * d["xx"] * d["yy"] + TINY
        factors = F.struct(((1 + 2 * c * d["xy"] + c * d["yy"]) / bottom).alias("l"), ((1 - c * d["xx"]) / bottom).alias("r"))
        return let(factors, lambda f: F.zip_with(x, y, lambda a, b: f["l"] * a + f["r"] * b))

    dots = lambda x, y: F.struct(dot(x, y).alias("xy"), dot(x, x).alias("xx"), dot(y, y).alias("yy"))
    return let(x, lambda x: let(y, lambda y: let(dots(x, y), lambda d: added(x, y, d))))


def exp_map(x: Column, v: Column, c: float = 1.0) -> Column:
    """The point reached from ``x`` along ``v``; ``x`` itself for vectors shorter than 1e-6."""
    root = math.sqrt(c)
    step = lambda v, n: scale(v, F.tanh(root * n) / (root * n))
    return let(v, lambda v: let(norm(v), lambda n: F.when(n < 1e-6, x).otherwise(mobius_add(x, step(v, n), c))))


def dimension(nodes: Column) -> Column:
    """32 below 50 nodes, else 4 log2 of their number, rounded up, between 16 and 128."""
    grown = F.ceil(4 * F.log2(nodes.cast("double"))).cast("int")
    return F.when(nodes < 50, F.lit(32)).otherwise(F.least(F.lit(128), F.greatest(F.lit(16), grown)))
