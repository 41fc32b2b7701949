"""Numeric column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

INF = float("inf")


def finite(value: Column) -> Column:
    """True for a number that is neither NaN nor infinite, NULL for NULL; Spark sorts NaN above infinity."""
    return F.abs(value) < F.lit(INF)


def softplus(raw: Column, floor: float = 1e-6) -> Column:
    """ln(1 + e^raw) + floor without overflow for large |raw|."""
    return F.greatest(raw, F.lit(0.0)) + F.log1p(F.exp(-F.abs(raw))) + F.lit(floor)


def norm(parts: Sequence[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def unit(parts: Sequence[Column], floor: float = 1e-12) -> list[Column]:
    length = F.greatest(norm(parts), F.lit(floor))
    return [p / length for p in parts]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def angle(a: Sequence[Column], b: Sequence[Column], margin: float = 1e-7) -> Column:
    """Angle in radians between two vectors; the cosine stays ``margin`` away from +-1."""
    lengths = [F.greatest(norm(v), F.lit(1e-12)) for v in (a, b)]
    return F.acos(clamp(dot(a, b) / lengths[0] / lengths[1], -1 + margin, 1 - margin))


def log_energy(energy: Column, policy: str) -> Column:
    """Decadic logarithm of an energy.

    ``nested`` floors the energy at 1e-6, ``flat`` gives 0 for anything not above 0.
    """
    if policy == "nested":
        return F.log10(F.greatest(energy, F.lit(1e-6)))
    if policy == "flat":
        return F.when((energy > 0) & ~F.isnan(energy), F.log10(energy)).otherwise(F.lit(0.0))
    raise ValueError(f"unknown policy {policy!r}")


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def softmax(values: Column) -> Column:
    def shares(powers: Column) -> Column:
        return bind(F.aggregate(powers, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(powers, lambda v: v / total))

    return bind(F.array_max(values), lambda top: bind(F.transform(values, lambda v: F.exp(v - top)), shares))


def log_sum_exp(values: Column) -> Column:
    return bind(F.array_max(values), lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def seeded_hash(seed: int | str, *ids: Column) -> Column:
    """Hex digest that orders rows the same way on every run and engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_fraction(digest: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
