"""Distance functions over two array columns as Spark expressions, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: added to the denominator of chi2 (the spacing of float32 at 1).
CHI2_EPSILON = 1.1920929e-07

Distance = Callable[[Column, Column], Column]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f over the places of a (a place that b lacks is null, which makes the whole distance null)."""
    return F.zip_with(a, F.slice(b, 1, F.greatest(F.size(a), F.lit(0))), lambda x, y: f(x.cast("double"), y.cast("double")))


def l1norm(a: Column, b: Column) -> Column:
    return _total(_zip(a, b, lambda x, y: F.abs(x - y)))


def l2norm_squared(a: Column, b: Column) -> Column:
    return _total(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def l2norm(a: Column, b: Column) -> Column:
    return F.sqrt(l2norm_squared(a, b))


def one_minus_dot(a: Column, b: Column) -> Column:
    return F.lit(1.0) - _total(_zip(a, b, lambda x, y: x * y))


def jsd(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence of non-negative histograms, without the factor of one half; 0 where both are 0."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.ln(2 * x / (x + y))).otherwise(0.0)

    return _total(_zip(a, b, lambda x, y: part(x, y) + part(y, x)))


def chi2(a: Column, b: Column) -> Column:
    return _total(_zip(a, b, lambda x, y: F.try_divide((x - y) * (x - y), x + y + F.lit(CHI2_EPSILON))))


def frobenius(mask: Column | None = None) -> Distance:
    """Sum of sqrt(dE^2 + 2 dF^2 + dG^2) over triples (E, F, G); triple i is left out where mask[i] is true."""

    def distance(a: Column, b: Column) -> Column:
        def triple(i: Column) -> Column:
            d = [F.get(a, 3 * i + j).cast("double") - F.get(b, 3 * i + j).cast("double") for j in range(3)]
            value = F.sqrt(d[0] * d[0] + 2 * d[1] * d[1] + d[2] * d[2])
            return value if mask is None else F.when(F.get(mask, i), 0.0).otherwise(value)

        n = F.floor(F.size(a) / 3).cast("int")
        return F.when(n > 0, _total(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), triple))).otherwise(0.0)

    return distance


def df(a: Column, b: Column) -> Column:
    """The first half of a vector is a distance transform, the second a sketch: sum of a1 * b2 + b1 * a2."""
    h = F.floor(F.size(a) / 2).cast("int")

    def half(x: Column, second: bool) -> Column:
        return F.slice(x, h + 1 if second else F.lit(1), h)

    return _total(_zip(half(a, False), half(b, True), lambda x, y: x * y)) + _total(_zip(half(b, False), half(a, True), lambda x, y: x * y))


DISTANCES: dict[str, Distance] = {"l1norm": l1norm, "l2norm_squared": l2norm_squared, "l2norm": l2norm, "one_minus_dot": one_minus_dot, "jsd": jsd, "chi2": chi2, "frobenius": frobenius(), "df": df}


def distance(name: str) -> Distance:
    """The distance of that name; an unknown name is an error."""
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(sorted(DISTANCES))}")
    return DISTANCES[name]
