"""Small linear systems and hulls as column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def solve(matrix: Column, rhs: Column) -> Column:
    """Solution of a symmetric positive definite system: array of rows, array of right-hand sides."""
    rows = F.zip_with(matrix, rhs, lambda row, b: F.concat(row, F.array(b)))

    def eliminate(m: Column, k: Column) -> Column:
        own = F.get(m, k)
        pivot = F.transform(own, lambda v: v / F.get(own, k))
        return let(
            pivot,
            lambda p: F.transform(m, lambda row, i: F.when(i == k, p).otherwise(F.zip_with(row, p, lambda v, q: v - F.get(row, k) * q))),
        )

    reduced = F.aggregate(F.sequence(F.lit(0), F.size(rhs) - 1), rows, eliminate)
    return F.transform(reduced, lambda row: F.element_at(row, -1))


def clamped_solve(matrix: Column, rhs: Column, clamped: Column, size: int) -> Column:
    """Least-squares slopes of normal equations, those marked in ``clamped`` not negative.

    Every set of marked slopes is held at zero in turn and the rest solved; among the sets whose marked
    slopes come out without a negative one, the least error is the constrained optimum. For a
    positive definite matrix it is unique. There are at most 2^size sets, so this is for a handful of features.
    """
    places = F.sequence(F.lit(0), F.lit(size - 1))

    def held(mask: Column, i: Column) -> Column:
        return F.floor(mask / F.pow(F.lit(2.0), i)) % 2 == 1

    def fit(mask: Column) -> Column:
        m = F.transform(
            matrix,
            lambda row, i: F.transform(
                row, lambda v, j: F.when(held(mask, i) | held(mask, j), F.when(i == j, 1.0).otherwise(0.0)).otherwise(v)
            ),
        )
        slopes = solve(m, F.transform(rhs, lambda b, i: F.when(held(mask, i), 0.0).otherwise(b)))
        return let(slopes, lambda s: F.struct((-dot(s, rhs)).alias("error"), mask.alias("mask"), s.alias("slopes")))

    masks = F.filter(F.sequence(F.lit(0), F.lit(2**size - 1)), lambda mask: F.forall(places, lambda i: ~held(mask, i) | F.get(clamped, i)))
    fits = F.transform(masks, fit)
    sound = F.filter(fits, lambda f: F.forall(places, lambda i: ~F.get(clamped, i) | (F.get(f["slopes"], i) >= 0)))
    return F.array_min(sound)["slopes"]


def lower_hull(points: Column) -> Column:
    """Lower convex hull of points (k, x, y) in order of growing x, as a stack that each point joins once.

    A new point stays on the part of the hull whose slopes are below the slope to it; slopes
    grow along the hull, so that part is found by halving.
    """

    def slope(a: Column, b: Column) -> Column:
        return (b["y"] - a["y"]) / (b["x"] - a["x"])

    def halve(point: Column, stack: Column) -> Callable[[Column, Column], Column]:
        def step(span: Column, _: Column) -> Column:
            middle = F.floor((span["low"] + span["high"] + 1) / 2).cast("int")
            here = F.element_at(stack, middle)
            keeps = (middle == 1) | (slope(F.element_at(stack, F.greatest(middle - 1, F.lit(1))), here) < slope(here, point))
            low, high = F.when(keeps, middle).otherwise(span["low"]), F.when(keeps, span["high"]).otherwise(middle - 1)
            return F.when(span["low"] >= span["high"], span).otherwise(F.struct(low.alias("low"), high.alias("high")))

        return step

    def push(stack: Column, point: Column) -> Column:
        span = F.struct(F.lit(1).alias("low"), F.size(stack).alias("high"))
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(stack) + 1.0)).cast("int") + 1)
        keep = F.aggregate(steps, span, halve(point, stack))["low"]
        return F.concat(F.slice(stack, F.lit(1), keep), F.array(point))

    rest = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    return F.aggregate(rest, F.slice(points, 1, 1), push)
