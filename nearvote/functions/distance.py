"""Squared distances as JVM expressions: unrolled over columns (one generated loop body) or over arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def squared_l2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Integer squared distance of two lists of columns, BIGINT. Components are widened first: SMALLINT would overflow."""
    deltas = [x.cast("bigint") - y.cast("bigint") for x, y in zip(a, b, strict=True)]
    return _sum([d * d for d in deltas])


def squared_l2_arrays(a: Column, b: Column) -> Column:
    """The same for arrays of any length."""
    delta = F.zip_with(a, b, lambda x, y: x.cast("bigint") - y.cast("bigint"))
    return F.aggregate(delta, F.lit(0).cast("bigint"), lambda s, d: s + d * d)


def squared_l2_float(a: Column, b: Column) -> Column:
    """Float32 squared distance, summed in order."""
    delta = F.zip_with(a, b, lambda x, y: (x.cast("float") - y.cast("float")).cast("float"))
    return F.aggregate(delta, F.lit(0.0).cast("float"), lambda s, d: (s + (d * d).cast("float")).cast("float"))


def box_bound(q: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    """Least squared distance from a point to a box."""
    zero = F.lit(0).cast("bigint")
    gaps = [F.greatest(low.cast("bigint") - x.cast("bigint"), x.cast("bigint") - high.cast("bigint"), zero) for x, low, high in zip(q, lo, hi, strict=True)]
    return _sum([g * g for g in gaps])


def box_bound_arrays(q: Column, lo: Column, hi: Column) -> Column:
    edges = F.arrays_zip(q.alias("q"), lo.alias("lo"), hi.alias("hi"))
    zero = F.lit(0).cast("bigint")
    gap = lambda e: F.greatest(e["lo"].cast("bigint") - e["q"].cast("bigint"), e["q"].cast("bigint") - e["hi"].cast("bigint"), zero)
    return F.aggregate(F.transform(edges, gap), zero, lambda s, g: s + g * g)


def as_columns(array: Column, dims: int) -> list[Column]:
    return [F.get(array, F.lit(d)) for d in range(dims)]
