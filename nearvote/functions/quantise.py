"""Float32 scaling and quantisation as JVM expressions.

Spark divides FLOAT columns in DOUBLE; casting the quotient back gives exactly
the float32 quotient. Rounding is half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LIMIT, SCALE


def f32(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def div32(a: Column, b: Column | float) -> Column:
    """Float32 division."""
    return (f32(a) / f32(b)).cast("float")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, f32(0.0)), f32(1.0))


def quantise(x: Column) -> Column:
    """A float as SMALLINT: rint(x * 10000), at most 32767 in magnitude."""
    scaled = F.rint((f32(x) * f32(float(SCALE))).cast("float"))
    return F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), scaled)).cast("smallint")


def quantise_array(v: Column) -> Column:
    return F.transform(v, quantise)


def dequantise(q: Column) -> Column:
    return div32(q.cast("float"), float(SCALE))
