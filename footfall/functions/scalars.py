"""Column expressions used throughout."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Window = tuple[float, float, float, float]


def to_metres(x: Column, units_per_m: float) -> Column:
    return x / F.lit(float(units_per_m))


def to_cells(x: Column, size: float, shift: float = 0.0) -> Column:
    """Coordinate in cells of a given size after a fixed shift."""
    return (x + F.lit(shift)) / F.lit(float(size))


def direction(vx: Column, vy: Column, scale: float = 2.0) -> tuple[Column, Column]:
    """Unit vector times scale; zero speed stays the zero vector."""
    norm = F.sqrt(vx * vx + vy * vy)
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return vx / safe * scale, vy / safe * scale


def occupancy_class(n: Column, breaks: tuple[int, int] = (30, 60)) -> Column:
    """low up to the first break, med up to the second, high beyond (right-closed)."""
    return F.when(n <= breaks[0], "low").when(n <= breaks[1], "med").otherwise("high")


def log_floor(v: Column, least: float = 1e-10) -> Column:
    """Natural logarithm of a value raised to a floor (Spark's ln(0) is null, so the floor is never 0)."""
    return F.ln(F.greatest(v, F.lit(least)))


def _cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))), na_action="ignore")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; for small tables such as a grid's cells."""
    return F.pandas_udf(_cdf, "double")(z)
