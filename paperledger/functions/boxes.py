"""Boxes: four numbers x0, y0, x1, y1 from 0 to 1, from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def intersects(a: Column, b: Column) -> Column:
    """Strictly: boxes that only touch do not intersect."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def inflate(a: Column, by: float) -> Column:
    low, high = F.lit(0.0), F.lit(1.0)
    return box(F.greatest(low, a["x0"] - by), F.greatest(low, a["y0"] - by), F.least(high, a["x1"] + by), F.least(high, a["y1"] + by))


def distance(a: Column, b: Column) -> Column:
    """Between centres."""
    return F.hypot((a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2, (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)
