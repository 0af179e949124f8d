"""Seeded uniform draws from whole numbers, the same bits in Spark, SQL and numpy.

A draw folds its arguments one by one into a number below 2^31 - 1, by a
multiplication and a square modulo that prime, so all steps are exact in 64-bit
integers.  They are for model randomness, not for keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2 ** 31 - 1
FACTOR, START = 48271, 17


def _fold(h, x):
    t = (h * FACTOR + x % PRIME) % PRIME
    return (t * (t + 1)) % PRIME


def draw(*parts) -> Column:
    """Uniform value in [0, 1) of non-negative whole numbers (ints first, then columns)."""
    h = START
    for x in parts:  # ints are folded here, so the expression holds columns only
        h = _fold(h if isinstance(h, int) and isinstance(x, int) else F.lit(h).cast("bigint") if isinstance(h, int) else h, x)
    return (F.lit(h) if isinstance(h, int) else h).cast("double") / float(PRIME)


def draw_sql(*parts) -> str:
    """The same as SQL text; parts are ints or SQL."""
    h: int | str = START
    for x in parts:
        if isinstance(h, int) and isinstance(x, int):
            h = _fold(h, x)
        else:
            t = f"(CAST({h} AS BIGINT) * {FACTOR} + CAST({x} AS BIGINT) % {PRIME}) % {PRIME}"
            h = f"(({t}) * (({t}) + 1)) % {PRIME}"
    return f"(CAST({h} AS DOUBLE) / {float(PRIME)!r}e0)"


def draw_np(*parts) -> np.ndarray:
    """The same for numpy arrays (or ints) of whole numbers, broadcast."""
    h = np.int64(START)
    for x in parts:
        t = (h * FACTOR + np.asarray(x, np.int64) % PRIME) % PRIME
        h = (t * (t + 1)) % PRIME
    return h / float(PRIME)
