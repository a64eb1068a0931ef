"""Distribution functions written as Spark Columns (JVM-side, no UDF).

Neither Spark nor DuckDB ships erf / a normal CDF. The standard normal CDF is
Hart's rational form in double precision (absolute error below 2e-16 against
erfc), a continued fraction beyond ``SPLIT``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's coefficients of the normal tail, highest power first, and
# the point from which the continued fraction takes over.
HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT = 7.07106781186547
ROOT_2PI = math.sqrt(2.0 * math.pi)


def _tail(a, exp):
    """(near, far) forms of 1 - Phi(a), a >= 0, for any number type."""
    num, den = 0.0, 0.0
    for c in HART_NUM:
        num = num * a + c
    for c in HART_DEN:
        den = den * a + c
    far = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + k / far
    e = exp(a * a * -0.5)
    return e * num / den, e / far / ROOT_2PI


def phi(u: Column) -> Column:
    """Standard normal CDF of ``u`` (NULL in, NULL out)."""
    near, far = _tail(F.abs(u), F.exp)
    tail = F.when(F.abs(u) < SPLIT, near).otherwise(far)
    return F.when(u >= 0, 1.0 - tail).otherwise(tail)


def phi_np(u: np.ndarray) -> np.ndarray:
    """NumPy twin of :func:`phi`."""
    near, far = _tail(np.abs(u), np.exp)
    tail = np.where(np.abs(u) < SPLIT, near, far)
    return np.where(u >= 0, 1.0 - tail, tail)


def phi_py(u: float) -> float:
    """Scalar twin of :func:`phi`."""
    near, far = _tail(abs(u), math.exp)
    tail = near if abs(u) < SPLIT else far
    return 1.0 - tail if u >= 0 else tail
