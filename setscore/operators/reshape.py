"""Long <-> wide reshapes.

Everything stays long inside the engine; ``long_to_wide`` is for the edge
(a saved matrix, a heatmap) where the number of columns is known to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscore.functions.labels import contains_ci
from setscore.sources.expression import wide_to_long  # noqa: F401  (P4, re-exported)


def long_to_wide(df: DataFrame, id_col: str, key_col: str, value_col: str,
                 values: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """One row per id, one column per key of ``values``; missing cells become ``fill``.

    The keys are named by the caller: an open key set stays in the long form.
    """
    wide = df.groupBy(id_col).pivot(key_col, list(values)).agg(F.first(value_col))
    return wide if fill is None else wide.fillna(fill, list(values))


def select_timepoint_units(df: DataFrame, unit_col: str = "unit") -> DataFrame:
    """Long form of select(gene, contains("OT"), contains("BT")), case-insensitive."""
    return df.where(contains_ci(unit_col, "OT") | contains_ci(unit_col, "BT"))
