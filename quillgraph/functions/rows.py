"""Row-level plan shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(rows: DataFrame, *computed: str) -> DataFrame:
    """Computes the named columns once per row.

    A filter on a derived column would otherwise be pushed below the projections that define it,
    repeating the nested array work many times. Filters do not pass a generator's output.
    """
    rest = [c for c in rows.columns if c not in computed]
    return rows.select(*rest, F.inline(F.array(F.struct(*computed))))
