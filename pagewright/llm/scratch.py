"""Tables written to the folder that every executor shares, as the rest of the library has them; and joins of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, folders, is_there

__all__ = ["Scratch", "folders", "is_there", "small"]


def small(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """``table`` with a broadcast hint if it has no more than ``rows`` rows; else as it is, for a shuffled join.

    The count is of a written table of narrow rows, so it costs a read of file footers.
    """
    return F.broadcast(table) if table.count() <= rows else table
