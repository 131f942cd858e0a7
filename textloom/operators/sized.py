"""Broadcasting only what has a proven bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows above which a side is left to Spark's own choice of join.
LARGEST = 100_000


def sized_broadcast(df: DataFrame, bound: int) -> DataFrame:
    """A broadcast hint for a frame whose plan has at most ``bound`` rows, if that is few.

    The bound must follow from the plan (a limit, a fixed list); larger bounds
    leave the choice to statistics and adaptive execution.
    """
    return F.broadcast(df) if bound <= LARGEST else df
