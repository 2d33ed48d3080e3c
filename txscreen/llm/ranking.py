"""Ranks and running sums within hot groups, without one task per group.

Rows are dealt by group and by a slice of their order; a small table of slices
says how much lies before each. A group with a third of all rows is spread
over all of its slices.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    slice_column: str,
    order: Sequence[Column | str],
    value: Column,
    *,
    before: str,
    total: str,
) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the rows ahead in the same group,
    and ``total``, the group's sum.

    ``slice_column`` must be a coarse, non-decreasing function of ``order``.
    ``keys`` and the slice must not be null; no keys means one group. ``df`` is
    read twice, so it should be cheap or stored. The table of slices has at
    most as many rows per group as there are slices.
    """
    value = value.cast("long")
    by_slice = Window.partitionBy(*keys).orderBy(slice_column)
    slices = df.groupBy(*keys, slice_column).agg(F.sum(value).alias("_in_slice"))
    slices = slices.select(
        *keys,
        slice_column,
        (F.sum("_in_slice").over(by_slice) - F.col("_in_slice")).alias("_ahead"),
        F.sum("_in_slice").over(Window.partitionBy(*keys)).alias(total),
    )
    inside = Window.partitionBy(*keys, slice_column).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.sum(value).over(inside) - value + F.col("_ahead")
    joined = df.join(slices, [*keys, slice_column])
    return joined.withColumn(before, ahead).drop("_ahead")
