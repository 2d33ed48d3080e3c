"""Counts, cross-tabs, means and ratios over a transactions table.

Every operator is one aggregation over one scan of the columns it names. All
of them combine in the map tasks, so a key that holds a third of the rows
reaches the shuffle as one row per map task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txscreen import schema as S
from txscreen.functions import percent, ratio
from txscreen.operators.prepare import labelled_as


#: Registers of a sketch, as a power of two, and three standard errors of its estimate.
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def _rows(condition: Column | None = None, weight: str | None = None) -> Column:
    """Rows that meet ``condition``; with ``weight``, each counts for that many."""
    if weight is None:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    rows = F.col(weight) if condition is None else F.when(condition, F.col(weight))
    return F.coalesce(F.sum(rows), F.lit(0))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(_rows().alias("row_count"))


def _label_aggregates(label: str, weight: str | None = None) -> list[Column]:
    return [
        _rows(weight=weight).alias("row_count"),
        _rows(F.col(label) == 1, weight).alias("fraud"),
        _rows(F.col(label) == 0, weight).alias("normal"),
    ]


def _flag_aggregates(label: str, flag: str, weight: str | None = None) -> list[Column]:
    fraud = F.col(label) == 1
    return [
        _rows(fraud & (F.col(flag) == 1), weight).alias("caught"),
        _rows(fraud & (F.col(flag) == 0), weight).alias("missed"),
    ]


def _mean_aggregates(label: str, amount: str) -> list[Column]:
    # Two guarded means, never "fraud or else": a null label belongs to neither.
    return [
        F.coalesce(F.avg(F.when(F.col(label) == value, F.col(amount))), F.lit(0.0)).alias(name)
        for value, name in ((1, "mean_fraud"), (0, "mean_normal"))
    ]


def _value_aggregates(column: str) -> list[Column]:
    return [
        F.count(column).alias("value_count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("stddev"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    ]


def cells(
    df: DataFrame, *keys: str, amount: str | None = None, distinct: str | None = None
) -> DataFrame:
    """Rows per combination of a few coarse ``keys``.

    Pass it on with ``weight="row_count"``: every count below over these keys
    then comes from a handful of rows instead of a scan of its own. With
    ``amount`` each cell also holds moments that ``cell_amounts`` combines,
    with ``distinct`` a sketch of that column's values for ``distinct_estimate``.
    """
    sketch = [F.hll_sketch_agg(distinct, SKETCH_BITS).alias("sketch")] if distinct else []
    if amount is None:
        return df.groupBy(*keys).agg(_rows().alias("row_count"), *sketch)
    return df.groupBy(*keys).agg(
        _rows().alias("row_count"),
        F.count(amount).alias("value_count"),
        F.avg(amount).alias("mean"),
        (F.var_pop(amount) * F.count(amount)).alias("squares"),
        F.min(amount).alias("min"),
        F.max(amount).alias("max"),
        *sketch,
    )


def distinct_estimate(cells: DataFrame, *keys: str) -> DataFrame:
    """About how many distinct values there are per ``keys``, from the cells' sketches.

    ``estimate`` with ``low`` and ``high``, three standard errors off: with
    2 ** SKETCH_BITS registers one is 1.04 / 2 ** (SKETCH_BITS / 2), so they are
    4.9 percent away. Small numbers are exact but for equal hashes, and the
    bounds are at least one off. Any grouping that the cells' keys allow comes
    from the same few sketches, of some KB each, where exact figures need a
    shuffle of all values each; ``sender_stats`` gives these. Nulls aren't
    counted.
    """
    merged = cells.groupBy(*keys).agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))
    estimate = F.hll_sketch_estimate("sketch")
    off = F.greatest(F.ceil(estimate * SKETCH_ERROR), F.lit(1))
    found = merged.select(*keys, estimate.alias("estimate"), off.alias("off"))
    low = F.greatest(F.col("estimate") - F.col("off"), F.lit(0)).alias("low")
    return found.select(*keys, "estimate", low, (F.col("estimate") + F.col("off")).alias("high"))


def cell_amounts(cells: DataFrame, *, label: str = S.LABEL) -> DataFrame:
    """What ``amounts`` gives, from the moments of a few dozen cells.

    Squares are sums of squared distances from each cell's mean, so that
    nothing large cancels when they are combined.
    """
    n, mean = F.col("value_count"), F.col("mean")

    def mean_of(*condition: Column) -> Column:
        used = mean.isNotNull()
        for c in condition:
            used &= c
        total = F.sum(F.when(used, mean * n))
        return total / F.sum(F.when(used, n))

    whole = cells.agg(
        F.coalesce(F.sum("value_count"), F.lit(0)).alias("value_count"),
        mean_of().alias("mean"),
        F.collect_list(F.struct("value_count", "mean", "squares")).alias("parts"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.coalesce(mean_of(F.col(label) == 1), F.lit(0.0)).alias("mean_fraud"),
        F.coalesce(mean_of(F.col(label) == 0), F.lit(0.0)).alias("mean_normal"),
    )
    squares = F.aggregate(
        F.filter("parts", lambda p: p["mean"].isNotNull()),
        F.lit(0.0),
        lambda total, p: total
        + p["squares"]
        + p["value_count"] * F.pow(p["mean"] - F.col("mean"), F.lit(2.0)),
    )
    stddev = F.when(F.col("value_count") > 1, F.sqrt(squares / (F.col("value_count") - 1)))
    return whole.select(
        "value_count", "mean", stddev.alias("stddev"), "min", "max", "mean_fraud", "mean_normal"
    )


def label_counts(
    df: DataFrame, *, label: str = S.LABEL, weight: str | None = None
) -> DataFrame:
    """All rows, fraud rows and normal rows; rows without a label are in neither."""
    return df.agg(*_label_aggregates(label, weight))


def fraud_share(df: DataFrame, *, label: str = S.LABEL, weight: str | None = None) -> DataFrame:
    """Fraud in percent of the labelled rows."""
    labelled = F.col("fraud") + F.col("normal")
    return label_counts(df, label=label, weight=weight).select(
        "fraud", "normal", percent("fraud", labelled, 3).alias("fraud_percent")
    )


def cross_tab(df: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """Rows per combination of ``keys``, nulls as a group of their own, sorted."""
    return df.groupBy(*keys).agg(_rows(weight=weight).alias("row_count")).orderBy(*keys)


def fraud_by(
    df: DataFrame, key: str, *, label: str = S.LABEL, weight: str | None = None
) -> DataFrame:
    """Fraud rows per value of ``key``."""
    fraud = labelled_as(df, 1, label=label)
    return fraud.groupBy(key).agg(_rows(weight=weight).alias("fraud"))


def mean_by_label(df: DataFrame, *, label: str = S.LABEL, amount: str = S.AMOUNT) -> DataFrame:
    return df.agg(*_mean_aggregates(label, amount))


def describe(df: DataFrame, column: str = S.AMOUNT) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum, as numbers."""
    return df.agg(*_value_aggregates(column))


def detection_rate(
    df: DataFrame, *, label: str = S.LABEL, flag: str = S.FLAG, weight: str | None = None
) -> DataFrame:
    """How much of the fraud the existing flag caught."""
    total = F.col("caught") + F.col("missed")
    return df.agg(*_flag_aggregates(label, flag, weight)).select(
        "caught",
        "missed",
        total.alias("fraud"),
        ratio("caught", total).alias("recall"),
        percent("caught", total, 2).alias("recall_percent"),
    )


def rows_per_sender(df: DataFrame, *, sender: str = S.SENDER) -> DataFrame:
    return df.groupBy(sender).agg(F.count(F.lit(1)).alias("row_count"))


def sender_stats(df: DataFrame, *, sender: str = S.SENDER, counted: bool = False) -> DataFrame:
    """Rows, distinct senders and rows per sender.

    Counts the groups rather than distinct values: a null sender is one group.
    With ``counted``, ``df`` is a stored result of ``rows_per_sender``.
    """
    per_sender = df if counted else rows_per_sender(df, sender=sender)
    totals = per_sender.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("senders"),
    )
    return totals.withColumn("rows_per_sender", F.round(ratio("row_count", "senders"), 2))


def top_senders(
    df: DataFrame, k: int = 10, *, sender: str = S.SENDER, counted: bool = False
) -> DataFrame:
    """The ``k`` busiest senders; equal counts in order of the sender's name.

    With ``counted``, ``df`` is a stored result of ``rows_per_sender``.
    """
    per_sender = df if counted else rows_per_sender(df, sender=sender)
    return per_sender.orderBy(F.desc("row_count"), F.asc(sender)).limit(k)


def overview(
    df: DataFrame, *, label: str = S.LABEL, flag: str = S.FLAG, amount: str = S.AMOUNT
) -> DataFrame:
    """Every global figure of the exploration in a single pass over three columns."""
    return df.agg(
        *_label_aggregates(label), *_flag_aggregates(label, flag), *_mean_aggregates(label, amount)
    )


def amounts(df: DataFrame, *, label: str = S.LABEL, amount: str = S.AMOUNT) -> DataFrame:
    """``describe`` and ``mean_by_label`` in one pass."""
    return df.agg(*_value_aggregates(amount), *_mean_aggregates(label, amount))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows in the order of all columns, so the same ones each time."""
    return df.orderBy(*df.columns).limit(n)
