"""Filters, deduplication and the cleaning chain."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txscreen import schema as S
from txscreen.functions import exchange_type, rule_flag


def with_exchange_type(
    df: DataFrame, *, sender: str = S.SENDER, receiver: str = S.RECEIVER, column: str = S.EXCHANGE
) -> DataFrame:
    return df.withColumn(column, exchange_type(sender, receiver))


def with_rule_flag(df: DataFrame, *, column: str = "ruleFlag", **rule) -> DataFrame:
    return df.withColumn(column, rule_flag(**rule))


def labelled_as(df: DataFrame, value: int, *, label: str = S.LABEL) -> DataFrame:
    """Rows whose label is ``value``; a null label is neither 0 nor 1."""
    return df.filter(F.col(label) == value)


def missed_by_flag(df: DataFrame, *, label: str = S.LABEL, flag: str = S.FLAG) -> DataFrame:
    return df.filter((F.col(label) == 1) & (F.col(flag) == 0))


def drop_null_label(df: DataFrame, *, label: str = S.LABEL) -> DataFrame:
    """Rows with a label, by a predicate that reaches the scan (``dropna`` does not)."""
    return df.filter(F.col(label).isNotNull())


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of each set of exact copies.

    Copies are collapsed in the map tasks before the shuffle, so a group of
    copies of any size costs each reducer at most one row per map task.
    """
    return df.dropDuplicates()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def unique_labelled(df: DataFrame, *, label: str = S.LABEL) -> DataFrame:
    """Labelled rows without exact copies, all columns still there."""
    return drop_duplicate_rows(drop_null_label(df, label=label))


def to_features(df: DataFrame) -> DataFrame:
    """Account ids and the rule's flag out, the exchange type in."""
    return with_exchange_type(df).select(*S.CLEAN_COLUMNS)


def clean(df: DataFrame, *, label: str = S.LABEL) -> DataFrame:
    """Copies and unlabelled rows out, then the feature columns.

    Copies are judged on whole rows: rows that become equal only once the
    account ids are gone all stay.
    """
    return to_features(unique_labelled(df, label=label))
