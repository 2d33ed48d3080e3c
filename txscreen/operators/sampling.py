"""Samples and train/test splits, random and repeatable."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txscreen.functions import row_bucket, row_number

TRAIN, TEST = "train", "test"


def random_sample(df: DataFrame, fraction: float = 0.05, seed: int = 67) -> DataFrame:
    """Bernoulli sample; which rows it keeps depends on the partitioning."""
    return df.sample(fraction=fraction, seed=seed)


def random_split(df: DataFrame, train: float = 0.8, seed: int = 67) -> tuple[DataFrame, DataFrame]:
    """Random split of a stored table.

    Both parts recompute ``df``. Their rows only add up when it comes in the
    same partitions each time: give it a scan of files, not a shuffle's result.
    """
    first, second = df.randomSplit([train, 1.0 - train], seed=seed)
    return first, second


def hash_sample(df: DataFrame, percent: int = 5) -> DataFrame:
    """Rows of the first ``percent`` of 100 row buckets; the same ones in any layout."""
    return df.filter(row_bucket() < percent)


def fraction_sample(df: DataFrame, fraction: float = 0.05, seed: int = 67) -> DataFrame:
    """Any ``fraction`` of the rows, chosen by a hash of row and seed.

    The same rows in any layout, on any cluster and at every run, as a filter
    of the scan; another seed chooses others. Exact copies are chosen together,
    and a larger fraction of one seed holds all rows of a smaller one.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"a fraction is from 0 to 1, not {fraction}")
    return df.filter(row_number(seed) < F.lit(round(fraction * 2**52)))


def with_part(df: DataFrame, train_percent: int = 80, *, column: str = "part") -> DataFrame:
    """Mark each row ``train`` or ``test`` by its bucket.

    Needs the account ids, so it comes before they are projected away. Exact
    copies always land on the same side.
    """
    return df.withColumn(column, F.when(row_bucket() < train_percent, TRAIN).otherwise(TEST))
