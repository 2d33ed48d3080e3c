"""Feature columns, the guard against leaks, category indexes and assembly."""

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txscreen import schema as S

CATEGORIES = (S.KIND, S.EXCHANGE)


def index_name(category: str) -> str:
    return f"{category}_num"


# The two feature sets that get compared.
LEAK_FREE = ("step", index_name(S.KIND), S.AMOUNT, index_name(S.EXCHANGE))
FULL = ("step", index_name(S.KIND), S.AMOUNT, *S.BALANCE_COLUMNS, index_name(S.EXCHANGE))


class LeakError(ValueError):
    """A feature is only known after the event it should predict."""


def check_leaks(
    columns: Sequence[str],
    *,
    known_late: Sequence[str] = S.BALANCE_COLUMNS,
    allow_late: bool = False,
) -> tuple[str, ...]:
    """``columns``, or an error when one of them is known too late."""
    late = [c for c in columns if c in known_late]
    if late and not allow_late:
        raise LeakError(f"known only after the event: {', '.join(late)}")
    return tuple(columns)


def without_late_columns(
    df: DataFrame, *, known_late: Sequence[str] = S.BALANCE_COLUMNS
) -> DataFrame:
    return df.drop(*known_late)


def check_invalid(handle_invalid: str) -> str:
    """``error`` or ``keep``: skipping would drop rows without a word."""
    if handle_invalid not in ("error", "keep"):
        raise ValueError(f"handle_invalid is error or keep, not {handle_invalid}")
    return handle_invalid


def fit_indexers(
    df: DataFrame, categories: Sequence[str] = CATEGORIES, *, handle_invalid: str = "error"
) -> StringIndexerModel:
    """Index all ``categories`` by frequency, most frequent first, in one pass."""
    check_invalid(handle_invalid)
    return StringIndexer(
        inputCols=list(categories),
        outputCols=[index_name(c) for c in categories],
        handleInvalid=handle_invalid,
    ).fit(df)


def index_table(df: DataFrame, category: str) -> DataFrame:
    """Every value of ``category`` with the index a fitted indexer gives it.

    Nothing passes through the driver. Numbering the values takes one task, a
    row per value: this is for categories, not for account ids.
    """
    values = df.filter(F.col(category).isNotNull()).groupBy(category)
    counts = values.agg(F.count(F.lit(1)).alias("row_count"))
    place = F.row_number().over(W.orderBy(F.desc("row_count"), F.col(category))) - 1
    return counts.select(category, place.cast("double").alias(index_name(category)))


def assembler(columns: Sequence[str], *, handle_invalid: str = "error") -> VectorAssembler:
    check_invalid(handle_invalid)
    return VectorAssembler(
        inputCols=list(columns), outputCol="features", handleInvalid=handle_invalid
    )


def assemble(df: DataFrame, columns: Sequence[str], *, handle_invalid: str = "error") -> DataFrame:
    """Index the categories and add the vector ``features`` of ``columns``.

    Reads ``df`` once for the indexes and once for the rows: store it first
    when it is costly to make.
    """
    indexed = fit_indexers(df, handle_invalid=handle_invalid).transform(df)
    return assembler(columns, handle_invalid=handle_invalid).transform(indexed)


def vector_columns(df: DataFrame, columns: Sequence[str], *, vector: str = "features") -> DataFrame:
    """Read the elements of ``vector`` back as one double column each."""
    values = vector_to_array(F.col(vector))
    return df.select(*[values[i].alias(c) for i, c in enumerate(columns)])
