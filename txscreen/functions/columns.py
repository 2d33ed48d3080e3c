"""Column expressions; all of them stay in the JVM."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from txscreen import schema as S

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def account_kind(account: ColumnOrName) -> Column:
    """First letter of an account id: C for a client, M for a merchant."""
    return F.left(_col(account), F.lit(1))


def exchange_type(sender: ColumnOrName = S.SENDER, receiver: ColumnOrName = S.RECEIVER) -> Column:
    """Kinds of both parties, e.g. ``CM``; null when an account is null."""
    return F.concat(account_kind(sender), account_kind(receiver))


def ratio(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """``part / whole``, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(_col(part), _col(whole)), F.lit(0.0))


def percent(part: ColumnOrName, whole: ColumnOrName, places: int) -> Column:
    return F.round(ratio(_col(part) * F.lit(100.0), whole), places)


def rule_flag(
    kind: ColumnOrName = S.KIND,
    amount: ColumnOrName = S.AMOUNT,
    *,
    on_kind: str = S.RULE_KIND,
    limit: float = S.RULE_LIMIT,
) -> Column:
    """1 when a payment of ``on_kind`` exceeds ``limit``, else 0."""
    hit = (_col(kind) == on_kind) & (_col(amount) > F.lit(float(limit)))
    return F.when(hit, 1).otherwise(0)


def cents(amount: ColumnOrName) -> Column:
    """Amount as whole cents, a form that prints the same in every engine."""
    return F.floor(_col(amount) * F.lit(100.0) + F.lit(0.5))


def key_bucket(*keys: ColumnOrName, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 that depends on the values of ``keys`` only.

    Unlike ``rand`` it does not change with partitioning, task retries or the
    number of executors. Pass integer and string columns; doubles print
    differently from engine to engine (see ``cents``).
    """
    digest = F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _row_keys() -> list[Column]:
    return [
        cents(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in S.TRANSACTION_SCHEMA
        if f.name not in (S.LABEL, S.FLAG)
    ]


def row_bucket(buckets: int = 100) -> Column:
    """``key_bucket`` over every column of a transaction but label and flag.

    All the columns take part so that one busy sender or one busy pair of
    accounts spreads over the buckets; only exact copies stay together.
    """
    return key_bucket(*_row_keys(), buckets=buckets)


def row_number(seed: int) -> Column:
    """A number from 0 to 2**52 - 1 that row and ``seed`` decide, as ``row_bucket`` does."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in _row_keys()]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def fraud_probability(probability: ColumnOrName = "probability") -> Column:
    """P(label = 1) out of a classifier's probability vector.

    A model trained on one class only has no second element; that is 0.
    """
    return F.coalesce(F.get(vector_to_array(_col(probability)), 1), F.lit(0.0))
