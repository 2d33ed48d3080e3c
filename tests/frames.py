"""Hand-made transactions."""

from txscreen.schema import TRANSACTION_SCHEMA

BASE = {
    "step": 1,
    "type": "TRANSFER",
    "amount": 100.0,
    "nameOrig": "C1",
    "oldbalanceOrg": 0.0,
    "newbalanceOrig": 0.0,
    "nameDest": "C2",
    "oldbalanceDest": 0.0,
    "newbalanceDest": 0.0,
    "isFraud": 0,
    "isFlaggedFraud": 0,
}


def transactions(spark, *changes):
    rows = [tuple({**BASE, **c}.values()) for c in changes]
    return spark.createDataFrame(rows, TRANSACTION_SCHEMA)


def one(df):
    (row,) = df.collect()
    return row.asDict()
