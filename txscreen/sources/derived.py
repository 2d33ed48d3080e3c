"""A transactions table derived from the ``events`` test table."""

from pyspark.sql import DataFrame

from txscreen import schema as S

# The expressions the expected results were worked out with (FIXTURES.md).
_ORIGIN = "CAST((event_id % 7) * 10000 AS DOUBLE)"
_DESTINATION = "CAST((event_id % 11) * 5000 AS DOUBLE)"
_K = "CAST(get_json_object(props, '$.k') AS INT)"
_KIND = """
    CASE event_type WHEN 'view' THEN 'PAYMENT' WHEN 'signup' THEN 'CASH_IN'
    WHEN 'click' THEN 'DEBIT' WHEN 'purchase' THEN 'TRANSFER' ELSE 'CASH_OUT' END
"""
_LABEL = """
    CASE WHEN event_id % 97 = 0 THEN NULL
    WHEN type IN ('TRANSFER', 'CASH_OUT') AND amount > 90000D AND event_id % 3 <> 0 THEN 1
    WHEN event_id % 211 = 1 AND type = 'TRANSFER' THEN 1 ELSE 0 END
"""
_COLUMNS = {
    "step": "CAST((day(ts) - 1) * 24 + hour(ts) AS INT) + 1",
    S.KIND: "type",
    S.AMOUNT: "amount",
    S.SENDER: "concat('C', user_id)",
    "oldbalanceOrg": _ORIGIN,
    "newbalanceOrig": f"greatest(round({_ORIGIN} - amount, 2), 0D)",
    S.RECEIVER: f"concat(if(type = 'PAYMENT', 'M', 'C'), {_K})",
    "oldbalanceDest": _DESTINATION,
    "newbalanceDest": f"round({_DESTINATION} + amount, 2)",
    S.LABEL: _LABEL,
    S.FLAG: "if(type = 'TRANSFER' AND amount > 200000D, 1, 0)",
}


def transactions_from_events(events: DataFrame) -> DataFrame:
    """One transaction per event, every 50th event twice, from a single scan."""
    columns = [f"{expression} AS {name}" for name, expression in _COLUMNS.items()]
    copies = "explode(if(event_id % 50 = 0, array(1, 2), array(1))) AS copy"
    return (
        events.selectExpr("*", f"{_KIND} AS type", "round(value * 1000, 2) AS amount")
        .selectExpr(*columns, copies)
        .select(*S.TRANSACTION_SCHEMA.names)
    )
