from txscreen.functions.columns import (
    account_kind,
    cents,
    exchange_type,
    fraud_probability,
    key_bucket,
    percent,
    ratio,
    row_bucket,
    row_number,
    rule_flag,
)

__all__ = [
    "account_kind",
    "cents",
    "exchange_type",
    "fraud_probability",
    "key_bucket",
    "percent",
    "ratio",
    "row_bucket",
    "row_number",
    "rule_flag",
]
