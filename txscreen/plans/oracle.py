"""The same results in SQL, for DuckDB over the same tables."""

from txscreen import schema as S

_DERIVED = """
WITH kinds AS (
  SELECT *,
    CASE event_type WHEN 'view' THEN 'PAYMENT' WHEN 'signup' THEN 'CASH_IN'
      WHEN 'click' THEN 'DEBIT' WHEN 'purchase' THEN 'TRANSFER' ELSE 'CASH_OUT' END AS type,
    ROUND(value * 1000, 2) AS amount
  FROM events
), once AS (
  SELECT event_id,
    CAST((day(ts) - 1) * 24 + hour(ts) AS INTEGER) + 1 AS step,
    type,
    amount,
    'C' || CAST(user_id AS VARCHAR) AS nameOrig,
    CAST((event_id % 7) * 10000 AS DOUBLE) AS oldbalanceOrg,
    CASE WHEN ROUND((event_id % 7) * 10000 - amount, 2) > 0
      THEN ROUND((event_id % 7) * 10000 - amount, 2) ELSE CAST(0 AS DOUBLE) END AS newbalanceOrig,
    CASE type WHEN 'PAYMENT' THEN 'M' ELSE 'C' END
      || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS nameDest,
    CAST((event_id % 11) * 5000 AS DOUBLE) AS oldbalanceDest,
    ROUND((event_id % 11) * 5000 + amount, 2) AS newbalanceDest,
    CAST(CASE WHEN event_id % 97 = 0 THEN NULL
      WHEN type IN ('TRANSFER', 'CASH_OUT') AND amount > 90000 AND event_id % 3 <> 0 THEN 1
      WHEN event_id % 211 = 1 AND type = 'TRANSFER' THEN 1
      ELSE 0 END AS INTEGER) AS isFraud,
    CAST(CASE WHEN type = 'TRANSFER' AND amount > 200000 THEN 1 ELSE 0 END AS INTEGER)
      AS isFlaggedFraud
  FROM kinds
), tx AS (
  SELECT * EXCLUDE (event_id) FROM once
  UNION ALL
  SELECT * EXCLUDE (event_id) FROM once WHERE event_id % 50 = 0
), typed AS (
  SELECT *, substr(nameOrig, 1, 1) || substr(nameDest, 1, 1) AS typeEchange FROM tx
), clean AS (
  SELECT step, type, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest,
    typeEchange, isFraud
  FROM (SELECT DISTINCT * FROM typed) WHERE isFraud IS NOT NULL
), ruled AS (
  SELECT *, CAST(CASE WHEN type = 'TRANSFER' AND amount > 200000 THEN 1 ELSE 0 END AS INTEGER)
    AS ruleFlag
  FROM tx
), scored AS (
  SELECT *, CASE WHEN score > CAST(0.3 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)
    END AS prediction
  FROM (SELECT *, ROUND(amount / CAST(500000 AS DOUBLE), 6) AS score FROM ruled
    WHERE isFraud IS NOT NULL)
), bucketed AS (
  SELECT *, CAST('0x' || substr(md5(keys), 1, 8) AS BIGINT) % 100 AS bucket
  FROM (SELECT *, concat_ws('|', step, type,
      CAST(floor(amount * 100 + 0.5) AS BIGINT), nameOrig,
      CAST(floor(oldbalanceOrg * 100 + 0.5) AS BIGINT),
      CAST(floor(newbalanceOrig * 100 + 0.5) AS BIGINT),
      nameDest, CAST(floor(oldbalanceDest * 100 + 0.5) AS BIGINT),
      CAST(floor(newbalanceDest * 100 + 0.5) AS BIGINT)) AS keys FROM tx)
), type_index AS (
  SELECT type,
    CAST(row_number() OVER (ORDER BY count(*) DESC, type) - 1 AS DOUBLE) AS type_num
  FROM clean GROUP BY type
), exchange_index AS (
  SELECT typeEchange,
    CAST(row_number() OVER (ORDER BY count(*) DESC, typeEchange) - 1 AS DOUBLE) AS typeEchange_num
  FROM clean GROUP BY typeEchange
), per_score AS (
  SELECT score, count(*) FILTER (WHERE isFraud = 1) AS pos,
    count(*) FILTER (WHERE isFraud = 0) AS neg
  FROM scored GROUP BY score
), ranked AS (
  SELECT pos, neg,
    coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS below
  FROM per_score
), area AS (
  SELECT coalesce(CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / 2
    / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0), CAST(0 AS DOUBLE)) AS auc
  FROM ranked
), counts AS (
  SELECT count(*) FILTER (WHERE isFraud = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE isFraud = 1 AND prediction = 0) AS fn,
    count(*) FILTER (WHERE isFraud = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE isFraud = 0 AND prediction = 0) AS tn
  FROM scored
)
"""


def _guarded(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), CAST(0 AS DOUBLE))"


def _percent(part: str, whole: str, places: int) -> str:
    share = f"coalesce(CAST(100 AS DOUBLE) * {part} / nullif({whole}, 0), CAST(0 AS DOUBLE))"
    return f"ROUND({share}, {places})"


def _where(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_CAUGHT = _where("isFraud = 1 AND isFlaggedFraud = 1")
_MISSED = _where("isFraud = 1 AND isFlaggedFraud = 0")
_FRAUD = _where("isFraud = 1")
_NORMAL = _where("isFraud = 0")
_MEANS = """
  ROUND(coalesce(avg(amount) FILTER (WHERE isFraud = 1), CAST(0 AS DOUBLE)), 4) AS mean_fraud,
  ROUND(coalesce(avg(amount) FILTER (WHERE isFraud = 0), CAST(0 AS DOUBLE)), 4) AS mean_normal
"""


def _count_by(table: str, *keys: str) -> str:
    names = ", ".join(keys)
    return f"SELECT {names}, count(*) AS row_count FROM {table} GROUP BY {names}"


def _schema_rows() -> str:
    names = {"INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double"}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return " UNION ALL ".join(
        f"SELECT DISTINCT CAST({i} AS INTEGER) AS position, '{f.name}' AS column_name, "
        f"CASE typeof({f.name}) {cases} END AS column_type FROM tx"
        for i, f in enumerate(S.TRANSACTION_SCHEMA)
    )


def _sweep() -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST({t} AS DOUBLE) AS threshold, tp, fn, fp,
        {_percent('tp', '(tp + fn)', 9)} AS recall_percent
        FROM (SELECT {_where(f'isFraud = 1 AND score >= CAST({t} AS DOUBLE)')} AS tp,
          {_where(f'isFraud = 1 AND score < CAST({t} AS DOUBLE)')} AS fn,
          {_where(f'isFraud = 0 AND score >= CAST({t} AS DOUBLE)')} AS fp FROM scored)"""
        for t in S.THRESHOLDS
    )


def _alerts() -> str:
    alerts = {"flag": "isFlaggedFraud", "rule": "ruleFlag", "score": "prediction"}
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS system, caught, missed, false_alerts,
        {_percent('caught', '(caught + missed)', 2)} AS recall_percent
        FROM (SELECT {_where(f'isFraud = 1 AND {column} = 1')} AS caught,
          {_where(f'isFraud = 1 AND {column} = 0')} AS missed,
          {_where(f'isFraud = 0 AND {column} = 1')} AS false_alerts FROM scored)"""
        for name, column in alerts.items()
    )


_TEST_PART = """(SELECT * FROM (SELECT DISTINCT * FROM bucketed)
        WHERE isFraud IS NOT NULL AND bucket >= 80)"""
_INDEXED = "clean JOIN type_index USING (type) JOIN exchange_index USING (typeEchange)"
_WEIGHTED = f"""
SELECT ROUND(accuracy, 9) AS accuracy,
  ROUND((p1 * n1 + p0 * n0) / (n1 + n0), 9) AS weighted_precision,
  ROUND((r1 * n1 + r0 * n0) / (n1 + n0), 9) AS weighted_recall,
  ROUND((n1 * coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0)
    + n0 * coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0)) / (n1 + n0), 9) AS f1
FROM (SELECT tp + fn AS n1, tn + fp AS n0, {_guarded('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
  {_guarded('tp', '(tp + fp)')} AS p1, {_guarded('tn', '(tn + fn)')} AS p0,
  {_guarded('tp', '(tp + fn)')} AS r1, {_guarded('tn', '(tn + fp)')} AS r0 FROM counts)
"""

_BODIES = {
    "scan_transactions": "SELECT * FROM tx",
    "csv_roundtrip": "SELECT * FROM tx",
    "sample_roundtrip": "SELECT * EXCLUDE (bucket, keys) FROM bucketed WHERE bucket < 5",
    "schema_profile": _schema_rows(),
    "preview": f"SELECT * FROM tx ORDER BY {', '.join(S.TRANSACTION_SCHEMA.names)} LIMIT 5",
    "sample_hash": "SELECT * EXCLUDE (bucket, keys) FROM bucketed WHERE bucket < 5",
    "sample_fraction": """SELECT * EXCLUDE (bucket, keys) FROM bucketed
        WHERE CAST('0x' || substr(md5('67|' || keys), 1, 13) AS BIGINT) < 562949953421312""",
    "csv_account": """SELECT count(*) AS line_count, count(*) FILTER (bucket > 3) AS row_count,
        count(*) FILTER (bucket < 4) AS refused_count, count(*) FILTER (bucket < 4) AS listed_count,
        count(*) FILTER (bucket > 3 AND isFraud = 1) AS fraud FROM bucketed""",
    "csv_rows_kept": "SELECT * EXCLUDE (bucket, keys) FROM bucketed WHERE bucket > 3",
    "senders_by_type": """SELECT type, count(DISTINCT nameOrig) AS senders, TRUE AS held
        FROM tx GROUP BY type""",
    "split_hash": """SELECT * EXCLUDE (bucket, keys),
        CASE WHEN bucket < 80 THEN 'train' ELSE 'test' END AS part FROM bucketed""",
    "split_random_rows": "SELECT * FROM clean",
    "train_test_rows": """SELECT step, type, amount, oldbalanceOrg, newbalanceOrig,
        oldbalanceDest, newbalanceDest, substr(nameOrig, 1, 1) || substr(nameDest, 1, 1)
        AS typeEchange, isFraud, CASE WHEN bucket < 80 THEN 'train' ELSE 'test' END AS part
        FROM (SELECT DISTINCT * FROM bucketed) WHERE isFraud IS NOT NULL""",
    "account_kind": """SELECT nameOrig, substr(nameOrig, 1, 1) AS sender_kind, nameDest,
        substr(nameDest, 1, 1) AS receiver_kind FROM tx""",
    "exchange_type": "SELECT * FROM typed",
    "clean_features": f"SELECT {', '.join(S.CLEAN_COLUMNS)} FROM typed",
    "fraud_rows": "SELECT * FROM tx WHERE isFraud = 1",
    "missed_by_flag": "SELECT * FROM tx WHERE isFraud = 1 AND isFlaggedFraud = 0",
    "drop_null_label": "SELECT * FROM tx WHERE isFraud IS NOT NULL",
    "rule_flag": "SELECT * FROM ruled",
    "rule_flag_agreement": _count_by("ruled", "isFlaggedFraud", "ruleFlag"),
    "dedup_rows": "SELECT DISTINCT * FROM tx",
    "distinct_senders": "SELECT DISTINCT nameOrig FROM tx",
    "clean_transactions": "SELECT * FROM clean",
    "row_count": "SELECT count(*) AS row_count FROM tx",
    "label_counts": f"SELECT count(*) AS row_count, {_FRAUD} AS fraud, {_NORMAL} AS normal FROM tx",
    "class_balance": _count_by("tx", "isFraud"),
    "fraud_by_type": "SELECT type, count(*) AS fraud FROM tx WHERE isFraud = 1 GROUP BY type",
    "fraud_by_exchange": """SELECT typeEchange, count(*) AS fraud FROM typed WHERE isFraud = 1
        GROUP BY typeEchange""",
    "flag_vs_label": _count_by("tx", "isFraud", "isFlaggedFraud"),
    "label_by_type": _count_by("tx", "type", "isFraud"),
    "label_by_exchange": _count_by("typed", "typeEchange", "isFraud"),
    "mean_amount_by_label": f"SELECT {_MEANS} FROM tx",
    "amount_describe": """SELECT count(amount) AS value_count, ROUND(avg(amount), 4) AS mean,
        ROUND(stddev_samp(amount), 4) AS stddev, min(amount) AS min, max(amount) AS max FROM tx""",
    "bank_detection_rate": f"""SELECT caught, missed, caught + missed AS fraud,
        ROUND({_guarded('caught', '(caught + missed)')}, 9) AS recall,
        {_percent('caught', '(caught + missed)', 2)} AS recall_percent
        FROM (SELECT {_CAUGHT} AS caught, {_MISSED} AS missed FROM tx)""",
    "fraud_share": f"""SELECT fraud, normal, {_percent('fraud', '(fraud + normal)', 3)}
        AS fraud_percent FROM (SELECT {_FRAUD} AS fraud, {_NORMAL} AS normal FROM tx)""",
    "sender_stats": """SELECT row_count, senders,
        ROUND(CAST(row_count AS DOUBLE) / senders, 2) AS rows_per_sender
        FROM (SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT nameOrig FROM tx))
          AS senders FROM tx)""",
    "top_senders": """SELECT nameOrig, count(*) AS row_count FROM tx GROUP BY nameOrig
        ORDER BY row_count DESC, nameOrig LIMIT 10""",
    "overview": f"""SELECT count(*) AS row_count, {_FRAUD} AS fraud, {_NORMAL} AS normal,
        {_CAUGHT} AS caught, {_MISSED} AS missed, {_MEANS} FROM tx""",
    "index_type": "SELECT type, type_num FROM type_index",
    "index_exchange": "SELECT typeEchange, typeEchange_num FROM exchange_index",
    "assemble_full": f"""SELECT CAST(step AS DOUBLE) AS step, type_num, amount, oldbalanceOrg,
        newbalanceOrig, oldbalanceDest, newbalanceDest, typeEchange_num FROM {_INDEXED}""",
    "assemble_leakfree": f"""SELECT CAST(step AS DOUBLE) AS step, type_num, amount,
        typeEchange_num FROM {_INDEXED}""",
    "leakfree_columns": "SELECT step, type, amount, typeEchange, isFraud FROM clean",
    "auc_exact": "SELECT ROUND(auc, 9) AS auc FROM area",
    "auc_bounds": """SELECT ROUND(sure / pairs, 9) AS auc_low, ROUND((sure + unsure) / pairs, 9) AS auc_high
        FROM (SELECT CAST(sum(2 * pos * below + CASE WHEN one THEN pos * neg ELSE 0 END) AS DOUBLE) AS sure,
            CAST(sum(CASE WHEN one THEN 0 ELSE 2 * pos * neg END) AS DOUBLE) AS unsure,
            CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2 AS pairs
          FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY place
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
            FROM (SELECT least(floor(least(score, 1) * 1000), 999) AS place,
                count(*) FILTER (isFraud = 1) AS pos, count(*) FILTER (isFraud = 0) AS neg,
                min(score) = max(score) AS one FROM scored GROUP BY place)))""",
    "confusion_matrix": _count_by("scored", "isFraud", "prediction"),
    "confusion_of_cells": _count_by("scored", "isFraud", "prediction"),
    "metrics_of_cells": _WEIGHTED,
    "outcomes_of_cells": "SELECT tp, fn, fp FROM counts",
    "sweep_of_cells": _sweep(),
    "tp_fn_fp": "SELECT tp, fn, fp FROM counts",
    "recall": f"SELECT ROUND({_guarded('tp', '(tp + fn)')}, 9) AS recall FROM counts",
    "weighted_metrics": _WEIGHTED,
    "evaluation_summary": f"""SELECT (SELECT ROUND(auc, 9) FROM area) AS auc,
        ROUND({_guarded('tp', '(tp + fn)')}, 9) AS recall, tp, fn, fp FROM counts""",
    "recall_comparison": _alerts(),
    "threshold_sweep": _sweep(),
    "sample_and_rest": "SELECT * FROM tx",
    "scored_labels": f"""SELECT model, isFraud, count(*) AS row_count, count(*) AS rated
        FROM {_TEST_PART}, (VALUES ('with balances'), ('leak-free')) AS m(model)
        GROUP BY model, isFraud""",
    "sweep_totals_model": f"""SELECT CAST(threshold AS DOUBLE) AS threshold, {_FRAUD} AS fraud
        FROM {_TEST_PART}, (VALUES {', '.join(f'({t})' for t in S.THRESHOLDS)}) AS t(threshold)
        GROUP BY threshold""",
    "importance_check": """SELECT * FROM (VALUES
        ('with balances', 'amount,newbalanceDest,newbalanceOrig,oldbalanceDest,oldbalanceOrg,'
          || 'step,typeEchange_num,type_num', CAST(1 AS DOUBLE)),
        ('leak-free', 'amount,step,typeEchange_num,type_num', CAST(1 AS DOUBLE)))
        AS t(model, variables, total) WHERE EXISTS (SELECT * FROM clean)""",
    "model_totals": f"""SELECT system, {_FRAUD} AS fraud, count(*) AS scored
        FROM {_TEST_PART}, (VALUES ('with balances'), ('leak-free')) AS s(system) GROUP BY system
        UNION ALL SELECT 'existing flag', {_FRAUD}, count(*) FROM tx""",
}

# Results that show the label; it is given as a double there, as some labels are null.
_WITH_LABEL = """
    scan_transactions csv_roundtrip sample_roundtrip preview sample_hash split_hash
    exchange_type clean_features rule_flag dedup_rows class_balance flag_vs_label
    label_by_type label_by_exchange sample_and_rest sample_fraction csv_rows_kept
""".split()


def _comparable(name: str, body: str) -> str:
    if name not in _WITH_LABEL:
        return body
    return f"SELECT * REPLACE (CAST(isFraud AS DOUBLE) AS isFraud) FROM ({body})"


ORACLE_SQL = {name: _DERIVED + _comparable(name, body) for name, body in _BODIES.items()}
