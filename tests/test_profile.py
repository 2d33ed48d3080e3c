import pytest
from conftest import DATA
from frames import one, transactions
from pyspark.sql import functions as F

from txscreen.operators import prepare, profile
from txscreen.plans import catalog, screening


def test_counts_leave_null_labels_out(spark):
    tx = transactions(spark, {"isFraud": None}, {"isFraud": 1}, {}, {})
    assert one(profile.label_counts(tx)) == {"row_count": 4, "fraud": 1, "normal": 2}
    assert one(profile.fraud_share(tx))["fraud_percent"] == pytest.approx(33.333)


def test_cross_tab_keeps_null_as_a_group(spark):
    tx = transactions(spark, {"isFraud": None}, {"isFraud": 1}, {})
    rows = [tuple(r) for r in profile.cross_tab(tx, "isFraud", "isFlaggedFraud").collect()]
    assert rows == [(None, 0, 1), (0, 0, 1), (1, 0, 1)]


def test_means_leave_null_labels_out(spark):
    tx = transactions(
        spark, {"isFraud": None, "amount": 1e6}, {"amount": 10.0}, {"isFraud": 1, "amount": 30.0}
    )
    assert one(profile.mean_by_label(tx)) == {"mean_fraud": 30.0, "mean_normal": 10.0}


def test_no_fraud_gives_zeros(spark):
    tx = transactions(spark, {}, {"isFraud": None})
    assert one(profile.mean_by_label(tx))["mean_fraud"] == 0.0
    rate = one(profile.detection_rate(tx))
    assert (rate["fraud"], rate["recall"], rate["recall_percent"]) == (0, 0.0, 0.0)


def test_empty_table(spark):
    empty = transactions(spark, {}).filter("false")
    assert one(profile.overview(empty)) == {
        "row_count": 0, "fraud": 0, "normal": 0, "caught": 0, "missed": 0,
        "mean_fraud": 0.0, "mean_normal": 0.0,
    }
    senders = one(profile.sender_stats(empty))
    assert senders == {"row_count": 0, "senders": 0, "rows_per_sender": 0.0}
    assert one(profile.fraud_share(empty))["fraud_percent"] == 0.0


def test_null_sender_is_one_sender(spark):
    tx = transactions(spark, {}, {"nameOrig": None}, {"nameOrig": None}, {"nameOrig": "C3"})
    assert one(profile.sender_stats(tx)) == {"row_count": 4, "senders": 3, "rows_per_sender": 1.33}


def test_top_senders_break_ties_by_name(spark):
    tx = transactions(spark, *[{"nameOrig": n} for n in ("C3", "C2", "C1", "C3")])
    assert [r.nameOrig for r in profile.top_senders(tx, 2).collect()] == ["C3", "C1"]


def test_top_senders_plan_is_a_top_k(spark):
    top = profile.top_senders(transactions(spark, {}))
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_describe_agrees_with_the_builtin(spark):
    tx = catalog.transactions(spark, f"{DATA}/sf0.001")
    ours = list(one(profile.describe(tx)).values())
    builtin = [float(r.amount) for r in tx.select("amount").describe().collect()]
    assert ours == pytest.approx(builtin)


def test_exploration_agrees_with_single_operators(spark):
    tx = catalog.transactions(spark, f"{DATA}/sf0.001")
    typed = prepare.with_exchange_type(tx)
    expected = {
        "fraud_share": profile.fraud_share(tx),
        "label_counts": profile.label_counts(tx),
        "detection_rate": profile.detection_rate(tx),
        "flag_vs_label": profile.cross_tab(tx, "isFraud", "isFlaggedFraud"),
        "class_balance": profile.cross_tab(tx, "isFraud"),
        "label_by_type": profile.cross_tab(tx, "type", "isFraud"),
        "label_by_exchange": profile.cross_tab(typed, "typeEchange", "isFraud"),
        "fraud_by_type": profile.fraud_by(tx, "type"),
        "fraud_by_exchange": profile.fraud_by(typed, "typeEchange"),
    }
    explored = screening.explore(tx)
    for name, table in expected.items():
        assert sorted(map(str, explored[name].collect())) == sorted(map(str, table.collect())), name
    senders = [explored[n].collect() for n in ("senders", "top_senders")]
    assert senders == [profile.sender_stats(tx).collect(), profile.top_senders(tx).collect()]
    amounts = one(explored["amounts"])
    assert amounts == pytest.approx({**one(profile.describe(tx)), **one(profile.mean_by_label(tx))})


def test_amounts_of_cells_with_nulls_and_none(spark):
    rows = [{"amount": a, "isFraud": y} for a, y in ((1e9, 1), (None, 1), (1e9 + 1, 0), (5.0, None))]
    tx = prepare.with_exchange_type(transactions(spark, *rows))
    for table in (tx, tx.filter("step < 0"), tx.filter("amount IS NULL"), tx.limit(1)):
        cells = profile.cells(table, "type", "isFraud", amount="amount")
        found, plain = one(profile.cell_amounts(cells)), one(profile.amounts(table))
        assert {k: v and pytest.approx(v) for k, v in plain.items()} == found


def test_preview_is_ordered(spark):
    tx = transactions(spark, {"step": 3}, {"step": 1}, {"step": 2})
    assert [r.step for r in profile.preview(tx.repartition(3), 2).collect()] == [1, 2]


def test_sketches_merge_to_any_grouping(spark):
    """Per type, per label and over all, from one table of cells, next to exact counts."""
    rows = spark.range(60_000).selectExpr(
        "concat('T', id % 3) AS type", "cast(id % 2 AS int) AS isFraud",
        "concat('C', if(id % 5 = 0, 7, id % 23000)) AS nameOrig",
    )
    cells = profile.cells(rows, "type", "isFraud", distinct="nameOrig")
    for keys in (["type"], ["isFraud"], ["type", "isFraud"], []):
        exact = rows.groupBy(*keys).agg(F.countDistinct("nameOrig").alias("n"))
        found = profile.distinct_estimate(cells, *keys)
        both = found.join(exact, keys) if keys else found.crossJoin(exact)
        for r in both.collect():
            assert r.low <= r.n <= r.high
            assert r.high - r.low <= 2 * max(1, 0.05 * r.estimate)


def test_sketch_of_nulls_and_nothing(spark):
    tx = transactions(spark, {"nameOrig": None}, {"type": "X"}, {"type": "X", "nameOrig": "C9"})
    cells = profile.cells(tx, "type", distinct="nameOrig", amount="amount")
    found = {r.type: tuple(r)[1:] for r in profile.distinct_estimate(cells, "type").collect()}
    assert found == {"TRANSFER": (0, 0, 1), "X": (2, 1, 3)}
    assert profile.distinct_estimate(cells.filter("false"), "type").collect() == []
