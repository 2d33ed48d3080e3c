import re

import pytest
from conftest import DATA
from frames import transactions
from pyspark.sql import functions as F

from txscreen import functions as fn
from txscreen.operators import prepare, sampling
from txscreen.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_label_is_neither_fraud_nor_normal(spark):
    tx = transactions(spark, {"isFraud": None}, {"isFraud": 1}, {"isFraud": 0})
    assert prepare.labelled_as(tx, 0).count() == 1
    assert prepare.labelled_as(tx, 1).count() == 1
    assert prepare.drop_null_label(tx).count() == 2


def test_copies_are_judged_before_ids_are_dropped(spark):
    tx = transactions(spark, {}, {}, {"nameOrig": "C9"}, {"isFraud": None})
    cleaned = prepare.clean(tx)
    assert cleaned.count() == 2
    assert cleaned.distinct().count() == 1
    assert "nameOrig" not in cleaned.columns and "isFlaggedFraud" not in cleaned.columns


def test_exchange_type(spark):
    tx = transactions(spark, {"nameDest": "M3"}, {"nameOrig": None})
    kinds = {r.typeEchange for r in prepare.with_exchange_type(tx).collect()}
    assert kinds == {"CM", None}


@pytest.mark.parametrize(
    "kind, amount, flag",
    [
        ("TRANSFER", 200000.0, 0),
        ("TRANSFER", 200000.01, 1),
        ("CASH_OUT", 900000.0, 0),
        (None, 1e9, 0),
    ],
)
def test_rule_flag(spark, kind, amount, flag):
    tx = transactions(spark, {"type": kind, "amount": amount})
    assert prepare.with_rule_flag(tx).first().ruleFlag == flag


def test_missed_by_flag(spark):
    tx = transactions(spark, {"isFraud": 1}, {"isFraud": 1, "isFlaggedFraud": 1}, {})
    assert prepare.missed_by_flag(tx).count() == 1


def test_ratio_is_guarded(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a long, b long")
    assert [r.x for r in df.select(fn.ratio("a", "b").alias("x")).collect()] == [0.0, 0.25]


def test_label_filter_reaches_the_scan(spark, tmp_path):
    transactions(spark, {}, {"isFraud": None}).write.parquet(str(tmp_path / "t"))
    cleaned = prepare.clean(spark.read.parquet(str(tmp_path / "t")))
    assert "PushedFilters: [IsNotNull(isFraud)]" in plan(cleaned)


def test_columns_are_pruned(spark, tmp_path):
    transactions(spark, {}).write.parquet(str(tmp_path / "t"))
    tx = spark.read.parquet(str(tmp_path / "t"))
    fraud = prepare.labelled_as(tx, 1).groupBy("type").count()
    assert re.search(r"ReadSchema: struct<type:string,isFraud:int>", plan(fraud))


def test_hash_split_does_not_depend_on_layout(spark):
    tx = catalog.transactions(spark, f"{DATA}/sf0.001")

    def parts(df):
        return sorted(map(str, sampling.with_part(df).collect()))

    assert parts(tx) == parts(tx.repartition(7))
    shares = {r.part: r["count"] for r in sampling.with_part(tx).groupBy("part").count().collect()}
    assert 0.75 < shares["train"] / sum(shares.values()) < 0.85


def test_hash_split_spreads_one_busy_sender(spark):
    busy = spark.range(3000).select(
        F.lit(1).alias("step"),
        F.lit("TRANSFER").alias("type"),
        (F.col("id") / 100).alias("amount"),
        F.lit("C1").alias("nameOrig"),
        *[F.lit(0.0).alias(c) for c in ("oldbalanceOrg", "newbalanceOrig")],
        F.lit("C2").alias("nameDest"),
        *[F.lit(0.0).alias(c) for c in ("oldbalanceDest", "newbalanceDest")],
    )
    train = sampling.with_part(busy).filter("part = 'train'").count()
    assert 0.75 < train / 3000 < 0.85


def test_copies_share_a_part(spark):
    tx = catalog.transactions(spark, f"{DATA}/sf0.001")
    sides = sampling.with_part(tx).groupBy(*tx.columns).agg(F.countDistinct("part").alias("n"))
    assert sides.filter("n > 1").count() == 0


def test_random_split_covers_a_stored_table(spark, tmp_path):
    prepare.clean(catalog.transactions(spark, f"{DATA}/sf0.01")).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    first, second = sampling.random_split(stored)
    assert stored.exceptAll(first.unionByName(second)).count() == 0
    assert first.count() + second.count() == stored.count()
    assert 0.75 < first.count() / stored.count() < 0.85


def test_random_sample_size(spark):
    tx = catalog.transactions(spark, f"{DATA}/sf0.01")
    assert 0.03 < sampling.random_sample(tx).count() / tx.count() < 0.07


def test_fraction_sample_of_any_layout(spark):
    tx = catalog.transactions(spark, f"{DATA}/sf0.01")

    def kept(df, fraction, seed=67):
        return sorted(map(str, sampling.fraction_sample(df, fraction, seed).collect()))

    small = kept(tx, 0.0125)
    assert small == kept(tx.repartition(7), 0.0125)
    assert 0.008 < len(small) / tx.count() < 0.018
    assert set(small) <= set(kept(tx, 0.2)) and kept(tx, 0.2) != kept(tx, 0.2, seed=5)
    assert len(kept(tx, 1.0)) == tx.count() and kept(tx, 0.0) == []
    for wrong in (-0.1, 1.1):
        with pytest.raises(ValueError, match="from 0 to 1"):
            sampling.fraction_sample(tx, wrong)


def test_fraction_sample_filters_the_scan(spark):
    sample = sampling.fraction_sample(catalog.transactions(spark, f"{DATA}/sf0.001"), 0.1)
    assert "Exchange" not in plan(sample)


def test_fraud_probability_of_a_one_class_model(spark):
    from pyspark.ml.linalg import Vectors

    vectors = [(Vectors.dense(1.0),), (Vectors.dense(0.25, 0.75),)]
    df = spark.createDataFrame(vectors, ["probability"])
    scores = df.select(fn.fraud_probability().alias("s")).collect()
    assert [r.s for r in scores] == [0.0, 0.75]


