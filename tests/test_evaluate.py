import random

import pytest
from frames import one
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from txscreen.operators import evaluate
from txscreen.schema import THRESHOLDS

SCHEMA = "isFraud int, score double, prediction double"


def frame(spark, rows):
    predicted = [(y, s, float(s is not None and s > 0.5)) for y, s in rows]
    return spark.createDataFrame(predicted, SCHEMA)


def brute_auc(rows):
    fraud = [s for y, s in rows if y == 1]
    normal = [s for y, s in rows if y == 0]
    right = sum((f > n) + 0.5 * (f == n) for f in fraud for n in normal)
    return right / (len(fraud) * len(normal)) if fraud and normal else 0.0


def some_rows(n, distinct, seed=1):
    rnd = random.Random(seed)
    return [(int(rnd.random() < 0.3), rnd.randrange(distinct) / distinct) for _ in range(n)]


@pytest.mark.parametrize("distinct", [1, 2, 7, 100, 10_000])
def test_auc_against_all_pairs(spark, distinct):
    rows = some_rows(600, distinct)
    auc = one(evaluate.roc_auc(frame(spark, rows)))["auc"]
    assert auc == pytest.approx(brute_auc(rows), abs=1e-12)


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("slices", ["1", "3", "31"])
def test_auc_does_not_depend_on_the_ranges(spark, adaptive, slices):
    before = {
        k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    }
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        rows = some_rows(500, 400)
        auc = one(evaluate.roc_auc(frame(spark, rows).repartition(5)))["auc"]
        assert auc == pytest.approx(brute_auc(rows), abs=1e-12)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        for key, value in before.items():
            spark.conf.set(key, value)


def test_auc_with_a_third_of_the_rows_on_one_score(spark):
    rows = some_rows(400, 300) + [(int(i % 5 == 0), 0.25) for i in range(200)]
    auc = one(evaluate.roc_auc(frame(spark, rows)))["auc"]
    assert auc == pytest.approx(brute_auc(rows), abs=1e-12)


def test_auc_agrees_with_the_unbinned_evaluator(spark):
    df = frame(spark, some_rows(2000, 1500))
    builtin = BinaryClassificationEvaluator(
        labelCol="isFraud", rawPredictionCol="score", metricName="areaUnderROC", numBins=0
    )
    assert one(evaluate.roc_auc(df))["auc"] == pytest.approx(builtin.evaluate(df), abs=1e-9)


@pytest.mark.parametrize("rows", [[(0, 0.1), (0, 0.2)], [(1, 0.1)], []])
def test_auc_of_one_class_is_zero(spark, rows):
    result = one(evaluate.evaluation(frame(spark, rows)))
    assert result["auc"] == 0.0 and result["recall"] == 0.0


def test_auc_leaves_missing_scores_and_labels_out(spark):
    rows = some_rows(50, 20)
    odd = [(None, 0.3), (None, 0.9), (1, None), (0, None)]
    assert one(evaluate.roc_auc(frame(spark, rows + odd)))["auc"] == pytest.approx(brute_auc(rows))


def test_evaluation_is_its_parts(spark):
    df = frame(spark, some_rows(500, 90))
    whole = one(evaluate.evaluation(df))
    parts = {
        **one(evaluate.roc_auc(df)), **one(evaluate.recall(df)), **one(evaluate.outcome_counts(df))
    }
    assert whole == pytest.approx(parts)


def test_all_scores_never_meet_in_one_task(spark):
    plan = evaluate.roc_auc(frame(spark, some_rows(10, 10)))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    # The only single-task exchange comes after one row per range is left.
    above, _, below = text.partition("Exchange SinglePartition")
    assert "keys=[slice" not in above and "rangepartitioning(score" in below


def test_weighted_metrics_agree_with_the_evaluator(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 0, 0, 1, 2]), 0.0, float(rnd.choice([0, 0, 1, 3]))) for _ in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    ours = one(evaluate.weighted_metrics(df))
    names = {
        "accuracy": "accuracy",
        "weighted_precision": "weightedPrecision",
        "weighted_recall": "weightedRecall",
        "f1": "f1",
    }
    for column, metric in names.items():
        builtin = MulticlassClassificationEvaluator(
            labelCol="isFraud", predictionCol="prediction", metricName=metric
        )
        expected = builtin.evaluate(df.withColumn("isFraud", F.col("isFraud").cast("double")))
        assert ours[column] == pytest.approx(expected, abs=1e-9), column


def test_weighted_metrics_of_no_rows(spark):
    assert set(one(evaluate.weighted_metrics(frame(spark, []))).values()) == {0.0}


def test_sweep_against_single_counts(spark):
    rows = some_rows(300, 40)
    swept = {r.threshold: r for r in evaluate.threshold_sweep(frame(spark, rows)).collect()}
    assert tuple(swept) == THRESHOLDS
    for t, r in swept.items():
        assert r.tp == sum(y == 1 and s >= t for y, s in rows)
        assert r.fn == sum(y == 1 and s < t for y, s in rows)
        assert r.fp == sum(y == 0 and s >= t for y, s in rows)
        assert r.recall_percent == pytest.approx(100 * r.tp / (r.tp + r.fn))


def test_sweep_only_grows_as_the_threshold_falls(spark):
    rows = evaluate.threshold_sweep(frame(spark, some_rows(300, 100))).collect()
    assert len({r.tp + r.fn for r in rows}) == 1
    for higher, lower in zip(rows, rows[1:]):
        assert lower.tp >= higher.tp and lower.fp >= higher.fp


def test_sweep_takes_a_score_on_the_threshold(spark):
    tie = frame(spark, [(1, 0.5)])
    first = evaluate.threshold_sweep(tie).first()
    assert (first.threshold, first.tp, first.fn) == (0.5, 1, 0)
    assert one(evaluate.outcome_counts(tie)) == {"tp": 0, "fn": 1, "fp": 0}


def test_sweep_without_fraud(spark):
    rows = evaluate.threshold_sweep(frame(spark, [(0, 0.9), (None, 0.9)])).collect()
    assert {(r.tp, r.fn, r.fp, r.recall_percent) for r in rows} == {(0, 0, 1, 0.0)}


def test_sweep_is_one_scan(spark, tmp_path):
    frame(spark, some_rows(10, 5)).write.parquet(str(tmp_path / "s"))
    sweep = evaluate.threshold_sweep(spark.read.parquet(str(tmp_path / "s")))
    plan = sweep._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_comparison_of_alerts(spark):
    df = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (0, 0, 1), (None, 1, 1)], "isFraud int, a int, b int"
    )
    compared = evaluate.compare_alerts(df, {"first": "a", "second": "b"})
    rows = {r.system: r for r in compared.collect()}
    assert (rows["first"].caught, rows["first"].missed, rows["first"].false_alerts) == (1, 1, 0)
    assert (rows["second"].caught, rows["second"].missed, rows["second"].false_alerts) == (1, 1, 1)
    assert rows["first"].recall_percent == 50.0


def test_confusion_is_sorted_and_complete(spark):
    rows = some_rows(100, 10)
    cells = [tuple(r) for r in evaluate.confusion(frame(spark, rows)).collect()]
    assert cells == sorted(cells) and sum(c[2] for c in cells) == 100


def test_binned_area_is_close_to_the_exact_one(spark):
    df = frame(spark, some_rows(4000, 3000))
    exact = one(evaluate.roc_auc(df))["auc"]
    assert evaluate.binned_auc(df) == pytest.approx(exact, abs=1e-2)
    assert evaluate.binned_auc(df, bins=0) == pytest.approx(exact, abs=1e-9)


LABELS = st.sampled_from([0, 0, 1, None])
SCORES = st.one_of(st.none(), st.sampled_from([0.0, 0.05, 0.3, 0.5, 1.0]), st.floats(0, 1))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(LABELS, SCORES), max_size=40))
def test_any_rows(spark, rows):
    df = frame(spark, rows)
    known = [(y, s) for y, s in rows if s is not None]
    fraud = sum(y == 1 for y, _ in known)
    assert one(evaluate.roc_auc(df))["auc"] == pytest.approx(brute_auc(known), abs=1e-12)
    for r in evaluate.threshold_sweep(df).collect():
        assert r.tp + r.fn == fraud
        assert r.fp == sum(y == 0 and s >= r.threshold for y, s in known)


@pytest.mark.parametrize("count", [0, 1, 5, 1000])
def test_sweep_of_any_list(spark, count):
    """Unsorted and repeated thresholds, ties with scores, null and NaN scores, null labels."""
    rnd = random.Random(count)
    rows = [(rnd.choice([0, 1, None]), rnd.randrange(200) / 200) for _ in range(400)]
    rows += [(1, None), (0, None), (1, float("nan")), (0, float("nan"))]
    rows += [(1, float("inf")), (0, float("-inf"))]
    thresholds = [rnd.randrange(-20, 220) / 200 for _ in range(count)]
    found = evaluate.threshold_sweep(frame(spark, rows), thresholds).collect()
    known = [(y, s) for y, s in rows if s is not None]

    def alerts(score, t):
        return score != score or score >= t

    wanted = [
        (
            t,
            sum(y == 1 and alerts(s, t) for y, s in known),
            sum(y == 1 and not alerts(s, t) for y, s in known),
            sum(y == 0 and alerts(s, t) for y, s in known),
        )
        for t in thresholds
    ]
    assert [tuple(r)[:4] for r in found] == wanted


def test_sweep_refuses_what_is_no_number(spark):
    with pytest.raises(ValueError, match="finite"):
        evaluate.threshold_sweep(frame(spark, []), [0.5, float("nan")])


AWKWARD = [
    (1, 0.5), (1, 0.3), (0, 0.3), (0, 0.05), (1, 0.0499), (0, None), (1, None), (None, 0.7),
    (0, float("nan")), (1, float("nan")), (0, -3.0), (1, 7.5), (1, 1.0), (0, 0.0),
]


@pytest.mark.parametrize("rows", [AWKWARD, some_rows(500, 40), []])
def test_cells_give_what_the_rows_give(spark, rows):
    df = frame(spark, rows)
    thresholds = [0.5, 0.05, 0.3, 0.3, 2.0, -1.0]
    cells = evaluate.outcome_cells(df, thresholds)
    weight = "row_count"
    assert evaluate.confusion(cells, weight=weight).collect() == evaluate.confusion(df).collect()
    for operator in (evaluate.outcome_counts, evaluate.recall, evaluate.weighted_metrics):
        assert one(operator(cells, weight=weight)) == one(operator(df))
    sweep = evaluate.sweep_of_cells(cells, thresholds).collect()
    assert sweep == evaluate.threshold_sweep(df, thresholds).collect()


def test_cells_are_one_aggregation(spark):
    cells = evaluate.outcome_cells(frame(spark, some_rows(50, 9)))
    assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def bounds(df, bins):
    return one(evaluate.auc_bounds(evaluate.score_histogram(df, bins=bins)))


@pytest.mark.parametrize("bins", [1, 7, 1000])
@pytest.mark.parametrize(
    "rows",
    [
        some_rows(600, 5000),
        some_rows(300, 7),
        some_rows(400, 300) + [(int(i % 5 == 0), 0.25) for i in range(200)],
        [(1, 0.1), (0, 0.9)],
        AWKWARD,
    ],
)
def test_histogram_bounds_hold_the_exact_area(spark, rows, bins):
    df = frame(spark, rows)
    exact = one(evaluate.roc_auc(df))["auc"]
    found = bounds(df, bins)
    assert 0 <= found["auc_low"] <= exact + 1e-12 and exact - 1e-12 <= found["auc_high"] <= 1


def test_histogram_bounds_are_narrow_and_exact_where_they_can_be(spark):
    wide = bounds(frame(spark, some_rows(2000, 10_000)), 1000)
    assert wide["auc_high"] - wide["auc_low"] < 0.002
    # Every range has one score only.
    rows = some_rows(300, 7)
    found = bounds(frame(spark, rows), 1000)
    assert found["auc_low"] == found["auc_high"] == pytest.approx(brute_auc(rows))
    for none in ([], [(1, 0.5)], [(0, 0.5), (None, 0.2), (1, None)]):
        assert bounds(frame(spark, none), 10) == {"auc_low": 0.0, "auc_high": 0.0}


def test_histograms_of_parts_merge(spark):
    rows = some_rows(400, 3000)
    parts = [evaluate.score_histogram(frame(spark, rows[i::3]), bins=50) for i in range(3)]
    merged = evaluate.merged_histograms(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    whole = evaluate.score_histogram(frame(spark, rows), bins=50)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
