"""Evaluation of a score, a predicted class or any alert against the label."""

import bisect
import math
from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txscreen import schema as S
from txscreen.functions import percent, ratio

# Counts that simply add up, per score and then per range of scores.
_OUTCOMES = ("tp", "fn", "fp")


def _rows(condition: Column | None = None, weight: str | None = None) -> Column:
    """Rows that meet ``condition``; with ``weight``, each counts for that many."""
    if weight is None:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    rows = F.col(weight) if condition is None else F.when(condition, F.col(weight))
    return F.coalesce(F.sum(rows), F.lit(0))


def _outcome(
    name: str, label: str, alert: Column, quiet: Column, weight: str | None = None
) -> Column:
    fraud, normal = F.col(label) == 1, F.col(label) == 0
    hit = {"tp": fraud & alert, "fn": fraud & quiet, "fp": normal & alert}[name]
    return _rows(hit, weight).alias(name)


def _outcomes(label: str, prediction: str, weight: str | None = None) -> list[Column]:
    alert, quiet = F.col(prediction) == 1, F.col(prediction) == 0
    return [_outcome(name, label, alert, quiet, weight) for name in _OUTCOMES]


def confusion(
    df: DataFrame,
    *,
    label: str = S.LABEL,
    prediction: str = "prediction",
    weight: str | None = None,
) -> DataFrame:
    """Confusion matrix in long form."""
    cells = df.groupBy(label, prediction).agg(_rows(weight=weight).alias("row_count"))
    return cells.orderBy(label, prediction)


def outcome_counts(
    df: DataFrame,
    *,
    label: str = S.LABEL,
    prediction: str = "prediction",
    weight: str | None = None,
) -> DataFrame:
    """True positives, false negatives and false positives in one pass."""
    return df.agg(*_outcomes(label, prediction, weight))


def recall(
    df: DataFrame,
    *,
    label: str = S.LABEL,
    prediction: str = "prediction",
    weight: str | None = None,
) -> DataFrame:
    counts = outcome_counts(df, label=label, prediction=prediction, weight=weight)
    return counts.select(ratio("tp", F.col("tp") + F.col("fn")).alias("recall"))


def _ranked(df: DataFrame, label: str, score: str, extra: Sequence[Column]) -> DataFrame:
    """One row: label pairs ordered right by ``score``, and the sums of ``extra``.

    A (fraud, normal) pair is right when the fraud row scores higher, and half
    right when both score the same. No task ever sees all scores:

    1. count fraud and normal rows per distinct score, combined in the map
       tasks, so a score shared by a third of the rows is one row per task;
    2. range-partition the distinct scores and run up the normal rows below
       within each range;
    3. one row per range is left; run up the normal rows of the ranges below.

    Pairs are counted twice over as integers, hence exactly and in any order.
    """
    scored = F.col(score).isNotNull()
    per_score = df.groupBy(score).agg(
        F.count_if((F.col(label) == 1) & scored).alias("pos"),
        F.count_if((F.col(label) == 0) & scored).alias("neg"),
        *extra,
    )
    sums = [c for c in per_score.columns if c != score]
    wide = "decimal(19,0)"

    def up_to_now(window: WindowSpec) -> Column:
        before = window.rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("neg").over(before), F.lit(0))

    def pairs(pos: str, normal: Column) -> Column:
        return (F.col(pos).cast(wide) * normal.cast(wide)).cast("decimal(38,0)")

    ranges = per_score.repartitionByRange(score).withColumn("slice", F.spark_partition_id())
    in_range = ranges.withColumn("below", up_to_now(W.partitionBy("slice").orderBy(score)))
    per_range = in_range.groupBy("slice").agg(
        F.min(score).alias("lowest"),
        F.sum(pairs("pos", F.col("below") * 2 + F.col("neg"))).alias("pairs"),
        *[F.sum(c).alias(c) for c in sums],
    )
    across = per_range.withColumn("below", up_to_now(W.orderBy("lowest")))
    right = F.col("pairs") + pairs("pos", F.col("below") * 2)
    return across.agg(
        F.coalesce(F.sum(right).cast("double") / 2, F.lit(0.0)).alias("right"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )


def _auc() -> Column:
    every_pair = F.col("pos").cast("double") * F.col("neg").cast("double")
    return ratio("right", every_pair).alias("auc")


def roc_auc(df: DataFrame, *, label: str = S.LABEL, score: str = "score") -> DataFrame:
    """Exact area under the ROC curve; 0 when one of the classes is missing."""
    return _ranked(df, label, score, []).select(_auc())


def binned_auc(
    df: DataFrame, *, label: str = S.LABEL, score: str = "score", bins: int = 1000
) -> float:
    """Area as MLlib's evaluator takes it, over ``bins`` groups of neighbouring scores.

    Runs at once, and with bins the last digits depend on the partitioning.
    """
    evaluator = BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol=score, metricName="areaUnderROC", numBins=bins
    )
    return evaluator.evaluate(df)


def score_histogram(
    df: DataFrame, *, label: str = S.LABEL, score: str = "score", bins: int = 1000
) -> DataFrame:
    """Fraud and normal rows per range of scores, and each range's least and greatest score.

    One aggregation to at most ``bins + 2`` rows: equal ranges from 0 to 1,
    whatever is outside in the first or last, NaN above all and null left out.
    Histograms of parts of the rows merge: counts by sum, scores by minimum and
    maximum of their places.
    """
    value = F.col(score).cast("double")
    inside = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    # A score of 1 shares the last range with those just below it.
    place = F.least(F.floor(inside * bins), F.lit(bins - 1))
    place = F.when(F.isnan(value), F.lit(bins)).otherwise(place).cast("int")
    scored = df.filter(value.isNotNull())
    return scored.groupBy(place.alias("place")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
    )


def merged_histograms(histograms: DataFrame) -> DataFrame:
    """One histogram out of the rows of several, stacked."""
    return histograms.groupBy("place").agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
    )


def auc_bounds(histogram: DataFrame) -> DataFrame:
    """auc_low and auc_high, between which the exact area lies, from a ``score_histogram``.

    Pairs in different ranges are known to be right or wrong; pairs in one
    range may be either, unless it holds a single score: then each is half
    right. The bounds are ``sum(pos * neg) / (all pos * all neg)`` apart, over
    the ranges of several scores. Both are 0 when a class is missing. The
    histogram's few rows are summed up in one task; pairs are whole numbers.
    """
    wide = "decimal(38,0)"
    pos, neg = (F.col(c).cast("decimal(19,0)") for c in ("pos", "neg"))
    below = F.coalesce(
        F.sum("neg").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    single = F.col("least").eqNullSafe(F.col("greatest"))
    ran = histogram.withColumn("below", below.cast("decimal(19,0)"))
    inside = (pos * neg).cast(wide)
    # Twice the pairs, so that halves are whole.
    sure = (pos * F.col("below")).cast(wide) * 2 + F.when(single, inside).otherwise(0)
    unsure = F.when(single, F.lit(0).cast(wide)).otherwise(inside) * 2
    sums = ran.agg(
        F.sum(sure.cast(wide)).cast("double").alias("sure"),
        F.sum(unsure.cast(wide)).cast("double").alias("unsure"),
        F.sum("pos").cast("double").alias("pos"),
        F.sum("neg").cast("double").alias("neg"),
    )
    every_pair = F.col("pos") * F.col("neg") * 2
    return sums.select(
        ratio("sure", every_pair).alias("auc_low"),
        ratio(F.col("sure") + F.col("unsure"), every_pair).alias("auc_high"),
    )


def evaluation(
    df: DataFrame, *, label: str = S.LABEL, score: str = "score", prediction: str = "prediction"
) -> DataFrame:
    """Area under the curve, recall and outcome counts from one pass over the rows."""
    found = F.col("tp") + F.col("fn")
    return _ranked(df, label, score, _outcomes(label, prediction)).select(
        _auc(), ratio("tp", found).alias("recall"), *_OUTCOMES
    )


def weighted_metrics(
    df: DataFrame,
    *,
    label: str = S.LABEL,
    prediction: str = "prediction",
    weight: str | None = None,
) -> DataFrame:
    """Accuracy, and precision, recall and F1 averaged by class size.

    Any number of classes; after one pass only the confusion cells are left.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    cells = known.groupBy(
        F.col(label).cast("double").alias("actual"), F.col(prediction).cast("double").alias("guess")
    ).agg(_rows(weight=weight).alias("n"))
    # Each cell counts for its actual class and for its predicted class.
    hits = F.when(F.col("actual") == F.col("guess"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("actual").alias("class"),
                    F.col("n").alias("actual_n"),
                    none.alias("guess_n"),
                    hits.alias("hit_n"),
                ),
                F.struct(
                    F.col("guess").alias("class"),
                    none.alias("actual_n"),
                    F.col("n").alias("guess_n"),
                    none.alias("hit_n"),
                ),
            )
        ).alias("side")
    ).select("side.*")
    classes = sides.groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("actual_n", "guess_n", "hit_n")]
    )
    rates = classes.select(
        "actual_n",
        "hit_n",
        ratio("hit_n", "guess_n").alias("precision"),
        ratio("hit_n", "actual_n").alias("recall"),
    ).withColumn(
        "f1", ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    )

    def weighted(rate: str) -> Column:
        return ratio(F.sum(F.col(rate) * F.col("actual_n")), F.sum("actual_n"))

    return rates.agg(
        ratio(F.sum("hit_n"), F.sum("actual_n")).alias("accuracy"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("f1"),
    )


def _one_pass(
    df: DataFrame, key: str, cases: Sequence[tuple[Column, Column, Column]], label: str
) -> DataFrame:
    """Outcome counts of several alerts over one scan, a row per alert.

    ``cases`` holds (name, rows that alert, rows that stay quiet). All counts
    are taken in a single aggregation, and its one row is turned into a table.
    """
    counts = [
        F.struct(name.alias(key), *[_outcome(o, label, alert, quiet) for o in _OUTCOMES])
        for name, alert, quiet in cases
    ]
    return df.agg(F.array(*counts).alias("cases")).select(F.inline("cases"))


def _steps(thresholds: Sequence[float]) -> list[float]:
    asked = sorted({float(t) for t in thresholds})
    if not all(map(math.isfinite, asked)):
        raise ValueError("thresholds must be finite numbers")
    return asked


def _placed(scored: DataFrame, steps: list[float]) -> DataFrame:
    """``place``: how many of ``steps`` a row's score reaches, by binary search.

    NaN reaches one more than there are. ``scored`` has a ``score``, never null.
    """
    splits = [-math.inf, *steps, math.inf] if steps else [-math.inf, 0.0, math.inf]
    bucketizer = Bucketizer(
        splits=splits, inputCol="score", outputCol="place", handleInvalid="keep"
    )
    return bucketizer.transform(scored).withColumn("place", F.col("place").cast("int"))


def outcome_cells(
    df: DataFrame,
    thresholds: Sequence[float] = S.THRESHOLDS,
    *,
    label: str = S.LABEL,
    score: str = "score",
    prediction: str = "prediction",
) -> DataFrame:
    """Rows per label, class and place of the score between the thresholds.

    One pass over the scored rows. With ``weight="row_count"``, ``confusion``,
    ``outcome_counts``, ``recall`` and ``weighted_metrics`` then come from a
    handful of rows, and ``sweep_of_cells`` gives the threshold sweep. A null
    score has a null place.
    """
    rows = df.select(
        F.col(label).alias(label),
        F.col(prediction).alias(prediction),
        F.col(score).cast("double").alias("score"),
    )
    # The search refuses nulls; what stands in for them has no place.
    filled = rows.withColumns(
        {"no_score": F.col("score").isNull(), "score": F.coalesce("score", F.lit(0.0))}
    )
    placed = _placed(filled, _steps(thresholds))
    place = F.when(~F.col("no_score"), F.col("place")).alias("place")
    return placed.groupBy(label, prediction, place).agg(F.count(F.lit(1)).alias("row_count"))


def sweep_of_cells(
    cells: DataFrame,
    thresholds: Sequence[float] = S.THRESHOLDS,
    *,
    label: str = S.LABEL,
    weight: str = "row_count",
) -> DataFrame:
    """``threshold_sweep`` from the cells of the same thresholds."""
    asked, steps = [float(t) for t in thresholds], _steps(thresholds)
    placed = cells.filter(F.col("place").isNotNull()).groupBy("place")
    counts = placed.agg(
        _rows(F.col(label) == 1, weight).alias("fraud"),
        _rows(F.col(label) == 0, weight).alias("normal"),
    )
    # A row without counts for each threshold takes up the sums of all places
    # from its own on: peers in the order count as well.
    rows = [(bisect.bisect_left(steps, t) + 1, 0, 0, i, t) for i, t in enumerate(asked)]
    types = "place int, fraud long, normal long, position int, threshold double"
    wanted = cells.sparkSession.createDataFrame(rows, types)
    above = W.orderBy(F.desc("place"))
    summed = counts.unionByName(wanted, allowMissingColumns=True).select(
        "position",
        "threshold",
        F.sum("fraud").over(above).alias("tp"),
        F.sum("normal").over(above).alias("fp"),
        F.sum("fraud").over(W.partitionBy()).alias("fraud"),
    )
    return (
        summed.filter(F.col("position").isNotNull())
        .withColumn("fn", F.col("fraud") - F.col("tp"))
        .orderBy("position")
        .select(
            "threshold",
            *_OUTCOMES,
            ratio(F.col("tp") * F.lit(100.0), F.col("tp") + F.col("fn")).alias("recall_percent"),
        )
    )


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float] = S.THRESHOLDS,
    *,
    label: str = S.LABEL,
    score: str = "score",
) -> DataFrame:
    """Recall and false alerts when every score at or above a threshold alerts.

    A row is placed between two thresholds by binary search and counted there,
    so neither the work per row nor the plan grows with the list; sums over
    the few places follow. Rows come in the order of ``thresholds``, repeated
    ones too. A null score neither alerts nor stays quiet, NaN always alerts.
    Mind that a model's own class at 0.5 leaves out a score of exactly 0.5.
    """
    scored = df.filter(F.col(score).isNotNull()).select(
        F.col(label).alias(label), F.col(score).cast("double").alias("score")
    )
    placed = _placed(scored, _steps(thresholds)).groupBy(label, "place")
    cells = placed.agg(F.count(F.lit(1)).alias("row_count"))
    return sweep_of_cells(cells, thresholds, label=label)


def compare_alerts(df: DataFrame, alerts: Mapping[str, str], *, label: str = S.LABEL) -> DataFrame:
    """Recall, caught, missed and false alerts of several 0/1 columns side by side."""
    cases = [(F.lit(n), F.col(c) == 1, F.col(c) == 0) for n, c in alerts.items()]
    return _one_pass(df, "system", cases, label).select(
        "system",
        F.col("tp").alias("caught"),
        F.col("fn").alias("missed"),
        F.col("fp").alias("false_alerts"),
        percent("tp", F.col("tp") + F.col("fn"), 2).alias("recall_percent"),
    )


def compare_models(
    evaluations: Mapping[str, DataFrame], baselines: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Stack evaluation rows and detection rates of flags, one row per system.

    A flag has no score, so its area under the curve is null.
    """
    rows = [
        df.select(
            F.lit(name).alias("system"),
            "auc",
            "recall",
            F.col("tp").alias("caught"),
            F.col("fn").alias("missed"),
            F.col("fp").alias("false_alerts"),
        )
        for name, df in evaluations.items()
    ]
    rows += [
        df.select(
            F.lit(name).alias("system"),
            F.lit(None).cast("double").alias("auc"),
            "recall",
            "caught",
            "missed",
            F.lit(None).cast("long").alias("false_alerts"),
        )
        for name, df in (baselines or {}).items()
    ]
    table, *others = rows
    for other in others:
        table = table.unionByName(other)
    return table
