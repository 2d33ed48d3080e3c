"""Seeded forests over a train and a test table."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txscreen import schema as S
from txscreen.functions import fraud_probability
from txscreen.operators import evaluate, features, prepare, sampling
from txscreen.sources import keep_on_disk, materialize, session_settings


@dataclass(frozen=True)
class Forest:
    """Settings of a forest; the seed is always set, so a run can be repeated."""

    num_trees: int = 50
    seed: int = 67
    handle_invalid: str = "error"
    #: Partitions of the training rows. MLlib samples by partition and place in
    #: it, so this number is part of the model, as the seed is.
    partitions: int = 64

    def __post_init__(self) -> None:
        features.check_invalid(self.handle_invalid)


@dataclass(frozen=True)
class Trained:
    """A fitted model with its scored test rows and results."""

    name: str
    columns: tuple[str, ...]
    model: PipelineModel
    predictions: DataFrame
    evaluation: DataFrame
    importances: DataFrame


def train_test_tables(
    df: DataFrame,
    train_percent: int = 80,
    *,
    random_seed: int | None = None,
    partitions: int = Forest.partitions,
) -> tuple[DataFrame, DataFrame]:
    """Clean and split ``df``, dealt out once for all models and passes.

    One shuffle serves deduplication, split and layout: copies are dropped in
    the map tasks, the rest is dealt by a hash of the whole row, and what
    arrives is sorted and kept on the executors' disks. Fitting passes over
    the training rows many times and finds them there. The split goes by row
    bucket; with ``random_seed`` it is a random one of the rows as they lie.
    """
    whole = _dealt_rows(df, train_percent, partitions)
    if random_seed is not None:
        return sampling.random_split(whole.drop("part"), train_percent / 100, random_seed)
    train = whole.filter(F.col("part") == sampling.TRAIN).drop("part")
    test = whole.filter(F.col("part") == sampling.TEST).drop("part")
    return train, test


def _dealt_rows(df: DataFrame, train_percent: int, partitions: int) -> DataFrame:
    """Clean rows with their part, in one order over a given number of partitions.

    MLlib samples by partition and by place in it. Dealt by a hash of the whole
    row and sorted, rows that are equal once the ids are gone being
    interchangeable, a forest depends on rows, seed and ``partitions`` alone:
    not on files, cores or the size of the table. For a large table the number
    should be one that fits a few hundred MB each.

    The deal is the deduplication's own shuffle, so that a set of copies is one
    row per map task there, whatever its size; its number of partitions is a
    setting of the session while the plan is made and run.
    """
    parts = sampling.with_part(prepare.unique_labelled(df), train_percent)
    kept = prepare.with_exchange_type(parts).select(*S.CLEAN_COLUMNS, "part")
    fixed = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    # Spark finds kept rows by their plan, which must tell one number from another.
    told = kept.withColumn("dealt", F.lit(partitions))
    with session_settings(df.sparkSession, fixed):
        return keep_on_disk(told.sortWithinPartitions(*S.CLEAN_COLUMNS, "part")).drop("dealt")


def fit_forest(
    train: DataFrame,
    columns: Sequence[str],
    settings: Forest = Forest(),
    *,
    label: str = S.LABEL,
    indexers: StringIndexerModel | None = None,
    allow_late: bool = False,
) -> PipelineModel:
    """Indexers, assembler and forest as one fitted pipeline.

    Passes over ``train`` several times, so its rows should be kept as
    ``train_test_tables`` does.
    ``indexers`` fitted before on the same rows are taken over as they are.
    """
    columns = features.check_leaks(columns, allow_late=allow_late)
    if indexers is None:
        indexers = features.fit_indexers(train, handle_invalid=settings.handle_invalid)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=settings.num_trees, seed=settings.seed
    )
    stages = [indexers, features.assembler(columns, handle_invalid=settings.handle_invalid), forest]
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, df: DataFrame, *, label: str = S.LABEL) -> DataFrame:
    """Label, predicted class and P(label = 1) of every row."""
    return model.transform(df).select(label, "prediction", fraud_probability().alias("score"))


def preview_predictions(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` rows with the highest score."""
    order = [F.desc("score"), *[c for c in predictions.columns if c != "score"]]
    return predictions.orderBy(*order).limit(n)


def importances(spark: SparkSession, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Importance per feature, largest first; one row per feature column."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(columns, weights)), "variable string, importance double")
    return table.orderBy(F.desc("importance"), "variable")


def train_and_evaluate(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str],
    name: str,
    settings: Forest = Forest(),
    *,
    label: str = S.LABEL,
    indexers: StringIndexerModel | None = None,
    allow_late: bool = False,
) -> Trained:
    """Fit on ``train``, score ``test`` once, store the scored rows and their evaluation.

    Outcome cells and preview then read three stored columns instead of running
    the forest again.
    """
    model = fit_forest(
        train, columns, settings, label=label, indexers=indexers, allow_late=allow_late
    )
    predictions = materialize(score(model, test, label=label), "scored")
    return Trained(
        name=name,
        columns=tuple(columns),
        model=model,
        predictions=predictions,
        evaluation=materialize(evaluate.evaluation(predictions, label=label), "evaluation"),
        importances=importances(train.sparkSession, model, columns),
    )
