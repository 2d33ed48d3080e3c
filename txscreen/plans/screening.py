"""The screening job: explore, clean, train two forests, compare, sweep."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from txscreen import schema as S
from txscreen.operators import evaluate, features, profile, sampling, training
from txscreen.operators.prepare import drop_duplicate_rows, with_exchange_type
from txscreen.operators.training import Forest, Trained
from txscreen.sources import materialize, read_csv, read_csv_with_account, read_parquet

WITH_BALANCES, LEAK_FREE, RULE = "with balances", "leak-free", "existing flag"


@dataclass(frozen=True)
class Models:
    """Both forests, fitted and scored on the same split."""

    train: DataFrame
    test: DataFrame
    full: Trained
    leak_free: Trained


def load(
    spark: SparkSession,
    path: str,
    *,
    file_format: str = "csv",
    fraction: float | None = None,
    seed: int = 67,
    infer_schema: bool = False,
    by_hash: bool = True,
) -> DataFrame:
    """Transactions of ``path``, all of them or a ``fraction``.

    The sample goes by a hash of row and seed and is the same however the
    files are cut; without ``by_hash`` each row is drawn on its own, which
    depends on them. CSV rows and such draws are stored once: CSV would be
    parsed whole for every table, and a draw again need not be the same sample.
    """
    if file_format == "csv":
        df = read_csv(spark, path, infer_schema=infer_schema)
    else:
        df = read_parquet(spark, path)
    if fraction is not None and by_hash:
        df = sampling.fraction_sample(df, fraction, seed)
    elif fraction is not None:
        df = sampling.random_sample(df, fraction, seed)
    if file_format == "csv" or (fraction is not None and not by_hash):
        return materialize(df, "transactions")
    return df


def load_with_account(
    spark: SparkSession, path: str
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Transactions of delimited files without their malformed rows, and the tables of these.

    ``input_files`` counts lines, rows and refused rows of each file, and
    ``refused_rows`` has the refused ones as they are written.
    """
    account = read_csv_with_account(spark, path)
    lists = {"input_files": account.files.orderBy("file"), "refused_rows": account.refused}
    return account.rows, lists


def explore(tx: DataFrame, *, senders_of: DataFrame | None = None) -> dict[str, DataFrame]:
    """Result tables of the exploration.

    All counts and amounts, and the estimates of senders per type, come from
    one stored pass over six columns. Rows per sender, of ``senders_of`` where
    ``tx`` is a sample of it, are counted and stored once for both tables of
    senders.
    """
    keys = (S.KIND, S.EXCHANGE, S.LABEL, S.FLAG)
    whole = profile.cells(with_exchange_type(tx), *keys, amount=S.AMOUNT, distinct=S.SENDER)
    cells = materialize(whole, "cells")
    senders = profile.rows_per_sender(tx if senders_of is None else senders_of)
    senders = materialize(senders, "senders")
    weight = "row_count"
    return {
        "fraud_share": profile.fraud_share(cells, weight=weight),
        "label_counts": profile.label_counts(cells, weight=weight),
        "detection_rate": profile.detection_rate(cells, weight=weight),
        "flag_vs_label": profile.cross_tab(cells, S.LABEL, S.FLAG, weight=weight),
        "class_balance": profile.cross_tab(cells, S.LABEL, weight=weight),
        "label_by_type": profile.cross_tab(cells, S.KIND, S.LABEL, weight=weight),
        "label_by_exchange": profile.cross_tab(cells, S.EXCHANGE, S.LABEL, weight=weight),
        "fraud_by_type": profile.fraud_by(cells, S.KIND, weight=weight),
        "fraud_by_exchange": profile.fraud_by(cells, S.EXCHANGE, weight=weight),
        "amounts": profile.cell_amounts(cells),
        "senders": profile.sender_stats(senders, counted=True),
        "senders_by_type": profile.distinct_estimate(cells, S.KIND).orderBy(S.KIND),
        "top_senders": profile.top_senders(senders, counted=True),
    }


def train_models(
    tx: DataFrame,
    settings: Forest = Forest(),
    *,
    train_percent: int = 80,
    random_seed: int | None = None,
) -> Models:
    """Fit the forest with and the one without the balances known too late.

    The rows are cleaned and dealt out once, and both forests share the split
    and the category indexes. The split goes by a hash of the row; with
    ``random_seed`` it is a random one.
    """
    train, test = training.train_test_tables(
        tx, train_percent, random_seed=random_seed, partitions=settings.partitions
    )
    indexers = features.fit_indexers(train, handle_invalid=settings.handle_invalid)
    full = training.train_and_evaluate(
        train, test, features.FULL, WITH_BALANCES, settings, indexers=indexers, allow_late=True
    )
    leak_free = training.train_and_evaluate(
        train, test, features.LEAK_FREE, LEAK_FREE, settings, indexers=indexers
    )
    return Models(train, test, full, leak_free)


def compare(detection_rate: DataFrame, models: Models) -> DataFrame:
    """Both forests on the test rows next to the flag on all rows."""
    return evaluate.compare_models(
        {m.name: m.evaluation for m in (models.full, models.leak_free)}, {RULE: detection_rate}
    )


def report(
    tx: DataFrame,
    settings: Forest = Forest(),
    *,
    random_seed: int | None = None,
    unique: bool = False,
    senders_of: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every result table of the screening, by name.

    With ``unique`` the exploration looks at the rows without exact copies,
    unlabelled ones included.
    """
    seen = materialize(drop_duplicate_rows(tx), "unique") if unique else tx
    tables = explore(seen, senders_of=senders_of)
    models = train_models(tx, settings, random_seed=random_seed)
    tables["model_comparison"] = compare(tables["detection_rate"], models)
    for key, model in (("full", models.full), ("leak_free", models.leak_free)):
        tables[f"evaluation_{key}"] = model.evaluation
        # One pass over the scored rows for all of the model's tables of counts.
        cells = materialize(evaluate.outcome_cells(model.predictions), "outcomes")
        weight = "row_count"
        tables[f"outcomes_{key}"] = evaluate.outcome_counts(cells, weight=weight)
        tables[f"weighted_metrics_{key}"] = evaluate.weighted_metrics(cells, weight=weight)
        tables[f"confusion_{key}"] = evaluate.confusion(cells, weight=weight)
        tables[f"threshold_sweep_{key}"] = evaluate.sweep_of_cells(cells)
        tables[f"importances_{key}"] = model.importances
        tables[f"preview_{key}"] = training.preview_predictions(model.predictions)
    tables["threshold_sweep"] = tables["threshold_sweep_leak_free"]
    return tables
