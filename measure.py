"""Times the fused operators against one action per figure, on the bench's tables."""

import json

import bench
from txscreen import schema as S
from txscreen.operators import features, prepare, profile, sampling, training
from txscreen.operators.evaluate import binned_auc, threshold_sweep
from txscreen.plans import catalog, screening
from txscreen.sources import materialize


def separate_figures(tx) -> None:
    for value in (0, 1):
        rows = prepare.labelled_as(tx, value)
        rows.count()
        rows.agg({"amount": "avg"}).collect()
    for flag in (0, 1):
        tx.filter(f"{S.LABEL} = 1 AND {S.FLAG} = {flag}").count()
    tx.count()


def separate_sweep(rows) -> None:
    for t in S.THRESHOLDS:
        for condition in (f"1 AND score >= {t}", f"1 AND score < {t}", f"0 AND score >= {t}"):
            rows.filter(f"{S.LABEL} = {condition}").count()


def separate_tables(tx) -> None:
    typed = prepare.with_exchange_type(tx)
    for table in (
        profile.fraud_share(tx),
        profile.label_counts(tx),
        profile.detection_rate(tx),
        profile.cross_tab(tx, S.LABEL, S.FLAG),
        profile.cross_tab(tx, S.LABEL),
        profile.cross_tab(tx, S.KIND, S.LABEL),
        profile.cross_tab(typed, S.EXCHANGE, S.LABEL),
        profile.fraud_by(tx, S.KIND),
        profile.fraud_by(typed, S.EXCHANGE),
    ):
        table.collect()


def shared_tables(tx) -> None:
    tables = screening.explore(tx)
    for name in ("amounts", "senders", "top_senders"):
        del tables[name]
    for table in tables.values():
        table.collect()


def separate_training(tx) -> None:
    """Nothing stored: every pass starts from the raw rows again."""
    train, test = sampling.random_split(prepare.clean(tx))
    for columns in (features.FULL, features.LEAK_FREE):
        model = training.fit_forest(train, columns, allow_late=True)
        predictions = training.score(model, test)
        binned_auc(predictions)
        for case in ("1 AND prediction = 1", "1 AND prediction = 0", "0 AND prediction = 1"):
            predictions.filter(f"{S.LABEL} = {case}").count()
    separate_sweep(materialize(predictions, "predictions"))


def shared_training(tx) -> None:
    models = screening.train_models(tx)
    screening.compare(profile.detection_rate(tx), models).collect()
    threshold_sweep(models.leak_free.predictions).collect()


def main() -> None:
    spark = bench.session()
    tx = materialize(catalog.transactions(spark, bench.SF_DIR), "transactions")
    rows = materialize(catalog.scored(spark, bench.SF_DIR), "rows")
    cases = {
        "figures_one_action_each": lambda: separate_figures(tx),
        "figures_one_pass": lambda: profile.overview(tx).collect(),
        "sweep_one_action_each": lambda: separate_sweep(rows),
        "sweep_one_pass": lambda: threshold_sweep(rows).collect(),
        "tables_one_scan_each": lambda: separate_tables(tx),
        "tables_from_cells": lambda: shared_tables(tx),
        "training_from_raw_rows": lambda: separate_training(tx),
        "training_from_stored_rows": lambda: shared_training(tx),
    }
    for run in cases.values():
        run()
    times = {name: bench.timed(run) for name, run in cases.items()}
    spark.stop()
    print(json.dumps(times))


if __name__ == "__main__":
    main()
