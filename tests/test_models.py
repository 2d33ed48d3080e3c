import os
import re
import subprocess
import sys

import pytest
from conftest import DATA
from frames import one, transactions

from txscreen.__main__ import main
from txscreen.operators import evaluate, features, prepare, training
from txscreen.operators.training import Forest
from txscreen.plans import catalog, screening
from txscreen.sources import job_folder

SMALL = Forest(num_trees=10, seed=5, partitions=8)


@pytest.fixture(scope="module")
def tx(spark):
    return catalog.transactions(spark, f"{DATA}/sf0.01")


@pytest.fixture(scope="module")
def models(tx):
    return screening.train_models(tx, SMALL)


def test_equally_frequent_categories_are_indexed_by_name(spark):
    tx = transactions(spark, *[{"type": t} for t in ("B", "A", "C", "C", "C")])
    rows = [tuple(r) for r in features.index_table(tx, "type").collect()]
    assert rows == [("C", 0.0), ("A", 1.0), ("B", 2.0)]


def test_unseen_category_fails_unless_kept(spark):
    seen = prepare.clean(transactions(spark, {"type": "A"}, {"type": "B", "step": 2}))
    other = prepare.clean(transactions(spark, {"type": "Z"}))
    with pytest.raises(Exception, match="Unseen label"):
        features.fit_indexers(seen).transform(other).collect()
    kept = features.fit_indexers(seen, handle_invalid="keep").transform(other)
    assert kept.first().type_num == 2.0


def test_balances_are_refused_unless_asked_for(models):
    with pytest.raises(features.LeakError, match="oldbalanceOrg"):
        features.check_leaks(features.FULL)
    assert features.check_leaks(features.FULL, allow_late=True) == features.FULL
    assert features.check_leaks(features.LEAK_FREE) == features.LEAK_FREE
    with pytest.raises(features.LeakError):
        training.fit_forest(models.train, features.FULL, SMALL)


def test_split_covers_the_clean_rows(tx, models):
    cleaned = prepare.clean(tx)
    both = models.train.unionByName(models.test)
    assert both.count() == cleaned.count() == 9896
    assert cleaned.exceptAll(both).count() == 0


def test_random_split_of_the_clean_rows(tx):
    train, test = training.train_test_tables(tx, random_seed=67)
    assert train.count() + test.count() == 9896


@pytest.mark.parametrize("files", [1, 3, 31])
def test_forest_does_not_depend_on_the_files(spark, tx, models, tmp_path, files):
    tx.repartition(files).write.parquet(str(tmp_path / "tx"))
    train, test = training.train_test_tables(
        spark.read.parquet(str(tmp_path / "tx")), partitions=SMALL.partitions
    )
    again = training.fit_forest(train, features.LEAK_FREE, SMALL)
    before = models.leak_free
    assert sorted(training.score(again, test).collect()) == sorted(before.predictions.collect())
    weights = training.importances(spark, again, features.LEAK_FREE).collect()
    assert weights == before.importances.collect()


_ON_CORES = """
import sys
from pyspark.sql import SparkSession
from txscreen.operators import features, training
from txscreen.operators.training import Forest
from txscreen.plans import catalog

builder = SparkSession.builder.master(f"local[{sys.argv[1]}]").config("spark.ui.enabled", "false")
spark = builder.config("spark.driver.memory", "2g").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
train, test = training.train_test_tables(catalog.transactions(spark, sys.argv[2]), partitions=5)
model = training.fit_forest(train, features.LEAK_FREE, Forest(4, 5, partitions=5))
rows = sorted(map(str, training.score(model, test).collect()))
print(train.rdd.getNumPartitions(), hash(tuple(rows)), len(rows))
"""


def test_forest_does_not_depend_on_the_cores():
    """Sessions of their own on 1, 2 and 4 cores, with their own default partitions."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    printed = set()
    for cores in (1, 2, 4):
        run = subprocess.run(
            [sys.executable, "-c", _ON_CORES, str(cores), f"{DATA}/sf0.001"],
            env=os.environ | {"PYTHONPATH": folder, "PYTHONHASHSEED": "0"},
            capture_output=True, text=True, timeout=300,
        )
        printed.add(run.stdout.strip().splitlines()[-1])
    assert len(printed) == 1 and printed.pop().startswith("5 ")


def plan_that_ran(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_training_rows_are_shuffled_once(spark, tx):
    """Deduplication, split and layout share one exchange; what comes after reads kept rows."""
    train, test = training.train_test_tables(tx, partitions=7)
    for rows in (train, test):
        plan = plan_that_ran(rows)
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange ") == 1
        assert re.search(r"Exchange hashpartitioning\(.*, 7\), ENSURE_REQUIREMENTS", plan)
        above = plan.split("InMemoryRelation")[0]
        assert "Exchange" not in above and "Sort" not in above
        assert rows.rdd.getNumPartitions() == 7
    # Another number is not served from the rows kept for the first one.
    assert training.train_test_tables(tx, partitions=3)[0].rdd.getNumPartitions() == 3


def test_a_hot_row_is_one_row_per_task(spark):
    """Copies are dropped before the shuffle: a third of the rows being one doesn't matter."""
    some = transactions(spark, *[{"step": i} for i in range(40)])
    copies = transactions(spark, {}).crossJoin(spark.range(500)).drop("id")
    train, test = training.train_test_tables(some.unionByName(copies), partitions=4)
    assert train.count() + test.count() == 40
    assert plan_that_ran(train).split("Exchange hashpartitioning")[1].count("HashAggregate") == 1


def test_rows_are_never_skipped():
    for build in (
        lambda: Forest(handle_invalid="skip"),
        lambda: features.assembler(features.LEAK_FREE, handle_invalid="skip"),
        lambda: features.fit_indexers(None, handle_invalid="skip"),
    ):
        with pytest.raises(ValueError, match="error or keep"):
            build()


def test_kept_invalid_rows_are_scored(spark, tx):
    rows = tx.unionByName(transactions(spark, *[{"nameOrig": None, "step": i} for i in range(30)]))
    keeping = Forest(5, 5, "keep", 4)
    found = screening.train_models(rows, keeping)
    assert found.leak_free.predictions.count() == found.test.count()
    assert found.test.filter("typeEchange IS NULL").count() > 0


def test_importances_sum_to_one(models):
    for trained in (models.full, models.leak_free):
        rows = trained.importances.collect()
        assert {r.variable for r in rows} == set(trained.columns)
        assert sum(r.importance for r in rows) == pytest.approx(1.0)
        assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_models_find_the_rule(models):
    for trained in (models.full, models.leak_free):
        result = one(trained.evaluation)
        assert result["auc"] > 0.9
        assert result["tp"] + result["fn"] == models.test.filter("isFraud = 1").count()


def test_auc_agrees_with_the_evaluator_on_raw_predictions(models):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    builtin = BinaryClassificationEvaluator(
        labelCol="isFraud", rawPredictionCol="rawPrediction", numBins=0
    ).evaluate(models.leak_free.model.transform(models.test))
    assert one(models.leak_free.evaluation)["auc"] == pytest.approx(builtin, abs=1e-6)


def test_same_seed_gives_the_same_predictions(models):
    again = training.fit_forest(models.train, features.LEAK_FREE, SMALL)
    before = sorted(models.leak_free.predictions.collect())
    assert sorted(training.score(again, models.test).collect()) == before


def test_comparison_lists_every_system(tx, models):
    from txscreen.operators import profile

    rows = {r.system: r for r in screening.compare(profile.detection_rate(tx), models).collect()}
    assert set(rows) == {"with balances", "leak-free", "existing flag"}
    flag = rows["existing flag"]
    assert (flag.caught, flag.missed, flag.auc) == (15, 396, None)


def test_preview_shows_the_highest_scores(models):
    shown = [r.score for r in training.preview_predictions(models.leak_free.predictions).collect()]
    every = sorted((r.score for r in models.leak_free.predictions.collect()), reverse=True)
    assert shown == every[:10]


def test_forest_of_one_class(spark):
    rows = [{"step": i, "type": "AB"[i % 2]} for i in range(20)]
    cleaned = prepare.clean(transactions(spark, *rows))
    model = training.fit_forest(cleaned, features.LEAK_FREE, SMALL)
    assert {r.score for r in training.score(model, cleaned).collect()} == {0.0}


def test_job_writes_every_table(spark, tx, tmp_path):
    source, output = str(tmp_path / "csv"), str(tmp_path / "out")
    tx.write.csv(source, header=True)
    main([source, "--trees", "10", "--output", output])
    comparison = spark.read.parquet(f"{output}/model_comparison")
    assert comparison.count() == 3
    for name in ("threshold_sweep", "threshold_sweep_full", "threshold_sweep_leak_free"):
        assert spark.read.parquet(f"{output}/{name}").count() == 5
    assert spark.read.parquet(f"{output}/senders_by_type").count() == 5
    assert one(spark.read.parquet(f"{output}/detection_rate"))["caught"] == 15


def test_job_on_a_sample(spark, tx, tmp_path):
    source = str(tmp_path / "csv")
    tx.write.csv(source, header=True)
    sample = screening.load(spark, source, fraction=0.5)
    assert 0.45 < sample.count() / tx.count() < 0.55
    assert sorted(map(str, sample.collect())) == sorted(map(str, sample.collect()))


def test_tables_of_counts_equal_the_single_operators(spark, tx):
    with job_folder(spark):
        tables = screening.report(tx, Forest(4, 5, partitions=4))
        models = screening.train_models(tx, Forest(4, 5, partitions=4))
        for key, rows in (("full", models.full.predictions), ("leak_free", models.leak_free.predictions)):
            for name, operator in (
                ("outcomes", evaluate.outcome_counts),
                ("weighted_metrics", evaluate.weighted_metrics),
                ("confusion", evaluate.confusion),
                ("threshold_sweep", evaluate.threshold_sweep),
            ):
                table = tables[f"{name}_{key}"]
                assert table.collect() == operator(rows).collect()
                assert all("outcomes" in f for f in table.inputFiles())


def test_job_samples_the_same_rows_of_any_files(spark, tx, tmp_path):
    kept = []
    for files in (1, 3, 31):
        tx.repartition(files).write.csv(str(tmp_path / str(files)), header=True)
        sample = screening.load(spark, str(tmp_path / str(files)), fraction=0.125)
        kept.append(sorted(map(str, sample.collect())))
    assert kept[0] == kept[1] == kept[2] and 0.11 < len(kept[0]) / tx.count() < 0.14


def test_job_accounts_for_malformed_rows(spark, tx, tmp_path):
    source, output = str(tmp_path / "csv"), str(tmp_path / "out")
    tx.coalesce(1).write.csv(source, header=True)
    with open(f"{source}/more.csv", "w") as file:
        file.write(",".join(tx.columns) + "\n1,PAYMENT\n")
    main([source, "--malformed", "account", "--trees", "3", "--partitions", "2", "--output", output])
    files = sorted(tuple(r)[1:] for r in spark.read.parquet(f"{output}/input_files").collect())
    assert files == [(1, 0, 1), (tx.count(), tx.count(), 0)]
    assert [r.text for r in spark.read.parquet(f"{output}/refused_rows").collect()] == ["1,PAYMENT"]
    assert one(spark.read.parquet(f"{output}/label_counts"))["row_count"] == tx.count()
    with pytest.raises(SystemExit):
        main([source, "--malformed", "account", "--format", "parquet"])


def test_job_with_every_argument(spark, tx, tmp_path):
    source, output = str(tmp_path / "csv"), str(tmp_path / "out")
    copies = transactions(spark, *[{"nameOrig": None}] * 5)
    tx.unionByName(copies).write.csv(source, header=True)
    arguments = "--sampling random --trees 3 --partitions 2 --split random --invalid keep --infer-schema --unique"
    main([source, *arguments.split(), "--fraction", "0.5", "--all-senders", "--output", output])
    senders = one(spark.read.parquet(f"{output}/senders"))
    assert senders["row_count"] == tx.count() + 5
    counts = one(spark.read.parquet(f"{output}/label_counts"))
    assert counts["row_count"] < 0.55 * tx.count()
    assert spark.read.parquet(f"{output}/model_comparison").count() == 3


def test_job_prints_every_table(spark, tx, tmp_path, capsys):
    source = str(tmp_path / "tx")
    tx.write.parquet(source)
    main([source, "--format", "parquet", "--trees", "10", "--fraction", "0.5"])
    printed = capsys.readouterr().out
    for name in ("detection_rate", "top_senders", "model_comparison", "threshold_sweep"):
        assert f"{name}\n+" in printed
