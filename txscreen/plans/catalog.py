"""Every operator as a named query over the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txscreen import functions as fn
from txscreen import schema as S
from txscreen.operators import evaluate, features, prepare, profile, sampling, training
from txscreen.plans import screening
from txscreen.sources import (
    files,
    materialize,
    new_path,
    read_csv,
    read_csv_with_account,
    transactions_from_events,
    write_csv,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_MODELS: dict[tuple[str, str], screening.Models] = {}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a score and a class that are plain functions of the amount."""
    tx = prepare.drop_null_label(transactions(spark, sf_dir))
    rated = tx.withColumn("score", F.round(F.col(S.AMOUNT) / F.lit(500000.0), 6))
    guess = F.when(F.col("score") > F.lit(0.3), 1.0).otherwise(0.0)
    return rated.withColumn("prediction", guess)


def models(spark: SparkSession, sf_dir: str) -> screening.Models:
    """Both forests, fitted once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = screening.train_models(transactions(spark, sf_dir))
    return _MODELS[key]


#: Queries whose labels are never null; all others give them as doubles, since
#: integers with nulls have no one form in pandas.
WHOLE_LABELS = (
    "fraud_rows",
    "missed_by_flag",
    "drop_null_label",
    "clean_transactions",
    "split_random_rows",
    "train_test_rows",
    "leakfree_columns",
    "confusion_matrix",
    "confusion_of_cells",
    "scored_labels",
)


def _comparable(df: DataFrame) -> DataFrame:
    return df.withColumn(S.LABEL, F.col(S.LABEL).cast("double")) if S.LABEL in df.columns else df


def _on(source: Callable[[SparkSession, str], object]):
    """Register a query that starts from ``source(spark, sf_dir)``."""

    def decorate(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = build(source(spark, sf_dir))
            return result if build.__name__ in WHOLE_LABELS else _comparable(result)

        QUERIES[build.__name__] = query
        return build

    return decorate


# Sources and sinks


@_on(transactions)
def scan_transactions(tx):
    return tx


@_on(transactions)
def csv_roundtrip(tx):
    """The whole table through the CSV sink and the typed CSV scan."""
    path = new_path(tx.sparkSession, "transactions-csv")
    write_csv(tx, path)
    return read_csv(tx.sparkSession, path)


@_on(transactions)
def sample_roundtrip(tx):
    path = new_path(tx.sparkSession, "sample-csv")
    write_csv(sampling.hash_sample(tx, 5), path)
    return read_csv(tx.sparkSession, path)


@_on(transactions)
def schema_profile(tx):
    """Columns and types as Spark infers them from a CSV copy of the whole table."""
    path = new_path(tx.sparkSession, "inferred-csv")
    write_csv(tx, path)
    return files.schema_profile(read_csv(tx.sparkSession, path, infer_schema=True))


#: Of 100 buckets of rows, those that ``_with_broken_lines`` breaks, and how.
BROKEN_LABEL, BROKEN_AMOUNT, TOO_SHORT, TOO_LONG = range(4)


def _with_broken_lines(tx: DataFrame) -> str:
    """Path of the table as lines of text, some of them malformed."""
    values = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in tx.columns}
    bucket = fn.row_bucket()
    changed = values | {
        S.LABEL: F.when(bucket == BROKEN_LABEL, "yes").otherwise(values[S.LABEL]),
        S.AMOUNT: F.when(bucket == BROKEN_AMOUNT, "n/a").otherwise(values[S.AMOUNT]),
    }
    line = F.concat_ws(",", *changed.values())
    line = F.when(bucket == TOO_SHORT, F.concat_ws(",", *list(values.values())[:-2])).otherwise(line)
    line = F.when(bucket == TOO_LONG, F.concat(line, F.lit(",1"))).otherwise(line)
    path = new_path(tx.sparkSession, "broken-csv")
    tx.select(line.alias("line")).write.text(path)
    return path


@_on(transactions)
def csv_account(tx):
    """Lines read, rows taken and rows refused, and the fraud among those taken."""
    account = read_csv_with_account(tx.sparkSession, _with_broken_lines(tx), header=False)
    counts = account.files.agg(
        *[F.sum(c).alias(c) for c in ("line_count", "row_count", "refused_count")]
    )
    listed = account.refused.agg(F.count(F.lit(1)).alias("listed_count"))
    return _beside(counts, listed, profile.label_counts(account.rows).select("fraud"))


@_on(transactions)
def csv_rows_kept(tx):
    """The rows of a broken table that fit."""
    return read_csv_with_account(tx.sparkSession, _with_broken_lines(tx), header=False).rows


@_on(transactions)
def preview(tx):
    return profile.preview(tx, 5)


# Sampling and splitting


@_on(transactions)
def sample_bernoulli(tx):
    return sampling.random_sample(tx, 0.05)


@_on(transactions)
def sample_hash(tx):
    return sampling.hash_sample(tx, 5)


@_on(transactions)
def sample_fraction(tx):
    return sampling.fraction_sample(tx, 0.125, 67)


@_on(transactions)
def split_hash(tx):
    return sampling.with_part(tx)


@_on(transactions)
def split_random(tx):
    first, second = sampling.random_split(materialize(prepare.clean(tx), "clean"))
    return first.withColumn("part", F.lit(sampling.TRAIN)).unionByName(
        second.withColumn("part", F.lit(sampling.TEST))
    )


@_on(transactions)
def split_random_rows(tx):
    """Both random parts together: every clean row, each once."""
    first, second = sampling.random_split(materialize(prepare.clean(tx), "clean"))
    return first.unionByName(second)


@_on(transactions)
def train_test_rows(tx):
    """The stored tables that forests are trained and tested on."""
    train, test = training.train_test_tables(tx)
    return train.withColumn("part", F.lit(sampling.TRAIN)).unionByName(
        test.withColumn("part", F.lit(sampling.TEST))
    )


@_on(transactions)
def sample_and_rest(tx):
    """A stored random sample with all that isn't in it: the whole table again."""
    stored = materialize(tx, "transactions")
    sample = materialize(sampling.random_sample(stored, 0.05), "sample")
    return sample.unionByName(stored.exceptAll(sample))


# Projections and scalar functions


@_on(transactions)
def account_kind(tx):
    return tx.select(
        S.SENDER,
        fn.account_kind(S.SENDER).alias("sender_kind"),
        S.RECEIVER,
        fn.account_kind(S.RECEIVER).alias("receiver_kind"),
    )


@_on(transactions)
def exchange_type(tx):
    return prepare.with_exchange_type(tx)


@_on(transactions)
def clean_features(tx):
    return prepare.to_features(tx)


# Filters


@_on(transactions)
def fraud_rows(tx):
    return prepare.labelled_as(tx, 1)


@_on(transactions)
def missed_by_flag(tx):
    return prepare.missed_by_flag(tx)


@_on(transactions)
def drop_null_label(tx):
    return prepare.drop_null_label(tx)


@_on(transactions)
def rule_flag(tx):
    return prepare.with_rule_flag(tx)


@_on(transactions)
def rule_flag_agreement(tx):
    return profile.cross_tab(prepare.with_rule_flag(tx), S.FLAG, "ruleFlag")


# Deduplication


@_on(transactions)
def dedup_rows(tx):
    return prepare.drop_duplicate_rows(tx)


@_on(transactions)
def distinct_senders(tx):
    return prepare.distinct_values(tx, S.SENDER)


@_on(transactions)
def clean_transactions(tx):
    return prepare.clean(tx)


# Aggregations and ratios


@_on(transactions)
def row_count(tx):
    return profile.row_count(tx)


@_on(transactions)
def label_counts(tx):
    return profile.label_counts(tx)


@_on(transactions)
def class_balance(tx):
    return profile.cross_tab(tx, S.LABEL)


@_on(transactions)
def fraud_by_type(tx):
    return profile.fraud_by(tx, S.KIND)


@_on(transactions)
def fraud_by_exchange(tx):
    return profile.fraud_by(prepare.with_exchange_type(tx), S.EXCHANGE)


@_on(transactions)
def flag_vs_label(tx):
    return profile.cross_tab(tx, S.LABEL, S.FLAG)


@_on(transactions)
def label_by_type(tx):
    return profile.cross_tab(tx, S.KIND, S.LABEL)


@_on(transactions)
def label_by_exchange(tx):
    return profile.cross_tab(prepare.with_exchange_type(tx), S.EXCHANGE, S.LABEL)


@_on(transactions)
def mean_amount_by_label(tx):
    return _rounded(profile.mean_by_label(tx), 4)


@_on(transactions)
def amount_describe(tx):
    return _rounded(profile.describe(tx), 4)


@_on(transactions)
def bank_detection_rate(tx):
    return _rounded(profile.detection_rate(tx), 9)


@_on(transactions)
def fraud_share(tx):
    return profile.fraud_share(tx)


@_on(transactions)
def sender_stats(tx):
    return profile.sender_stats(tx)


@_on(transactions)
def senders_by_type(tx):
    """Distinct senders per type, and whether the sketch's bounds hold them."""
    exact = tx.groupBy(S.KIND).agg(F.countDistinct(S.SENDER).alias("senders"))
    cells = profile.cells(tx, S.KIND, S.LABEL, distinct=S.SENDER)
    near = profile.distinct_estimate(cells, S.KIND)
    held = F.col("senders").between(F.col("low"), F.col("high")).alias("held")
    return exact.join(near, S.KIND).select(S.KIND, "senders", held)


@_on(transactions)
def top_senders(tx):
    return profile.top_senders(tx, 10)


@_on(transactions)
def overview(tx):
    return _rounded(profile.overview(tx), 4)


# Features


@_on(transactions)
def index_type(tx):
    return features.index_table(prepare.clean(tx), S.KIND)


@_on(transactions)
def index_exchange(tx):
    return features.index_table(prepare.clean(tx), S.EXCHANGE)


@_on(transactions)
def assemble_full(tx):
    rows = materialize(prepare.clean(tx), "clean")
    return features.vector_columns(features.assemble(rows, features.FULL), features.FULL)


@_on(transactions)
def assemble_leakfree(tx):
    rows = materialize(prepare.clean(tx), "clean")
    columns = features.check_leaks(features.LEAK_FREE)
    return features.vector_columns(features.assemble(rows, columns), columns)


@_on(transactions)
def leakfree_columns(tx):
    return features.without_late_columns(prepare.clean(tx))


# Evaluation of a score that does not depend on a model


@_on(scored)
def auc_exact(rows):
    return _rounded(evaluate.roc_auc(rows), 9)


@_on(scored)
def auc_bounds(rows):
    return _rounded(evaluate.auc_bounds(evaluate.score_histogram(rows)), 9)


@_on(scored)
def confusion_of_cells(rows):
    return evaluate.confusion(evaluate.outcome_cells(rows), weight="row_count")


@_on(scored)
def metrics_of_cells(rows):
    return _rounded(evaluate.weighted_metrics(evaluate.outcome_cells(rows), weight="row_count"), 9)


@_on(scored)
def outcomes_of_cells(rows):
    return evaluate.outcome_counts(evaluate.outcome_cells(rows), weight="row_count")


@_on(scored)
def sweep_of_cells(rows):
    return _rounded(evaluate.sweep_of_cells(evaluate.outcome_cells(rows)), 9)


@_on(scored)
def confusion_matrix(rows):
    return evaluate.confusion(rows)


@_on(scored)
def tp_fn_fp(rows):
    return evaluate.outcome_counts(rows)


@_on(scored)
def recall(rows):
    return _rounded(evaluate.recall(rows), 9)


@_on(scored)
def weighted_metrics(rows):
    return _rounded(evaluate.weighted_metrics(rows), 9)


@_on(scored)
def evaluation_summary(rows):
    return _rounded(evaluate.evaluation(rows), 9)


@_on(scored)
def recall_comparison(rows):
    alerts = {"flag": S.FLAG, "rule": "ruleFlag", "score": "prediction"}
    return evaluate.compare_alerts(prepare.with_rule_flag(rows), alerts)


@_on(scored)
def threshold_sweep(rows):
    return _rounded(evaluate.threshold_sweep(rows), 9)


# Forests


@_on(models)
def rf_predictions_full(m):
    return m.full.predictions


@_on(models)
def rf_predictions_leakfree(m):
    return m.leak_free.predictions


@_on(models)
def fraud_probability(m):
    return training.score(m.leak_free.model, m.test).select("score")


@_on(models)
def prediction_preview(m):
    return training.preview_predictions(m.leak_free.predictions, 10)


@_on(models)
def feature_importance(m):
    rows = [
        t.importances.withColumn("model", F.lit(t.name)) for t in (m.full, m.leak_free)
    ]
    return rows[0].unionByName(rows[1]).orderBy("model", F.desc("importance"), "variable")


@_on(models)
def auc_model(m):
    """Of both forests: exact, binned as MLlib's evaluator has it, and the histogram's bounds."""
    rows = [
        _beside(
            evaluate.roc_auc(t.predictions).select(
                F.lit(t.name).alias("model"),
                "auc",
                F.lit(evaluate.binned_auc(t.predictions)).alias("auc_binned"),
            ),
            evaluate.auc_bounds(evaluate.score_histogram(t.predictions)),
        )
        for t in (m.full, m.leak_free)
    ]
    return rows[0].unionByName(rows[1])


@_on(models)
def threshold_sweep_model(m):
    return evaluate.threshold_sweep(m.leak_free.predictions)


@_on(models)
def scored_labels(m):
    """Rows scored per model and label, and those with a score from 0 to 1."""
    rated = F.count_if(F.col("score").between(0.0, 1.0)).alias("rated")
    rows = [
        t.predictions.groupBy(F.lit(t.name).alias("model"), S.LABEL).agg(
            F.count(F.lit(1)).alias("row_count"), rated
        )
        for t in (m.full, m.leak_free)
    ]
    return rows[0].unionByName(rows[1])


@_on(models)
def sweep_totals_model(m):
    """Caught and missed together, at each threshold all the fraud there is."""
    return evaluate.threshold_sweep(m.leak_free.predictions).select(
        "threshold", (F.col("tp") + F.col("fn")).alias("fraud")
    )


@_on(models)
def importance_check(m):
    """Features per model, and their importances' sum."""
    rows = [
        t.importances.agg(
            F.lit(t.name).alias("model"),
            F.array_join(F.sort_array(F.collect_list("variable")), ",").alias("variables"),
            F.round(F.sum("importance"), 6).alias("total"),
        )
        for t in (m.full, m.leak_free)
    ]
    return rows[0].unionByName(rows[1])


def model_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraud rows that each system caught or missed, and rows each has scored."""
    m = models(spark, sf_dir)
    tx = transactions(spark, sf_dir)
    compared = screening.compare(profile.detection_rate(tx), m)
    scored_rows = [(t.name, t.predictions) for t in (m.full, m.leak_free)]
    scored_rows.append((screening.RULE, tx.filter(F.col(S.FLAG).isNotNull())))
    sizes = [df.agg(F.lit(n).alias("system"), F.count(F.lit(1)).alias("scored")) for n, df in scored_rows]
    together = sizes[0].unionByName(sizes[1]).unionByName(sizes[2])
    fraud = compared.select("system", (F.col("caught") + F.col("missed")).alias("fraud"))
    return fraud.join(together, "system")


QUERIES["model_totals"] = model_totals


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = profile.detection_rate(transactions(spark, sf_dir))
    return screening.compare(rate, models(spark, sf_dir))


QUERIES["model_comparison"] = model_comparison


def _beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first.agg(*[F.first(c, ignorenulls=True).alias(c) for c in first.columns])


def _rounded(df: DataFrame, places: int) -> DataFrame:
    """Doubles to ``places``, as sums of doubles differ in their last digits."""
    return df.select(
        [
            F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else f.name
            for f in df.schema
        ]
    )
