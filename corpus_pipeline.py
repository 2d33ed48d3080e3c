"""From raw documents to token ids: five stages, each one operator of ``txscreen.llm``.

A stage works on all that the one before it kept. All but the last return the
columns of ``documents``; ``n_chars`` follows a changed text.
"""

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txscreen.llm import bpe, jaccard, langid, linedup, mixing
from txscreen.llm.common import read
from txscreen.llm.queries import word_bpe_path
from txscreen.sources import stored_result

#: A text no nearer than this to any language goes. Of the 10,000 labelled
#: documents of sf0.1 the lowest score is 0.387; a text of no learned n-gram has 0.
LEAST_SCORE = 0.3

#: Words of a shingle and percentage of the union for the near-duplicate stage.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


#: Rows of an Arrow batch, where the session has Spark's own number for it.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPARK_ROWS, TEXT_ROWS = "10000", "1000"


def bound_batches(spark: SparkSession) -> None:
    """Let the session send fewer rows to Python at once: they are whole texts here.

    A stage's result is planned after the stage has returned, so this stays set.
    A session with a number of its own keeps it.
    """
    if spark.conf.get(ARROW_ROWS) == SPARK_ROWS:
        spark.conf.set(ARROW_ROWS, TEXT_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a learned language; those without a letter go too."""
    bound_batches(spark)
    return langid.keep_identified(docs, min_score=LEAST_SCORE)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share.

    A text without such lines stays as it is, a null one too. A document that
    loses all of its lines goes on with an empty text.
    """
    found = linedup.drop_frequent_lines(docs)
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    out = found.withColumns({"n_chars": chars, "text": text})
    return out.select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 80 percent.

    The width and limit of the query ``op1_jaccard`` are its own.
    """
    bound_batches(spark)
    return jaccard.keep_first(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of every document as the mix takes, from none to three."""
    return mixing.apply_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of every document."""
    bound_batches(spark)
    return bpe.encode_documents(docs, bpe.load_definition(word_bpe_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near-duplicates", join_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode_tokens),
]

# The stages learn profiles and run a tokenizer, which SQL can't.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read by the next.

    What a stage has stored on its way is dropped once its result is.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_result(spark, f"stage-{name}", partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
