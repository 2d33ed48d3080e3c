"""Line dedup over levelled sorted runs of line hashes.

Every batch of documents is counted once and becomes a run: (line hash,
documents), sorted by hash. A batch is merge-anti-joined with the lines known
to be frequent and merged with the runs before it, which tell how often its
lines were seen; those that reach the limit join the frequent ones, and the
rest is the batch's own run. Full levels are compacted: their runs merge into
one of the next level, without the lines that are frequent by then. All of it
is DataFrame expressions.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txscreen.llm.common import WHITE, ascii_lower, numbered, sha256
from txscreen.sources import materialize, session_settings, stored_result

#: A line in this many documents goes; keys shorter than MIN_CHARS stay.
MIN_DOCS, MIN_CHARS = 10, 1

#: Batches that a whole table is added in, and runs that fill a level.
BATCHES, FANOUT = 4, 2

KEY = ["h1", "h2"]

#: A scan of a bucketed table tells that a bucket is sorted, being one file. Runs are
#: never broadcast; an anti-join that could be would also be moved ahead of the counting.
MERGING = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def text_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, mark (hash of the text), place and key hashes of every line that counts.

    Two hashes, 96 bits together, stand for a key. A row is found again by id
    and text, so that rows with one id and different texts stay apart.
    """
    lines = docs.select(
        F.col(doc_id).alias("doc"),
        F.xxhash64(F.col(text)).alias("mark"),
        F.posexplode(text_lines(text)).alias("place", "line"),
    ).withColumn("key", line_key(F.col("line")))
    return lines.filter(F.char_length("key") >= max(1, min_chars)).select(
        "doc", "mark", "place", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")
    )


class LineRuns:
    """Line counts of all batches added so far, as sorted runs in the shared folder.

    All runs have the same buckets, as many as the session has shuffle
    partitions when the first is made. A batch is dealt into these by its
    grouping, meets each run bucket by bucket in a merge join, and no run is
    shuffled or sorted again. Runs are never changed: a line's count is the sum
    over its runs. ``levels`` and ``frequent`` hold the runs by level.
    """

    def __init__(self, spark: SparkSession, *, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.frequent: list[list[DataFrame]] = [[]]

    def add(self, lines: DataFrame) -> None:
        """Count the lines of one batch of documents and add them as a run.

        ``lines`` comes from ``line_hashes``. A document must be in one batch
        only, with all of its lines.
        """
        # A line of a null document still is a line of one document.
        self.add_counted(
            lines.groupBy("doc", "mark", *KEY)
            .agg(F.min("place").alias("place"))
            .groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("docs"))
        )

    def add_counted(self, counts: DataFrame) -> None:
        """Add (h1, h2, docs) that are counted already, each line once."""
        self._compact(self.frequent)
        self._compact(self.levels)
        counts = self._without_frequent(counts)
        total = F.col("docs")
        for number, run in enumerate(_all(self.levels)):
            seen = f"seen{number}"
            counts = counts.join(run.withColumnRenamed("docs", seen), KEY, "left")
            total += F.coalesce(F.col(seen), F.lit(0))
        run = self._store(counts.select(*KEY, "docs", total.alias("total")))
        due = F.col("total") >= self.min_docs
        self.frequent[0].append(run.filter(due).select(*KEY, F.col("total").alias("docs")))
        self.levels[0].append(run.filter(~due).select(*KEY, "docs"))

    def frequent_lines(self) -> DataFrame:
        """Keys of all lines in at least ``min_docs`` documents, each once."""
        none = self.spark.createDataFrame([], "h1 long, h2 int")
        return reduce(DataFrame.unionByName, (r.select(*KEY) for r in _all(self.frequent)), none)

    def _without_frequent(self, counts: DataFrame) -> DataFrame:
        for run in _all(self.frequent):
            counts = counts.join(run.select(*KEY), KEY, "left_anti")
        return counts

    def _compact(self, levels: list[list[DataFrame]]) -> None:
        for level, runs in enumerate(levels):
            if len(runs) < self.fanout:
                continue
            if levels is self.levels:
                runs = [self._without_frequent(r) for r in runs]
            merged = self._store(reduce(_sum, runs))
            levels[level] = []
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(merged)

    def _store(self, counts: DataFrame) -> DataFrame:
        with session_settings(self.spark, MERGING):
            return materialize(counts, "lines-run", bucket_by=tuple(KEY), buckets=self.buckets)


def _all(levels: list[list[DataFrame]]) -> list[DataFrame]:
    return [run for level in levels for run in level]


def _sum(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs merged into one."""
    both = one.join(other.withColumnRenamed("docs", "more"), KEY, "full_outer")
    counts = (F.coalesce(F.col(c), F.lit(0)) for c in ("docs", "more"))
    return both.select(*KEY, reduce(Column.__add__, counts).alias("docs"))


def drop_frequent_lines(
    docs: DataFrame,
    *,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    All documents are counted, in ``batches`` batches by a hash of the row,
    before the first line is dropped. Each row is a document; a null text is
    one empty line, and its ``kept_text`` is empty. Other columns pass through
    untouched (a column by one of the three added names is replaced). An empty
    table gives an empty one.

    The hashes of all lines are stored once, by batch; the runs are dropped
    when the frequent lines are known and stored. These meet the hashes in a
    join; only places of dropped lines go on to the documents, in
    one list per document.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    batch = F.pmod(F.xxhash64("doc", "mark"), F.lit(batches)).cast("int")
    hashed = line_hashes(docs, doc_id, text, min_chars)
    lines = materialize(hashed.withColumn("batch", batch), "lines", partition_by=("batch",))

    def frequent_lines() -> DataFrame:
        runs = LineRuns(spark, min_docs=min_docs)
        for number in range(batches):
            runs.add(lines.filter(F.col("batch") == number))
        return runs.frequent_lines()

    dropped = (
        lines.join(stored_result(spark, "frequent-lines", frequent_lines), KEY, "left_semi")
        # Repeated rows have the same lines at the same places.
        .groupBy("doc", "mark")
        .agg(F.sort_array(F.collect_set("place")).alias("gone"))
    )
    plain, names = numbered(docs)
    own, own_text = F.col(names[doc_id]), F.col(names[text])
    same = own.eqNullSafe(F.col("doc")) & (F.xxhash64(own_text) == F.col("mark"))
    found = plain.join(dropped, same, "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    lines_of_text = text_lines(names[text])
    kept = F.when(F.size(gone) == 0, F.coalesce(own_text, F.lit(""))).otherwise(
        F.array_join(without_places(lines_of_text, gone), "\n")
    )
    counts = [F.size(c).cast("long") for c in (lines_of_text, gone)]
    added = ("kept_text", "n_lines", "n_dropped")
    return found.select(*plain.columns, kept, *counts).toDF(*docs.columns, *added)


def without_places(lines: Column, gone: Column) -> Column:
    """``lines`` without the places in ``gone``: the stretches between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT hit), '')) AS kept_sha256
FROM (SELECT *, key IN (SELECT key FROM frequent) AS hit FROM keyed)
GROUP BY doc_id
"""
