"""Ranked lexical search by best-first intervals over range-maximum tables.

Documents are read once, for their terms that some query has. Blocks of
documents get posting lists with impacts, and over each list a sparse table of
range maxima. A query starts with the whole block as one interval. The sum of
its lists' maxima bounds every score in an interval; the interval of the
highest bound is split at the document of its greatest impact, which is scored,
until no bound reaches the score of rank k.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txscreen.llm.common import ascii_lower
from txscreen.sources import materialize

#: Results per query.
TOP = 20

#: The formula's settings: weight scale, impact scale, saturation, percentage by length.
LN_SCALE, TF_SCALE, SATURATION, LENGTH_PERCENT = 1000, 1_000_000_000, 12, 25

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Bytes of queries that are broadcast at once, each term with what it costs in a dictionary.
PIECE_BYTES, ENTRY_BYTES = 64 << 20, 200

#: A block is closed with this many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20

#: Intervals split together times query terms.
WIDE = 1 << 13

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8 bytes
_PLACE = 14  # bits of a posting's place in its block: 2 * BLOCK_DOCS at most


@dataclass(frozen=True)
class Queries:
    """One piece of queries: the vocabulary, and per query its terms and how often each."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    ids: pa.Array


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and per term of the vocabulary its documents."""

    docs: int
    tokens: int
    frequency: np.ndarray

    def weights(self) -> np.ndarray:
        odds = ((2 * self.docs + 2) / (2 * int(df) + 1) for df in self.frequency)
        return np.array([math.floor(LN_SCALE * math.log(x)) for x in odds], np.int64)


def _pieces(queries: DataFrame, piece_bytes: int) -> Iterator[Queries]:
    """The queries in pieces of about ``piece_bytes`` at most; one is on the driver at a time.

    Only a query that is larger by itself makes a larger piece.
    """
    size = F.octet_length("text") + ENTRY_BYTES * F.size("terms")
    total = queries.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    number = 1 if total <= piece_bytes else -(-2 * total // piece_bytes)
    for p in range(number):
        own = F.pmod(F.xxhash64("query"), F.lit(number)) == p
        table = (queries.filter(own) if number > 1 else queries).drop("text").toArrow()
        vocabulary: dict[bytes, int] = {}
        terms, times = [], []
        for words in table["terms"].to_pylist():
            counts = Counter(vocabulary.setdefault(w.encode(), len(vocabulary)) for w in words)
            terms.append(np.array(list(counts.keys()), np.int64))
            times.append(np.array(list(counts.values()), np.int64))
        ids = table["item_id"].combine_chunks()
        yield Queries(vocabulary, terms, times, ids)


def _reader(broadcast):
    """doc_id, number of terms, and the query terms of each text with their counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = broadcast.value.vocabulary
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes, terms, counts = [], [], []
            for value in texts:
                data = value.as_py()
                words = _TERM.findall(data.lower()) if data else []
                own = [(vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary]
                sizes.append(len(words))
                terms.append([t for t, _ in own])
                counts.append([n for _, n in own])
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(terms, pa.list_(pa.int32())),
                pa.array(counts, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return read


class Block:
    """Posting lists of some documents, one behind the other, with tables of range maxima.

    ``keys`` are term * documents + document, ascending, so a term's list is a
    stretch of them. Level j of the tables has at i the greatest of the 2**j
    postings from i on. A posting is its impact with its document in the low
    bits, so that a maximum also says where it is.
    """

    def __init__(
        self,
        sizes: np.ndarray,
        lengths: np.ndarray,
        terms: np.ndarray,
        counts: np.ndarray,
        statistics: Statistics,
        weights: np.ndarray,
    ):
        self.docs = len(sizes)
        doc = np.repeat(np.arange(self.docs), lengths)
        # Documents that are alike stand together: by their most frequent query term, then by size.
        frequent = np.full(self.docs, -1, np.int64)
        order = np.lexsort((terms, counts, doc))
        last = np.cumsum(lengths) - 1
        some = lengths > 0
        frequent[some] = terms[order][last[some]]
        self.places = np.lexsort((sizes, frequent))
        at = np.empty(self.docs, np.int64)
        at[self.places] = np.arange(self.docs)
        share = (LENGTH_PERCENT * sizes * statistics.docs) // max(statistics.tokens, 1)
        measure = 100 - LENGTH_PERCENT + share
        saturated = (TF_SCALE * counts) // (1000 * counts + SATURATION * measure[doc])
        impact = weights[terms] * saturated
        keys = terms * self.docs + at[doc]
        order = np.argsort(keys, kind="stable")
        self.keys, self.impact = keys[order], impact[order]
        self.starts = np.searchsorted(self.keys, np.arange(len(weights) + 1) * self.docs)
        longest = int(np.diff(self.starts).max(initial=0))
        self.floor_log2 = np.zeros(longest + 2, np.int64)
        for i in range(2, longest + 2):
            self.floor_log2[i] = self.floor_log2[i // 2] + 1
        # A posting behind the end keeps places in range; its impact is nothing.
        level = np.append((self.impact << _PLACE) | (self.keys % max(self.docs, 1)), 0)
        self.levels = [level]
        for j in range(int(self.floor_log2[longest]) if longest else 0):
            ahead = np.append(level[1 << j :], np.zeros(min(1 << j, len(level)), np.int64))
            level = np.maximum(level, ahead[: len(level)])
            self.levels.append(level)
        self.levels = np.stack(self.levels)

    def _rank(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Place of the first posting of each term in a document of ``docs`` or behind it."""
        return np.searchsorted(self.keys, terms * self.docs + docs[:, None])

    def _bounds(self, low: np.ndarray, high: np.ndarray, times: np.ndarray):
        """Sum of the range maxima of each row's lists, and the document of the greatest."""
        length = high - low
        level = self.floor_log2[length]
        most = np.maximum(self.levels[level, low], self.levels[level, high - (1 << level)])
        most = np.where(length > 0, most, 0)
        impact = (most >> _PLACE) * times
        best = impact.argmax(axis=1)
        split = most[np.arange(len(most)), best] & ((1 << _PLACE) - 1)
        return impact.sum(axis=1), split

    def search(
        self, terms: np.ndarray, times: np.ndarray, top: int, floor: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and their scores, of the ``top`` greatest and all equal to the last of them.

        Scores below ``floor`` don't count.
        """
        listed = self.starts[terms + 1] > self.starts[terms]
        terms, times = terms[listed], times[listed]
        found = scores = np.zeros(0, np.int64)
        floor = max(floor, 1)
        if not len(terms):
            return found, scores
        together = max(1, WIDE // len(terms))
        first, end = np.array([0]), np.array([self.docs])
        bound, split = self._bounds(
            self.starts[terms][None, :], self.starts[terms + 1][None, :], times
        )
        while True:
            alive = bound >= floor
            first, end, bound, split = first[alive], end[alive], bound[alive], split[alive]
            if not len(bound):
                return self.places[found], scores
            if len(bound) > together:
                best = np.argpartition(-bound, together)
                now, later = best[:together], best[together:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            a, b, d = first[now], end[now], split[now]
            at = self._rank(terms, d)
            there = np.minimum(at, len(self.keys) - 1)
            has = self.keys[there] == terms * self.docs + d[:, None]
            score = (np.where(has, self.impact[there], 0) * times).sum(axis=1)
            found, scores = np.append(found, d), np.append(scores, score)
            if len(scores) >= top:
                floor = max(floor, int(np.partition(scores, -top)[-top]))
            good = scores >= floor
            found, scores = found[good], scores[good]
            # Left and right of the split document.
            left, left_split = self._bounds(self._rank(terms, a), at, times)
            right, right_split = self._bounds(at + has, self._rank(terms, b), times)
            first = np.concatenate([first[later], a, d + 1])
            end = np.concatenate([end[later], d, b])
            bound = np.concatenate([bound[later], left, right])
            split = np.concatenate([split[later], left_split, right_split])


def _order(pair: tuple) -> tuple:
    """Greatest score first, then by id, a null one last."""
    value, score = pair
    return (-score, value is None, 0 if value is None else value)


def _searcher(broadcast, statistics: Statistics, top: int):
    """Search of all queries in the blocks of a partition; the best so far bounds the next block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        waiting, docs, postings = [], 0, 0
        for batch in batches:
            done = 0
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for row, n in enumerate(lengths.tolist()):
                if docs and (docs == BLOCK_DOCS or postings + n > BLOCK_POSTINGS):
                    yield [*waiting, batch.slice(done, row - done)]
                    waiting, docs, postings, done = [], 0, 0, row
                docs, postings = docs + 1, postings + n
            waiting.append(batch.slice(done))
        if docs:
            yield waiting

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = broadcast.value
        weights = statistics.weights()
        best: list[list[tuple]] = [[] for _ in queries.terms]
        id_type = None
        for parts in blocks(batches):
            table = pa.Table.from_batches(parts)
            id_type = table.schema.field(0).type
            lists = table.column(2).combine_chunks()
            block = Block(
                table.column(1).to_numpy(),
                pa.compute.list_value_length(lists).to_numpy().astype(np.int64),
                lists.flatten().to_numpy().astype(np.int64),
                table.column(3).combine_chunks().flatten().to_numpy().astype(np.int64),
                statistics,
                weights,
            )
            ids = table.column(0)
            for q, (terms, times) in enumerate(zip(queries.terms, queries.times)):
                floor = best[q][-1][1] if len(best[q]) == top else 1
                docs, scores = block.search(terms, times, top, floor)
                if len(docs):
                    own = zip(ids.take(pa.array(docs)).to_pylist(), scores.tolist())
                    best[q] = sorted([*best[q], *own], key=_order)[:top]
        rows = [(q, *pair) for q, found in enumerate(best) for pair in found]
        if rows:
            places = pa.array([r[0] for r in rows], pa.int32())
            columns = [
                places,
                queries.ids.take(places),
                pa.array([r[1] for r in rows], id_type),
                pa.array([r[2] for r in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["query", "item_id", "doc_id", "score"])

    return search


def _statistics(index: DataFrame, size: int) -> Statistics:
    """Counts over all documents; the driver gets one row per term of the vocabulary."""
    full = index.filter("n > 0")
    totals = full.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    docs, tokens = totals.first()
    frequency = np.zeros(size, np.int64)
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    frequency[counted["term"].to_numpy()] = counted["count"].to_numpy()
    return Statistics(docs, tokens, frequency)


def search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    top: int = TOP,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` documents for every query.

    The score is the contract's, in 64-bit integers, over all documents with a
    term; only scores above 0 count, and equal ones go by ascending id, a null
    one last. Every row of ``queries`` is a query with ranks of its own, rows
    that repeat an id too; a text that is null or has no term finds nothing.
    Repeated documents are ranked each. Empty tables give empty results.
    Other columns are left out.

    Whole texts are read once per piece of queries (of ``piece_bytes``, mostly
    one); what is stored are the counts of query terms. A task holds a block
    of documents, whose results bound those of its next block; one row per
    task, query and rank goes on to the final ranking.
    """
    words = F.regexp_extract_all(ascii_lower(F.col(item_text)), F.lit(TERM), F.lit(0))
    asked = queries.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), words.alias("terms"))
    asked = asked.filter(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id())
    asked = materialize(asked, "queries")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    doc_type, item_type = own.schema["doc_id"].dataType, asked.schema["item_id"].dataType
    read_as = T.StructType().add("doc_id", doc_type).add("n", "long")
    read_as = read_as.add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType()))
    found_as = T.StructType().add("query", "integer").add("item_id", item_type)
    found_as = found_as.add("doc_id", doc_type).add("score", "long")
    results = []
    for number, piece in enumerate(_pieces(asked, piece_bytes)):
        shared = context.broadcast(piece)
        index = materialize(own.mapInArrow(_reader(shared), read_as), "postings")
        statistics = _statistics(index, len(piece.vocabulary))
        found = index.mapInArrow(_searcher(shared, statistics, top), found_as)
        results.append(found.withColumn("piece", F.lit(number)))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("piece", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM documents WHERE text IS NOT NULL),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM sizes),
weights AS (
  SELECT term, floor({LN_SCALE} * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark)
  GROUP BY item_id, term),
measures AS (
  SELECT doc_id, {100 - LENGTH_PERCENT} + ({LENGTH_PERCENT} * n * docs) // tokens AS m
  FROM sizes, totals),
scored AS (
  SELECT item_id, doc_id,
    sum(times * w * (({TF_SCALE} * tf) // (1000 * tf + {SATURATION} * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN measures USING (doc_id)
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
