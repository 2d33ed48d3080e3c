"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector is centred, rotated into ``WIDE`` times its components and reduced to
their signs. With two numbers per vector, its length and how well the signs
point its way, packed signs give an estimate of the inner product with a bound
on its error. Vectors whose bound reaches the k-th best found so far are scored
exactly.
"""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txscreen.sources import materialize

TOP, QUERY_EVERY = 20, 20

#: Bits per component of a rotated query, and the width of the error bound in
#: standard deviations.
QUERY_BITS, BOUND = 4, 3.0
ROUNDING = 1e-11

#: Signs per component of a vector. Twice as many take a third off the error.
WIDE = 2

#: Vectors whose codes are compared at once, and queries that are.
BLOCK, QUERIES_TOGETHER = 4096, 128

#: Bytes of the vectors that a task holds, and the queries that it is asked, on
#: the average. Both go to a task per pair of parts, so large ones move less.
PART_BYTES, QUERY_PART = 1 << 25, 32_768

#: Parts of vectors at least, so that a small table has work for several executors.
LEAST_PARTS = 16

#: Shuffle partitions at most; with more pairs of parts than that, a task has several in turn.
MOST_PARTITIONS = 20_000

SEED = 67


def rotation(size: int, wide: int = 1, seed: int = SEED) -> np.ndarray:
    """``size`` random orthogonal directions in ``wide`` times as many dimensions.

    The same for every task.
    """
    normal = np.random.default_rng(seed).standard_normal((size * wide, size * wide))
    q, r = np.linalg.qr(normal)
    return (q * np.sign(np.diag(r)))[:, :size]


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Packed signs, length, and inner product of signs and direction, per vector.

    A vector at the centre has length 0 and so is estimated without error.
    """
    rest = vectors.astype(np.float64) - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length > 0, length, 1.0)[:, None]) @ turn.T
    signs = turned >= 0
    fit = np.abs(turned).sum(axis=1) / np.sqrt(len(turn))
    return _pack(signs), length, np.where(length > 0, fit, 1.0)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    spare = -packed.shape[1] % 8
    return np.pad(packed, ((0, 0), (0, spare))).view(np.uint64)


def estimate(codes, length, fit, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Estimated inner products (queries by vectors) and the half width of their bounds."""
    dims = len(turn)
    turned = queries.astype(np.float64) @ turn.T
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-300) / (2**QUERY_BITS - 1)
    levels = np.clip(np.rint((turned - low) / step), 0, 2**QUERY_BITS - 1).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # Sum of the levels where the sign is +, bit plane by bit plane.
    hits = np.zeros((len(queries), len(codes)), np.float64)
    for bit in range(QUERY_BITS):
        plane = _pack((levels >> bit) & 1)
        both = np.zeros(hits.shape, np.uint16)
        for word in range(plane.shape[1]):
            both += np.bitwise_count(plane[:, word, None] & codes[None, :, word])
        hits += float(1 << bit) * both
    sums = levels.sum(axis=1, dtype=np.float64)[:, None]
    signed = step * (2 * hits - sums) + low * (2 * ones - dims)[None, :]
    scale = length / fit
    value = (queries.astype(np.float64) @ centre)[:, None] + signed / np.sqrt(dims) * scale
    # Error of the signs, and of the query's rounding.
    off = np.sqrt(np.maximum(1 - fit * fit, 0)) * scale / np.sqrt(max(dims - 1, 1))
    norm = np.linalg.norm(turned, axis=1)[:, None]
    half = BOUND * (norm * off + step / np.sqrt(12) * scale)
    # What the arithmetic itself may be off, where the code is exact.
    half += ROUNDING * norm * (np.linalg.norm(centre) + length)
    return value, half


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal values."""
    return (vectors.astype(np.float64) * query.astype(np.float64)).sum(axis=1)


class _Part:
    """Vectors that a task holds in blocks with their codes, all added before the first query."""

    def __init__(self, centre: np.ndarray, turn: np.ndarray, top: int):
        self.centre, self.turn, self.top = centre, turn, top
        self.blocks: list[tuple[np.ndarray, ...]] = []
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, len(ids), BLOCK):
            # Copies: the batch they are part of goes.
            self.open.append((ids[start : start + BLOCK].copy(), vectors[start : start + BLOCK].copy()))
            self.waiting += len(self.open[-1][0])
            if self.waiting >= BLOCK:
                self._close()

    def _close(self) -> None:
        if self.open:
            ids, vectors = (np.concatenate(column) for column in zip(*self.open))
            self.blocks.append((ids, vectors, *encode(vectors, self.centre, self.turn)))
        self.open, self.waiting = [], 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray):
        """The ``top`` best for each query: query ids, ids and exact scores.

        A block's vectors are scored whose upper bound reaches the worst of the
        ``top`` scores that a query has by then. Before it has as many, they
        are those that reach the ``top``-th lower bound of the block.
        """
        self._close()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for start in range(0, len(queries), QUERIES_TOGETHER):
            some, own = queries[start : start + QUERIES_TOGETHER], query_ids[start : start + QUERIES_TOGETHER]
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(some)
            least = np.full(len(some), -np.inf)
            for block in self.blocks:
                self._meet(block, own, some, best, least)
            found += [(np.full(len(ids), query), ids, scores) for query, (ids, scores) in zip(own, best)]
        return tuple(np.concatenate(column) for column in zip(*found))

    def _meet(self, block, own: np.ndarray, queries: np.ndarray, best: list, least: np.ndarray) -> None:
        """Bring ``best``, and ``least`` of it, up to date with a block."""
        ids, vectors, *codes = block
        value, half = estimate(*codes, queries, self.centre, self.turn)
        value[own[:, None] == ids[None, :]] = -np.inf
        reach = least
        if np.isneginf(least).any() and len(ids) > self.top:
            place = len(ids) - self.top
            reach = np.maximum(least, np.partition(value - half, place, axis=1)[:, place])
        chosen = (value + half >= reach[:, None]) & ~np.isneginf(value)
        for i, query in enumerate(queries):
            at = np.flatnonzero(chosen[i])
            if len(at):
                names = np.concatenate([best[i][0], ids[at]])
                scores = np.concatenate([best[i][1], exact(query, vectors[at])])
                order = np.lexsort((names, -scores))[: self.top]
                best[i] = names[order], scores[order]
                if len(order) == self.top:
                    least[i] = scores[order[-1]]


def _usable(vectors: DataFrame, vec_id: str, embedding: str, size: int) -> DataFrame:
    """Rows that take part: an id, ``size`` finite components, not all of them 0."""
    items = F.col("items")
    bad = F.exists(items, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    other = F.exists(items, lambda x: x != 0)
    kind = "float" if vectors.schema[embedding].dataType.elementType == T.FloatType() else "double"
    few = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).cast(f"array<{kind}>").alias("items"),
    )
    right = F.col("vec_id").isNotNull() & (F.size(items) == size)
    return few.filter(right).filter(~bad & other)


def _dealt(rows: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
    """Rows dealt into ``parts`` by a hash of id and salt, each for all parts of the other side."""
    part = F.pmod(F.xxhash64("vec_id", "salt"), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
    return rows.select(part.alias(own), every.alias(other), "vec_id", "items")


def _arrays(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch."""
    items = batch.column("items").flatten().to_numpy()
    return batch.column("vec_id").to_numpy(), items.reshape(-1, size)


def nearest(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    query_every: int = QUERY_EVERY,
    top: int = TOP,
    seed: int = SEED,
) -> DataFrame:
    """The ``top`` nearest of all other rows for every row whose id ``query_every`` divides.

    Returns query_id, rank from 1, vec_id and score, the inner product in
    double precision. Ties go to the smaller id. Left out as query and as
    candidate: a null id, a null vector, one with a null, NaN or infinite
    component, a zero vector, and one that is longer or shorter than the
    longest common size (the most frequent one, the larger of equals). Rows
    that repeat an id are candidates each, but never of a query by their id;
    a repeated query is answered once, for its smallest vector. No usable row:
    an empty result.

    Ids must be integers.

    Vectors are dealt into parts of bounded bytes, copies of one id spread over
    them, and queries into parts of their own. A task has one part of either:
    it holds the vectors with their codes and reads the queries one after the
    other. What is moved is each vector once per ``QUERY_PART`` queries, and
    the best ``top`` per query and part, which are ranked per query.
    """
    if not isinstance(vectors.schema[vec_id].dataType, T.IntegralType):
        raise ValueError(f"{vec_id} must be an integer")
    sizes = vectors.select(F.size(F.col(embedding)).alias("size")).filter("size > 0")
    common = sizes.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], result)
    size = int(common["size"])
    # A stored number per row, so that copies of an id don't share a block.
    usable = _usable(vectors, vec_id, embedding, size)
    rows = materialize(usable.withColumn("salt", F.monotonically_increasing_id()), "vectors")
    means = [F.avg(F.col("items")[i]) for i in range(size)]
    averages = rows.agg(F.array(*means).alias("centre")).first()["centre"]
    if averages[0] is None:
        return vectors.sparkSession.createDataFrame([], result)
    centre = np.array(averages)

    queries = (
        rows.filter(F.col("vec_id") % query_every == 0)
        .groupBy("vec_id")
        .agg(F.min("items").alias("items"))
        .withColumn("salt", F.lit(0).cast("long"))
    )
    queries = materialize(queries, "queries")
    numbers = max(-(-queries.count() // QUERY_PART), 1)
    width = 4 if rows.schema["items"].dataType.elementType == T.FloatType() else 8
    parts = max(-(-rows.count() * size * width // PART_BYTES), LEAST_PARTS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(size, WIDE, seed)
        part, number = None, None
        for batch in batches:
            groups, asked = (batch.column(c).to_numpy() for c in ("group", "asked"))
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(asked) != 0)) + 1
            for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if part is None or groups[a] != number:
                    part, number = _Part(centre, turn, top), groups[a]
                ids, items = _arrays(batch.slice(a, b - a), size)
                if not asked[a]:
                    part.add(ids, items)
                    continue
                columns = zip(part.search(ids, items), (pa.int64(), pa.int64(), pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in columns], ["query_id", "vec_id", "score"]
                )

    index = _dealt(rows, "part", parts, "number", numbers).withColumn("asked", F.lit(0))
    asked = _dealt(queries, "number", numbers, "part", parts).withColumn("asked", F.lit(1))
    group = F.col("part") * numbers + F.col("number")
    partitions = min(parts * numbers, MOST_PARTITIONS)
    together = index.unionByName(asked).select(group.alias("group"), "asked", "vec_id", "items")
    met = together.repartitionById(partitions, F.pmod("group", F.lit(partitions)).cast("int"))
    found = met.sortWithinPartitions("group", "asked").mapInArrow(
        search, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
