"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

Two documents link when their sets of word shingles overlap enough. A set's
shingles are put in one order, rare ones first, by how often their bucket
occurs in the whole corpus. Of any two sets that link, each has one of its
``n - T + 1`` first shingles in common with the other's: the lists of these are
short, and deal the sets out to where they can meet.

Documents with equal sets are one row from the start. Lists are never turned
into all of their pairs:

1. Every list has a pivot, its smallest set. All members are held against it,
   first by counts of shingles in ranges of the hash (an upper bound of the
   overlap), then exactly.
2. Members that link to the pivot are connected, so their pairs need no look.
   By the triangle inequality of the Jaccard distance a member that links to
   the pivot can't link to one twice as far from it.
3. What is left over searches the index, dealt in blocks of sets: a set goes
   as a query to the blocks that have one of its short shingles, and the
   block's short lists are merged there. What sizes and range counts allow of
   these comes back with its sets. A block then has the inverted lists of all
   their shingles: a query's shorter lists are merged on a heap that skips
   what too few of them have, and its L longest ones are probed by binary
   search for those found in T - L of the others.
"""

import bisect
import heapq
import math
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txscreen.llm.common import numbered
from txscreen.llm.components import connected
from txscreen.sources import materialize, session_settings, stored_result

#: Words of a shingle, and the percentage of the union that must be shared.
WIDTH, PERCENT = 4, 85

#: Buckets that shingles are counted in to order them: a table of this size, whatever the corpus.
BUCKET_BITS = 18

#: Ranges of the hash that a set's shingles are counted in, for the upper bound.
RANGE_BITS = 7

#: Bits of the filter that spares reading the sets of documents nobody asks for.
#: A full filter lets everyone pass: more is read then, nothing is lost.
FILTER_BITS = 23

#: Sets of an index block in the search, and their shingles, on the average. A
#: block holds sets of about one size; sizes with more sets have several. Each
#: set takes some 1.5 KB there: its short shingles and range counts in arrays.
BLOCK_SETS, BLOCK_TOKENS = 65_536, 32_000_000

#: Shingles whose lists are held at once where sets are probed, of 12 bytes each.
PROBED_TOKENS = 3_000_000

#: Weight of a probe against a step of the merge, which decides how many lists are probed.
LONG_SHARE = 0.01

#: While rows hold sets or texts, Arrow batches have a bounded number of them.
SET_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

#: Each step is stored, so its shuffle files go with it. Else they stay on disk
#: until the driver happens to collect its garbage.
SHORT_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Times that one block may be there for its queries: a bound of the numbers of blocks alone.
MOST_TIMES = 1 << 32

# Odd multipliers of the hash of a shingle: multiples of the golden ratio's.
_GOLDEN = 0x9E3779B97F4A7C15
_MIX = np.array([(_GOLDEN * k) % 2**64 | 1 for k in range(1, 40, 2)], np.uint64)


class _WordHashes:
    """64-bit hash of each word, worked out each time.

    With as many new words as texts have, looking them up first takes longer.
    """

    __getitem__ = staticmethod(xxhash.xxh3_64_intdigest)


def shingle_set(text: str | None, hashes: _WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than ``width`` make up one.

    On bytes, ``lower`` changes A to Z only and ``split`` takes the white space
    of the contract. Null, empty and blank texts have no shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    wide = min(width, len(words))
    count = len(words) - wide + 1
    mixed = np.full(count, wide, np.uint64)
    for i in range(wide):
        mixed += values[i : i + count] * _MIX[i % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[-1]
    mixed ^= mixed >> np.uint64(32)
    # For the few values of a text this takes a tenth of the time of np.unique.
    mixed.sort()
    first = np.ones(count, bool)
    np.not_equal(mixed[1:], mixed[:-1], out=first[1:])
    return mixed[first]


def set_key(shingles: np.ndarray) -> int:
    """The name of a set: one 64-bit hash of all its shingles, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def needed(n: int, percent: int = PERCENT) -> int:
    """Overlap that a set of ``n`` needs at least with any partner: T."""
    return -(-n * percent // 100)


def short_count(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of ``n`` whose lists are merged; the others' are probed."""
    return n - needed(n, percent) + 1


def in_order(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sorted ``shingles``, rare ones first: by the count of their bucket, then by hash."""
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    # Count and place in one number, as plain numbers sort several times faster than two keys.
    bits = len(shingles).bit_length()
    order = np.sort(counts[bucket] << bits | np.arange(len(shingles)))
    return shingles[order & ((1 << bits) - 1)]


def range_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles per range of the middle bits, which the order doesn't depend on."""
    place = (shingles >> np.uint64(20)) & np.uint64((1 << RANGE_BITS) - 1)
    return np.bincount(place.astype(np.int64), minlength=1 << RANGE_BITS).astype(np.int32)


def overlap_reaching(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Size of the overlap of two sorted sets, or any smaller number than ``least``.

    The smaller set is probed piece by piece, each by binary search in the
    larger one, until what is left can't reach ``least`` any more.
    """
    if len(a) > len(b):
        a, b = b, a
    found, piece = 0, max(64, len(a) // 8)
    for start in range(0, len(a), piece):
        if found + len(a) - start < least:
            break
        probe = a[start : start + piece]
        at = np.searchsorted(b, probe)
        at[at == len(b)] = 0
        found += int(np.count_nonzero(b[at] == probe))
    return found


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*[batch.column(n).to_pylist() for n in names])


def _summaries(width: int):
    """One row per document, and per task one row for each bucket of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            sizes, keys, ranges = [], [], []
            waiting = []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), hashes, width)
                sizes.append(len(shingles))
                keys.append(set_key(shingles) if len(shingles) else None)
                ranges.append(range_counts(shingles).tobytes() if len(shingles) else None)
                waiting.append(shingles)
            if waiting:
                bucket = np.concatenate(waiting) >> np.uint64(64 - BUCKET_BITS)
                counts += np.bincount(bucket.astype(np.int64), minlength=len(counts))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["document"] * batch.num_rows),
                    batch.column("doc_id"),
                    pa.array(keys, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(ranges, pa.binary()),
                    none,
                ],
                ["kind", "doc_id", "key", "n", "ranges", "bucket"],
            )
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["bucket"] * len(at)),
                    pa.nulls(len(at), batch.column("doc_id").type),
                    pa.nulls(len(at), pa.int64()),
                    pa.array(counts[at], pa.int64()),
                    pa.nulls(len(at), pa.binary()),
                    pa.array(at, pa.int64()),
                ],
                ["kind", "doc_id", "key", "n", "ranges", "bucket"],
            )

    return run


def _short_lists(width: int, percent: int, shared):
    """Token, set and size for the short lists; a set met before in the task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, seen = _WordHashes(), shared.value, set()
        for batch in batches:
            tokens, keys, sizes, lengths = [], [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), hashes, width)
                if not len(shingles):
                    continue
                key = set_key(shingles)
                if key in seen:
                    continue
                seen.add(key)
                short = in_order(shingles, counts)[: short_count(len(shingles), percent)]
                tokens.append(short.view(np.int64))
                keys.append(key)
                sizes.append(len(shingles))
                lengths.append(len(short))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens)),
                        pa.array(np.repeat(np.array(keys, np.int64), lengths)),
                        pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                    ],
                    ["token", "key", "n"],
                )

    return run


def _wanted_sets(width: int, wanted):
    """Set of each document whose id passes the filter; an equal one once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = _WordHashes(), wanted.value
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            passed = (bits[slots >> 3] >> (slots & 7)) & 1
            keys, sets = [], []
            for at in np.flatnonzero(passed):
                shingles = shingle_set(batch.column("text")[int(at)].as_py(), hashes, width)
                if len(shingles):
                    keys.append(set_key(shingles))
                    sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "shingles"]
            )

    return run


def _classify(percent: int, near: int):
    """Links, and what is near the pivot without linking to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, close = [], []
            for a, b in _rows(batch, "a_set", "b_set"):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(x) + len(y)
                # o >= p (both - o) / 100 is o >= p both / (100 + p).
                found = overlap_reaching(x, y, -(-near * both // (100 + near)))
                union = both - found
                linked.append(100 * found >= percent * union)
                close.append(100 * found >= near * union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pivot"), batch.column("key"), pa.array(linked, pa.bool_()), pa.array(close, pa.bool_())],
                ["pivot", "key", "linked", "close"],
            )

    return run


def _upper_bounds():
    """Of two sets' range counts, the sum of the smaller ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [
                int(np.minimum(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)).sum())
                for a, b in _rows(batch, "a_ranges", "b_ranges")
            ]
            names = ["pivot", "key", "both"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(tops, pa.int64())], [*names, "top"]
            )

    return run


class _Forest(dict):
    """Union-find over what has been seen of a block."""

    def find(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def _numbers(data: bytearray, kind: type) -> np.ndarray:
    """The numbers that ``data`` holds, without a copy."""
    return np.frombuffer(data, kind) if data else np.zeros(0, kind)


class _Lists:
    """Inverted lists of a block in two arrays: tokens in order, and the place of each one's set.

    ``tokens`` has the sets' tokens one after the other. It is emptied on the
    way, so that few arrays of all tokens are held at once.
    """

    def __init__(self, tokens: bytearray, lengths: array, kind: type):
        flat = _numbers(tokens, kind)
        # The sort is stable, so the places of a token ascend.
        order = np.argsort(flat, kind="stable")
        self.tokens = flat[order]
        del flat
        tokens.clear()
        self.places = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]

    def of(self, tokens: np.ndarray) -> list[np.ndarray]:
        """The list of each token that has one."""
        low, high = (np.searchsorted(self.tokens, tokens, side) for side in ("left", "right"))
        return [self.places[a:b] for a, b in zip(low.tolist(), high.tolist()) if a < b]


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Numbers in at least ``least`` of the ascending lists, and in how many.

    A heap holds the head of every list. Where too few lists have the smallest
    head, nothing ahead of the head that is ``least``-th in order can be in
    enough of them: the lists before it skip there by binary search.
    """
    at = [0] * len(lists)
    heap = [(members[0], i) for i, members in enumerate(lists) if members]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            yield top, len(taken)
            bound = top + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            bound = heap[0][0]
        for i in taken:
            at[i] = bisect.bisect_left(lists[i], bound, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def long_count(least: int, longest: int) -> int:
    """L: how many of a query's lists are probed rather than merged, below ``least``."""
    return min(least - 1, int(least / (LONG_SHARE * math.log2(max(longest, 2)) + 1)))


class _Block:
    """Sets of one index block by their inverted lists: DivideSkip for one query at a time.

    Index sets are added in the order of their keys, all before the first query.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.keys, self.sizes = array("q"), array("q")
        self.waiting = bytearray()
        self.lists: _Lists | None = None
        self.known = _Forest()

    def add(self, key: int, label: int, shingles: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(shingles))
        self.waiting += shingles.tobytes()
        self.known.join(key, label)

    def _reaches(self, place: int, count: int, long: list[np.ndarray], least: int) -> bool:
        """Whether ``place`` is in enough of the long lists besides ``count`` others."""
        for i, places in enumerate(long):
            if count >= least or count + len(long) - i < least:
                break
            at = int(np.searchsorted(places, place))
            count += at < len(places) and int(places[at]) == place
        return count >= least

    def search(self, query: int, label: int, shingles: np.ndarray) -> list[int]:
        """Index sets behind ``query`` in key order that link to it and weren't connected yet.

        T is the overlap that any partner needs. The L longest lists are set
        aside; who is in T - L of the others is probed for in these, until its
        own required overlap is reached or out of reach.
        """
        if self.lists is None:
            self.lists = _Lists(self.waiting, self.sizes, np.uint64)
        known, keys = self.known, self.keys
        known.join(query, label)
        own, behind = known.find(query), bisect.bisect_right(keys, query)
        n = len(shingles)
        least = needed(n, self.percent)
        lists = sorted(self.lists.of(shingles), key=len)
        if len(lists) < least:
            return []
        apart = long_count(least, len(lists[-1]))
        short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
        merged = []
        for places in short:
            later = places[np.searchsorted(places, behind) :].tolist()
            merged.append([i for i in later if known.find(keys[i]) != own])
        found = []
        for place, count in merge_skip(merged, least - apart):
            key, size = keys[place], self.sizes[place]
            if 100 * min(n, size) < self.percent * max(n, size):
                continue
            if known.find(key) == known.find(query):
                continue
            # o >= p (both - o) / 100 is o >= p both / (100 + p).
            if self._reaches(place, count, long, -(-self.percent * (n + size) // (100 + self.percent))):
                found.append(key)
                known.join(key, query)
        return found


def _search(percent: int):
    """Rows come sorted by block, index rows ahead of queries: one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, None
        for batch in batches:
            a, b = [], []
            for at, query, key, label, data in _rows(
                batch, "block", "query", "key", "label", "shingles"
            ):
                if block is None or at != number:
                    block, number = _Block(percent), at
                shingles = np.frombuffer(data, np.uint64)
                if query:
                    links = block.search(key, label, shingles)
                    a += [key] * len(links)
                    b += links
                else:
                    block.add(key, label, shingles)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
            )

    return run


def _bounded_search(percent: int):
    """Queries with an index set that sizes and range counts allow, and those sets.

    Rows come sorted by block, index rows ahead of queries. A query's lists are
    merged to the index sets behind it in key order; each row comes out once
    per block, so what comes out grows with the rows, not with their pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        for batch in batches:
            out: list[tuple[int, bool, int]] = []
            tokens = batch.column("tokens")
            names = ("block", "query", "key", "label", "n", "ranges")
            for row, (at, query, key, label, n, ranges) in enumerate(_rows(batch, *names)):
                if at != number:
                    # What the block before has held goes first.
                    number, table, told, lists, ranges_of = at, None, set(), None, None
                    keys, labels, sizes, lengths = (array("q") for _ in range(4))
                    counts, short = bytearray(), bytearray()
                mine = tokens[row].values.to_numpy()
                if not query:
                    for column, value in zip((keys, labels, sizes, lengths), (key, label, n, len(mine))):
                        column.append(value)
                    counts += ranges
                    short += mine.tobytes()
                    continue
                own = np.frombuffer(ranges, np.int32)
                if table is None:
                    table = [np.array(c, np.int64) for c in (keys, labels, sizes)]
                    ranges_of = _numbers(counts, np.int32).reshape(-1, 1 << RANGE_BITS)
                    lists = _Lists(short, lengths, np.int64)
                merged = heapq.merge(*[places.tolist() for places in lists.of(mine)])
                found = np.array([i for i, _ in groupby(merged)], np.int64)
                k, l, m = (column[found] for column in table)
                found = found[
                    (k > key)
                    & (l != label)
                    & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
                ]
                top = np.minimum(ranges_of[found], own).sum(axis=1)
                found = found[top * (100 + percent) >= percent * (table[2][found] + n)]
                if len(found):
                    out.append((at, True, key))
                    fresh = [keys[i] for i in found.tolist() if keys[i] not in told]
                    told.update(fresh)
                    out += [(at, False, f) for f in fresh]
            columns = list(zip(*out)) or [()] * 3
            kinds = (pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "query", "key"]
            )

    return run


def _stored(df: DataFrame, name: str, **layout) -> DataFrame:
    """``df`` stored, with sets and texts in Arrow batches of a bounded number of rows."""
    with session_settings(df.sparkSession, SET_ROWS):
        return materialize(df, name, **layout)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "query", "key")


def _in_pieces(rows: DataFrame) -> DataFrame:
    """Blocks whose index sets have too many shingles in several pieces, queries in each of them."""
    index = rows.filter("NOT query").groupBy("block")
    pieces = index.agg(F.ceil(F.sum("n") / PROBED_TOKENS).alias("pieces"))
    cut = rows.join(pieces, "block")
    every = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    one = F.array(F.pmod(F.xxhash64("key", F.lit(2)), F.col("pieces")))
    placed = cut.withColumn("piece", F.explode(F.when(F.col("query"), every).otherwise(one)))
    return placed.withColumn("block", F.struct("block", "piece"))


def _near(percent: int) -> int:
    """Similarity in percent at twice the distance of a link, rounded down."""
    return max(0, 2 * percent - 100)


def _sets_of(docs: DataFrame, keys: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """key and shingles of the sets named by ``keys``, read again from their texts.

    Each is named once; its other columns come with it. ``members`` has one
    document per set. The filter on its id has a fixed size; what passes it by
    chance falls out of the join behind.
    """
    spark = docs.sparkSession
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    asked = keys.join(members, "key").select(slot.alias("slot"))
    pieces = (
        asked.groupBy(F.bitmap_bucket_number("slot").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()
    )
    # Pieces count from 1 but for slot 0; each has 32,768 bits.
    bits = np.zeros((1 << FILTER_BITS) // 8 + 4096, np.uint8)
    for row in pieces:
        start = (row["piece"] - 1) * 4096 if row["piece"] > 0 else 0
        part = np.frombuffer(row["bits"], np.uint8)
        bits[start : start + len(part)] |= part
    wanted = spark.sparkContext.broadcast(bits)
    texts = docs.select(_bit_of(slot).alias("slot"), "text")
    sets = texts.mapInArrow(_wanted_sets(width, wanted), "key long, shingles binary")
    named = [F.first(c).alias(c) for c in ("shingles", *keys.columns) if c != "key"]
    return sets.join(keys, "key").groupBy("key").agg(*named)


def _bit_of(slot: Column) -> Column:
    """Where the bitmap functions put a slot, counted from the first bit of all."""
    piece = F.greatest(F.bitmap_bucket_number(slot) - 1, F.lit(0))
    return piece * 32768 + F.bitmap_bit_position(slot)


def _held(
    docs: DataFrame, pairs: DataFrame, members: DataFrame, width: int, percent: int
) -> DataFrame:
    """Pairs of a pivot and a key by their sets: whether they link, and whether they are close."""
    ends = [("pivot", True), ("key", False)]
    asked = [F.struct(F.col(c).alias("key"), F.lit(own).alias("own")) for c, own in ends]
    asked = pairs.select(F.explode(F.array(*asked)).alias("end")).groupBy("end.key")
    asked = asked.agg(F.bool_or("end.own").alias("as_pivot"), F.bool_or(~F.col("end.own")).alias("as_key"))
    sets = _stored(_sets_of(docs, asked, members, width), "shingles")
    # Most sets stand on one side of their pairs only, and are sent there alone.
    own, other = sets.filter("as_pivot"), sets.filter("as_key")
    return (
        pairs.join(other.select("key", F.col("shingles").alias("b_set")), "key")
        .join(own.select(F.col("key").alias("pivot"), F.col("shingles").alias("a_set")), "pivot")
        .mapInArrow(_classify(percent, _near(percent)), "pivot long, key long, linked boolean, close boolean")
    )


def links(
    docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Documents with their sets (doc_id, n, key), and links between sets (a, b).

    ``docs`` has doc_id and text. The links connect all sets that the join
    connects, not each pair that is already connected through others.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    summary = _stored(
        docs.mapInArrow(
            _summaries(width),
            f"kind string, doc_id {kind}, key long, n long, ranges binary, bucket long",
        ),
        "sets",
        partition_by=("kind",),
    )
    documents = summary.filter("kind = 'document'")
    buckets = summary.filter("kind = 'bucket'").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    table = buckets.toArrow()  # one number per bucket, whatever the corpus
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    postings = docs.select("text").mapInArrow(
        _short_lists(width, percent, shared), "token long, key long, n int"
    )
    # Most short lists have one entry. They go first, by their tokens alone: to read the
    # texts again costs less than to store all entries.
    long_enough = postings.groupBy("token").agg(F.count(F.lit(1)).alias("entries"))
    long_enough = _stored(long_enough.filter("entries > 1").select("token"), "repeated")
    lists = _stored(postings.join(long_enough, "token", "left_semi").distinct(), "lists")
    pivots = lists.groupBy("token").agg(
        F.min("key").alias("pivot"), F.max("key").alias("last"), F.min_by("n", "key").alias("pivot_n")
    )
    pivots = pivots.filter("pivot < last").drop("last")
    entries = lists.join(pivots, "token").filter("key != pivot")
    members = _stored(
        documents.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.first("ranges").alias("ranges"), F.first("n").alias("n")),
        "members",
    )

    # 1. Each member of a list against its pivot.
    near = _near(percent)
    stars = entries.groupBy("pivot", "key").agg(F.first("n").alias("n"), F.first("pivot_n").alias("pivot_n"))
    close_sizes = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * near
    stars = stars.filter(close_sizes).withColumn("both", F.col("n") + F.col("pivot_n"))
    own, other = members.select("key", "ranges"), members.select(F.col("key").alias("pivot"), "ranges")
    bounded = (
        stars.join(own.withColumnRenamed("ranges", "a_ranges"), "key")
        .join(other.withColumnRenamed("ranges", "b_ranges"), "pivot")
        .select("pivot", "key", F.col("both").cast("long").alias("both"), "a_ranges", "b_ranges")
        .mapInArrow(_upper_bounds(), "pivot long, key long, both long, top long")
        .filter(F.col("top") * (100 + near) >= F.col("both") * near)
    )
    bounded = _stored(bounded, "bounded")
    could_link = bounded.filter(F.col("top") * (100 + percent) >= F.col("both") * percent)
    pairs = could_link.select("pivot", "key")
    with session_settings(spark, SET_ROWS):
        held = stored_result(spark, "held", lambda: _held(docs, pairs, members, width, percent))
    linked = held.filter("linked").select(F.col("pivot").alias("a"), F.col("key").alias("b"))

    # 2. What the pivots leave open. Pairs not held exactly but bounded as near count as near.
    status = bounded.select("pivot", "key").join(held, ["pivot", "key"], "left")
    status = status.select(
        "pivot",
        "key",
        F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce("close", F.lit(True)).alias("close"),
    ).filter("linked OR close")
    placed = _stored(
        entries.select("token", "pivot", "key", "n").join(status, ["pivot", "key"], "left").select(
            "token",
            "key",
            "n",
            F.when(F.col("linked"), "linked").when(F.col("close"), "near").otherwise("far").alias("place"),
        ),
        "placed",
    )
    found = placed.groupBy("token").agg(
        F.count_if(F.col("place") == "near").alias("near"),
        F.count_if(F.col("place") == "far").alias("far"),
        F.count(F.lit(1)).alias("entries"),
    )
    unsettled = found.filter("near > 0 AND entries > 1 OR far > 1")
    open_entries = placed.join(unsettled, "token").filter(
        F.when(F.col("place") == "linked", F.col("near") > 0)
        .when(F.col("place") == "near", F.col("entries") > 1)
        .otherwise(F.col("far") + F.col("near") > 1)
    )
    open_entries = _stored(open_entries.select("token", "key", "n"), "open")

    # 3. They search the blocks of the index that have one of their short shingles:
    # first by sizes and range counts, then what that leaves by its sets.
    labels = linked.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("label"))
    searchers = _stored(
        open_entries.groupBy("key")
        .agg(F.collect_list("token").alias("tokens"))
        .join(members.select("key", "n", "ranges"), "key")
        .join(labels, "key", "left")
        .select("key", F.coalesce("label", "key").alias("label"), "n", "ranges", "tokens"),
        "searchers",
    )
    if not searchers.isEmpty():
        # Partners lie in the same band of sizes or in one beside it.
        # Bands are a little wider than the sizes that may link, for the rounding.
        width_of_band = max(math.log(100 / percent) * 1.01, 1e-6)
        band = F.floor(F.log(F.col("n")) / width_of_band).cast("int")
        # One row per band: as many as the largest size has powers.
        filled = searchers.groupBy(band.alias("band")).agg(
            F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")
        )
        parts = {
            row["band"]: max(-(-row["sets"] // BLOCK_SETS), -(-row["tokens"] // BLOCK_TOKENS))
            for row in filled.collect()
        }
        most = max(parts.values())
        in_band = F.create_map(*[F.lit(v) for item in parts.items() for v in item])
        part = F.pmod(F.xxhash64("key"), in_band[band]).cast("int")
        banded = open_entries.select("token", "key", band.alias("band"), part.alias("part"))
        where = banded.select("token", "band", "part").distinct()
        near_by = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))
        routed = banded.select("token", "key", near_by.alias("band")).join(where, ["token", "band"])
        routed = routed.select("key", "band", "part").distinct()
        routed = _stored(routed, "routed")
        # A block that more queries ask than it may hold sets is there several times.
        asked_of = routed.groupBy("band", "part").agg(
            F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("times")
        )
        turn = F.explode(F.sequence(F.lit(0), F.col("times") - 1))
        block = ((F.col("band") * most + F.col("part")) * MOST_TIMES + F.col("turn")).alias("block")
        index = searchers.withColumns({"band": band, "part": part}).join(asked_of, ["band", "part"])
        index = index.withColumn("turn", turn).select(
            block, F.lit(False).alias("query"), *searchers.columns
        )
        one_of = F.pmod(F.xxhash64("key", F.lit(1)), F.col("times"))
        turned = routed.join(asked_of, ["band", "part"]).withColumn("turn", one_of)
        queries = searchers.join(turned, "key").select(
            block, F.lit(True).alias("query"), *searchers.columns
        )
        left = _by_block(index.unionByName(queries)).mapInArrow(
            _bounded_search(percent), "block long, query boolean, key long"
        )
        left = _stored(left, "left")
        sets = _sets_of(docs, left.select("key").distinct(), members, width)
        again = _in_pieces(left.join(searchers.select("key", "label", "n"), "key"))
        more = _by_block(sets.join(again, "key")).select(
            "block", "query", "key", "label", "shingles"
        )
        more = more.mapInArrow(_search(percent), "a long, b long")
        linked = linked.unionByName(_stored(more, "found"))
    return documents.select("doc_id", "n", "key"), linked


def join_documents(
    docs: DataFrame,
    *,
    width: int = WIDTH,
    percent: int = PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    The component's id is the smallest doc_id that links lead to. A document
    without a word has an empty set and is on its own. Repeated rows and null
    ids stand for documents of their own; a component without any id has none.
    Other columns are not looked at. An empty table gives an empty one.
    """
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with session_settings(docs.sparkSession, SHORT_SHUFFLES):
        documents, linked = links(few, width=width, percent=percent)
        groups = connected(linked).withColumnRenamed("node", "key")
    first = (
        documents.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"))
    )
    named = first.join(groups, "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_set = named.join(smallest, "component").select("key", "component_id")
    return documents.join(of_set, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias(
            "component_id"
        ),
    )


def keep_first(
    docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest id, as it is.

    Rows that share an id stay or go together; of those that share their text
    too, one stays. Rows without an id stay, and so do documents without a
    word, but for repeated rows.
    """
    found = join_documents(docs, width=width, percent=percent)
    first = found.filter(F.col("doc_id") == F.col("component_id"))
    kept = first.select(F.col("doc_id").alias("kept")).distinct()
    plain, names = numbered(docs)
    key, text = names["doc_id"], names["text"]
    joined = plain.join(kept, F.col(key) == F.col("kept"), "left")
    joined = joined.filter(F.col(key).isNull() | F.col("kept").isNotNull())
    single = joined.dropDuplicates([key, text])
    return single.select(*plain.columns).toDF(*docs.columns)
