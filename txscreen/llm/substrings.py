"""Removal of repeated substrings by sparse suffix sorting over a difference cover.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts
earlier. Comparing every suffix would move the text a hundred times over, so
suffixes are sampled and named as in a difference-cover algorithm. The cover is
set by content, not by position: of the grams in a window of ``LENGTH`` bytes
the one with the least hash is its anchor. Equal windows have equal anchors at
equal places, so two strings meet in the sample wherever they stand, and the
sample is about one position in 46; a cover by position would need one in six.

1. Name. The windows of one anchor make up a phrase: from the start of the
   first to the end of the last. Equal phrases have equal names, a gram of the
   anchor with a hash of all of the phrase. A phrase that is found again in its
   document, or in an earlier one of the same task, is repeated for certain and
   goes no further.
2. Sort by gram and name and compare neighbours: all but the first of equal
   phrases are repeated. No recursion is needed, since names reach further than
   the strings that count.
3. Merge the rest. A window has the half of its bytes beside the anchor on the
   left of it or on the right, so two phrases that share one have that side of
   the gram in common, 58 bytes or more of 100. Of the first phrases of their
   names, the sides that other names have too are fetched from the texts, and
   the windows in them are compared byte by byte. A gram alone is soon shared
   by most phrases as texts become more.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txscreen.llm.jaccard import SHORT_SHUFFLES
from txscreen.sources import materialize, session_settings

#: Bytes of a string that counts, and of a gram.
LENGTH, GRAM = 100, 16

#: Windows that are looked at together: what a task holds of a very long text.
PIECE = 1 << 20

#: Phrases a task remembers to find them again.
REMEMBERED = 500_000

#: Phrases of one side that one task compares; windows of more are dealt out singly.
TOGETHER = 4000

_ODD = [np.uint64((0x9E3779B97F4A7C15 * k) % 2**64 | 1) for k in (1, 3, 5)]
_PLACE = np.uint64(PIECE * 2 - 1)


def grams(data: bytes) -> np.ndarray:
    """A 64-bit hash of the 16 bytes at each position."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    count = len(data) - GRAM + 1
    mixed = words[:count] * _ODD[0] + words[8 : 8 + count] * _ODD[1]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[2]
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _anchored(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Start and grams of each piece; first window, number of windows and anchor of its phrases."""
    span = length - GRAM + 1
    for start in range(0, len(data) - length + 1, PIECE):
        hashes = grams(data[start : start + PIECE + length - 1])
        key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        wide = 1
        while wide * 2 <= span:
            key = np.minimum(key[:-wide], key[wide:])
            wide *= 2
        if wide < span:
            key = np.minimum(key[: len(key) - (span - wide)], key[span - wide :])
        anchor = (key & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        yield start, hashes, first, count, anchor[first]


def phrases(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First window, number of windows and gram of each phrase, piece by piece.

    The anchor of a window is its gram with the least hash, the leftmost of
    equals. A phrase that a piece cuts in two is two phrases.
    """
    for start, hashes, first, count, anchor in _anchored(data, length):
        yield first + start, count, hashes[anchor]


def reach(length: int) -> int:
    """Bytes ahead of its anchor that a left window has at least; a right one has fewer."""
    return (length - GRAM + 1) // 2


def sides(hashes: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """What all left windows of a phrase have in common, and all right ones: 32 bits each.

    That is the anchor with the ``reach`` bytes ahead of it, or with as many
    behind it as every right window has. The bits say nothing where a phrase has
    no such window. Equal windows have their anchor at one place, so they are of
    one side and their phrases have equal bits there.
    """
    ahead = reach(length)
    found = []
    for far, way in ((ahead, -1), (length - GRAM - ahead + 1, 1)):
        mixed = np.zeros(len(anchor), np.uint64)
        for off in range(far, 0, -GRAM):
            mixed ^= hashes[np.clip(anchor + way * off, 0, len(hashes) - 1)]
            mixed *= _ODD[1]
            mixed ^= mixed >> np.uint64(32)
        found.append(mixed >> np.uint64(32))
    return found[0] << np.uint64(32) | found[1]


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that touch or overlap made one."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            if end > merged[-1][1]:
                merged[-1] = merged[-1][0], end
        else:
            merged.append((start, end))
    return merged


def _bytes(value: pa.Scalar) -> bytes:
    text = value.as_py()
    return text.encode("utf-8", "surrogatepass") if text else b""


_NAMED = "gram long, phrase long, doc long, start long, count int, mark int, lead int, sides long"


def _name_phrases(length: int):
    """Phrases to be sorted, and spans known to be repeated (as rows without a count).

    A span has its end in ``phrase``, and in ``gram`` a number to deal it by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earliest: dict[bytes, int] = {}
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            marks = batch.column("mark").to_numpy()
            texts = batch.column("text")
            out: list[list] = [[] for _ in range(8)]
            for at in np.argsort(docs, kind="stable").tolist():
                data, doc, mark = _bytes(texts[at]), int(docs[at]), int(marks[at])
                own: set[bytes] = set()
                known = []
                for piece, hashes, first, count, anchor in _anchored(data, length):
                    lead, gram, both = anchor - first, hashes[anchor], sides(hashes, anchor, length)
                    first = first + piece
                    ends = (first + count + length - 1).tolist()
                    starts = first.tolist()
                    fresh, names = [], []
                    for i, (a, b) in enumerate(zip(starts, ends)):
                        name = xxhash.xxh3_128_digest(data[a:b])
                        before = earliest.get(name)
                        if name in own or (before is not None and before < doc):
                            known.append((a, b))
                            continue
                        own.add(name)
                        if before is None or doc < before:
                            earliest[name] = doc
                        fresh.append(i)
                        names.append(name[:8])
                    if fresh:
                        n = len(fresh)
                        columns = (
                            gram[fresh].view(np.int64),
                            np.frombuffer(b"".join(names), np.int64),
                            np.full(n, doc),
                            first[fresh],
                            count[fresh],
                            np.full(n, mark),
                            lead[fresh],
                            both[fresh].view(np.int64),
                        )
                        for column, values in zip(out, columns):
                            column.append(values)
                    if len(earliest) >= REMEMBERED:
                        earliest.clear()
                spans = np.array(runs(known), np.int64).reshape(-1, 2)
                if len(spans):
                    n = len(spans)
                    spread = (np.full(n, doc) * 1_000_003 + spans[:, 0]) * 7919
                    none = np.zeros(n, int)
                    columns = (spread, spans[:, 1], np.full(n, doc), spans[:, 0], none, np.full(n, mark))
                    columns += (none, none)
                    for column, values in zip(out, columns):
                        column.append(values)
            if out[0]:
                arrays = [np.concatenate(c) for c in out]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, k) for a, k in zip(arrays, kinds)],
                    ["gram", "phrase", "doc", "start", "count", "mark", "lead", "sides"],
                )

    return run


_CUT = "side long, doc long, mark int, start long, count int, anchor long, bytes binary"


def _cut(length: int):
    """The bytes of each wanted side of a document's phrases.

    Those of a very common side come as single windows under a hash of their
    own. Such a window met before in the task is a span, without bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text, doc, mark, wanted in zip(
                *[batch.column(n) for n in ("text", "doc", "mark", "wanted")]
            ):
                data, doc, mark = _bytes(text), doc.as_py(), mark.as_py()
                for part in wanted.as_py():
                    start, count, anchor = part["start"], part["count"], part["anchor"]
                    if not part["many"]:
                        piece = data[start : start + count + length - 1]
                        _row(out, part["side"], doc, mark, start, count, anchor, piece)
                        continue
                    for at in range(start, start + count):
                        window = data[at : at + length]
                        if met.get(window, (doc, at)) < (doc, at):
                            _row(out, part["side"], doc, mark, at, 1, anchor, None)
                            continue
                        met[window] = doc, at
                        name = xxhash.xxh3_64_intdigest(window) - 2**63
                        _row(out, name, doc, mark, at, 1, anchor, window)
                if len(met) >= REMEMBERED:
                    met.clear()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)],
                ["side", "doc", "mark", "start", "count", "anchor", "bytes"],
            )

    return run


def _compare(length: int):
    """Rows come by side, document and anchor: spans of windows met before in their side.

    Equal windows are as far ahead of their anchors, so the earlier one comes first
    even if texts share an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, met = None, {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            names = ("side", "doc", "mark", "start", "count", "bytes")
            for s, doc, mark, start, count, data in zip(
                *[batch.column(n).to_pylist() for n in names]
            ):
                if s != side:
                    side, met = s, {}
                if data is None:
                    _row(out, doc, mark, start, start + length)
                    continue
                # Repeated rows bring the same place again: not an earlier one.
                repeated = [
                    at
                    for at in range(start, start + count)
                    if met.setdefault(data[at - start : at - start + length], (doc, at)) != (doc, at)
                ]
                for first, end in runs([(at, at + 1) for at in repeated]):
                    _row(out, doc, mark, first, end - 1 + length)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["doc", "mark", "start", "end"]
            )

    return run


def _row(out: list[list], *values) -> None:
    for column, value in zip(out, values):
        column.append(value)


def _remove(with_text: bool):
    """Spans made runs, and what is left of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = _bytes(text)
                found = runs([(s["start"], s["end"]) for s in spans.as_py() or ()])
                kept, at = [], 0
                for start, end in found:
                    kept.append(data[at:start])
                    at = end
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((len(data), len(data) - len(left), len(found), hashlib.sha256(left).hexdigest(), left))
            n_bytes, n_removed, n_spans, marks, left = zip(*rows) if rows else ((),) * 5
            columns = [batch.column("doc_id")]
            columns += [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans"]
            if with_text:
                columns.append(pa.array(left, pa.binary()))
                names.append("kept")
            columns.append(pa.array(marks, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "kept_sha256"])

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    length: int = LENGTH,
    doc_id: str = "doc_id",
    text: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Every row of ``docs`` without the bytes that repeat ``length`` bytes of earlier text.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256, and with
    ``with_text`` the bytes themselves (``kept``; a cut may fall within a
    character). Earlier means a smaller id, or under the same id an earlier
    start; at one start under one id none is earlier, so repeated rows keep the
    same bytes. A null text has no bytes. Rows without an id count as rows
    under one id behind all others. An empty table gives an empty one.

    Texts are shuffled by document, to be compared and to be cut; the sample is
    shuffled once, by gram. Shuffle files go with each stored step. A group of
    copies is summed up in the tasks that read it. The windows of a side with
    very many phrases are dealt out singly, and summed up likewise.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.hash(F.col(text)).alias("mark"),
        F.col(text).alias("text"),
    )
    long_enough = rows.filter(F.octet_length("text") >= length)
    named = long_enough.select("doc", "mark", "text").mapInArrow(_name_phrases(length), _NAMED)
    same = Window.partitionBy("gram", "phrase")
    # Sorted by gram and name, and by gram and side, behind one exchange by gram.
    sorted_ = (
        named.repartition("gram")
        .withColumn("first", F.min(F.struct("doc", "start")).over(same))
        .withColumn("gone", (F.col("count") == 0) | (F.struct("doc", "start") > F.col("first")))
    )
    anchor = F.col("start") + F.col("lead")
    middle = anchor - (reach(length) - 1)
    past = F.col("start") + F.col("count")
    parts = []
    for side, bits, begin, stop in (
        ("left", F.shiftright("sides", 32), F.col("start"), F.least(middle, past)),
        ("right", F.col("sides").bitwiseAND(2**32 - 1), F.greatest(middle, F.col("start")), past),
    ):
        sorted_ = sorted_.withColumn(side, F.when(begin < stop, bits))
        alike = Window.partitionBy("gram", side)
        others = F.min("phrase").over(alike) < F.max("phrase").over(alike)
        many = F.count(F.when(~F.col("gone"), 1)).over(alike) > TOGETHER
        part = F.struct(
            F.xxhash64("gram", F.lit(side), side).alias("side"),
            begin.alias("start"),
            (stop - begin).cast("int").alias("count"),
            anchor.alias("anchor"),
            many.alias("many"),
        )
        sorted_ = sorted_.withColumns({f"{side}_part": part, f"{side}_others": others})
        wanted = ~F.col("gone") & F.col(side).isNotNull() & F.col(f"{side}_others")
        parts.append(F.when(wanted, F.col(f"{side}_part")))
    end = F.when(F.col("count") == 0, F.col("phrase")).otherwise(past + (length - 1))
    gone = F.col("gone")
    with session_settings(docs.sparkSession, SHORT_SHUFFLES):
        judged = materialize(
            sorted_.withColumn("parts", F.array_compact(F.array(*parts)))
            .filter(gone | (F.size("parts") > 0))
            .select(
                "doc",
                "mark",
                F.when(gone, F.col("start")).alias("start"),
                F.when(gone, end).alias("end"),
                F.when(~gone, F.col("parts")).alias("parts"),
            ),
            "phrases",
        )
    # The rest, document by document, meets the texts.
    texts = rows.repartition("doc", "mark")
    wanted = (
        judged.filter(F.col("end").isNull())
        .groupBy("doc", "mark")
        .agg(F.flatten(F.collect_list("parts")).alias("wanted"))
    )
    cut = (
        texts.join(wanted, ["doc", "mark"])
        .select("doc", "mark", "text", "wanted")
        .mapInArrow(_cut(length), _CUT)
    )
    compared = (
        cut.repartition("side")
        .sortWithinPartitions("side", "doc", "anchor")
        .mapInArrow(_compare(length), "doc long, mark int, start long, end long")
    )
    with session_settings(docs.sparkSession, SHORT_SHUFFLES):
        compared = materialize(compared, "compared")
    spans = (
        judged.filter(F.col("end").isNotNull())
        .select("doc", "mark", "start", "end")
        .unionByName(compared)
        .groupBy("doc", "mark")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    kept = "kept binary, " if with_text else ""
    return (
        texts.join(spans, ["doc", "mark"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            _remove(with_text),
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {kept}kept_sha256 string",
        )
    )

