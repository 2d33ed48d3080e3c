"""Benchmark decontamination: a broadcast hash set of test n-grams against token windows.

The n-grams of the benchmark's items are counted in bytes and broadcast in
pieces of a bounded size, most often a single one. A task hashes the windows of
a document's words, looks the hashes up in a bit table, and verifies what it
finds by comparing the words themselves. The words within verified windows are
hit: they can be reported, cut out of the text, or cost the document its place.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txscreen.llm.common import ascii_lower, numbered
from txscreen.sources import materialize

#: Words of a window; an item with fewer words is one window.
WIDTH = 10

#: Bytes of n-grams that are broadcast at once, each with what it costs in a dictionary.
PIECE_BYTES, ENTRY_BYTES = 64 << 20, 200

#: A word, after A to Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # the same of UTF-8 bytes
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: What a scan adds to its rows.
FINDINGS = (
    T.StructType()
    .add("_words", "long")
    .add("_spans", T.ArrayType(T.StructType().add("first", "integer").add("end", "integer")))
    .add("_items", T.ArrayType(T.StringType()))
)

#: Rows of an Arrow batch that are worked on together.
TOGETHER = 1000


def item_ngrams(
    items: DataFrame, width: int = WIDTH, *, item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """gram (words joined by a blank) and item (the id as a string), each pair once.

    A null id becomes an empty string; rows of one id are one item. A null text
    and one without words give nothing.
    """
    words = F.regexp_extract_all(ascii_lower(F.col(item_text)), F.lit(WORD), F.lit(0))
    item = F.coalesce(F.col(item_id).cast("string"), F.lit(""))
    plain = items.select(item.alias("item"), words.alias("w"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("w") - width + 1),
        lambda i: F.array_join(F.slice("w", i, F.lit(width)), " "),
    )
    grams = F.when(F.size("w") > width, windows).otherwise(F.array(F.array_join("w", " ")))
    return plain.filter(F.size("w") > 0).select("item", F.explode(grams).alias("gram")).distinct()


@dataclass(frozen=True)
class Grams:
    """One piece of n-grams as it is broadcast: a text and the place of its item for each."""

    grams: list[bytes]
    owners: list[int]
    items: list[str]


class _HashSet:
    """What a task makes of a piece: exact n-grams, and a bit table of their hashes per width."""

    def __init__(self, piece: Grams):
        self.items = piece.items
        self.owners: dict[bytes, list[int]] = {}
        for gram, owner in zip(piece.grams, piece.owners):
            self.owners.setdefault(gram, []).append(owner)
        self.ids: dict[bytes, int] = {}
        by_width: dict[int, list[list[int]]] = {}
        for gram in self.owners:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in gram.split(b" ")]
            by_width.setdefault(len(ids), []).append(ids)
        self.tables = []
        for width, grams in sorted(by_width.items()):
            bits = max(16, (16 * len(grams)).bit_length())
            seen = np.zeros(1 << bits, bool)
            hashes = _rolled(np.array(grams, np.uint64).ravel(), width)[::width]
            seen[hashes >> np.uint64(64 - bits)] = True
            self.tables.append((width, np.uint64(64 - bits), seen))

    def windows(self, words: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """First word, width and items of every window of ``words`` that is an n-gram of the piece."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.uint64, len(words))
        for width, shift, seen in self.tables:
            if len(ids) < width:
                continue
            known = np.cumsum(np.concatenate([[0], ids == 0]))
            starts = np.flatnonzero(known[width:] == known[:-width])
            if not len(starts):
                continue
            hashes = _rolled(ids, width)[starts]
            for i in starts[seen[hashes >> shift]].tolist():
                owners = self.owners.get(b" ".join(words[i : i + width]))
                if owners:
                    yield i, width, owners


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive ids, modulo 2 to the 64."""
    hashes = np.zeros(len(ids) - width + 1, np.uint64)
    for i in range(width):
        hashes = (hashes + ids[i : i + len(hashes)]) * _MULTIPLIER
        hashes ^= hashes >> np.uint64(29)
    return hashes * _MULTIPLIER


def _stretches(places: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The maximal runs (first, end) of words that are in any of ``places``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, [p[0] for p in places], 1)
    np.add.at(edges, [p[1] for p in places], -1)
    inside = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` without what lies from the first to the last word of each span."""
    words = [m.span() for m in _WORD.finditer(data.lower())]
    kept, at = [], 0
    for first, end in spans:
        kept.append(data[at : words[first][0]])
        at = words[end - 1][1]
    return b"".join([*kept, data[at:]])


def _scanner(piece, again: bool, give: str):
    """Scan of Arrow batches whose first column is the text.

    With ``again`` the last three columns are the findings of the pieces
    before, to be added to. The text comes back as it is (``give`` is "text"),
    "cut", without its spans, or as null ("none").
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _HashSet(piece.value)
        small = (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER))
        for batch in small:
            others = batch.columns[1 : -3 if again else None]
            counts, spans, items, texts = [], [], [], []
            texts_in = batch.column(0).cast(pa.binary())
            for row, value in enumerate(texts_in):
                data = value.as_py()
                words = _WORD.findall(data.lower()) if data else []
                places, found = [], set()
                if again:
                    places = [(s["first"], s["end"]) for s in batch.column(-2)[row].as_py()]
                    found.update(batch.column(-1)[row].as_py())
                for first, width, owners in grams.windows(words):
                    places.append((first, first + width))
                    found.update(grams.items[o] for o in owners)
                hit = _stretches(places, len(words)) if places else []
                counts.append(len(words))
                spans.append([{"first": a, "end": b} for a, b in hit])
                items.append(sorted(found))
                if give != "none":
                    texts.append(_without(data, hit) if give == "cut" and hit else data)
            span = pa.struct([("first", pa.int32()), ("end", pa.int32())])
            columns = [
                pa.array(texts, pa.binary()).cast(pa.string())
                if give != "none"
                else pa.nulls(batch.num_rows, pa.string()),
                *others,
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(span)),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return scan


def _pieces(grams: DataFrame, piece_bytes: int) -> Iterator[Grams]:
    """The n-grams in as many pieces as keep each within ``piece_bytes``, one at a time.

    N-grams with their items are dealt by a hash, so that one that many items
    share is split as well. The driver holds a piece and the one after it.
    """
    size = F.octet_length("gram") + F.octet_length("item") + ENTRY_BYTES
    total = grams.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    # Hashes deal unevenly: up to a bound of half a piece on the average.
    number = 1 if total <= piece_bytes else -(-2 * total // piece_bytes)
    for p in range(number):
        own = F.pmod(F.xxhash64("gram", "item"), F.lit(number)) == p
        table = (grams.filter(own) if number > 1 else grams).toArrow()
        items = table["item"].unique().to_pylist()
        place = {item: i for i, item in enumerate(items)}
        owners = [place[item] for item in table["item"].to_pylist()]
        yield Grams(table["gram"].cast(pa.binary()).to_pylist(), owners, items)


def _scan(
    docs: DataFrame, text: str, give: str, benchmark: DataFrame, *, width: int, piece_bytes: int, **names
) -> DataFrame:
    """Columns of ``docs``, the text first, with the findings behind them."""
    context = docs.sparkSession.sparkContext
    grams = materialize(item_ngrams(benchmark, width, **names), "ngrams")
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(text).cast("string").alias(text), *others)
    schema = T.StructType([*rows.schema, *FINDINGS])
    pieces = _pieces(grams, piece_bytes)
    piece, again = next(pieces), False
    while piece is not None:
        after = next(pieces, None)
        scan = _scanner(context.broadcast(piece), again, give if after is None else "text")
        rows = rows.mapInArrow(scan, schema)
        if after is not None:
            # One piece is in a worker's memory at a time.
            rows = materialize(rows, "scanned")
        piece, again = after, True
    return rows


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = WIDTH,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """doc_id, n_words, spans and items of every row of ``docs``.

    ``spans`` are the maximal runs of hit words as (first, end) word numbers
    from 0, the end excluded; ``items`` the ids, as sorted strings, of the
    items with a window in the text. Windows are whole: ``width`` consecutive
    words of an item, or all words of a shorter one. Whole texts are read. A
    null text has no words; an empty benchmark hits nothing; repeated rows are
    documents each; an empty table gives an empty one. Any type will do for
    the ids. Other columns are left out.
    """
    own = docs.select(F.col(text).alias("c0"), F.col(doc_id).alias("c1"))
    settings = {"width": width, "piece_bytes": piece_bytes, "item_id": item_id, "item_text": item_text}
    found = _scan(own, "c0", "none", benchmark, **settings).drop("c0")
    return found.toDF("doc_id", "n_words", "spans", "items")


def hit_words(spans: str = "spans") -> Column:
    """Number of words within the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    drop_percent: float | None = None,
    width: int = WIDTH,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """``docs`` with the hit spans cut out of their texts.

    A span goes from the first to the last of its words, with what is between
    them; all other characters stay as they are. With ``drop_percent`` the
    documents go of whose words at least that share is hit: 0 leaves out every
    document with a hit. Rows, other columns, null texts and texts without a
    hit pass through untouched. Rules of ``find_contamination`` apply.
    """
    plain, names = numbered(docs)
    settings = {"width": width, "piece_bytes": piece_bytes, "item_id": item_id, "item_text": item_text}
    found = _scan(plain, names[text], "cut", benchmark, **settings)
    if drop_percent is not None:
        hit = hit_words("_spans")
        found = found.filter((hit == 0) | (100 * hit < drop_percent * F.col("_words")))
    return found.select(*plain.columns).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``find_contamination``."""
    n_hit = hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = rf"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
item_words AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, width, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), {WIDTH}) AS width,
      unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i
    FROM item_words WHERE len(w) > 0)),
windows AS (
  SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
    FROM doc_words, (SELECT DISTINCT width FROM grams) WHERE len(w) >= width)),
found AS (SELECT doc_id, i, width, item FROM windows JOIN grams USING (width, gram)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
