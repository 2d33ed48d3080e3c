"""Quality rules: boilerplate lines by host, next to measures of the single text.

Normalised lines are hashed and counted once per document and host. A line in
too many documents of its host is removed; a document that these lines leave
with too few characters is rejected, as is one that fails the measures.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txscreen.llm.common import numbered
from txscreen.llm.linedup import text_lines, without_places
from txscreen.sources import materialize

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: A line goes when it is in at least so many documents of a host, and in this
#: share of them. A document goes when fewer of its characters than this stay.
LINE_DOCS, LINE_PERCENT, LEAST_LEFT_PERCENT = 20, 1, 30

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines and words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    starts_character = (raw & 0xC0) != 0x80
    characters = int(np.count_nonzero(starts_character & ~_IS_SPACE[raw]))
    symbols = int(np.count_nonzero(_IS_SYMBOL[raw]))
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated_lines = len(lines) - len(set(lines))
    return len(words), characters, symbols, repeated_lines, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of five words found at least twice."""
    count = len(words) - WINDOW + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Names of pairs, then of pairs of pairs, then of five words: exact, no hash.
    radix = len(numbers) + 1
    names = _name(ids[:-1] * radix + ids[1:])
    names = _name(names[:-2] * (len(words) + 1) + names[2:])
    names = names[: count] * radix + ids[WINDOW - 1 :]
    _, inverse, found = np.unique(names, return_inverse=True, return_counts=True)
    twice = found[inverse] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered)[:-1]))


def _name(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        rows = [measures(t.as_py()) for t in batch.column("text")]
        columns = list(zip(*rows)) or [()] * 5
        arrays = [batch.column(n) for n in ("doc_id", "host", "mark")]
        arrays += [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "host", "mark", *names])


def _host(source: str) -> Column:
    """The host with nulls told from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def boilerplate_lines(
    docs: DataFrame,
    *,
    line_docs: int = LINE_DOCS,
    line_percent: float = LINE_PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Per document that has lines: the places of those above the limits, and characters.

    Returns doc_id, mark (hash of the text), host, line_chars (in all lines)
    and removed, an array of (place, chars). Lines are normalised (white space
    collapsed, none at the ends, lower case, digits as one sign; a line of
    white space is none), hashed to 96 bits, and counted
    over all documents of the host. Both limits must be reached: with the
    defaults the share decides in hosts of more than 2,000 documents and grows
    with them, so a hot host of 1,000,000 keeps a line of 9,999. Counts and
    lines meet in joins by host and line; a line with a third of all rows is
    summed up map-side. A list of places is no longer than its document.
    """
    collapsed = F.regexp_replace(F.col("line"), r"[\x20\x09-\x0D]+", " ")
    normal = F.regexp_replace(F.lower(F.trim(collapsed)), r"[0-9]+", "0")
    key = ["doc_id", "mark", "host"]
    lines = (
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.xxhash64(F.col(text)).alias("mark"),
            _host(host).alias("host"),
            F.posexplode(text_lines(text)).alias("place", "line"),
        )
        .withColumn("normal", normal)
        .filter(F.col("normal") != "")
        .select(
            *key,
            "place",
            F.xxhash64("normal").alias("h1"),
            F.hash("normal").alias("h2"),
            F.char_length("normal").cast("long").alias("chars"),
        )
    )
    # Repeated rows have the same lines at the same places.
    placed = materialize(
        lines.groupBy(*key, "place", "h1", "h2").agg(F.sum("chars").alias("chars")),
        "quality-lines",
    )
    hosts = docs.groupBy(_host(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"))
    counts = placed.select(*key, "h1", "h2").distinct()
    counts = counts.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("line_docs"))
    often = (
        counts.filter(F.col("line_docs") >= line_docs)
        .join(hosts, "host")
        .filter(F.col("line_docs") * 100 >= F.col("host_docs") * line_percent)
        .select("host", "h1", "h2", F.lit(1).alias("often"))
    )
    gone = F.when(F.col("often") == 1, F.struct("place", "chars"))
    return (
        placed.join(often, ["host", "h1", "h2"], "left")
        .groupBy(*key)
        .agg(
            F.sum("chars").alias("line_chars"),
            F.sort_array(F.collect_list(gone)).alias("removed"),
        )
    )


def clean(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    **limits,
) -> DataFrame:
    """Every row of ``docs`` with ``kept_text``, ``n_removed`` and ``kept`` added.

    ``kept_text`` is the text without its boilerplate lines, ``n_removed`` their
    number and ``kept`` the verdict of ``judge``, with its limits. A null text
    has an empty ``kept_text``. Other columns pass through untouched (a column
    by one of the three added names is replaced). The texts are shuffled once,
    with the places of removed lines.
    """
    docs = docs.drop("kept_text", "n_removed", "kept")
    judged = _judged(docs, doc_id=doc_id, text=text, host=host, **limits)
    judged = judged.select("doc_id", "mark", "host", "removed", "kept")
    judged = judged.dropDuplicates(["doc_id", "mark", "host"])
    plain, names = numbered(docs)
    own, own_text = F.col(names[doc_id]), F.col(names[text])
    same = (
        own.eqNullSafe(F.col("doc_id"))
        & (F.xxhash64(own_text) == F.col("mark"))
        & (_host(names[host]) == F.col("host"))
    )
    gone = F.col("removed")
    kept_text = F.when(F.size(gone) == 0, F.coalesce(own_text, F.lit(""))).otherwise(
        F.array_join(without_places(text_lines(names[text]), gone), "\n")
    )
    found = plain.join(judged, same)
    added = (kept_text, F.size(gone).cast("long"), F.col("kept"))
    return found.select(*plain.columns, *added).toDF(*docs.columns, "kept_text", "n_removed", "kept")


def judge(
    docs: DataFrame,
    *,
    line_docs: int = LINE_DOCS,
    line_percent: float = LINE_PERCENT,
    least_left_percent: float = LEAST_LEFT_PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Measures and verdict of every row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, line_chars, boiler_chars (characters of the removed lines),
    base_failed and kept. ``clean`` returns the texts without these lines. A
    null or empty text has no words and fails; a null host is a host of its
    own; each row is judged, and repeated rows alike. The measures are taken
    from whole texts in Arrow batches; only ids, hosts, and hashes and places
    of lines are shuffled.
    """
    return _judged(
        docs,
        line_docs=line_docs,
        line_percent=line_percent,
        least_left_percent=least_left_percent,
        doc_id=doc_id,
        text=text,
        host=host,
    ).drop("mark", "host", "removed")


def _judged(
    docs: DataFrame,
    *,
    line_docs: int = LINE_DOCS,
    line_percent: float = LINE_PERCENT,
    least_left_percent: float = LEAST_LEFT_PERCENT,
    doc_id: str,
    text: str,
    host: str,
) -> DataFrame:
    """The columns of ``judge``, behind them mark, host and removed (places of lines)."""
    few = docs.select(
        F.col(doc_id).alias("doc_id"),
        _host(host).alias("host"),
        F.xxhash64(F.col(text)).alias("mark"),
        F.col(text).alias("text"),
    )
    types = (
        f"doc_id {few.schema['doc_id'].dataType.simpleString()}, host string, mark long, "
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    )
    base = few.mapInArrow(_measure, types)
    lines = boilerplate_lines(
        docs, line_docs=line_docs, line_percent=line_percent, doc_id=doc_id, text=text, host=host
    ).select(
        F.col("doc_id").alias("_doc"),
        F.col("mark").alias("_mark"),
        F.col("host").alias("_host"),
        "line_chars",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["chars"]).alias("boiler_chars"),
        F.col("removed.place").alias("removed"),
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_doc"))
        & (F.col("mark") == F.col("_mark"))
        & (F.col("host") == F.col("_host"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    left = F.col("line_chars") - F.col("boiler_chars")
    depleted = 100 * left < least_left_percent * F.col("line_chars")
    return base.join(lines, same, "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.coalesce("line_chars", F.lit(0)).alias("line_chars"),
        F.coalesce("boiler_chars", F.lit(0)).alias("boiler_chars"),
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(depleted, F.lit(False))).alias("kept"),
        "mark",
        "host",
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )
