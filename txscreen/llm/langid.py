"""Language identification by rank-order profiles.

A language's profile ranks the n-grams most frequent in its training texts. A
text is ranked the same way, and goes to the language whose profile has its
n-grams least out of place.
"""

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txscreen.llm.common import numbered
from txscreen.sources import materialize

UNKNOWN = "und"

#: N-grams kept of a text and of a language, and their lengths.
PROFILE, ORDERS = 300, (1, 2, 3)

#: Of five parts by checksum of the id, this one is held out.
FOLDS, HELD_OUT = 5, 0

#: N-grams of training texts that a task counts together.
TOGETHER = 2_000_000

#: A model of at most this many languages is sent to the tasks.
MAX_LANGUAGES = 1000

_BITS = 21  # a code point takes as many, so three fit into 63 bits


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.int64)
    for code in range(0x110000):
        character = chr(code)
        if character.isalpha():
            low = character.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _codes(text: str) -> np.ndarray:
    """Letters of ``text``; every run of other characters becomes one 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[points]
    codes = np.concatenate([[0], codes, [0]])
    keep = (codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)
    return codes[keep]


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """All n-grams within words, the blank at either end included."""
    found = [codes[codes != 0]]
    if 2 in ORDERS:
        pairs = (codes[:-1] << _BITS) | codes[1:]
        found.append(pairs)
    if 3 in ORDERS:
        inside = codes[1:-1] != 0
        triples = (codes[:-2] << (2 * _BITS)) | (codes[1:-1] << _BITS) | codes[2:]
        found.append(triples[inside])
    return found


def _counted(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of ``texts`` with their counts, holding about ``TOGETHER`` of them at a time."""
    parts, waiting, size = [], [], 0
    for text in texts:
        grams = _grams(_codes(text))
        waiting += grams
        size += sum(map(len, grams))
        if size >= TOGETHER:
            parts.append(pd.Series(np.concatenate(waiting)).value_counts(sort=False))
            waiting, size = [], 0
    if waiting:
        parts.append(pd.Series(np.concatenate(waiting)).value_counts(sort=False))
    counts = pd.concat(parts).groupby(level=0).sum()
    return counts.index.to_numpy(), counts.to_numpy()


def text_profile(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of the whole text, best first; ties by code points."""
    grams, counts = np.unique(np.concatenate(_grams(_codes(text))), return_counts=True)
    # The sort is stable and the n-grams are in order, so ties stay in order.
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        enough = counts >= least
        grams, counts = grams[enough], counts[enough]
    return grams[np.argsort(-counts, kind="stable")][:size]


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams counted per language, summed up over a batch before they leave."""
    for batch in batches:
        frame = batch.to_pandas()
        for lang, rows in frame.groupby("lang"):
            texts = rows["text"].tolist()
            grams, counts = _counted(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(grams), pa.string()),
                    "gram": pa.array(grams, pa.int64()),
                    "n": pa.array(counts, pa.int64()),
                }
            )


def train_profiles(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", size: int = PROFILE
) -> DataFrame:
    """lang, gram and place (from 0) of the ``size`` most frequent n-grams per language.

    All rows of ``docs`` with a text and a language count, whole texts each.
    Ties go by code point. Rows of one language are counted in every task that
    has some, so no task needs all rows of a frequent language.
    """
    used = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    used = used.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    partial = used.mapInArrow(_count_batches, "lang string, gram long, n long")
    counts = partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("place", F.row_number().over(best) - 1)
        .filter(F.col("place") < size)
        .select("lang", "gram", "place")
    )


def _model(profiles: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Profiles as arrays on the driver: PROFILE numbers per language."""
    rows = (
        profiles.groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("grams"))
        .select("lang", "grams.gram")
        .limit(MAX_LANGUAGES + 1)
        .collect()
    )
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [(r["lang"], np.array(r["gram"], np.int64)) for r in sorted(rows, key=lambda r: r["lang"])]


def out_of_place(profile: np.ndarray, model: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Distance of a text's profile to every language; absent n-grams cost the most."""
    places = np.arange(len(profile))
    distances = np.empty(len(model), np.int64)
    for i, (_, grams) in enumerate(model):
        order = np.argsort(grams)
        at = np.searchsorted(grams[order], profile)
        at[at == len(grams)] = 0
        place = order[at] if len(grams) else np.zeros(len(profile), np.int64)
        found = grams[place] == profile if len(grams) else np.zeros(len(profile), bool)
        distances[i] = np.where(found, np.abs(place - places), PROFILE).sum()
    return distances


#: Rows of an Arrow batch that are read together.
ROWS_TOGETHER = 1000


def _predictor(model: list[tuple[str, np.ndarray]], at: int, keep_text: bool):
    """Judges the text in column ``at``, which comes back only with ``keep_text``."""

    def predict(text: str | None) -> tuple[str, float]:
        if not text or not model:
            return UNKNOWN, 0.0
        codes = _codes(text)
        if not codes.any():
            return UNKNOWN, 0.0
        profile = text_profile(text)
        distances = out_of_place(profile, model)
        best = int(distances.argmin())  # the first of equals: by name
        return model[best][0], 1.0 - float(distances[best]) / (PROFILE * len(profile))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = (b.slice(i, ROWS_TOGETHER) for b in rows for i in range(0, b.num_rows, ROWS_TOGETHER))
        for batch in few:
            found = [predict(t.as_py()) for t in batch.column(at)]
            kept = [i for i in range(batch.num_columns) if keep_text or i != at]
            columns = [batch.column(i) for i in kept]
            columns.append(pa.array([f[0] for f in found], pa.string()))
            columns.append(pa.array([f[1] for f in found], pa.float64()))
            names = [*[batch.schema.names[i] for i in kept], "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return batches


def predict(
    docs: DataFrame, profiles: DataFrame, *, text: str = "text", keep_text: bool = False
) -> DataFrame:
    """Add lang_pred and score (0 to 1, higher is nearer) to every row.

    Other columns pass through, whatever their names, the text only with
    ``keep_text``; one named lang_pred or score is replaced.

    A null text and one without a letter get ``und`` and 0. Equal distances go
    to the first name. Each row is judged by its text alone.
    """
    rows = docs.select(*[c for c in docs.columns if c == text or c not in ("lang_pred", "score")])
    plain, names = numbered(rows)
    at = rows.columns.index(text)
    left = [c for c in rows.columns if keep_text or c != text]
    schema = T.StructType([plain.schema[names[c]] for c in left])
    schema = schema.add("lang_pred", "string").add("score", "double")
    judged = plain.mapInArrow(_predictor(_model(profiles), at, keep_text), schema)
    return judged.toDF(*left, "lang_pred", "score")


def identify(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    Profiles are trained on the rows that aren't held out and have a language;
    prediction sees the text alone. A null id is in the fold of no one: it is
    neither held out nor trained on. An empty table gives an empty one.
    """
    known = docs.filter(fold(doc_id) != HELD_OUT)
    profiles = materialize(train_profiles(known, text=text, lang=lang), "profiles")
    held = F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")
    )
    return predict(rows, profiles)


def keep_identified(docs: DataFrame, *, min_score: float = 0.0) -> DataFrame:
    """Rows whose text has a language; profiles are trained as in ``identify``.

    Rows without a letter go, and so do those no nearer than ``min_score``; a
    text that shares no n-gram with any profile scores 0 and always goes.
    """
    known = docs.filter(fold() != HELD_OUT)
    profiles = materialize(train_profiles(known), "profiles")
    plain, names = numbered(docs)
    judged = predict(plain, profiles, text=names["text"], keep_text=True)
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("score") > min_score)
    return judged.filter(kept).select(*plain.columns).toDF(*docs.columns)
