"""Stages of the pipeline on hand-made rows that their settings decide."""

from conftest import DATA

import corpus_pipeline
from txscreen.llm import langid

TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def plain_overlap(a, b, width):
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)})
    return 100 * len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_take_five_words_and_80_percent(spark):
    """One word of fifty is another: 80.4 percent of five words, 84.3 percent of four."""
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(words), " ".join([*words[:25], "other", *words[26:]])]
    texts.append(" ".join([*words[:15], "one", *words[16:35], "two", *words[36:]]))
    assert plain_overlap(*texts[:2], 5) >= 80 and plain_overlap(*texts[:2], 4) < 85
    assert max(plain_overlap(texts[i], texts[2], 5) for i in (0, 1)) < 80
    rows = [(i, text, "en", "a", len(text)) for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, TYPES)
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, table, "").collect()) == [0, 2]


def test_language_stage_rejects_what_no_profile_knows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    # Their label is null, so they are in no profile.
    foreign = [
        (900_001, "Съешь же ещё этих мягких французских булок, да выпей чаю", None, "a", 56),
        (900_002, "いろはにほへと ちりぬるを わかよたれそ つねならむ", None, "a", 25),
        (900_003, "Съешь же ещё этих мягких булок и a", None, "a", 34),
        (900_004, "12 34 !!", None, "a", 8),
    ]
    table = docs.unionByName(spark.createDataFrame(foreign, TYPES).select(*docs.columns))
    stage = dict(corpus_pipeline.STAGES)["language"]
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert sorted(r["doc_id"] for r in stage(spark, table, "").collect()) == ids
    # Without a bound of the caller's own, a score of 0 is no language either.
    kept = {r["doc_id"] for r in langid.keep_identified(table).collect()}
    assert kept == {*ids, 900_003}
