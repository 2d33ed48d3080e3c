"""What the near-duplicate join and the removal of repeats leave on the disks."""

import os
import time

import numpy as np
import pytest

from txscreen.llm import jaccard, substrings
from txscreen.sources import job_folder


@pytest.fixture(scope="module")
def chain(spark):
    """Neighbours link, the ends don't: pivots settle some pairs and leave others."""
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(25)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def shuffle_files(spark):
    environment = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = environment.blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if os.path.basename(f).startswith("shuffle_")}


def test_join_leaves_no_shuffle_files(spark, chain):
    before = shuffle_files(spark)
    found = jaccard.join_documents(chain)
    # They are let go in the background.
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert {tuple(r) for r in found.collect()} == {(i, 117, 0) for i in range(25)}


def test_join_drops_the_sets_it_has_compared(spark, chain):
    with job_folder(spark) as folder:
        jaccard.join_documents(chain)
        names = {n for path, folders, _ in os.walk(folder) for n in folders}
        assert any(n.startswith("held_") for n in names)
        assert not any(n.startswith("shingles_") for n in names)


def test_settings_are_as_before(spark, chain):
    names = [*jaccard.SHORT_SHUFFLES, *jaccard.SET_ROWS]
    before = [spark.conf.get(n, None) for n in names]
    jaccard.join_documents(chain)
    assert [spark.conf.get(n, None) for n in names] == before


def around(common, docs=60, noise=90):
    """Texts of lower-case letters that have nothing but ``common`` in common."""
    rng = np.random.default_rng(3)
    parts = [["".join(rng.choice(list("abcdefghijklmnop"), noise)) for _ in range(2)] for _ in range(docs)]
    return [(i, a + common + b) for i, (a, b) in enumerate(parts)]


def least_gram():
    """The string of a gram's length with the least hash of many: an anchor wherever it stands."""
    rng = np.random.default_rng(4)
    found = ["".join(rng.choice(list("qrstuvwxyz"), substrings.GRAM)) for _ in range(20_000)]
    return min(found, key=lambda x: substrings.grams(x.encode())[0])


def stored_rows(spark, folder, name):
    return sum(
        spark.read.parquet(os.path.join(path, n)).count()
        for path, folders, _ in os.walk(folder)
        for n in folders
        if n.startswith(f"{name}_")
    )


def test_removal_leaves_no_shuffle_files(spark):
    table = spark.createDataFrame(around("", docs=20) * 2, "doc_id long, text string").repartition(4)
    before = shuffle_files(spark)
    found = substrings.remove_repeats(table)
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert found.count() == 40


@pytest.mark.parametrize("common, fetched", [(0, 0), (60, 60)])
def test_phrases_of_one_gram_alone_are_not_fetched(spark, common, fetched):
    """Texts share a gram, and ``common`` bytes behind it; a string that counts they don't."""
    table = spark.createDataFrame(around(least_gram() + "y" * common), "doc_id long, text string")
    with job_folder(spark) as folder:
        found = substrings.remove_repeats(table.repartition(4)).collect()
        assert stored_rows(spark, folder, "phrases") == fetched
    assert all(r["n_removed"] == 0 for r in found)
