"""Text operators on awkward rows, and against plain versions in Python.

Nulls in every column, empty, blank and very long texts, ties, repeated rows,
empty tables, and columns named like the operators' own.
"""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from txscreen.llm import (
    ann,
    bpe,
    components,
    jaccard,
    langid,
    linedup,
    mixing,
    quality,
    reputation,
    sharding,
    substrings,
)
from txscreen.llm.queries import word_bpe_path
from txscreen.sources import session_settings

TYPES = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must not get in the way.
CLASHES = ["key", "token", "slice", "row", "mark", "gone", "rank", "score", "copies", "kept", "size"]

PASSAGE = "the quick brown fox jumps over the lazy dog and runs far away from all of them " * 2
LONG = " ".join(f"w{i % 9973}q{i * i % 7919}" for i in range(30_000))


def awkward_rows():
    line = "shared line, seen everywhere"
    rows = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (3, " \n\t \x0b", "en", "b", 4),
        (4, "One two", "en", "a", 7),
        (5, "one TWO", "en", "b", 7),
        (6, PASSAGE + "alpha beta", "en", "a", None),
        (7, "gamma delta " + PASSAGE, "de", None, 3),
        (7, "gamma delta " + PASSAGE, "de", None, 3),
        (None, PASSAGE + "alpha beta", "en", "a", 5),
        (8, LONG, "en", "a", 9),
        (9, LONG + " tail of it", None, "b", 9),
        (10, "z" * 5000, "xx", "b", 9),
        (11, "Grüße aus Köln, ça va? Ñandú É é", "de", "c", 9),
        (12, "12 34 56 !! ??", "en", "c", 9),
        (13, "7 " * 400, "en", "c", 9),
    ]
    rows += [
        (20 + i, f"{line}\nown line {i} of {i * 7}\n  {line.upper()}\t\n", "en", "abc"[i % 3], 1)
        for i in range(12)
    ]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame(awkward_rows(), TYPES).repartition(3)
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], TYPES)


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    return rows, [tuple(r) for r in rows.collect()]


def plain_sets(rows, width=4):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        wide = min(width, len(words))
        sets.append(frozenset(tuple(words[i : i + wide]) for i in range(len(words) - wide + 1)) if words else frozenset())
    return sets


def plain_components(rows, percent=85, width=4):
    sets = plain_sets(rows, width)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    members = collections.defaultdict(list)
    for row, g in zip(rows, group):
        members[g].append(row[0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in members.items()}
    return [(row[0], len(s), least[g]) for row, s, g in zip(rows, sets, group)]


def as_multiset(rows):
    return collections.Counter(map(repr, map(tuple, rows)))


def test_join_equals_all_pairs(awkward, small):
    for table, rows in ((awkward, awkward_rows()), small):
        found = jaccard.join_documents(table).collect()
        assert as_multiset(found) == as_multiset(plain_components(rows))


def test_join_searches_what_the_pivots_leave(spark, monkeypatch):
    """A chain: neighbours link, the ends don't, and every list has far members."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "PROBED_TOKENS", 500)
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(60)]
    rng = np.random.default_rng(1)
    base = [f"u{i}" for i in range(100)]
    for i in range(80):
        mine = list(base)
        for at in rng.integers(0, 100, int(rng.integers(0, 5))):
            mine[at] = f"n{i}_{at}"
        rows.append((100 + i, " ".join(mine)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.join_documents(table).collect()
    assert as_multiset(found) == as_multiset(plain_components(rows))


def test_join_of_nothing(nothing):
    assert jaccard.join_documents(nothing).collect() == []
    assert jaccard.keep_first(nothing).collect() == []


def test_first_of_each_group_stays(awkward):
    kept = jaccard.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None)[:10] == [1, 2, 3, 4, 6, 7, 8, 10, 11, 12]
    assert ids.count(None) == 1 and 5 not in ids and 9 not in ids
    assert {r["key"] for r in kept.collect()} == {"own key"}


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(200)] + [(-5, -3), (-3, -9)]
    found = components.connected(spark.createDataFrame(path, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {
        **{i: 0 for i in range(201)},
        **{i: -9 for i in (-3, -5, -9)},
    }


def test_bpe_of_every_row(awkward, nothing):
    library = Tokenizer.from_file(word_bpe_path())
    definition = bpe.load_definition(word_bpe_path())
    found = bpe.encode_documents(awkward, definition, with_ids=True).collect()
    wanted = []
    for i, text, *_ in awkward_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        marks = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), back)]
        wanted.append((i, len(ids), ids, back, *marks))
    assert as_multiset(found) == as_multiset(wanted)
    assert bpe.encode_documents(nothing, definition).collect() == []


def plain_removal(rows, length=100):
    """Over places (id, start), with null ids behind all others."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, text, *_ in order:
        data, place = (text or "").encode(), 2**63 - 1 if i is None else i
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            first[window] = min(first.get(window, (place, s)), (place, s))
    out = []
    for i, text, *_ in rows:
        data, place = (text or "").encode(), 2**63 - 1 if i is None else i
        covered = np.zeros(len(data) + 1, int)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < (place, s):
                covered[s] += 1
                covered[s + length] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        starts = np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])) if len(data) else 0
        out.append((i, len(data), int(gone.sum()), int(starts), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("together", [4000, 1])
def test_removal_equals_all_windows(awkward, small, monkeypatch, together):
    monkeypatch.setattr(substrings, "TOGETHER", together)
    for table, rows in ((awkward, awkward_rows()), small):
        found = substrings.remove_repeats(table).collect()
        assert as_multiset(found) == as_multiset(plain_removal(rows))


def test_removal_in_pieces_of_long_texts(spark, monkeypatch):
    """Windows that a piece's border parts; tasks that forget."""
    monkeypatch.setattr(substrings, "PIECE", 128)
    monkeypatch.setattr(substrings, "REMEMBERED", 10)
    rng = np.random.default_rng(2)
    blocks = ["".join(rng.choice(list("abcd "), 150)) for _ in range(8)]
    rows = [(i, "".join(blocks[k] for k in rng.integers(0, 8, 5)) + str(i)) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = substrings.remove_repeats(table, with_text=True)
    assert as_multiset(found.drop("kept").collect()) == as_multiset(plain_removal(rows))
    assert all(
        hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found.collect()
    )


@pytest.mark.parametrize("length", [32, 47, 100])
def test_removal_of_strings_about_as_long_as_counts(spark, length):
    """Shared strings a little shorter or longer than counts, some in texts under one id."""
    rng = np.random.default_rng(length)
    letters = list("abcdefgh")
    blocks = ["".join(rng.choice(letters, length + d)) for d in (-3, -1, 0, 1, 2, 30)]
    rows = []
    for i in range(60):
        parts = [blocks[k] for k in rng.integers(0, len(blocks), 3)]
        noise = ["".join(rng.choice(letters, rng.integers(1, length))) for _ in range(4)]
        rows.append((i // 2 if i % 7 else None, "".join(x for pair in zip(noise, parts) for x in pair) + noise[3]))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substrings.remove_repeats(table, length=length).collect()
    assert as_multiset(found) == as_multiset(plain_removal(rows, length))


def test_removal_of_nothing(nothing):
    assert substrings.remove_repeats(nothing).collect() == []


def plain_lines(rows, min_docs=10):
    def keys(text):
        return [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(LOWER) for x in (text or "").split("\n")]

    LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = collections.Counter(k for k_ in ({*keys(t)} for _, t, *_ in rows) for k in k_)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x, k in zip(lines, keys(text)) if not k or counts[k] < min_docs]
        left = hashlib.sha256("\n".join(stay).encode()).hexdigest()
        out.append((i, len(lines), len(lines) - len(stay), left))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_equal_a_plain_count(awkward, small, batches):
    for table, rows in ((awkward, awkward_rows()), small):
        found = linedup.drop_frequent_lines(table, batches=batches)
        assert found.columns[: len(table.columns)] == table.columns
        assert as_multiset(linedup.digest(found).collect()) == as_multiset(plain_lines(rows))


def test_lines_of_nothing(nothing):
    assert linedup.drop_frequent_lines(nothing).collect() == []


def test_frequent_lines_leave_the_runs(spark):
    runs = linedup.LineRuns(spark, min_docs=3, fanout=2)
    for batch in range(5):
        rows = [(batch * 10 + d, f"hot\nown {batch} {d}\nrare {batch % 2}") for d in range(2)]
        table = spark.createDataFrame(rows, "doc_id long, text string")
        runs.add(linedup.line_hashes(table, "doc_id", "text"))
    stored = [r for level in runs.levels for run in level for r in run.collect()]
    assert max(r["docs"] for r in stored) <= 4
    hot = spark.sql("SELECT xxhash64('hot') AS h1").first()["h1"]
    frequent = [r["h1"] for r in runs.frequent_lines().collect()]
    assert hot in frequent and len(frequent) == len(set(frequent)) == 3


@pytest.mark.parametrize("fanout", [2, 3])
def test_lines_are_frequent_as_soon_as_all_batches_say_so(spark, fanout):
    runs = linedup.LineRuns(spark, min_docs=4, fanout=fanout)
    seen = collections.Counter()
    for batch in range(6):
        texts = [f"b{batch}\nby two {batch // 2}\nby three {batch // 3}\nalways {d % 2}" for d in range(2)]
        rows = [(batch * 10 + d, text) for d, text in enumerate(texts)]
        for text in texts:
            seen.update(set(text.split("\n")))
        table = spark.createDataFrame(rows, "doc_id long, text string")
        runs.add(linedup.line_hashes(table, "doc_id", "text"))
        due = spark.createDataFrame([(k,) for k, n in seen.items() if n >= 4] or [("",)], "key string")
        wanted = {r[0] for r in due.filter("key != ''").select(F.xxhash64("key")).collect()}
        found = [r["h1"] for r in runs.frequent_lines().collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
        assert all(len(level) <= fanout for level in runs.levels + runs.frequent)


def test_runs_are_merged_as_they_lie(spark):
    runs = linedup.LineRuns(spark, min_docs=2)
    table = spark.createDataFrame([(1, "a\nb"), (2, "a\nc")], "doc_id long, text string")
    lines = linedup.line_hashes(table, "doc_id", "text")
    runs.add(lines)
    counts = lines.groupBy(*linedup.KEY).agg(F.count(F.lit(1)).alias("docs"))
    with session_settings(spark, linedup.MERGING):
        new = runs._without_frequent(counts)
        both = linedup._sum(runs.levels[0][0], runs.levels[0][0].select(*linedup.KEY, "docs"))
        new, both = (f._jdf.queryExecution().executedPlan().toString() for f in (new, both))
    # The batch is dealt and sorted once, runs never.
    assert (new.count("SortMergeJoin"), new.count("Exchange "), new.count("Sort ")) == (1, 1, 1)
    assert (both.count("SortMergeJoin"), both.count("Exchange "), both.count("Sort ")) == (1, 0, 0)


def test_quality_of_awkward_rows(awkward, nothing):
    found = quality.judge(awkward).collect()
    wanted = [(r[0], *quality.measures(r[1])) for r in awkward_rows()]
    assert as_multiset(tuple(r)[:6] for r in found) == as_multiset(wanted)
    assert all(not r["kept"] for r in found if r["base_failed"])
    assert quality.judge(nothing).collect() == []


def test_boilerplate_is_counted_per_host(spark):
    line = "subscribe to our weekly letter number"
    own = "this sentence number {} belongs to its document alone and has words enough"
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(400)]
    words = [f"alpha{c} beta{c} gamma{c} delta{c} " for c in letters]
    rows = [(i, f"{line} {i}", "x") for i in range(40)]  # digits are one sign
    rows += [(100 + i, f"{line} {i} " + words[i] * 3, "y") for i in range(40)]
    rows += [(200 + i, own.format(words[200 + i]) + f"\n{line} {i}", "x") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality.judge(table).collect()}
    assert all(found[i]["boiler_chars"] == found[i]["line_chars"] for i in range(40))
    assert all(found[100 + i]["boiler_chars"] == 0 for i in range(40))
    assert all(found[200 + i]["kept"] and found[200 + i]["boiler_chars"] > 0 for i in range(40))


def plain_targets(sizes, weights=(1, 2, 3), top=3):
    """Target per source: the total by weight, what is above ``top`` sizes reshared."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, targets = sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        full = {s for s in free if share[s] > top * sizes[s]}
        if not full:
            return targets | share
        targets |= {s: float(top * sizes[s]) for s in full}
        left, free = left - sum(top * sizes[s] for s in full), free - full
    return targets


def plain_copies(rows, seed=67):
    """Copies per doc_id by a walk down the order, equal chances within a source."""
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[3]].append(r[0])
    targets = plain_targets({s: sum(words[i] for i in ids) for s, ids in sources.items()})
    copies = {}
    for source, ids in sources.items():
        size, target = sum(words[i] for i in ids), targets[source]
        whole = int(target // size) if size else 0
        due = target - whole * size
        order = sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
        taken = []
        for i in order:
            if words[i] <= int(due) - sum(words[t] for t in taken):
                taken.append(i)
        out, gap = [i for i in order if i not in taken], due - sum(words[t] for t in taken)
        if out and min(words[i] for i in out) < 2 * gap:
            taken.append(min(out, key=lambda i: words[i]))
        for i in ids:
            copies[i] = min(3, whole + (i in taken))
    return copies


def test_mix_equals_a_walk(small):
    found = {r["doc_id"]: r["copies"] for r in mixing.mix(small[0]).collect()}
    assert found == plain_copies(small[1])


def test_mix_comes_near_its_targets(awkward, small, nothing):
    for table, by_size in ((awkward, False), (small[0], False), (awkward, True), (small[0], True)):
        found = mixing.mix(table, by_size=by_size).collect()
        again = mixing.mix(table.repartition(5), by_size=by_size).collect()
        assert as_multiset(found) == as_multiset(again)
        sources = collections.defaultdict(list)
        for r in found:
            assert 0 <= r["taken"] <= 3 * r["size"]
            sources[r["source"]].append(r)
        total = sum(r["size"] for r in found)
        assert sum(v[0]["target"] for v in sources.values()) == pytest.approx(total)
        for rows in sources.values():
            size, target = sum(r["size"] for r in rows), rows[0]["target"]
            assert rows[0]["source_size"] == size and target <= 3 * size + 1e-6
            off = abs(sum(r["taken"] for r in rows) - target)
            # The last one taken may be above the target, by half of its size at most.
            assert off <= max(1, max(r["size"] for r in rows) / 2)
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("by_size", [False, True])
@pytest.mark.parametrize("long", [[60_000], [60_000, 50_000, 9_000, 7_000]])
def test_long_documents_keep_nothing_out(spark, long, by_size):
    """A document that is long against what is due doesn't cost the source its target."""
    rows = [(i, "w " * n, "x") for i, n in enumerate(long)]
    rows += [(100 + i, "w " * (100 + i % 3), "x") for i in range(400)]
    rows += [(1000 + i, "w " * 250, "y") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (67, 1, 2):
        found = mixing.mix(table, weights=(2, 1), seed=seed, by_size=by_size).collect()
        for source in "xy":
            own = [r for r in found if r["source"] == source]
            taken, target = sum(r["taken"] for r in own), own[0]["target"]
            least = min(r["copies"] for r in own)
            left_out = [r["size"] for r in own if r["copies"] == least]
            assert abs(taken - target) <= min(left_out) and abs(taken - target) < 251


def test_mix_of_empty_documents(spark):
    rows = [(1, None, "a"), (2, " \t", "a"), (3, "", None), (3, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(table).collect():
        assert (r["size"], r["target"], r["taken"], r["copies"]) == (0, 0.0, 0, 1)
    with pytest.raises(ValueError, match="not with both"):
        mixing.mix(table, inclusion="doc_id", by_size=True)


def test_a_hot_source_is_spread(spark):
    """No exchange deals documents by their source alone."""
    rows = [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = "spark.sql.autoBroadcastJoinThreshold"
    with session_settings(spark, {keys: "-1"}):
        rows = table.select("*", F.col("source").isNull().alias("no_source"), F.col("source").alias("name"))
        sources = rows.groupBy(*mixing.OWN).agg(F.count(F.lit(1)).alias("n"))
        found = mixing._with_source(rows.withColumn("row", F.col("doc_id")), sources)
        assert found.count() == 300
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan.split("SortMergeJoin")[1].split("\n")[0]


def test_targets_fill_to_one_level(spark):
    sizes = [(False, "a", 1), (False, "b", 1000), (False, "c", 100), (True, "", 899)]
    table = spark.createDataFrame(sizes, "no_source boolean, name string, source_size long")
    found = {r["name"]: r["target"] for r in mixing.source_targets(table).collect()}
    # a and c are full at three times their size; the rest goes 2 to 1.
    assert found["a"] == 3 and found["c"] == 300
    assert found["b"] == pytest.approx(1697 * 2 / 3) and found[""] == pytest.approx(1697 / 3)


def test_mix_applied_repeats_rows(awkward):
    rows = [r for r in awkward.collect() if r["doc_id"] not in (7,)]
    table = awkward.filter("doc_id IS NULL OR doc_id != 7")
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(table).collect()}
    applied = mixing.apply_mix(table)
    assert applied.columns == awkward.columns
    found = collections.Counter(r["doc_id"] for r in applied.collect())
    assert found == collections.Counter({r["doc_id"]: taken[r["doc_id"]] for r in rows}) - collections.Counter()


def test_sampling_favours_what_it_should(spark):
    rows = [(i, "w " * 10, "x", float(1 + 9 * (i % 2))) for i in range(2000)]
    rows += [(5000 + i, "w " * 10, "y", 1.0) for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, odds double")
    found = mixing.mix(table, weights=(1, 19), inclusion="odds").filter("source = 'x' AND copies > 0")
    odd = found.filter("doc_id % 2 = 1").count()
    assert 0.8 < odd / found.count() < 0.97


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((400, 16)).astype(np.float32)
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (None, [1.0] * 16)]
    rows += [(460, [1.0] * 15 + [None]), (480, [1.0, 2.0]), (500, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table = table.withColumn("items", F.lit("own")).repartition(3)
    found = ann.nearest(table).collect()
    hits = 0
    for query in range(0, 400, 20):
        scores = (vectors.astype(float) * vectors[query].astype(float)).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(400), -scores)) if i != query][:20]
        mine = sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == scores[r["vec_id"]] for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best))
    assert {r["query_id"] for r in found} == set(range(0, 400, 20)) and hits >= 0.97 * 400


def test_neighbours_of_few_and_none(spark):
    types = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 0.0])], types)
    assert [tuple(r) for r in ann.nearest(one).collect()] == [(0, 1, 3, 1.0)]
    assert ann.nearest(one.filter("vec_id < 0")).collect() == []
    assert ann.nearest(one.filter("vec_id = 3")).collect() == []


def test_urls_by_rule(spark):
    cases = {
        "http://a.example.org/es/1": ("example.org/es/", "block"),
        "http://EXAMPLE.org/en/123?x": ("example.org/en/1", "block"),
        "http://notexample.org/es/1": ("org/", "allow"),
        "http://x.com/fr/#top": ("com/fr/", "allow"),
        "https://x.com/de/": ("com/de/", "block"),
        "https://x.com/de": (None, "allow"),
        "https://x.org": (None, "allow"),
        "no scheme": (None, "allow"),
        None: (None, "allow"),
        "a://b://c/d": (None, "allow"),
    }
    rows = [(i, u, "own") for i, u in enumerate(cases)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = reputation.filter_urls(table, block_below=0.0).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in found} == dict(enumerate(cases.values()))
    parts = {r["page_id"]: (r["host"], r["path"]) for r in found}
    assert parts[1] == ("example.org", "/en/123") and parts[7] == parts[8] == ("", "")
    assert parts[9] == ("b:", "//c/d")
    assert reputation.filter_urls(table.limit(0)).collect() == []


def test_reputation_shrinks_hosts_to_their_domain(spark):
    rows = [("bad.x.com", 0)] * 40 + [("worse.x.com", 0)] * 30 + [("new.x.com", None)]
    rows += [("good.y.com", 1)] * 40 + [("one.y.com", 0)] + [("far.z.net", None)]
    table = spark.createDataFrame(rows, "host string, good int")
    found = {r["host"]: r for r in reputation.host_reputation(table).collect()}
    assert found["bad.x.com"]["upper"] < 0.1 and found["good.y.com"]["lower"] > 0.8
    assert found["new.x.com"]["mean"] < found["far.z.net"]["mean"]
    assert found["one.y.com"]["upper"] > 0.5
    assert all(0 <= r["mean"] <= 1 for r in found.values())


def test_shards_match_the_mixture(awkward, small, nothing):
    for table, rows in ((awkward, awkward_rows()), small):
        found = sharding.interleaved(table).collect()
        assert len(found) == len(rows)
        by_shard = collections.defaultdict(list)
        for r in found:
            by_shard[r["shard"]].append(r)
        counts = [len(by_shard[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 1
        for members in by_shard.values():
            assert sorted(r["slot"] for r in members) == list(range(len(members)))
        texts = collections.defaultdict(set)
        for i, text, *_ in rows:
            data = (text or "").encode()
            texts[i].add((len(data) + 1, zlib.crc32(data)))
        assert all((r["size"], r["text_crc32"]) in texts[r["doc_id"]] for r in found)
        sources = collections.Counter(r["source"] for r in found)
        for source, n in sources.items():
            each = [sum(r["source"] == source for r in by_shard[s]) for s in range(8)]
            assert max(each) - min(each) <= 2, (source, n, each)
    assert sharding.interleaved(nothing).collect() == []


def test_language_of_awkward_rows(awkward, nothing):
    found = langid.identify(awkward).collect()
    assert len(found) == len(awkward_rows())
    by_id = {r["doc_id"]: r for r in found}
    assert {by_id[i]["lang_pred"] for i in (1, 2, 3, 12, 13)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found) and not by_id[None]["held_out"]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in by_id if i is not None}
    assert {i: r["held_out"] for i, r in by_id.items() if i is not None} == held
    assert langid.identify(nothing).collect() == []
    kept = langid.keep_identified(awkward)
    assert kept.columns == awkward.columns and {r["score"] for r in kept.collect()} == {"own score"}
    assert langid.keep_identified(nothing).collect() == []


def letters_of(text):
    return "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)


def grams_of(text):
    """Letters, pairs and triples within words, a blank at either end, as code points."""
    counts = collections.Counter()
    for word in letters_of(text).split(" "):
        if word:
            full = [0, *map(ord, word), 0]
            counts.update((c,) for c in full[1:-1])
            counts.update(zip(full, full[1:]))
            counts.update(zip(full, full[1:], full[2:]))
    return counts


def by_code(counts):
    """Counts by the number that stands for an n-gram; a blank ahead adds nothing to it."""
    found = collections.Counter()
    for gram, n in counts.items():
        code = 0
        for c in gram:
            code = code << 21 | c
        found[code] += n
    return found


def plain_language(text, profiles, size=300):
    """The nearest profile by out-of-place distance, and the score."""
    counts = by_code(grams_of(text or ""))
    own = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    if not own or not profiles:
        return "und", 0.0
    off = {
        lang: sum(abs(places[g] - i) if g in places else size for i, g in enumerate(own))
        for lang, places in profiles.items()
    }
    best = min(off, key=lambda lang: (off[lang], lang))
    return best, 1.0 - off[best] / (size * len(own))


def test_language_equals_a_plain_prediction(spark, awkward, small):
    """Every text's language and score, of profiles counted by plain code."""
    for table, rows in ((awkward, awkward_rows()), small):
        counts = collections.defaultdict(collections.Counter)
        for i, text, lang, *_ in rows:
            if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
                counts[lang].update(grams_of(text or ""))
        profiles = {}
        for lang, found in counts.items():
            codes = by_code(found)
            best = sorted(codes, key=lambda g: (-codes[g], g))[:300]
            if best:
                profiles[lang] = {g: i for i, g in enumerate(best)}
        found = [(r["doc_id"], r["lang_pred"], round(r["score"], 12)) for r in langid.identify(table).collect()]
        wanted = [(r[0], *plain_language(r[1], profiles)) for r in rows]
        assert as_multiset(found) == as_multiset((i, p, round(s, 12)) for i, p, s in wanted)


def test_language_of_clashing_names(small):
    names = ["_read", "c0", "lang_pred", "score", "lang", "place", "gram"]
    table = small[0].limit(20).withColumns({n: F.lit(f"own {n}") for n in names})
    profiles = langid.train_profiles(small[0])
    few = langid.predict(table, profiles)
    assert few.columns == ["doc_id", "lang", "source", "n_chars", "_read", "c0", "place", "gram", "lang_pred", "score"]
    assert {r["_read"] for r in few.collect()} == {"own _read"}
    whole = langid.predict(table, profiles, keep_text=True)
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert {r["doc_id"]: r["text"] for r in whole.collect()} == texts


def test_language_of_held_out_documents(small):
    found = small[0].join(langid.identify(small[0]), "doc_id").filter("held_out").collect()
    assert len(found) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_profiles_equal_a_plain_count(small):
    rows = [r for r in small[1] if zlib.crc32(str(r[0]).encode()) % 5]
    known = small[0].filter(langid.fold() != langid.HELD_OUT)
    found = collections.defaultdict(dict)
    for r in langid.train_profiles(known).collect():
        found[r["lang"]][r["place"]] = r["gram"]
    for lang in {r[2] for r in rows}:
        counts = collections.Counter()
        for _, text, own, *_ in rows:
            if own == lang:
                word = "".join(c.lower() if c.isalpha() else " " for c in text)
                for w in word.split():
                    counts.update(map(ord, w))
                    full = f"\0{w}\0"
                    counts.update(ord(a) << 21 | ord(b) for a, b in zip(full, full[1:]))
                    counts.update(
                        ord(a) << 42 | ord(b) << 21 | ord(c)
                        for a, b, c in zip(full, full[1:], full[2:])
                    )
        best = sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]
        assert [found[lang][i] for i in range(len(best))] == best


def test_pipeline_stage_by_stage(spark, small):
    """Each stage on what the one before kept, against the plain versions."""
    docs, rows = small
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near-duplicates", "mix", "encode"]
    folder = f"{DATA}/sf0.001"

    one = stages["language"](spark, docs, folder)
    assert as_multiset(one.collect()) == as_multiset(
        r for r in rows if any(c.isalpha() for c in r[1] or "")
    )
    kept = [tuple(r) for r in one.collect()]
    two = stages["lines"](spark, one, folder)
    digests = [hashlib.sha256(r["text"].encode()).hexdigest() for r in two.collect()]
    assert sorted(digests) == sorted(d for *_, d in plain_lines(kept))
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    before = [tuple(r) for r in two.collect()]
    three = stages["near-duplicates"](spark, two, folder)
    first = {i for i, _, c in plain_components(before, percent=80, width=5) if i == c}
    assert as_multiset(three.collect()) == as_multiset(r for r in before if r[0] in first)

    copies = plain_copies([r for r in before if r[0] in first])
    four = stages["mix"](spark, three, folder)
    assert four.columns == docs.columns
    wanted = [r for r in before if r[0] in first for _ in range(copies[r[0]])]
    assert as_multiset(four.collect()) == as_multiset(wanted)

    library = Tokenizer.from_file(word_bpe_path())
    five = stages["encode"](spark, four, folder).collect()
    lengths = {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) for r in before}
    assert sorted((r["doc_id"], r["n_tokens"]) for r in five) == sorted(
        (r[0], lengths[r[0]]) for r in wanted
    )
    run = corpus_pipeline.run(spark, folder).collect()
    assert as_multiset(run) == as_multiset(five)
