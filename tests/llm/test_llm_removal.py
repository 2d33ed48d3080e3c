"""Texts that the quality operator leaves, line by line, and awkward urls."""

import collections
import re

from pyspark.sql import functions as F

from txscreen.llm import quality, reputation

TYPES = "doc_id long, text string, source string, kept string"


def test_boilerplate_lines_leave_the_text(spark):
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    own = [f"alpha{c} beta{c} gamma{c} delta{c} and words{c} enough{c} for it{c}" for c in letters]
    rows = []
    for i in range(30):
        # The frequent line has other blanks, cases and digits each time, and is there twice.
        text = f"  SUBSCRIBE to  letter {i}\n{own[i]}\n\n{own[i + 30]} end\nsubscribe to letter {i}0"
        rows.append((i, text, "x", "own"))
    rows += [(100 + i, f"Subscribe to letter {i}\n{own[i]}", "y", "own") for i in range(19)]
    rows += [(200, None, "x", "own"), (201, "", None, "own"), (None, rows[3][1], "x", "own")]
    rows += [(3, rows[3][1], "x", "own"), (202, "subscribe to letter 0", "x", "own")]
    table = spark.createDataFrame(rows, TYPES).withColumn("mark", F.lit("own mark")).repartition(3)
    found = quality.clean(table)
    assert found.columns == ["doc_id", "text", "source", "mark", "kept_text", "n_removed", "kept"]
    found = found.collect()
    wanted = []
    for doc_id, text, source, _ in rows:
        lines = (text or "").split("\n")
        left = [n for n in lines if source != "x" or "subscribe" not in n.lower()]
        wanted.append((doc_id, text, source, "own mark", "\n".join(left), len(lines) - len(left)))
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(map(repr, wanted))
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(table).collect()}
    assert {r["doc_id"]: r["kept"] for r in found} == verdicts
    assert verdicts[0] and not verdicts[202]


def test_boilerplate_of_nothing(spark):
    assert quality.clean(spark.createDataFrame([], TYPES)).collect() == []


def test_share_decides_in_a_hot_host(spark):
    """30 documents are one percent of 3,000, and less of 3,001."""
    for host_docs, gone in ((3000, 30), (3001, 0)):
        rows = [(i, "shared line" if i < 30 else "", "x", "") for i in range(host_docs)]
        table = spark.createDataFrame(rows, TYPES)
        found = quality.clean(table).filter("n_removed > 0").count()
        assert found == gone
    assert quality.clean(table, line_percent=0.5).filter("n_removed > 0").count() == 30


def normal(line):
    low = " ".join(part for part in re.split(r"[\x20\x09-\x0D]+", line) if part).lower()
    return re.sub("[0-9]+", "0", low)


def test_white_space_never_makes_another_line(spark):
    """Tabs, carriage returns and lines of white space alone, against a plain count."""
    ends = ["", "\t", "\r", " \t ", "\x0b", "\x0c\r"]
    blank = ["", " ", "\t", "\r", " \t\r"]
    rows = []
    for i in range(60):
        own = f"own line of document {chr(97 + i % 26)}{chr(97 + i // 26)}{ends[i % 6]}"
        lines = [f"{ends[i % 6]}Footer  of\tthe page{ends[-1 - i % 6]}", blank[i % 5], own, "\r"]
        rows.append((i, "\n".join(lines), "x" if i % 4 else "y", ""))
    rows += [(100 + i, "\r\n\t\n", "x", "") for i in range(30)]
    table = spark.createDataFrame(rows, TYPES).repartition(4)
    hosts = {s: sum(r[2] == s for r in rows) for s in "xy"}
    counts = collections.Counter(
        (source, key) for _, text, source, _ in rows for key in {normal(n) for n in text.split("\n")} if key
    )
    gone = {k for k, n in counts.items() if n >= 20 and 100 * n >= hosts[k[0]]}
    assert gone == {("x", "footer of the page")}
    found = {r["doc_id"]: r for r in quality.clean(table).collect()}
    chars = {r["doc_id"]: (r["line_chars"], r["boiler_chars"]) for r in quality.judge(table).collect()}
    for i, text, source, _ in rows:
        lines = text.split("\n")
        left = [n for n in lines if (source, normal(n)) not in gone]
        assert (found[i]["kept_text"], found[i]["n_removed"]) == ("\n".join(left), len(lines) - len(left))
        every = sum(len(normal(n)) for n in lines)
        assert chars[i] == (every, every - sum(len(normal(n)) for n in left))


def test_urls_repeated_long_and_of_no_host(spark):
    long = "http://deep.example.org/es/" + "x" * 200_000 + "?" + "y" * 200_000
    rows = [(1, long), (1, long), (2, "http://" + "a." * 50_000 + "com/de/"), (2, None)]
    rows += [(None, "http://x.com/fr/"), (3, "http:///de/"), (4, ""), (5, "://")]
    table = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    found = reputation.filter_urls(table, block_below=0.0).collect()
    assert len(found) == len(rows)
    rules = sorted((r["page_id"] or 0, r["rule"] or "", r["verdict"], len(r["path"])) for r in found)
    assert rules == [
        (0, "com/fr/", "allow", 4),
        (1, "example.org/es/", "block", 200_004),
        (1, "example.org/es/", "block", 200_004),
        (2, "", "allow", 0),
        (2, "com/de/", "block", 4),
        (3, "", "allow", 4),
        (4, "", "allow", 0),
        (5, "", "allow", 0),
    ]
