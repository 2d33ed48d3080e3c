"""Mixing sources to target weights: whole copies first, then Pareto order sampling.

A source's target is met by as many whole copies of all its documents as fit.
For the rest of it, documents are ranked by their random odds divided by their
odds of inclusion, and taken in this order: each that fits the words still due,
down to the end of the order. All of it is DataFrame expressions.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txscreen.llm.common import WORD, numbered
from txscreen.llm.ranking import running_totals
from txscreen.sources import materialize

#: Weights of the sources in code point order, repeating; the mix's settings.
WEIGHTS, MAX_COPIES, SEED = (1, 2, 3), 3, 67

#: Slices of a source's order; a task gets one of them. Copies of a source's own row.
SLICES, SALTS = 4096, 64


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """Target words per source: share by weight, at most ``max_copies`` times its size.

    ``sizes`` has no_source, name, source_size: one row per source, which one
    task sorts. What sources leave over is shared again by weight among the
    others. That is filling them all to one level: the level of the first
    source, by ascending limit per weight, whose share is within its limit.
    """
    by_name = Window.orderBy("no_source", "name")
    table = F.array(*[F.lit(int(w)) for w in weights])
    # The total comes along as a window over the same single partition.
    everything = Window.partitionBy()
    weighed = sizes.select(
        "*",
        F.get(table, (F.row_number().over(by_name) - 1) % len(weights)).alias("weight"),
        F.sum("source_size").over(everything).alias("all_words"),
    ).withColumn("limit", F.col("source_size") * max_copies)
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "name")
    ahead = rising.rowsBetween(Window.unboundedPreceding, -1)
    words_left = F.col("all_words") - F.coalesce(F.sum("limit").over(ahead), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(ahead), F.lit(0)
    )
    leveled = weighed.withColumns(
        {"level": words_left / weight_left, "place": F.row_number().over(rising)}
    )
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    level = F.min_by("level", F.when(fits, F.col("place"))).over(everything)
    target = F.least(level * F.col("weight"), F.col("limit").cast("double"))
    return leveled.select(
        "no_source", "name", "source_size", F.coalesce(target, F.lit(0.0)).alias("target")
    )


#: The source of a row, nulls told from every name.
OWN = ["no_source", "name"]


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source in ``sources``, one row per source.

    Each source is there once per salt and a row asks one of them, so a source
    with a third of all rows is spread over many tasks, and nothing needs to
    be small enough for a broadcast.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    spread = sources.select("*", salts)
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(spread, [*OWN, "salt"]).drop("salt")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    inclusion: str | None = None,
    by_size: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How many words, and so how many copies, of every document the mix takes.

    Returns doc_id, source, size (words), source_size, target, copies and
    taken (words, repeats counted) of every row, and the columns in ``keep``. A null text has size 0; a
    null source is one more source, behind the others; repeated rows are
    documents of their own. An empty table gives no rows. The random numbers
    come from a seeded hash of the id, so reruns agree.

    ``inclusion`` names a positive column: the odds of being in the sample
    grow with it. ``by_size`` makes them grow with the words of the document.
    Without either the documents of a source have equal chances, those of
    different sources different ones.

    The sample goes down the order and takes every document that fits the
    words still due; one that is too long doesn't keep those behind it out. So
    what is left over in the end is less than the smallest document left out.
    If that one, the first of equals, comes nearer to the target than to leave
    it out, it is taken too. Documents without words are always taken.

    A source is ranked in slices of its order, so it may hold any share of the
    rows. The walk down the order is one running sum up to the first document
    that doesn't fit, again over those behind it that do, and so on: what is
    due falls below the size of that document each time, and a round looks at
    what still fits only. Ids and sizes are stored between rounds, not texts.
    """
    if inclusion and by_size:
        raise ValueError("odds grow with a column or with the size, not with both")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    size = word_count(text)
    favour = F.col(inclusion).cast("double") if inclusion else F.lit(1.0)
    favour = size.cast("double") if by_size else favour
    favoured = F.sum(F.col("favour") * F.col("size"))
    if by_size:
        # Whole numbers, so that the order of the rows doesn't change the sum.
        favoured = F.sum(F.col("size").cast("decimal(19,0)") * F.col("size")).cast("double")
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).isNull().alias("no_source"),
            F.coalesce(F.col(source), F.lit("")).alias("name"),
            size.alias("size"),
            key.alias("key"),
            F.greatest(F.coalesce(favour, F.lit(1.0)), F.lit(1e-9)).alias("favour"),
            *keep,
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    sizes = rows.groupBy(*OWN).agg(
        F.sum("size").alias("source_size"),
        favoured.alias("favoured"),
    )
    targets = source_targets(sizes.drop("favoured"), weights, max_copies).join(
        sizes.drop("source_size"), OWN
    )
    filled = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    plan = targets.withColumn("whole", F.coalesce(filled, F.lit(0)).cast("long")).withColumn(
        "due", F.col("target") - F.col("whole") * F.col("source_size")
    )
    # Sizes are whole numbers, and so is what they may add up to.
    plan = materialize(plan.withColumn("left", F.floor("due")), "plan")
    ranked = materialize(_with_source(rows, plan).withColumns(_pareto()), "ranked")
    columns = ["row", *OWN, "size", "rank", "slice", "key", "doc_id", "left"]
    fitting = ranked.filter("size > 0 AND size <= left").select(*columns)
    taken = materialize(_walk(fitting, plan).select("row", F.lit(True).alias("sampled")), "taken")
    chosen = ranked.join(taken, "row", "left").withColumn(
        "sampled", F.coalesce("sampled", F.lit(False)) | (F.col("size") == 0)
    )
    chosen = materialize(chosen, "sampled")
    used = F.sum(F.when(F.col("sampled"), F.col("size")).otherwise(0))
    out = ~F.col("sampled") & (F.col("size") > 0)
    order = F.struct("size", "rank", "key", "doc_id", "row")
    gaps = chosen.groupBy(*OWN).agg(
        (F.first("due") - used).alias("gap"), F.min(F.when(out, order)).alias("last")
    )
    last = gaps.filter(F.col("last.size") - F.col("gap") < F.col("gap"))
    last = last.select("*", F.col("last.row").alias("row")).select("row", F.lit(True).alias("closes"))
    found = chosen.join(last, "row", "left")
    sampled = F.col("sampled") | F.coalesce("closes", F.lit(False))
    copies = F.least(F.col("whole") + sampled.cast("long"), F.lit(max_copies).cast("long"))
    return found.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *keep,
    )


def _pareto() -> dict[str, Column]:
    """The rank of a row in its source's order, and the slice of the order it is in."""
    near_one = 1 - 1e-12
    drawn = (F.conv(F.substring("key", 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    share = F.least(F.col("due") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(near_one))
    chance = F.least(
        F.col("due") * F.col("favour") / F.greatest(F.col("favoured"), F.lit(1e-9)), F.lit(near_one)
    )
    chance = F.greatest(chance, F.lit(1e-300))
    rank = (drawn / (1 - drawn)) * ((1 - chance) / chance)
    # The source's own odds spread the ranks evenly over the slices.
    share = F.greatest(share, F.lit(1e-300))
    even = rank * (share / (1 - share))
    return {"rank": rank, "slice": F.floor(even / (1 + even) * SLICES)}


def _walk(fitting: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows that the walk down the order takes.

    ``fitting`` has those that may still be taken, each with the words ``left``
    for its source, all of which its size is within.
    """
    taken, left = [], plan.select(*OWN, "left")
    while True:
        order = ["rank", "key", "doc_id", "row"]
        summed = running_totals(
            fitting, OWN, "slice", order, F.col("size"), before="ahead", total="_total"
        )
        summed = materialize(summed.drop("_total"), "walk")
        fits = F.col("ahead") + F.col("size") <= F.col("left")
        taken.append(summed.filter(fits))
        used = summed.filter(fits).groupBy(*OWN).agg(F.sum("size").alias("used"))
        left = left.join(used, OWN, "left").select(
            *OWN, (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")
        )
        left = materialize(left, "left")
        rest = _with_source(summed.filter(~fits).drop("left", "ahead"), left)
        fitting = materialize(rest.filter("size <= left"), "fitting")
        if fitting.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs`` as often as ``mix`` takes them, none to ``max_copies`` times.

    Rows that repeat an id and text are taken alike, as often as the one of
    them that is taken most. The texts are shuffled once, by id.
    """
    own = docs.select("doc_id", "text", "source", F.xxhash64("text", "source").alias("mark"))
    taken = mix(own, keep=["mark"], **settings).groupBy("doc_id", "mark")
    taken = taken.agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    plain, names = numbered(docs)
    key, text, source = (names[c] for c in ("doc_id", "text", "source"))
    same = F.col(key).eqNullSafe(F.col("doc_id")) & (F.xxhash64(text, source) == F.col("mark"))
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("time")
    found = plain.join(taken, same).select(*plain.columns, times)
    return found.drop("time").toDF(*docs.columns)


SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    greatest(sum(size * size)::DOUBLE, 1e-9::DOUBLE) AS favoured FROM rows GROUP BY source),
weighed AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS weight,
    source_size * {MAX_COPIES} AS top, sum(source_size) OVER () AS all_words
  FROM sizes),
leveled AS (
  SELECT *, (all_words - coalesce(sum(top) OVER ahead, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0))::DOUBLE AS level,
    row_number() OVER (ORDER BY top / weight, source IS NULL, source) AS place
  FROM weighed
  WINDOW ahead AS (ORDER BY top / weight, source IS NULL, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, favoured, least(top::DOUBLE, weight *
    (SELECT arg_min(level, place) FROM leveled WHERE level * weight <= top)) AS target
  FROM leveled),
plan AS (
  SELECT source, source_size, target, whole, target - whole * source_size AS due, favoured
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END
      AS whole FROM targets)),
drawn AS (
  SELECT rows.*, source_size, target, whole, due,
    least(due * greatest(size, 1e-9::DOUBLE) / favoured, 1 - 1e-12::DOUBLE) AS chance,
    (('0x' || substr(key, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM rows JOIN plan ON rows.source IS NOT DISTINCT FROM plan.source),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, key, doc_id) AS place
  FROM (SELECT *, (u / (1 - u)) * ((1 - greatest(chance, 1e-300::DOUBLE))
      / greatest(chance, 1e-300::DOUBLE)) AS rank FROM drawn)),
walk AS (
  SELECT source, 0::BIGINT AS place, floor(due)::BIGINT AS words_left, FALSE AS fits FROM plan
  UNION ALL
  SELECT p.source, p.place, words_left - CASE WHEN size <= words_left THEN size ELSE 0 END,
    size <= words_left
  FROM walk JOIN placed p ON p.source IS NOT DISTINCT FROM walk.source AND p.place = walk.place + 1),
sampled AS (
  SELECT p.*, fits FROM placed p
  JOIN walk ON walk.source IS NOT DISTINCT FROM p.source AND walk.place = p.place),
lasts AS (
  SELECT source, any_value(due) - coalesce(sum(size) FILTER (fits), 0) AS gap,
    min(row(size, place)) FILTER (NOT fits) AS last
  FROM sampled GROUP BY source),
counted AS (
  SELECT sampled.*, least(whole + (fits OR (last[2] = place AND last[1] - gap < gap))::BIGINT,
    {MAX_COPIES}) AS copies
  FROM sampled JOIN lasts ON sampled.source IS NOT DISTINCT FROM lasts.source)
SELECT doc_id, source, size, source_size, target, copies, (copies * size)::BIGINT AS taken
FROM counted
"""
