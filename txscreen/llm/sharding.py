"""Shards that all match the mixture of sources: proportional interleaving.

The rows of each source are shuffled by a seeded hash and ranked; rank ``r`` of
``n`` lies at the fraction (r - 1/2) / n of its source. In the order of these
fractions every stretch holds the sources in proportion, so the order is cut
into stretches of equal length. All of it is DataFrame expressions.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txscreen.llm.ranking import running_totals
from txscreen.sources import materialize

SHARDS, SEED = 8, 67

#: Slices of a source's order and of the whole order; a task gets one of them.
SLICES = 4096


def interleaved(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Shard and place of every row: law ``rows``, counts differ by one at most.

    Returns doc_id, source, size (UTF-8 bytes of the text and 1), text_crc32,
    law, shard, slot (from 0, without gaps) and grown_shard (null: adding a
    shard moves rows under this law). A null text counts no bytes and has the
    checksum of none; a null source is a source of its own, behind the others.
    Repeated rows take a slot each. Equal texts aren't kept together: a group
    of copies may exceed a shard. An empty table gives no rows.

    Neither order is sorted in one task: both are dealt in slices, and what
    lies ahead of a slice comes from one row per slice. Between the two orders
    the few columns that matter are stored.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("name"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        key.alias("key"),
    ).withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    ranked = running_totals(
        rows,
        ["no_source", "name"],
        "slice",
        ["key", "doc_id", "size", "text_crc32"],
        F.lit(1),
        before="ahead",
        total="in_source",
    )
    fraction = (2 * F.col("ahead") + 1) / (2 * F.col("in_source"))
    placed = materialize(
        ranked.select(
            "doc_id", "no_source", "name", "size", "text_crc32", fraction.alias("fraction")
        ),
        "fractions",
    )
    # The slice is below SLICES: a fraction is below 1.
    placed = placed.withColumn("slice", F.floor(F.col("fraction") * SLICES))
    order = ["fraction", "no_source", "name"]
    spread = running_totals(placed, [], "slice", order, F.lit(1), before="place", total="rows")
    shard = F.expr(f"place * {shards} div rows")
    start = F.expr(f"(shard * rows + {shards - 1}) div {shards}")
    return spread.withColumn("shard", shard).select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("name")).alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
