"""Merkle manifest of a table: nested structs rolled up by the digits of a rank.

Rows become leaves, and a leaf's rank within its group is written in digits to
the base of the tree's arity. Blocks of leaves are rolled up by grouping one
digit column away after the other: the nodes that differ in it alone become the
children of one struct, which has their digest. What is left of a block is one
row with all of its leaves nested inside. Blocks are the leaves of the next
round, up to the root; then every round's structs are opened again from the
top, and the path to the root comes down with them.
"""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txscreen.sources import materialize

#: Children of a node, and digits of a rank that are rolled up within a block.
ARITY, DIGITS = 2, 8

#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as a string."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def sampled_change(doc_id: str = "doc_id", n_chars: str = "n_chars", every: int = 7) -> dict[str, Column]:
    """The contract's tampering: one more character where ``every`` divides the id's checksum."""
    chosen = F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0
    return {n_chars: F.when(chosen, F.col(n_chars) + 1).otherwise(F.col(n_chars))}


def _ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` stored in order, with the rank (from 0) within ``_group`` and the group's size.

    Rows are dealt by ranges of group and order, so that a large group is in
    many partitions, and numbered where they lie; a number before the deal
    spreads rows that are equal. One row per partition and group says what
    comes before it. Null groups and null orders come first.
    """
    keys = ["_group", *order, "_copy"]
    dealt = df.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys).drop("_copy")
    stored = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    stored = stored.withColumn("_part", F.shiftright("_at", 33))
    within = Window.partitionBy("_group")
    counted = stored.groupBy("_group", "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    ahead = F.sum("_rows").over(within.orderBy("_part")) - F.col("_rows")
    pieces = counted.select(
        F.col("_group").alias("_of"),
        F.col("_part").alias("_in"),
        (ahead - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(within).alias("_size"),
    )
    same = (F.col("_part") == F.col("_in")) & F.col("_group").eqNullSafe(F.col("_of"))
    rank = (F.col("_at") + F.col("_shift")).alias("_rank")
    return stored.join(pieces, same).select(*df.columns, rank, "_size")


def _largest(ranked: DataFrame) -> int:
    return ranked.agg(F.coalesce(F.max("_size"), F.lit(0)).alias("n")).first()["n"]


def _levels(size: int, arity: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    levels = 0
    while arity**levels < size:
        levels += 1
    return levels


def _rolled(nodes: DataFrame, first_level: int, arity: int, digits: int) -> DataFrame:
    """One row per group and block of ``arity ** digits`` nodes, with the tree of the block.

    All digits stay grouping keys until they are rolled up, so that the one
    exchange by group and block serves them all.
    """
    digit = [(F.expr(f"_rank div {arity**i}") % arity).cast("int").alias(f"_d{i}") for i in range(digits)]
    block = F.expr(f"_rank div {arity**digits}").alias("_block")
    table = nodes.select("_group", "_height", block, *digit, "node")
    table = table.repartition("_group", "_block")
    for i in range(digits):
        rest = ["_group", "_height", "_block", *[f"_d{j}" for j in range(i + 1, digits)]]
        run = F.sort_array(F.collect_list(F.struct(f"_d{i}", "node")))
        table = table.groupBy(*rest).agg(run.alias("_run"))
        kids = F.transform("_run", lambda k: k["node"])
        hashes = F.transform("_run", lambda k: k["node"]["hash"])
        # Above a group's own height its only node goes up as it is.
        hashed = F.when(F.col("_height") > first_level + i, digest(F.array_join(hashes, "")))
        node = F.struct(F.coalesce(hashed, hashes[0]).alias("hash"), kids.alias("kids"))
        table = table.select(*rest, node.alias("node"))
    return table


def _opened(node: Column, level: int, first_level: int, path: Column) -> Column:
    """Every node ``level`` levels below ``node`` with its path to the root.

    A step of a path holds the digests left and right of a node in its run;
    steps come from the bottom to the top.
    """
    if level == 0:
        return F.array(F.struct(node.alias("node"), path.alias("path")))

    def kid(child: Column, i: Column) -> Column:
        hashes = F.transform(node["kids"], lambda k: k["hash"])
        left = F.array_join(F.slice(hashes, F.lit(1), i), "")
        right = F.array_join(F.slice(hashes, i + 2, F.size(hashes)), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        # Above the group's height there is no run.
        here = F.when(F.col("_height") >= first_level + level, step)
        here = F.coalesce(here, F.array().cast(PATH))
        return _opened(child, level - 1, first_level, F.concat(here, path))

    return F.flatten(F.transform(node["kids"], kid))


def _tree(
    leaves: DataFrame, rounds: int, arity: int, digits: int, above: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Roll ``leaves`` up, give the tops to ``above``, and bring the paths it returns down.

    ``leaves`` has _group, _height, _rank and node (a struct with ``hash``).
    ``above`` takes _group and hash of every group's top and returns _group,
    subroot, root and path. Returns _group, subroot, root, node and path of
    every leaf.
    """
    blocks, nodes = [], leaves
    for r in range(rounds):
        rolled = _rolled(nodes, r * digits, arity, digits)
        blocks.append(materialize(rolled, "manifest-blocks"))
        node = F.struct(F.col("node.hash").alias("hash")).alias("node")
        nodes = blocks[r].select("_group", "_height", F.col("_block").alias("_rank"), node)
    paths = above(nodes.select("_group", F.col("node.hash").alias("hash")))
    paths = paths.withColumn("_block", F.lit(0).cast("long"))
    for r in reversed(range(rounds)):
        # A block's tree and its path are two rows of one group.
        both = blocks[r].unionByName(paths, allowMissingColumns=True)
        given = [F.first(c, ignorenulls=True).alias(c) for c in ("_height", "node", "subroot", "root", "path")]
        met = both.groupBy("_group", "_block").agg(*given)
        places = _opened(F.col("node"), digits, r * digits, F.col("path"))
        opened = met.select("_group", "_block", "subroot", "root", F.posexplode(places).alias("_place", "_leaf"))
        place = F.col("_block") * arity**digits + F.col("_place")
        own = ["_leaf.path"] if r else ["_leaf.path", "_leaf.node"]
        paths = opened.select("_group", place.alias("_block"), "subroot", "root", *own)
    return paths.drop("_block")


def _height(arity: int, levels: int) -> Column:
    found = F.lit(0)
    for i in range(levels):
        found = found + (F.col("_size") > arity**i).cast("int")
    return found.alias("_height")


def _tree_of_tops(arity: int, digits: int) -> Callable[[DataFrame], DataFrame]:
    """The tree over the groups' tops, in the order of the groups."""

    def above(tops: DataFrame) -> DataFrame:
        one = tops.select(F.lit(0).alias("_group"), F.col("_group").alias("_name"), "hash")
        ranked = _ranked(one, ["_name"], "manifest-tops")
        levels = _levels(_largest(ranked), arity)
        leaves = ranked.select("_group", _height(arity, levels), "_rank", F.struct("hash", "_name").alias("node"))

        def whole(root: DataFrame) -> DataFrame:
            same = [F.col("hash").alias("subroot"), F.col("hash").alias("root")]
            return root.select("_group", *same, F.array().cast(PATH).alias("path"))

        tree = _tree(leaves, max(1, -(-levels // digits)), arity, digits, whole)
        name, top = F.col("node._name").alias("_group"), F.col("node.hash").alias("subroot")
        return tree.select(name, top, "root", "path")

    return above


def proofs(
    docs: DataFrame,
    *,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    doc_id: str = "doc_id",
    altered: Mapping[str, Column] | None = None,
    arity: int = ARITY,
    digits: int = DIGITS,
) -> DataFrame:
    """doc_id, leaf, given, subroot, root and path of every row of ``docs``.

    A leaf is the digest of the row's ``fields``. Leaves of a group ascend by
    id, a null one first, equal ones by digest; every ``arity`` of them get a
    node, and so on up to the group's subroot. The subroots, by group with
    null first, get the root in the same way. ``given`` is the leaf with the
    columns of ``altered`` in place of the row's own, to be held against the
    original tree. ``path`` are the steps from the leaf to the root: the digests
    left and right of it in its run, both empty for a run of one. Repeated rows
    are leaves each; other columns are left out; an empty table gives no rows.

    Texts are only read to be hashed. A row of the trees holds at most
    ``arity ** digits`` leaves, whatever the size of a group; paths come down
    to the blocks by grouping.
    """
    changes = altered or {}

    def leaf(own: Mapping[str, Column]) -> Column:
        return digest(*[field(own.get(c, F.col(c))) for c in fields])

    changed = F.lit(False)
    for column, value in changes.items():
        changed = changed | ~value.eqNullSafe(F.col(column))
    given = F.when(changed, leaf(changes)).alias("given")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(group).alias("_group"), leaf({}).alias("hash"), given)
    # Stored first: finding the ranges reads its input twice, which should not be the texts.
    ranked = _ranked(materialize(plain, "manifest-hashed"), ["doc_id", "hash"], "manifest-leaves")
    levels = _levels(_largest(ranked), arity)
    node = F.struct("hash", "doc_id", "given").alias("node")
    leaves = ranked.select("_group", _height(arity, levels), "_rank", node)
    rounds = max(1, -(-levels // digits))
    tree = _tree(leaves, rounds, arity, digits, _tree_of_tops(arity, digits))
    found = F.coalesce("node.given", "node.hash").alias("given")
    return tree.select("node.doc_id", F.col("node.hash").alias("leaf"), found, "subroot", "root", "path")


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def verified(proved: DataFrame) -> DataFrame:
    """The contract's columns: the proof's digest, and the root that the given leaf leads to."""
    siblings = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    found = proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.col("given")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
