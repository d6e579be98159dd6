"""A Merkle manifest of a dataset, with levels as concatenated strings.

Rows are hashed to leaves, leaves are numbered within their group by key. Every `BLOCK`
consecutive leaves of a group are one block, which holds each level of its part of the tree as a
single string of hex digests. Fixed-width substrings of a level, two digests wide, hash to the
level above; what flanks a digest within its pair is its sibling segment. A block's topmost digest
is a leaf of the next round, until a group is one block; the groups' roots, in the order of the
groups, recurse likewise to the root.

A group of any size is many blocks, a round shrinks it by `BLOCK`. Leaves are ordered by a range
shuffle whose last key is a number of each row, so that neither a hot group nor a key that repeats
gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from supportlake.llm.common import materialize, prepare

#: Leaves of a block, 2 ** LEVELS; a level-0 string then has 64 KB.
LEVELS = 10
#: Hex digits of a digest.
WIDTH = 64


def leaf_hash(*columns: Column | str) -> Column:
    """Lowercase hex SHA-256 of the columns in order, each `-` if null, else its UTF-8 byte
    count, a colon and its value as text."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(
            F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give: array<struct<before, after>>, a level each."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _number(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds g, a number of the row's group that ascends with the groups, pos, its place in the
    group's order from 0, and n, the group's size."""
    keys = [group, *order]
    placed = materialize(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("place", F.monotonically_increasing_id()),
        name,
    )
    # The upper bits of the place are the range's number.
    part = F.shiftright("place", 33)
    runs = placed.groupBy(F.col(group).alias("run_group"), part.alias("run_part")).agg(
        F.min("place").alias("run_first"), F.count(F.lit(1)).alias("run_size")
    )
    before = Window.partitionBy("run_group").orderBy("run_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy("run_group")
    starts = runs.select(
        "run_group", "run_part", "run_first",
        F.min("run_first").over(whole).alias("g"),
        F.sum("run_size").over(whole).alias("n"),
        F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("run_start"),
    )
    same = placed[group].eqNullSafe(starts["run_group"]) & (part == starts["run_part"])
    return (
        placed.join(starts, same)
        .withColumn("pos", F.col("place") - F.col("run_first") + F.col("run_start"))
        .drop("place", "run_group", "run_part", "run_first", "run_start")
    )


#: The level above a level x: digests of substrings of two digests each.
_ABOVE = f"""array_join(transform(
    sequence(0, cast((octet_length(x) - 1) div {2 * WIDTH} as int)),
    i -> sha2(substring(x, i * {2 * WIDTH} + 1, {2 * WIDTH}), 256)), '')"""

def _flanks(level: str, at: str) -> str:
    """What stands before and after a digest of a level within its pair."""
    return f"""named_struct(
        'before', cast(substring({level}, ({at} div 2) * {2 * WIDTH} + 1, ({at} % 2) * {WIDTH})
            as string),
        'after', cast(substring({level}, {at} * {WIDTH} + {WIDTH + 1}, (1 - {at} % 2) * {WIDTH})
            as string))"""


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(g, block, n, blocks, members, levels) of nodes (g, pos, n, hash, carried): the levels
    of each block as strings, up to its topmost digest."""
    size = 1 << levels
    carried = [c for c in nodes.columns if c not in ("g", "pos", "n")]
    grouped = nodes.groupBy(
        "g", F.expr(f"pos div {size}").alias("block"), "n"
    ).agg(
        F.array_sort(
            F.collect_list(F.struct((F.col("pos") % size).cast("int").alias("at"), *carried))
        ).alias("members")
    )
    # A group that is one block is hashed until one digest is left, others `levels` times.
    height = F.when(F.col("blocks") > 1, levels).otherwise(
        F.expr(f"size(filter(sequence(0, {levels} - 1), l -> shiftleft(1L, l) < n))")
    )
    bottom = F.expr("cast(array_join(transform(members, m -> m.hash), '') as binary)")
    return (
        grouped.withColumn("blocks", F.expr(f"(n + {size - 1}) div {size}"))
        .withColumn("height", height)
        .withColumn("bottom", bottom)
        .withColumn(
            "levels",
            F.expr(
                f"""aggregate(slice(sequence(1, {levels}), 1, height), array(bottom),
                (done, l) -> concat(done, transform(slice(done, -1, 1),
                    x -> cast({_ABOVE} as binary))))"""
            ),
        )
        .drop("bottom")
    )


def _rounds(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """Written blocks of each round; a group takes part until it is one block."""
    rounds = []
    while True:
        blocks = materialize(_blocks(nodes, levels), f"{name}-blocks")
        rounds.append(blocks)
        above = blocks.filter("blocks > 1")
        if above.isEmpty():
            return rounds
        nodes = above.select(
            "g", F.col("block").alias("pos"), F.col("blocks").alias("n"),
            F.expr("cast(element_at(levels, -1) as string)").alias("hash"),
        )


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(g, round, hash): the root of each group and the round it ends in."""
    ends = [
        blocks.filter("blocks = 1").select(
            "g", F.lit(i).alias("round"),
            F.expr("cast(element_at(levels, -1) as string)").alias("hash"),
        )
        for i, blocks in enumerate(rounds)
    ]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionAll(more)
    return out


def _paths(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """(g, pos, member, path, subroot, root) of the nodes that the first round is made of.
    tops: (g, round, path, subroot, root), what lies above the groups' roots."""
    own = f"""transform(slice(levels, 1, height),
        (x, l) -> {_flanks("x", "shiftright(m.at, l)")})"""
    found = None
    for i in reversed(range(len(rounds))):
        above = tops.filter(F.col("round") == i).select(
            "g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root"
        )
        if found is not None:
            above = above.unionAll(
                found.select("g", F.col("pos").alias("block"), "path", "subroot", "root")
            )
        leaves = F.expr(
            f"transform(members, m -> named_struct('member', m, 'path', concat({own}, path)))"
        )
        found = (
            rounds[i]
            .join(above, ["g", "block"])
            .select("g", "block", "subroot", "root", F.explode(leaves).alias("leaf"))
            .select(
                "g", (F.col("block") * (1 << levels) + F.col("leaf.member.at")).alias("pos"),
                "leaf.member", "leaf.path", "subroot", "root",
            )
        )
    return found


@dataclass
class Manifest:
    """leaves: carried, pos, leaf, path, subroot, root, a row for each row of the dataset.
    groups: group, n, subroot, path, root, a row for each group."""

    leaves: DataFrame
    groups: DataFrame


def manifest(
    rows: DataFrame, leaf: str, group: str, key: str, carried: list[str], levels: int = LEVELS
) -> Manifest:
    """The tree over the hex digests in column `leaf`: per `group`, in the order of `key`.

    `path` is an array with a struct (before, after) for each level up to the root: the sibling
    digests that stand left and right of a node, empty strings where there are none; `fold`
    makes the root of it. pos is the row's place in its group. The columns `carried` are handed
    on in a struct of that name, so no name clashes.

    Groups follow each other by their value, null first, strings by their UTF-8 bytes. Within a
    group, null keys come first, rows with equal keys follow their leaf; rows that repeat are
    leaves of their own. `leaf` must not be null, as `leaf_hash` never is. A dataset of one row
    has its leaf as root; an empty one has no rows and no root.
    """
    prepare(rows.sparkSession)
    own = materialize(
        rows.select(
            F.col(group).alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("hash"),
            F.struct(*carried).alias("carried"),
        ),
        "leaves",
    ).withColumn("row", F.monotonically_increasing_id())
    numbered = _number(own, "grp", ["key", "hash", "row"], "ordered-leaves")
    rounds = _rounds(numbered.select("g", "pos", "n", "hash", "carried"), levels, "leaf")
    roots = _tops(rounds)

    ordered = _number(
        roots.select(
            F.lit(0).alias("all"), F.col("g").alias("group_no"), "hash",
            F.struct("g", "round").alias("carried"),
        ),
        "all", ["group_no"], "ordered-roots",
    )
    upper = _rounds(ordered.select("g", "pos", "n", "hash", "carried"), levels, "root")
    none = F.expr("cast(array() as array<struct<before: string, after: string>>)")
    top = _tops(upper).select(
        "g", "round", none.alias("path"), F.lit(None).cast("string").alias("subroot"),
        F.col("hash").alias("root"),
    )
    tops = materialize(
        _paths(upper, top, levels).select(
            "member.carried.*", "path", F.col("member.hash").alias("subroot"), "root"
        ),
        "roots",
    )
    leaves = _paths(rounds, tops, levels).select(
        "member.carried", "pos", F.col("member.hash").alias("leaf"), "path", "subroot", "root"
    )
    names = numbered.groupBy("g").agg(F.first("grp").alias("group"), F.first("n").alias("n"))
    groups = names.join(tops, "g").select("group", "n", "subroot", "path", "root")
    return Manifest(leaves, groups)
