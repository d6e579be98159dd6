"""Exact top-k by cosine over embedding columns, without a cross join.

Cases lie in a tree of pivot vectors. A node with more than `block_rows` cases gets up to `FAN`
of them as pivots of child nodes, and each case goes to the nearest; leaves hold the cases. Nodes
are rows of a table, as many as the cases demand. By the triangle inequality on angles no case
below a node is nearer to a query than the pivot's angle less the node's radius, nor farther
than their sum.

Queries go down level by level, each join meeting the queries at a node with the node's
children. First every query takes its most promising way to a leaf, whose cases give it a k-th
best score. Then it goes down all ways that can still change its top k or its hits; a node whose
cases are certainly all hits is counted as a whole. One task multiplies one block of a leaf by one
chunk of queries and emits k rows per query. Where a level leaves very many nodes open, the bounds
exclude too little: then all queries are multiplied with all cases in cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.operators import cells
from supportlake.operators.retrieval import first_ids
from supportlake.operators.sampling import sample_key, smallest_per_group
from supportlake.session import materialize

#: Children of a node, and queries or cases of one node that a task meets with them.
FAN = 64
CHUNK = 1024
ASSIGNED = 16_384
ROOT = 1
#: Open nodes per query from which on all pairs are multiplied, and rows of a side of a cell then.
OPEN_NODES = 64
CELL_ROWS = 8_192
EPS = 1e-9


def _unit(column: pd.Series) -> np.ndarray:
    m = np.asarray(column.tolist(), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0.0, 1.0, norm)


def _meet(
    rows: DataFrame, facts: DataFrame, sizes: DataFrame, chunk_rows: int, by: str,
    task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
) -> DataFrame:
    """Rows (node, ...) and facts (node, ...) that share a node, handed to `task` in chunks of
    about `chunk_rows` rows with all facts of the node. sizes: (node, n) of the rows."""
    chunks = sizes.select("node", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
    left = rows.join(chunks, "node").withColumn(
        "chunk", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int")
    )
    right = facts.join(chunks, "node").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    return _cogroup(left.drop("chunks"), right.drop("chunks"), ["node", "chunk"], task, schema)


def _cogroup(
    left: DataFrame, right: DataFrame, keys: list[str],
    task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
) -> DataFrame:
    # Both sides may come from one table: new names part their columns.
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(task, schema)


class DenseIndex:
    """A pivot tree over a case table (case_id, embedding, intent; customer_problem and
    resolution, if there, are returned with a case). Cases without an embedding are left out.
    Cases with equal embedding and intent are one group.

    placed    (gid, first_id, copies, case_intent, embedding, node), node a leaf
    nodes     (node, parent, pivot, radius, groups, copies, leaf); the root has no pivot
    intents   (node, case_intent, of_intent): copies of each intent below a node
    """

    def __init__(self, cases: DataFrame, block_rows: int = 4096, fan: int = FAN):
        cases = cases.filter(F.col("embedding").isNotNull())
        key = F.md5(
            F.concat_ws(
                "\u0001",
                F.coalesce(F.col("intent").cast("string"), F.lit("\u0000")),
                F.array_join(F.col("embedding").cast("array<string>"), ","),
            )
        )
        self.texts = [c for c in ("customer_problem", "resolution") if c in cases.columns]
        keyed = cases.select(
            "case_id", F.col("intent").cast("string").alias("intent"), "embedding",
            key.alias("gid"), *self.texts,
        )
        self.block_rows, self.fan = block_rows, fan
        self.cases = materialize(keyed, "dense-cases")
        sizes = self.cases.groupBy("gid").agg(
            F.count("*").alias("copies"),
            F.first("intent").alias("case_intent"),
            F.first("embedding").alias("embedding"),
            F.min("case_id").alias("first_id"),
        )
        self.groups = materialize(sizes, "dense-groups")
        self._build()

    def _build(self) -> None:
        """One level after another, until no leaf is too large or none can be split."""
        root = F.lit(ROOT).cast("long")
        placed = self.groups.select(
            "gid", "first_id", "copies", "case_intent", "embedding", root.alias("node")
        )
        whole = placed.groupBy("node").agg(
            F.count("*").alias("groups"), F.sum("copies").alias("copies")
        )
        empty = F.array().cast(self.groups.schema["embedding"].dataType)
        level = materialize(
            whole.select(
                "node", F.lit(0).cast("long").alias("parent"), empty.alias("pivot"),
                F.lit(np.pi).alias("radius"), "groups", "copies",
                (F.col("groups") <= self.block_rows).alias("leaf"),
            ),
            "dense-level",
        )
        nodes, intents = level, []
        done = None
        while True:
            intents.append(
                placed.groupBy("node", "case_intent").agg(F.sum("copies").alias("of_intent"))
            )
            leaves = placed.join(level.filter("leaf").select("node"), "node", "left_semi")
            done = leaves if done is None else done.unionByName(leaves)
            open_ = level.filter(~F.col("leaf"))
            if open_.isEmpty():
                break
            placed, level = self._split(placed, open_)
            nodes = nodes.unionByName(level)
        self.placed = materialize(done, "dense-placed")
        self.nodes = materialize(nodes, "dense-nodes")
        every = intents[0]
        for more in intents[1:]:
            every = every.unionByName(more)
        self.intents = materialize(every, "dense-intents")
        self.depth = len(intents)

    def _split(self, placed: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of the open nodes at their children, and the children."""
        fan = self.fan
        rows = placed.join(open_.select("node"), "node", "left_semi")
        wanted = F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(F.col("groups") / self.block_rows)))
        drawn = smallest_per_group(
            rows.select("node", "gid", "embedding"), ["node"], [sample_key(0, "gid")], fan
        )
        number = F.row_number().over(Window.partitionBy("node").orderBy(sample_key(0, "gid")))
        pivots = materialize(
            drawn.withColumn("child", number - 1)
            .join(open_.select("node", wanted.alias("wanted")), "node")
            .filter(F.col("child") < F.col("wanted"))
            .select(
                "node", (F.col("node") * fan + F.col("child")).alias("child"),
                F.col("embedding").alias("pivot"),
            ),
            "dense-pivots",
        )

        def nearest(part: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            if part.empty:
                return pd.DataFrame(columns=columns)
            near = near.sort_values("child")
            cos = np.clip(_unit(part["embedding"]) @ _unit(near["pivot"]).T, -1.0, 1.0)
            best = cos.argmax(axis=1)
            out = part[columns[:-2]].copy()
            out["node"] = near["child"].to_numpy()[best]
            out["angle"] = np.arccos(cos[np.arange(len(part)), best])
            return out

        kept = ["gid", "first_id", "copies", "case_intent", "embedding"]
        columns = [*kept, "node", "angle"]
        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", node long, angle double"
        sizes = open_.select("node", F.col("groups").alias("n"))
        moved = materialize(
            _meet(rows, pivots, sizes, ASSIGNED, "gid", nearest, schema), "dense-moved"
        )
        found = moved.groupBy("node").agg(
            F.max("angle").alias("radius"), F.count("*").alias("groups"),
            F.sum("copies").alias("copies"),
        )
        level = (
            pivots.select(F.col("child").alias("node"), F.col("node").alias("parent"), "pivot")
            .join(found, "node")
            .join(open_.select(F.col("node").alias("parent"), F.col("groups").alias("above")), "parent")
            # Equal vectors do not part: such a node stays a leaf of many blocks. Numbers of
            # nodes end where a long does.
            .withColumn(
                "leaf",
                (F.col("groups") <= self.block_rows)
                | (F.col("groups") == F.col("above"))
                | (F.col("node") >= (1 << 62) // fan),
            )
            .select("node", "parent", "pivot", "radius", "groups", "copies", "leaf")
        )
        return moved.drop("angle"), materialize(level, "dense-level")


def _children(at: DataFrame, queries: DataFrame, index: DenseIndex, weight: float) -> DataFrame:
    """(qid, counted, node, leaf, high, low, bound, relevant, intent) for the children of the
    nodes that queries are at (qid, node, counted): the largest and smallest similarity below, the
    largest final score, and how many cases below count as hits if they are near enough."""

    def angles(part: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if part.empty or near.empty:
            return pd.DataFrame(columns=columns)
        angle = np.arccos(np.clip(_unit(part["embedding"]) @ _unit(near["pivot"]).T, -1.0, 1.0))
        radius = near["radius"].to_numpy()[None, :]
        n, m = angle.shape
        return pd.DataFrame(
            {
                "qid": np.repeat(part["qid"].to_numpy(), m),
                "counted": np.repeat(part["counted"].to_numpy(), m),
                "intent": np.repeat(part["intent"].to_numpy(dtype=object), m),
                "node": np.tile(near["child"].to_numpy(), n),
                "leaf": np.tile(near["leaf"].to_numpy(), n),
                "copies": np.tile(near["copies"].to_numpy(), n),
                "high": np.cos(np.maximum(angle - radius, 0.0)).ravel(),
                "low": np.cos(np.minimum(angle + radius, np.pi)).ravel(),
            }
        )

    columns = ["qid", "counted", "intent", "node", "leaf", "copies", "high", "low"]
    kind = dict(queries.dtypes)["qid"]
    schema = (
        f"qid {kind}, counted boolean, intent string, node long, leaf boolean, copies long, "
        "high double, low double"
    )
    below = index.nodes.filter("parent > 0").select(
        F.col("parent").alias("node"), F.col("node").alias("child"), "pivot", "radius", "leaf", "copies"
    )
    there = at.join(queries.select("qid", "intent", "embedding"), "qid")
    sizes = at.groupBy("node").agg(F.count("*").alias("n"))
    met = _meet(there, below, sizes, CHUNK, "qid", angles, schema)
    same = index.intents.withColumnRenamed("case_intent", "intent")
    joined = met.join(same, ["node", "intent"], "left")
    bonus = F.when(F.col("of_intent").isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    relevant = F.when(F.col("intent").isNull(), F.col("copies")).otherwise(
        F.coalesce("of_intent", F.lit(0))
    )
    return joined.select(
        "qid", "counted", "intent", "node", "leaf", "high", "low",
        (F.col("high") + bonus).alias("bound"), relevant.alias("relevant"),
    )


def _best(q: pd.DataFrame, c: pd.DataFrame, k: int, weight: float) -> pd.DataFrame:
    """The best k of a block for each query, the block's hits on the first of them."""
    c = cells.by_first_id(c)
    asked, have = _unit(q["embedding"]), _unit(c["vector"]).T
    return cells.best_cases(q, c, lambda s: asked[s] @ have, k, weight)


def _score_cells(queries: DataFrame, index: DenseIndex, k: int, weight: float) -> DataFrame:
    """All queries with all cases: k rows per query for what a task meets, the hits on the first."""
    right = index.placed.select(
        "gid", "first_id", "copies", "case_intent", F.col("embedding").alias("vector")
    )
    kind, id_kind = dict(queries.dtypes)["qid"], dict(right.dtypes)["first_id"]
    schema = f"qid {kind}, gid string, first_id {id_kind}, sim double, final double, hits long"
    return cells.meet(
        queries, "qid", cells.parts(queries.count(), CELL_ROWS), right, "gid",
        cells.parts(right.count(), CELL_ROWS),
        lambda q, c: _best(q, c, k, weight), schema, lambda found: cells.best_of(found, k),
    )


def _score(
    visits: DataFrame, queries: DataFrame, index: DenseIndex, k: int, intent_weight: float
) -> DataFrame:
    """Score (qid, node, counted) visits of leaves block by block: k candidate rows per query and
    block, the hits of the block on the first of them, none where they are counted already."""
    load = visits.groupBy("node").agg(
        F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks")
    )
    blocks = F.ceil(F.col("groups") / F.lit(index.block_rows)).cast("int")
    plan = load.join(index.nodes.filter("leaf").select("node", blocks.alias("blocks")), "node")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        visits.join(plan, "node")
        .withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
        .withColumn("block", each("blocks"))
        .join(queries.select("qid", "intent", "embedding"), "qid")
        .select("node", "block", "chunk", "qid", "intent", "embedding", "counted")
    )
    right = (
        index.placed.join(plan, "node")
        .withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
        .withColumn("chunk", each("chunks"))
        .select(
            "node", "block", "chunk", "gid", "first_id", "copies", "case_intent",
            F.col("embedding").alias("vector"),
        )
    )

    def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        columns = ["qid", "gid", "first_id", "sim", "final", "hits"]
        if q.empty or c.empty:
            return pd.DataFrame(columns=columns)
        out = _best(q, c, k, intent_weight)
        counted = q["qid"][q["counted"].to_numpy(dtype=bool)]
        return out.assign(hits=out["hits"].mask(out["qid"].isin(counted), 0))

    kinds = dict(queries.dtypes)
    id_kind = dict(index.placed.dtypes)["first_id"]
    schema = (
        f"qid {kinds['qid']}, gid string, first_id {id_kind}, sim double, final double, hits long"
    )
    return _cogroup(left, right, ["node", "block", "chunk"], block, schema)


def _first_leaf(start: DataFrame, asked: DataFrame, index: DenseIndex, weight: float) -> DataFrame:
    """(qid, node, level): the leaf at the end of each query's most promising way."""
    at, leaves = start, None
    for level in range(1, index.depth):
        best = F.row_number().over(
            Window.partitionBy("qid").orderBy(F.desc("bound"), F.asc("node"))
        )  # the children of one node
        step = materialize(
            _children(at, asked, index, weight).withColumn("nth", best).filter("nth = 1"),
            "dense-step",
        ).select("qid", "counted", "node", "leaf")
        ended = step.filter("leaf").select("qid", "node", F.lit(level).alias("level"))
        leaves = ended if leaves is None else leaves.unionByName(ended)
        at = step.filter(~F.col("leaf")).select("qid", "node", "counted")
    return leaves if leaves is not None else start.select("qid", "node", F.lit(0).alias("level"))


def _open_leaves(
    start: DataFrame, first: DataFrame, kth: DataFrame, asked: DataFrame, index: DenseIndex,
    k: int, weight: float,
) -> tuple[DataFrame, list[DataFrame]] | None:
    """Leaves (qid, node, counted) that can still change a query's top k or hits, and
    (qid, hits) of nodes counted as a whole. `first`: the leaf each query looked into. None if
    a level leaves more than OPEN_NODES nodes a query open: its children are not looked at."""
    at, leaves, sure = start, None, []
    most = OPEN_NODES * asked.count()
    known = first.select("qid", F.col("node").alias("seen"), F.col("level").alias("seen_level"))
    for level in range(1, index.depth):
        any_ = ~F.col("counted") & (F.col("relevant") > 0)
        # The node of this level that the leaf looked into lies below; its hits are counted.
        above = F.expr(f"seen div cast(pow({index.fan}, greatest(seen_level - {level}, 0)) as bigint)")
        on_way = (F.col("seen_level") >= level) & (above == F.col("node"))
        whole = any_ & ~on_way & (F.col("low") >= packs.HIT_SIMILARITY + EPS)
        some = any_ & (F.col("high") >= packs.HIT_SIMILARITY - EPS)
        judged = (
            _children(at, asked, index, weight)
            .join(kth, "qid", "left")
            .join(known, "qid")
            .filter(F.col("seen") != F.col("node"))
            .withColumns({
                "near": (F.coalesce("n", F.lit(0)) < k) | (F.col("bound") >= F.col("kth") - EPS),
                "whole": whole, "some": some,
            })
            .filter(F.col("near") | F.col("some"))
        )
        judged = materialize(judged, "dense-judged")
        sure.append(judged.filter("whole").select("qid", F.col("relevant").alias("hits")))
        on = judged.filter(F.col("near") | ~F.col("whole")).select(
            "qid", "node", (F.col("counted") | F.col("whole")).alias("counted"), "leaf"
        )
        if on.count() > most:
            return None
        ended = on.filter("leaf").drop("leaf")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        at = on.filter(~F.col("leaf")).drop("leaf")
    return leaves, sure


def dense_retrieve(
    queries: DataFrame,
    index: DenseIndex,
    k: int = 3,
    intent_weight: float = packs.INTENT_WEIGHT,
) -> DataFrame:
    """Long form (query_id, predicted_intent, rank, case_id, case_intent, similarity,
    final_score, relevant_hit_count) of queries (query_id, embedding, intent), with the texts of
    the cases if the index has them: then the columns are those of the sparse `retrieve`. A
    query without an embedding has no rows."""
    asked = materialize(
        queries.filter(F.col("embedding").isNotNull()).select(
            F.col("query_id").alias("qid"), "embedding", F.col("intent").cast("string").alias("intent")
        ),
        "dense-queries",
    )
    no = F.lit(False).alias("counted")
    start = asked.select("qid", F.lit(ROOT).cast("long").alias("node"), no)
    first = materialize(_first_leaf(start, asked, index, intent_weight), "dense-first-leaf")
    found = materialize(
        _score(first.select("qid", "node", no), asked, index, k, intent_weight),
        "dense-first",
    )
    hit_rows = [found.select("qid", "hits")]
    if index.depth > 1:
        best = smallest_per_group(found.select("qid", "final"), ["qid"], [F.desc("final")], k)
        kth = best.groupBy("qid").agg(F.count("*").alias("n"), F.min("final").alias("kth"))
        open_ = _open_leaves(start, first, kth, asked, index, k, intent_weight)
        if open_ is None:
            found = materialize(_score_cells(asked, index, k, intent_weight), "dense-cells")
            hit_rows = [found.select("qid", "hits")]
        else:
            leaves, sure = open_
            second = materialize(
                _score(materialize(leaves, "dense-leaves"), asked, index, k, intent_weight),
                "dense-second",
            )
            found = found.unionByName(second)
            hit_rows += [second.select("qid", "hits"), *sure]
    hits = hit_rows[0]
    for more in hit_rows[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("qid").agg(F.sum("hits").alias("relevant_hit_count"))
    order = [F.desc(F.round("final", 9))]
    near = materialize(
        smallest_per_group(found, ["qid"], [*order, F.asc("first_id")], k), "dense-near"
    )
    expanded = (
        near.join(index.groups.select("gid", "case_intent"), "gid")
        .join(first_ids(index.cases, near, k), "gid")
        .select("qid", "sim", "final", "case_intent", "case_id")
    )
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order, F.asc("case_id")))
    ranked = expanded.withColumn("rank", rank).filter(F.col("rank") <= k)
    if index.texts:
        ranked = ranked.join(index.cases.select("case_id", *index.texts), "case_id")
    return (
        ranked.join(hits, "qid")
        .join(asked.select("qid", F.col("intent").alias("predicted_intent")), "qid")
        .select(
            F.col("qid").alias("query_id"),
            "predicted_intent",
            "rank",
            "case_id",
            "case_intent",
            *index.texts,
            F.col("sim").alias("similarity"),
            F.col("final").alias("final_score"),
            F.col("relevant_hit_count").cast("bigint").alias("relevant_hit_count"),
        )
    )
