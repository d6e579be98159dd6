"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import materialize


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end to its smaller one."""
    return (
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least node it knows."""
    both = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionAll(
        e.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
    )
    least = both.groupBy("n").agg(F.min("m").alias("least")).select(
        "n", F.least("n", "least").alias("least")
    )
    return (
        both.filter(F.col("m") > F.col("n"))
        .join(least, "n")
        .select(F.col("m").alias("hi"), F.col("least").alias("lo"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = (
        e.join(least, "hi")
        .filter(F.col("lo") != F.col("least"))
        .select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    )
    return moved.unionAll(least.select("hi", F.col("least").alias("lo"))).distinct()


def _mark(e: DataFrame) -> tuple:
    row = e.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node that
    can be reached. Nodes without an edge to another node are not returned.

    Each round is a few equi-joins and minima per node; the table of a round is written, so the
    plan stays short and a lost executor costs a re-read. A round that changes nothing ends it;
    on n nodes that takes about log(n)^2 rounds at most. A hub is one key of a join only, which
    AQE splits, its minimum is pre-aggregated.
    """
    e = materialize(_down(edges), "edges")
    mark = _mark(e)
    while mark[0]:
        e = materialize(_small_star(_large_star(e)), "star")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
