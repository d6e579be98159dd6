"""Reply graph to conversation threads.

A message table has tweet_id, author_id, inbound, created_at, text, parent_id, ord; ids are
unique (see `last_version`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions.text import nvl
from supportlake.session import materialize

MAX_ROUNDS = 64  # chains of up to 2^64 messages; the walk stops by itself long before


def reply_edges(messages: DataFrame) -> DataFrame:
    """Adjacency as edges: one row per reply, whether or not the parent is in the table."""
    return messages.filter(F.col("parent_id").isNotNull()).select(
        "parent_id", F.col("tweet_id").alias("child_id"), "ord"
    )


def reply_fanout(messages: DataFrame) -> DataFrame:
    """Per parent: how many replies, and the first one in file order.

    Both are partial aggregates, so a parent with very many replies is combined map-side.
    """
    first = F.min_by("child_id", F.struct("ord", "child_id"))
    return (
        reply_edges(messages)
        .groupBy("parent_id")
        .agg(F.count("*").alias("n_replies"), first.alias("primary_child"))
    )


def primary_edges(messages: DataFrame) -> DataFrame:
    """(parent_id, child_id): each present parent's first reply. Unique on either side."""
    present = messages.select(F.col("tweet_id").alias("parent_id"))
    return (
        reply_fanout(messages)
        .join(present, "parent_id", "left_semi")
        .select("parent_id", F.col("primary_child").alias("child_id"))
    )


def thread_roots(messages: DataFrame) -> DataFrame:
    """Inbound messages whose parent is null or not in the table."""
    present = messages.select(F.col("tweet_id").alias("parent_id"))
    inbound = messages.filter(F.col("inbound"))
    # Messages without a parent are no part of the join: they would all be one key of it.
    starts = inbound.filter(F.col("parent_id").isNull()).select("tweet_id")
    orphans = inbound.filter(F.col("parent_id").isNotNull()).join(present, "parent_id", "left_anti")
    return starts.unionByName(orphans.select("tweet_id"))


def walk(messages: DataFrame) -> DataFrame:
    """(tweet_id, root_id, turn_no) of every message on a thread, turn 1 being the root.

    Pointer doubling over primary edges: after round r a message knows its ancestor 2^r steps
    up. Open pointers of one chain are distinct, and finished messages do not take part, so no
    join key repeats. Each round works on the open rest only. A branch that hangs below no
    root loses its pointer and drops out; a cycle never finishes and is left behind once a
    round finishes nobody.
    """
    roots = thread_roots(messages).select(
        "tweet_id",
        F.col("tweet_id").alias("ptr"),
        F.lit(0).cast("bigint").alias("dist"),
        F.lit(True).alias("done"),
    )
    steps = primary_edges(messages).select(
        F.col("child_id").alias("tweet_id"),
        F.col("parent_id").alias("ptr"),
        F.lit(1).cast("bigint").alias("dist"),
        F.lit(False).alias("done"),
    )
    start = materialize(roots.unionByName(steps), "walk")
    finished = [start.filter("done")]
    active = start.filter(~F.col("done"))
    nodes = start
    for _ in range(MAX_ROUNDS):
        target = nodes.select(
            F.col("tweet_id").alias("ptr"),
            F.col("ptr").alias("next"),
            F.col("dist").alias("more"),
            F.col("done").alias("ends"),
        )
        moved = active.join(target, "ptr").select(
            "tweet_id",
            F.col("next").alias("ptr"),
            (F.col("dist") + F.col("more")).alias("dist"),
            F.col("ends").alias("done"),
        )
        moved = materialize(moved, "walk")
        counts = {r["done"]: r["count"] for r in moved.groupBy("done").count().collect()}
        if counts.get(True):
            finished.append(moved.filter("done"))
        if not counts.get(True) or not counts.get(False):
            break
        active = moved.filter(~F.col("done"))
        nodes = active
        for part in finished:
            nodes = nodes.unionByName(part)
    else:
        raise RuntimeError(f"a reply chain did not end within {MAX_ROUNDS} doublings")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.select(
        "tweet_id", F.col("ptr").alias("root_id"), (F.col("dist") + 1).alias("turn_no")
    )


def speaker(brand: str, ignore_case: bool = False) -> Column:
    """`brand` if the brand wrote it or it is outbound, else `customer`."""
    author = F.lower("author_id") if ignore_case else F.col("author_id")
    by_brand = author == (brand.lower() if ignore_case else brand)
    return F.when(by_brand | ~F.col("inbound"), F.lit("brand")).otherwise(F.lit("customer"))


def _turns(steps: DataFrame, messages: DataFrame, brand: str, ignore_case: bool) -> DataFrame:
    return steps.join(messages, "tweet_id").select(
        F.col("root_id").cast("string").alias("thread_id"),
        "turn_no",
        "tweet_id",
        "author_id",
        speaker(brand, ignore_case).alias("speaker"),
        "created_at",
        nvl(F.col("text")).alias("text"),
    )


def walked_turns(messages: DataFrame, brand: str, ignore_case: bool = False) -> DataFrame:
    """Every message on a thread with its thread and turn number, one-sided threads included."""
    return _turns(walk(messages), messages, brand, ignore_case)


def two_sided(steps: DataFrame, messages: DataFrame, brand: str, ignore_case: bool) -> DataFrame:
    """Roots of threads with at least one customer and one brand turn. Reads no texts."""
    who = messages.select("tweet_id", speaker(brand, ignore_case).alias("speaker"))
    sides = (
        steps.join(who, "tweet_id")
        .groupBy("root_id")
        .agg(
            F.bool_or(F.col("speaker") == "customer").alias("c"),
            F.bool_or(F.col("speaker") == "brand").alias("b"),
        )
    )
    return sides.filter("c AND b").select("root_id")


def thread_turns(messages: DataFrame, brand: str, ignore_case: bool = False) -> DataFrame:
    """Turns of the threads both sides took part in, one row per turn.

    One-sided threads are sorted out on ids alone; texts are joined to what is left.
    """
    steps = walk(messages)
    kept = steps.join(two_sided(steps, messages, brand, ignore_case), "root_id", "left_semi")
    return _turns(kept, messages, brand, ignore_case)


def thread_endpoints(turns: DataFrame) -> DataFrame:
    """One row per thread: size, root message, first and last texts per speaker, last turn.

    Only min/max aggregates, so a thread of any length is combined map-side.
    """
    of_customer = F.when(F.col("speaker") == "customer", F.col("turn_no"))
    of_brand = F.when(F.col("speaker") == "brand", F.col("turn_no"))
    root = F.struct("tweet_id", "author_id", "text")
    last = F.struct("speaker", "text")
    return (
        turns.groupBy("thread_id")
        .agg(
            F.count("*").alias("turns_count"),
            F.count(of_customer).alias("customer_turns"),
            F.count(of_brand).alias("brand_turns"),
            F.min_by(root, F.col("turn_no")).alias("root"),
            F.min_by(F.col("text"), of_customer).alias("first_customer_text"),
            F.max_by(F.col("text"), of_customer).alias("last_customer_text"),
            F.min_by(F.col("text"), of_brand).alias("first_brand_text"),
            F.max_by(F.col("text"), of_brand).alias("last_brand_text"),
            F.max_by(last, F.col("turn_no")).alias("last"),
        )
        .select(
            "thread_id",
            "turns_count",
            "customer_turns",
            "brand_turns",
            F.col("root.tweet_id").alias("tweet_id"),
            F.col("root.author_id").alias("author_id"),
            F.col("root.text").alias("root_text"),
            "first_customer_text",
            "last_customer_text",
            "first_brand_text",
            "last_brand_text",
            F.col("last.speaker").alias("last_speaker"),
            F.col("last.text").alias("last_text"),
        )
    )


def nest_threads(turns: DataFrame, graded: DataFrame, brand: str) -> DataFrame:
    """The nested record of the JSON files: messages as an ordered array.

    A record holds its whole thread, as that file format asks; use the turn table for
    everything else.
    """
    message = F.struct("turn_no", "tweet_id", "author_id", "speaker", "created_at", "text")
    nested = turns.groupBy("thread_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    fields = ["tweet_id", "author_id", "speaker", "created_at", "text"]
    return nested.join(graded.select("thread_id", "tier", "reason"), "thread_id").select(
        "thread_id",
        F.lit(brand).alias("brand"),
        F.size("m").alias("turns_count"),
        F.transform("m", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("messages"),
        F.col("reason").alias("quality_reason"),
        F.col("tier").alias("quality_label"),
    )


def unnest_threads(threads: DataFrame) -> DataFrame:
    """Turn table of nested thread records."""
    return threads.select(
        "thread_id", F.posexplode("messages").alias("pos", "m")
    ).select(
        "thread_id",
        (F.col("pos") + 1).cast("bigint").alias("turn_no"),
        "m.tweet_id",
        "m.author_id",
        "m.speaker",
        "m.created_at",
        nvl(F.col("m.text")).alias("text"),
    )


def lookup_threads(graded: DataFrame, thread_ids: list[str]) -> DataFrame:
    """Graded threads with the given ids, with their closing text."""
    return graded.filter(F.col("thread_id").isin(thread_ids)).select(
        "thread_id",
        F.col("tier").alias("quality_label"),
        F.col("reason").alias("quality_reason"),
        F.col("last_text").alias("closing_text"),
    )
