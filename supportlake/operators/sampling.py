"""Seeded samples, splits and first-n rows.

The order of a sample is md5(seed|id): the same rows on every engine and every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import packs


def sample_key(seed: int, id_col: str | Column) -> Column:
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), col.cast("string")))


def smallest_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """The first n rows of each group.

    `row_number() <= n` lets Spark cut every partition to n rows per group before the
    shuffle, so a group of any size sends only n rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def tier_sample(graded: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """At most n random threads per tier."""
    keyed = graded.withColumn("sample_key", sample_key(seed, "thread_id"))
    return smallest_per_group(
        keyed, ["tier"], [F.col("sample_key"), F.col("thread_id")], n
    ).drop("sample_key")


def strata_counts(
    queries: DataFrame, intents: Sequence[str], intent: str = "intent", tier: str = "tier"
) -> DataFrame:
    """Available rows per intent and tier, intents without rows kept."""
    dimension = queries.sparkSession.createDataFrame([(i,) for i in intents], f"{intent} string")
    counts = queries.groupBy(intent).agg(
        F.count_if(F.col(tier) == packs.USABLE).alias("usable_available"),
        F.count_if(F.col(tier) == packs.PARTIAL).alias("partially_available"),
    )
    return dimension.join(counts, intent, "left").fillna(
        0, ["usable_available", "partially_available"]
    )


def quotas(strata: DataFrame, n_intents: int, target_total: int = 198) -> DataFrame:
    """Rows to draw per intent and tier."""
    per_intent = max(15, target_total // n_intents)
    usable_goal = max(3, int(per_intent * 0.35))
    return strata.withColumn(
        "usable_quota", F.least("usable_available", F.lit(usable_goal))
    ).withColumn(
        "partially_quota",
        F.least("partially_available", F.lit(per_intent) - F.col("usable_quota")),
    )


def _ranked_by_quota(
    queries: DataFrame, quota: DataFrame, max_quota: int, seed: int
) -> DataFrame:
    """Rows drawn within their stratum's quota. No quota exceeds `max_quota`, so each task
    sends that many rows per stratum at most."""
    keyed = queries.withColumn("sample_key", sample_key(seed, "tweet_id"))
    rank = F.row_number().over(
        Window.partitionBy("intent", "tier").orderBy("sample_key", "tweet_id")
    )
    short = keyed.withColumn("_rank", rank).filter(F.col("_rank") <= max_quota)
    return short.join(quota, ["intent", "tier"]).filter(F.col("_rank") <= F.col("quota"))


def golden_sample(
    queries: DataFrame, intents: Sequence[str], target_total: int = 198, seed: int = 42
) -> DataFrame:
    """Blind evaluation sheet: rows drawn by intent and tier, label columns blank.

    `queries` has thread_id, tweet_id, raw_text, tier, intent.
    """
    wide = quotas(strata_counts(queries, intents), len(intents), target_total)
    quota = wide.select(
        "intent",
        F.explode(
            F.array(
                F.struct(F.lit(packs.USABLE).alias("tier"), F.col("usable_quota").alias("quota")),
                F.struct(
                    F.lit(packs.PARTIAL).alias("tier"), F.col("partially_quota").alias("quota")
                ),
            )
        ).alias("q"),
    ).select("intent", "q.tier", "q.quota")
    drawn = _ranked_by_quota(queries, quota, max(15, target_total // len(intents)), seed)
    blank = [F.lit("").alias(c) for c in packs.GOLDEN_COLUMNS[3:10]]
    return (
        drawn.orderBy("sample_key", "tweet_id")
        .limit(target_total)
        .select(
            "thread_id",
            "tweet_id",
            F.col("raw_text").alias("customer_message"),
            *blank,
            F.col("tier").alias("evidence_tier"),
            F.col("intent").alias("model_suggested_intent"),
        )
    )


def sampling_log(
    queries: DataFrame, intents: Sequence[str], target_total: int = 198
) -> DataFrame:
    """Available and drawn rows per intent, and the size of the whole sample."""
    wide = quotas(strata_counts(queries, intents), len(intents), target_total)
    drawn = F.col("usable_quota") + F.col("partially_quota")
    everything = Window.partitionBy()  # one row per intent
    return wide.select(
        "intent",
        "usable_available",
        "partially_available",
        drawn.alias("allocated"),
        F.least(F.sum(drawn).over(everything), F.lit(target_total)).alias("actual_sampled_total"),
    )


def split_quota(counts: DataFrame, label: str, test_share: float = 0.2) -> DataFrame:
    """Test rows per class: shares of ceil(test_share * n), largest remainders rounded up."""
    everything = Window.partitionBy()  # one row per class
    total = F.sum("n").over(everything)
    exact = F.col("n") * F.ceil(total * F.lit(test_share)) / total
    ranked = counts.select(
        label,
        "n",
        F.ceil(total * F.lit(test_share)).alias("_goal"),
        F.floor(exact).alias("_base"),
        F.round(exact - F.floor(exact), 9).alias("_rest"),
    )
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rest"), F.asc(label)))
    missing = F.col("_goal") - F.sum("_base").over(everything)
    extra = F.when(place <= missing, F.lit(1)).otherwise(F.lit(0))
    return ranked.select(label, "n", (F.col("_base") + extra).alias("test_quota"))


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `split`, `train` or `test`, with exact test sizes per class.

    The cut of a class is found without putting the class into one task: rows are counted per
    class and md5 prefix, 65,536 buckets a class, and ranked within their bucket only.
    """
    keyed = df.withColumn("_key", sample_key(seed, id_col)).withColumn(
        "_bucket", F.substring("_key", 1, 4)
    )
    per_bucket = keyed.groupBy(label, "_bucket").agg(F.count("*").alias("_in"))
    classes = per_bucket.groupBy(label).agg(F.sum("_in").alias("n"))
    quota = split_quota(classes, label, test_share).drop("n")
    running = Window.partitionBy(label).orderBy("_bucket")  # at most 65,536 buckets a class
    cut = (
        per_bucket.join(quota, label)
        .withColumn("_before", F.sum("_in").over(running) - F.col("_in"))
        .withColumn("_take", F.col("test_quota") - F.col("_before"))
        .select(label, "_bucket", "_take")
    )
    rank = F.row_number().over(
        Window.partitionBy(label, "_bucket").orderBy("_key", F.col(id_col))
    )
    test = rank <= F.col("_take")
    columns = [c for c in df.columns if c != "split"]
    return (
        keyed.join(cut, [label, "_bucket"])
        .withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))
        .select(*columns, "split")
    )
