"""Rule-made intent labels and topic counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.rules import RulePack, first_match, matches
from supportlake.functions.text import preview
from supportlake.operators.quality import share
from supportlake.operators.sampling import smallest_per_group


def weak_intent(df: DataFrame, text: str, pack: RulePack) -> DataFrame:
    """Add intent and label_confidence.

    No match: the fallback at 0.5. One match: that intent at 1.0. Several: the first in
    priority order at 0.8.
    """
    tested = df.select(
        "*",
        *[
            matches(F.col(text), alts).alias(f"_hit{i}")
            for i, alts in enumerate(pack.intents.values())
        ],
    )
    position = {label: i for i, label in enumerate(pack.intents)}
    hits = sum((F.col(f"_hit{i}").cast("int") for i in position.values()), F.lit(0))
    by_priority = F.coalesce(
        *[
            F.when(F.col(f"_hit{position[label]}"), F.lit(label))
            for label in pack.intent_order()
        ],
        F.lit(pack.fallback),
    )
    return tested.select(
        *[c for c in df.columns if c not in ("intent", "label_confidence")],
        by_priority.alias("intent"),
        F.when(hits == 0, F.lit(0.5))
        .when(hits == 1, F.lit(1.0))
        .otherwise(F.lit(0.8))
        .alias("label_confidence"),
    )


def keyword_intent(text: Column, pack: RulePack) -> Column:
    """First matching keyword intent, else the fallback."""
    return first_match(F.lower(text), pack.keywords, pack.fallback)


def keyword_confidence(intent_hit: Column) -> Column:
    return F.when(intent_hit, F.lit(packs.KEYWORD_CONFIDENCE)).otherwise(
        F.lit(packs.KEYWORD_DEFAULT_CONFIDENCE)
    )


def add_keyword_intent(df: DataFrame, text: str, pack: RulePack) -> DataFrame:
    """Add intent and intent_confidence by keyword."""
    label = first_match(F.lower(F.col(text)), pack.keywords, "")
    return df.withColumn("_label", label).select(
        *[c for c in df.columns if c not in ("intent", "intent_confidence")],
        F.when(F.col("_label") == "", F.lit(pack.fallback))
        .otherwise(F.col("_label"))
        .alias("intent"),
        keyword_confidence(F.col("_label") != "").alias("intent_confidence"),
    )


def topic(text: Column, pack: RulePack) -> Column:
    """First matching topic, on the raw text."""
    return first_match(text, pack.topics, packs.OTHER_TOPIC)


def topic_distribution(
    df: DataFrame, text: str, id_col: str, pack: RulePack, samples: int = 3, width: int = 110
) -> DataFrame:
    """Count, share (1 dp) and the first few sample texts per topic."""
    labelled = df.select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), topic(F.col(text), pack).alias("topic")
    )
    counts = labelled.groupBy("topic").agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per topic of the pack
    counts = counts.select(
        "topic",
        F.col("n").alias("threads"),
        share(F.col("n"), F.sum("n").over(everything), 1).alias("pct"),
    )
    firsts = (
        smallest_per_group(labelled, ["topic"], [F.col("id")], samples)
        .groupBy("topic")
        .agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("rows"))
        .select(
            "topic",
            F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias(
                "sample_ids"
            ),
            F.array_join(F.transform("rows", lambda r: preview(r["text"], width)), " | ").alias(
                "sample_texts"
            ),
        )
    )
    return counts.join(firsts, "topic")


def label_distribution(df: DataFrame, label: str = "intent") -> DataFrame:
    """Rows and share (1 dp) per label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per label
    return counts.select(
        label, "n", share(F.col("n"), F.sum("n").over(everything), 1).alias("pct")
    )


def class_weights(df: DataFrame, label: str = "intent") -> DataFrame:
    """Balanced weights: n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per class
    return counts.select(
        label,
        "n",
        (
            F.sum("n").over(everything)
            / (F.count("*").over(everything) * F.col("n"))
        ).alias("weight"),
    )
