"""Classification, escalation, safety and rubric metrics over stacked predictions.

A prediction table is long: (system, id, gold..., pred...). Every metric groups by system.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.text import nvl, safe_ratio
from supportlake.operators.sampling import smallest_per_group


def pair_gold(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Gold rows with each system's prediction, by key."""
    return predictions.join(gold, key)


def labelled_rows(sheet: DataFrame) -> DataFrame:
    """Rows of the evaluation sheet with both gold fields filled."""
    return sheet.filter(
        (nvl(F.col("gold_intent")) != "") & (nvl(F.col("gold_auto_or_escalate")) != "")
    )


def class_list(df: DataFrame, label: str) -> DataFrame:
    """The distinct labels, sorted."""
    return df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label)


def cell_counts(pairs: DataFrame, gold: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Pairs per (by, gold, pred). All other metrics are built on this small table."""
    return pairs.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def _label_dimension(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    return pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")


def confusion_matrix(
    pairs: DataFrame, gold: str, pred: str, labels: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Long matrix (by, gold, pred, n) in label order, zero cells kept."""
    cells = cell_counts(pairs, gold, pred, by)
    groups = cells.select(*by).distinct() if by else None
    names = F.array(*[F.lit(x) for x in labels])
    frame = groups if by else pairs.sparkSession.range(1).select()
    frame = frame.select("*", F.explode(names).alias("gold")).select(
        "*", F.explode(names).alias("pred")
    )
    return frame.join(cells, [*by, "gold", "pred"], "left").fillna(0, ["n"])


def confusion_wide(
    pairs: DataFrame, gold: str, pred: str, labels: Sequence[str]
) -> DataFrame:
    """One row per gold label, one column per predicted label."""
    matrix = confusion_matrix(pairs, gold, pred, labels)
    return matrix.groupBy("gold").pivot("pred", list(labels)).agg(F.sum("n"))


def _per_class(
    pairs: DataFrame, gold: str, pred: str, labels: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Unrounded (by, label, precision, recall, f1, support), absent classes 0."""
    cells = cell_counts(pairs, gold, pred, by)
    side = F.explode(
        F.array(
            F.struct(
                F.col("gold").alias("label"),
                F.col("n").alias("support"),
                F.lit(0).cast("bigint").alias("predicted"),
                F.when(F.col("gold") == F.col("pred"), F.col("n"))
                .otherwise(F.lit(0))
                .alias("tp"),
            ),
            F.struct(
                F.col("pred").alias("label"),
                F.lit(0).cast("bigint").alias("support"),
                F.col("n").alias("predicted"),
                F.lit(0).cast("bigint").alias("tp"),
            ),
        )
    )
    sums = (
        cells.select(*by, side.alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
            F.sum("s.tp").alias("tp"),
        )
    )
    names = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    frame = (
        cells.select(*by).distinct().select("*", names)
        if by
        else _label_dimension(pairs, labels)
    )
    full = frame.join(sums, [*by, "label"], "left").fillna(0, ["support", "predicted", "tp"])
    precision = safe_ratio(F.col("tp"), F.col("predicted"))
    recall = safe_ratio(F.col("tp"), F.col("support"))
    rated = full.select(
        *by, "label", "support", precision.alias("precision"), recall.alias("recall")
    )
    f1 = safe_ratio(
        2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
    )
    return rated.withColumn("f1", f1)


def class_metrics(
    pairs: DataFrame,
    gold: str,
    pred: str,
    labels: Sequence[str] = packs.INTENTS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 (4 dp) and support per label."""
    return _per_class(pairs, gold, pred, labels, by).select(
        *by,
        "label",
        *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")],
        "support",
    )


def overall_metrics(
    pairs: DataFrame,
    gold: str,
    pred: str,
    labels: Sequence[str] = packs.INTENTS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows, accuracy, macro means over the full label list, support-weighted F1 (4 dp)."""
    per_class = _per_class(pairs, gold, pred, labels, by)
    weighted = F.sum(F.col("f1") * F.col("support"))
    means = per_class.groupBy(*by).agg(
        F.round(F.avg("precision"), 4).alias("macro_precision"),
        F.round(F.avg("recall"), 4).alias("macro_recall"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.round(safe_ratio(weighted, F.sum("support")), 4).alias("weighted_f1"),
    )
    right = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0)))
    accuracy = (
        cell_counts(pairs, gold, pred, by)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("rows"),
            F.round(safe_ratio(right, F.sum("n")), 4).alias("accuracy"),
        )
    )
    if by:
        return accuracy.join(means, list(by))
    one = F.lit(1).alias("_one")
    return (
        accuracy.select("*", one).join(means.select("*", one), "_one").drop("_one")
    )


def escalation_metrics(
    pairs: DataFrame, gold: str, pred: str, by: Sequence[str] = ("system",)
) -> DataFrame:
    """False auto-handle and false escalation rates, accuracy, per-action scores (4 dp)."""

    def count(g: str, p: str) -> Column:
        return F.count_if((F.col(gold) == g) & (F.col(pred) == p))

    a, e = packs.AUTO, packs.ESCALATE
    counts = pairs.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(gold) == F.col(pred)).alias("right"),
        count(a, a).alias("aa"),
        count(e, e).alias("ee"),
        count(e, a).alias("false_auto_handle_count"),
        count(a, e).alias("false_escalation_count"),
        F.count_if(F.col(gold) == a).alias("auto_support"),
        F.count_if(F.col(gold) == e).alias("escalate_support"),
        F.count_if(F.col(pred) == a).alias("auto_predicted"),
        F.count_if(F.col(pred) == e).alias("escalate_predicted"),
    )

    def scores(hit: str, name: str) -> list[Column]:
        p = safe_ratio(F.col(hit), F.col(f"{name}_predicted"))
        r = safe_ratio(F.col(hit), F.col(f"{name}_support"))
        return [
            F.round(p, 4).alias(f"{name}_precision"),
            F.round(r, 4).alias(f"{name}_recall"),
            F.round(safe_ratio(2.0 * p * r, p + r), 4).alias(f"{name}_f1"),
            F.col(f"{name}_support"),
        ]

    return counts.select(
        *by,
        F.round(safe_ratio(F.col("right"), F.col("rows")), 4).alias("escalation_accuracy"),
        F.round(
            safe_ratio(F.col("false_auto_handle_count"), F.col("escalate_support")), 4
        ).alias("false_auto_handle_rate"),
        "false_auto_handle_count",
        F.round(safe_ratio(F.col("false_escalation_count"), F.col("auto_support")), 4).alias(
            "false_escalation_rate"
        ),
        "false_escalation_count",
        *scores("aa", "auto"),
        *scores("ee", "escalate"),
    )


def safety_summary(audited: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Unsafe replies and their rate (4 dp)."""
    unsafe = F.count_if(~F.col("is_safe"))
    return audited.groupBy(*by).agg(
        F.count("*").alias("rows"),
        unsafe.alias("safety_violations_count"),
        F.round(safe_ratio(unsafe, F.count("*")), 4).alias("safety_violation_rate"),
    )


def judge_summary(scored: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Mean rubric scores (2 dp)."""
    names = ["groundedness", "relevance", "safety", "escalation"]

    def mean(col: str, name: str) -> Column:
        return F.round(F.coalesce(F.avg(col), F.lit(0.0)), 2).alias(f"mean_{name}")

    return scored.groupBy(*by).agg(
        F.count("*").alias("count"),
        *[mean(f"{n}_score", n) for n in names],
        mean("overall_score", "overall"),
    )


def score_histogram(scored: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Rows per rubric dimension and score."""
    names = ["groundedness", "relevance", "safety", "escalation"]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("dimension"), F.col(f"{n}_score").alias("score"))
            for n in names
        ]
    )
    return (
        scored.select(*by, F.explode(cells).alias("c"))
        .groupBy(*by, "c.dimension", "c.score")
        .agg(F.count("*").alias("n"))
    )


def benchmark_table(
    pairs: DataFrame, labels: Sequence[str] = packs.INTENTS
) -> DataFrame:
    """One row per system: intent, escalation and safety metrics.

    `pairs` has system, gold_intent, intent, gold_auto_or_escalate, decision, is_safe. The
    intent columns of all metrics come from one small count table per system.
    """
    intent = overall_metrics(pairs, "gold_intent", "intent", labels, by=["system"])
    action = escalation_metrics(pairs, "gold_auto_or_escalate", "decision")
    return intent.join(action, "system").join(safety_summary(pairs).drop("rows"), "system")


def agreement_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Rows per pair of labels with share of all (2 dp) and an agreement flag."""
    counts = pairs.groupBy(left, right).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per pair of labels
    return counts.select(
        left,
        right,
        "n",
        (F.col(left) == F.col(right)).alias("agrees"),
        F.round(F.col("n") * 100.0 / F.sum("n").over(everything), 2).alias("pct"),
    )


def agreement_rate(pairs: DataFrame, left: str, right: str) -> DataFrame:
    same = F.count_if(F.col(left) == F.col(right))
    return pairs.agg(
        F.count("*").alias("rows"),
        same.alias("agreeing"),
        F.round(safe_ratio(same * 100.0, F.count("*")), 2).alias("pct"),
    )


def system_disagreement(
    predictions: DataFrame, first: str, second: str, label: str = "intent", key: str = "id"
) -> DataFrame:
    """Rows on which two systems differ, with both labels."""
    one = predictions.filter(F.col("system") == first).select(
        key, F.col(label).alias("first_label")
    )
    two = predictions.filter(F.col("system") == second).select(
        key, F.col(label).alias("second_label")
    )
    return one.join(two, key).filter(
        ~F.col("first_label").eqNullSafe(F.col("second_label"))
    )


def failure_cases(
    pairs: DataFrame, system: str, target_intents: Sequence[str]
) -> DataFrame:
    """One row per failure of a system: false_auto_handle, false_escalation, or
    misclassified for the target intents. A row can fail in two ways."""
    gold, chosen = F.col("gold_auto_or_escalate"), F.col("decision")
    kinds = F.array_compact(
        F.array(
            F.when(
                (gold == packs.ESCALATE) & (chosen == packs.AUTO), F.lit("false_auto_handle")
            ),
            F.when(
                (gold == packs.AUTO) & (chosen == packs.ESCALATE), F.lit("false_escalation")
            ),
            F.when(
                F.col("gold_intent").isin(*target_intents)
                & (F.col("gold_intent") != F.col("intent")),
                F.lit("misclassified"),
            ),
        )
    )
    return pairs.filter(F.col("system") == system).select("*", F.explode(kinds).alias("failure"))


def failure_samples(
    failures: DataFrame, limits: dict[str, int | None], key: str = "id"
) -> DataFrame:
    """The first rows per failure kind, by key; per gold intent for misclassified rows. A
    kind with limit None is kept whole."""
    group = F.when(F.col("failure") == "misclassified", F.col("gold_intent")).otherwise("")
    grouped = failures.withColumn("_group", group)
    out = None
    for kind, n in limits.items():
        part = grouped.filter(F.col("failure") == kind)
        if n is not None:
            part = smallest_per_group(part, ["_group"], [F.col(key)], n)
        out = part if out is None else out.unionByName(part)
    return out.drop("_group")
