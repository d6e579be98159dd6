"""Evaluation-sheet work: progress, validation, navigation, merging label updates.

Sheet rows have `idx`, their 0-based position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.text import nvl, safe_ratio, strip
from supportlake.operators.sampling import smallest_per_group


def is_labelled() -> Column:
    return (nvl(F.col("gold_intent")) != "") & (nvl(F.col("gold_auto_or_escalate")) != "")


def label_progress(sheet: DataFrame) -> DataFrame:
    """Total, labelled, remaining, percentage (1 dp)."""
    done = F.count_if(is_labelled())
    return sheet.agg(
        F.count("*").alias("total"),
        done.alias("labeled"),
        (F.count("*") - done).alias("remaining"),
        F.round(safe_ratio(done * 100.0, F.count("*")), 1).alias("percentage"),
    )


def label_counts(sheet: DataFrame) -> DataFrame:
    """(field, value, n) of the filled intents and actions, in one pass."""
    cells = F.array(
        F.struct(F.lit("intent").alias("field"), nvl(F.col("gold_intent")).alias("value")),
        F.struct(
            F.lit("action").alias("field"), nvl(F.col("gold_auto_or_escalate")).alias("value")
        ),
    )
    return (
        sheet.select(F.explode(cells).alias("c"))
        .filter(F.col("c.value") != "")
        .groupBy("c.field", "c.value")
        .agg(F.count("*").alias("n"))
    )


def progress_record(sheet: DataFrame) -> DataFrame:
    """Progress as one row, with the counts as maps."""
    counts = label_counts(sheet)

    def as_map(field: str) -> Column:
        entry = F.when(F.col("field") == field, F.struct("value", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    maps = counts.agg(as_map("intent").alias("intents"), as_map("action").alias("actions"))
    one = F.lit(1).alias("_one")
    return (
        label_progress(sheet).select("*", one).join(maps.select("*", one), "_one").drop("_one")
    )


def validation_errors(
    sheet: DataFrame, intents: Sequence[str] = packs.INTENTS, expected_count: int | None = None
) -> DataFrame:
    """(idx, error, detail): one row per fault. The row-count fault has idx -1."""
    intent = strip(nvl(F.col("gold_intent")))
    action = strip(nvl(F.col("gold_auto_or_escalate")))
    reason = strip(nvl(F.col("escalation_reason")))

    def fault(test: Column, name: str, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("error"), detail.alias("detail")))

    faults = F.array_compact(
        F.array(
            fault(intent == "", "blank_intent", F.col("tweet_id").cast("string")),
            fault((intent != "") & ~intent.isin(*intents), "invalid_intent", intent),
            fault(action == "", "blank_action", F.lit("")),
            fault((action != "") & ~action.isin(*packs.ACTIONS), "invalid_action", action),
            fault((action == packs.ESCALATE) & (reason == ""), "missing_reason", F.lit("")),
        )
    )
    errors = sheet.select("idx", F.explode(faults).alias("f")).select(
        "idx", "f.error", "f.detail"
    )
    if expected_count is None:
        return errors
    count = sheet.agg(F.count("*").alias("n")).filter(F.col("n") != expected_count)
    return errors.unionByName(
        count.select(
            F.lit(-1).cast("bigint").alias("idx"),
            F.lit("row_count").alias("error"),
            F.concat(
                F.lit(f"expected {expected_count}, got "), F.col("n").cast("string")
            ).alias("detail"),
        )
    )


def validation_report(errors: DataFrame, first: int = 25) -> DataFrame:
    """The first errors in row order."""
    return errors.orderBy("idx", "error").limit(first)


def next_unlabelled(sheet: DataFrame, after: int) -> DataFrame:
    """Index of the next unlabelled row behind `after`, wrapping around; -1 if there is none."""
    open_ = ~is_labelled()
    later = F.min(F.when(open_ & (F.col("idx") > after), F.col("idx")))
    any_ = F.min(F.when(open_ & (F.col("idx") <= after), F.col("idx")))
    return sheet.agg(F.coalesce(later, any_, F.lit(-1).cast("bigint")).alias("index"))


def first_unlabelled(sheet: DataFrame) -> DataFrame:
    """Index of the first unlabelled row, 0 if all are labelled."""
    first = F.min(F.when(~is_labelled(), F.col("idx")))
    return sheet.agg(F.coalesce(first, F.lit(0).cast("bigint")).alias("index"))


def row_at(sheet: DataFrame, index: int) -> DataFrame:
    """The row at `index`, clamped to the sheet."""
    bounds = sheet.agg(
        F.greatest(F.lit(0), F.least(F.max("idx"), F.lit(index))).alias("at")
    ).scalar()
    return sheet.filter(F.col("idx") == bounds)


def normalize_updates(updates: DataFrame) -> DataFrame:
    """Entry rules of a label update: a preset reason by number, a default reason for an
    escalation without one, unknown actions escalate, other actions carry no reason."""
    reason = strip(nvl(F.col("escalation_reason")))
    action = F.when(F.col("gold_auto_or_escalate") == packs.AUTO, F.lit(packs.AUTO)).otherwise(
        F.lit(packs.ESCALATE)
    )
    preset = None
    for i, text in enumerate(packs.PRESET_REASONS, start=1):
        test = reason == str(i)
        preset = F.when(test, F.lit(text)) if preset is None else preset.when(test, F.lit(text))
    preset = preset.when(reason == "", F.lit(packs.DEFAULT_REASON)).otherwise(reason)
    return updates.withColumn("gold_auto_or_escalate", action).withColumn(
        "escalation_reason",
        F.when(F.col("gold_auto_or_escalate") == packs.ESCALATE, preset).otherwise(F.lit("")),
    )


def merge_labels(sheet: DataFrame, updates: DataFrame, normalize: bool = True) -> DataFrame:
    """New sheet with the updates (seq, idx, gold_intent, gold_auto_or_escalate,
    escalation_reason, acceptable_resolution) applied. The last update of a row wins; updates
    of rows outside the sheet have no effect; a blank resolution keeps the old one."""
    fields = [
        "gold_intent", "gold_auto_or_escalate", "escalation_reason", "acceptable_resolution",
    ]
    if normalize:
        updates = normalize_updates(updates)
    filled = F.struct(*[nvl(F.col(f)).alias(f) for f in fields])
    last = updates.groupBy("idx").agg(F.max_by(filled, F.col("seq")).alias("u"))
    keep_old = F.when(F.col("u.acceptable_resolution") != "", F.col("u.acceptable_resolution"))
    new = {f: F.coalesce(F.col(f"u.{f}"), F.col(f)) for f in fields[:3]}
    if normalize:
        new[fields[3]] = F.coalesce(keep_old, F.col(fields[3]))
    else:
        new[fields[3]] = F.coalesce(F.col(f"u.{fields[3]}"), F.col(fields[3]))
    return sheet.join(last, "idx", "left").withColumns(new).drop("u")


def first_per_label(sheet: DataFrame, n: int) -> DataFrame:
    """The first n rows per gold intent, in sheet order."""
    return smallest_per_group(sheet, ["gold_intent"], [F.col("idx")], n)
