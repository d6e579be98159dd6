import pytest
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.operators import intents, labels, metrics, sampling

A, E = packs.AUTO, packs.ESCALATE

# A 3x3 matrix with a class never predicted, and one without rows.
CELLS = {("a", "a"): 8, ("a", "b"): 2, ("b", "b"): 5, ("b", "a"): 5, ("c", "a"): 4}


def pairs_of(spark, cells):
    rows = [(g, p) for (g, p), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "gold string, pred string")


def test_multi_class_scores(spark):
    pairs = pairs_of(spark, CELLS)
    got = {r.label: r for r in metrics.class_metrics(pairs, "gold", "pred", "abcd").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.4706, 0.8, 10)
    assert got["a"].f1 == pytest.approx(0.5926) and got["b"].f1 == 0.5882
    assert (got["c"].f1, got["c"].support, got["d"].f1, got["d"].support) == (0.0, 4, 0.0, 0)
    row = metrics.overall_metrics(pairs, "gold", "pred", "abcd").first()
    assert row.rows == 24 and row.accuracy == 0.5417
    assert row.macro_f1 == pytest.approx((0.592593 + 0.588235) / 4, abs=1e-4)
    assert row.weighted_f1 == pytest.approx((0.592593 * 10 + 0.588235 * 10) / 24, abs=1e-4)
    wide = {r.gold: r.asDict() for r in metrics.confusion_wide(pairs, "gold", "pred", "abcd").collect()}
    assert wide["a"]["b"] == 2 and wide["d"] == {"gold": "d", "a": 0, "b": 0, "c": 0, "d": 0}
    assert [r.gold for r in metrics.class_list(pairs, "gold").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize(
    "fah, fe, fahr, fer", [(31, 46, 0.8857, 0.2822), (9, 116, 0.2571, 0.7117), (7, 128, 0.2, 0.7853)]
)
def test_published_escalation_rates(spark, fah, fe, fahr, fer):
    cells = {(E, A): fah, (E, E): 35 - fah, (A, E): fe, (A, A): 163 - fe}
    pairs = pairs_of(spark, cells).withColumn("system", F.lit("s"))
    row = metrics.escalation_metrics(pairs, "gold", "pred").first()
    assert (row.false_auto_handle_rate, row.false_escalation_rate) == (fahr, fer)
    assert row.escalation_accuracy == round((198 - fah - fe) / 198, 4)
    assert (row.auto_support, row.escalate_support) == (163, 35)


def test_empty_denominators(spark):
    pairs = pairs_of(spark, {(A, A): 2}).withColumn("system", F.lit("s"))
    row = metrics.escalation_metrics(pairs, "gold", "pred").first()
    assert row.false_auto_handle_rate == 0.0 and row.escalate_f1 == 0.0


def test_failures_and_disagreement(spark):
    rows = [
        ("agent", 1, "x", "x", E, A, True), ("agent", 2, "x", "y", A, E, True),
        ("agent", 3, "z", "x", A, A, False), ("other", 1, "x", "y", E, E, True),
        ("other", 2, "x", "y", A, E, True),
    ]
    df = spark.createDataFrame(
        rows, "system string, id bigint, gold_intent string, intent string, "
        "gold_auto_or_escalate string, decision string, is_safe boolean")
    got = sorted((r.id, r.failure) for r in metrics.failure_cases(df, "agent", ["x"]).collect())
    assert got == [(1, "false_auto_handle"), (2, "false_escalation"), (2, "misclassified")]
    assert [r.id for r in metrics.system_disagreement(df, "agent", "other").collect()] == [1]
    safe = {r.system: r.safety_violation_rate for r in metrics.safety_summary(df).collect()}
    assert safe == {"agent": 0.3333, "other": 0.0}
    table = {r.system: r for r in metrics.benchmark_table(df, ["x", "y", "z"]).collect()}
    assert table["agent"].false_auto_handle_count == 1 and table["other"].accuracy == 0.0
    rate = metrics.agreement_rate(df, "gold_intent", "intent").first()
    assert (rate.rows, rate.agreeing, rate.pct) == (5, 1, 20.0)


def queries(spark, sizes):
    rows, n = [], 0
    for (intent, tier), size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((f"t{n}", n, f"text {n}", tier, intent))
    return spark.createDataFrame(
        rows, "thread_id string, tweet_id bigint, raw_text string, tier string, intent string")


def test_quotas_of_the_published_strata(spark):
    # Available rows per intent (usable, partially usable).
    sizes = [(19, 418), (5, 108), (9, 196), (23, 379), (5, 144), (9, 105), (15, 257), (9, 122), (134, 2982)]
    strata = spark.createDataFrame(
        [(i, u, p) for i, (u, p) in zip(packs.INTENTS, sizes)],
        "intent string, usable_available bigint, partially_available bigint")
    got = sampling.quotas(strata, 9, 198).collect()
    assert all(r.usable_quota == min(r.usable_available, 7) for r in got)
    assert all(r.usable_quota + r.partially_quota == 22 for r in got)


def test_golden_sample_with_thin_strata(spark):
    df = queries(spark, {("a", "usable"): 30, ("a", "partially_usable"): 3, ("b", "partially_usable"): 40})
    got = sampling.golden_sample(df, ["a", "b", "c"], 45).collect()
    counts = {}
    for r in got:
        key = (r.model_suggested_intent, r.evidence_tier)
        counts[key] = counts.get(key, 0) + 1
        assert r.gold_intent == "" and r.acceptable_resolution == ""
    assert counts == {("a", "usable"): 5, ("a", "partially_usable"): 3, ("b", "partially_usable"): 15}
    log = {r.intent: r for r in sampling.sampling_log(df, ["a", "b", "c"], 45).collect()}
    assert log["a"].allocated == 8 and log["c"].allocated == 0 and log["b"].actual_sampled_total == 23
    again = sampling.golden_sample(df.orderBy(F.desc("tweet_id")), ["a", "b", "c"], 45).collect()
    assert again == got


def test_split_sizes(spark):
    rows = [(i, "big" if i < 70 else "mid" if i < 95 else "few") for i in range(101)]
    df = spark.createDataFrame(rows, "id bigint, intent string")
    out = sampling.stratified_split(df, "intent", "id").collect()
    assert len(out) == 101 and len({r.id for r in out}) == 101
    test = [r.intent for r in out if r.split == "test"]
    assert len(test) == 21  # ceil(0.2 * 101)
    assert (test.count("big"), test.count("mid"), test.count("few")) == (15, 5, 1)


def test_tier_sample_and_weights(spark):
    df = spark.createDataFrame([(str(i), "x" if i < 30 else "y") for i in range(33)], "thread_id string, tier string")
    got = sampling.tier_sample(df, 10).groupBy("tier").count().collect()
    assert {r.tier: r["count"] for r in got} == {"x": 10, "y": 3}
    weights = {r.tier: r.weight for r in intents.class_weights(df, "tier").collect()}
    assert weights == {"x": pytest.approx(33 / 60), "y": pytest.approx(33 / 6)}


SHEET = "idx bigint, tweet_id string, gold_intent string, gold_auto_or_escalate string, escalation_reason string, acceptable_resolution string"


def sheet(spark):
    good = packs.INTENTS[0]
    return spark.createDataFrame(
        [
            (0, "t0", good, A, "", "old"), (1, "t1", "", A, "", ""), (2, "t2", "zzz", E, "", "keep"),
            (3, "t3", good, "", "", ""), (4, "t4", good, "maybe", "", ""), (5, "t5", good, E, "why", ""),
        ],
        SHEET,
    )


def test_validation(spark):
    got = sorted((r.idx, r.error) for r in labels.validation_errors(sheet(spark), expected_count=7).collect())
    assert got == [
        (-1, "row_count"), (1, "blank_intent"), (2, "invalid_intent"), (2, "missing_reason"),
        (3, "blank_action"), (4, "invalid_action"),
    ]
    report = labels.validation_report(labels.validation_errors(sheet(spark)), 2).collect()
    assert [r.idx for r in report] == [1, 2]


def test_progress_and_navigation(spark):
    row = labels.progress_record(sheet(spark)).first()
    assert (row.total, row.labeled, row.remaining, row.percentage) == (6, 4, 2, 66.7)
    assert row.actions == {A: 2, E: 2, "maybe": 1}
    nxt = [labels.next_unlabelled(sheet(spark), i).first()[0] for i in (0, 1, 3, 5)]
    assert nxt == [1, 3, 1, 1]
    full = sheet(spark).filter("idx = 0")
    assert labels.next_unlabelled(full, 0).first()[0] == -1
    assert labels.first_unlabelled(sheet(spark)).first()[0] == 1
    assert [labels.row_at(sheet(spark), i).first().idx for i in (-3, 2, 99)] == [0, 2, 5]


def test_label_updates(spark):
    updates = spark.createDataFrame(
        [
            (1, 0, "x", E, "2", ""), (2, 0, "y", E, "", "new"), (3, 1, "x", "odd", "5", ""),
            (4, 2, "x", A, "ignored", ""), (5, 99, "x", A, "", ""),
        ],
        "seq bigint, idx bigint, gold_intent string, gold_auto_or_escalate string, "
        "escalation_reason string, acceptable_resolution string")
    got = {r.idx: r for r in labels.merge_labels(sheet(spark), updates).collect()}
    assert len(got) == 6
    assert (got[0].gold_intent, got[0].escalation_reason, got[0].acceptable_resolution) == (
        "y", packs.DEFAULT_REASON, "new")
    assert (got[1].gold_auto_or_escalate, got[1].escalation_reason) == (E, packs.PRESET_REASONS[4])
    assert (got[2].escalation_reason, got[2].acceptable_resolution) == ("", "keep")
    raw = {r.idx: r for r in labels.merge_labels(sheet(spark), updates, normalize=False).collect()}
    assert raw[2].acceptable_resolution == "" and raw[2].escalation_reason == "ignored"
