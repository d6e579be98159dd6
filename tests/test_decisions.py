from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.operators import decisions, intents

P = packs.SUPPORT
CASES = "array<struct<thread_id string, similarity double, intent string, customer_problem string, resolution string>>"


def test_weak_intent(spark):
    rows = [
        ("where is my order", "delivery_delay_tracking", 1.0),
        ("my parcel arrived broken and late", "damaged_defective_wrong_item", 0.8),
        ("the voucher and the login", "account_access_security", 0.8),
        ("nothing of the kind", "other_miscellaneous_feedback", 0.5),
        ("so rude", "other_miscellaneous_feedback", 1.0),
        (None, "other_miscellaneous_feedback", 0.5),
    ]
    df = spark.createDataFrame(rows, "t string, want string, conf double")
    for r in intents.weak_intent(df, "t", P).collect():
        assert (r.intent, r.label_confidence) == (r.want, r.conf)


def test_topics_and_keywords(spark):
    df = spark.createDataFrame(
        [("Broken and late",), ("I never got it",), ("send it back",), ("hm",)], "t string"
    )
    topics = [r[0] for r in df.select(intents.topic(F.col("t"), P)).collect()]
    assert topics == ["delivery_shipping_delay", "other_unclassified", "other_unclassified", "other_unclassified"]
    labels = [(r.intent, r.intent_confidence) for r in intents.add_keyword_intent(df, "t", P).collect()]
    assert labels == [
        ("damaged_defective_wrong_item", 0.85), ("missing_stolen_delivery", 0.85),
        ("return_refund_request", 0.85), ("other_miscellaneous_feedback", 0.5),
    ]


def test_keyword_baseline(spark):
    df = spark.createDataFrame(
        [("no refund yet",), ("it was stolen",), ("hm",), ("my password",)], "t string"
    )
    got = decisions.keyword_decisions(df, "t", P).collect()
    assert [r.decision for r in got] == ["auto_handle", "auto_handle", "escalate", "auto_handle"]
    assert got[0].draft_reply == packs.KEYWORD_REFUND_REPLY
    assert got[1].draft_reply == packs.KEYWORD_REPLACEMENT_REPLY
    assert "account access security." in got[3].draft_reply


def test_replies(spark):
    rows = [
        ("HIGH", "@cust1 Please try again ^JM", "Hello! Please try again"),
        ("MODERATE", "Hi there ^ABC", "Hi there"), ("HIGH", "High time", "High time"),
        ("THIN_OR_ABSENT", "x", packs.REPLY_NO_EVIDENCE), ("HIGH", None, packs.REPLY_NO_EVIDENCE),
        ("HIGH", "^JMX^A @é", "Hello! ^A"),
    ]
    df = spark.createDataFrame(rows, "tier string, res string, want string")
    for r in df.select("want", decisions.draft_reply(F.col("tier"), F.col("res")).alias("g")).collect():
        assert r.g == r.want


def test_escalation_order(spark):
    delay = "delivery_delay_tracking"
    rows = [
        ("missing_stolen_delivery", 0.1, "THIN_OR_ABSENT", 0.0, "x", "escalate", "High-risk physical"),
        ("damaged_defective_wrong_item", 0.9, "HIGH", 0.5, "x", "escalate", "Physical damage"),
        ("other_miscellaneous_feedback", 0.9, "HIGH", 0.5, "x", "escalate", "Unstructured"),
        (delay, 0.5999, "THIN_OR_ABSENT", 0.0, "x", "escalate", "Low intent classification confidence (0.60 <"),
        (delay, 0.6, "THIN_OR_ABSENT", 0.1, "x", "escalate", "Insufficient historical evidence (top similarity: 0.10)"),
        (delay, 0.6, "HIGH", 0.5, "Your refund has been issued", "escalate", packs.REASON_UNSUPPORTED),
        (delay, 0.6, "HIGH", 0.5, "x", "auto_handle", f"Confident intent ({delay}, conf: 0.60)"),
    ]
    df = spark.createDataFrame(
        rows, "i string, c double, t string, s double, d string, want string, why string")
    args = [F.col("i"), F.col("c"), F.col("t")]
    for r in df.select(
        "want", "why", decisions.decision(*args, F.col("d")).alias("got"),
        decisions.decision_reason(*args, F.col("s"), F.col("d")).alias("reason"),
    ).collect():
        assert r.got == r.want and r.reason.startswith(r.why)


def test_confidence_rounds_before_the_gate(spark):
    df = spark.createDataFrame([(0.59996,), (0.59994,)], "c double")
    delay = F.lit("delivery_delay_tracking")
    got = df.select(
        decisions.decision(delay, F.round("c", 4), F.lit("HIGH"), F.lit("x")).alias("d")
    ).collect()
    assert [r.d for r in got] == ["auto_handle", "escalate"]


def test_verbatim_baseline(spark):
    rows = [
        (0.5, [("t", 0.25, "i", "p", "Do this")], "auto_handle"),
        (0.5, [("t", 0.2499, "i", "p", "Do this")], "escalate"),
        (0.39, [("t", 0.9, "i", "p", "Do this")], "escalate"),
        (0.9, [], "escalate"),
    ]
    df = spark.createDataFrame(rows, f"intent_confidence double, retrieved_cases {CASES}, want string")
    got = decisions.verbatim_decisions(df).collect()
    assert [r.decision for r in got] == [r[2] for r in rows]
    assert got[3].draft_reply == packs.VERBATIM_DEFAULT_REPLY and got[0].draft_reply == "Do this"
    assert got[2].decision_reason == "Top retrieval similarity (0.900) below threshold (0.25)."


def test_reply_audit(spark):
    bad = [
        "I've issued your refund", "I have canceled your subscription",
        "we shall send a replacement unit immediately", "a replacement has been ordered",
        "I have credited your account", "Reply with your debit card", "send us your password",
        "reply with your full address and phone", "tweet your order number and email",
    ]
    df = spark.createDataFrame([(t,) for t in [*bad, "All good", packs.KEYWORD_REFUND_REPLY]], "t string")
    got = decisions.reply_safety(df, "t").collect()
    assert [r.unexecuted_action_claim for r in got] == [True] * 5 + [False] * 6
    assert [r.public_pii_solicitation for r in got] == [False] * 5 + [True] * 4 + [False] * 2


def judge(spark, **fields):
    base = dict(
        customer_message="my parcel", intent="delivery_delay", draft_reply="we look",
        decision="auto_handle", retrieved_cases=[], gold_auto_or_escalate=None,
    ) | fields
    df = spark.createDataFrame(
        [tuple(base.values())],
        "customer_message string, intent string, draft_reply string, decision string, "
        f"retrieved_cases {CASES}, gold_auto_or_escalate string",
    )
    return decisions.judge_scores(df).first()


def test_rubric(spark):
    link = [("t", 0.9, "i", "p", "see HTTP://x")]
    r = judge(spark)
    assert (r.safety_score, r.groundedness_score, r.relevance_score, r.escalation_score) == (4, 1, 2, 4)
    assert r.overall_score == 2.75 and r.groundedness_notes == packs.NOTE_GROUND_NO_CASE_1
    assert judge(spark, decision="escalate").groundedness_score == 3
    assert judge(spark, decision="escalate").escalation_score == 3
    assert judge(spark, draft_reply="about a refund").safety_score == 2
    assert judge(spark, draft_reply="a refund at http://x").safety_score == 4
    bad = judge(spark, draft_reply="i have credited your account", retrieved_cases=link)
    assert (bad.safety_score, bad.groundedness_score) == (1, 1)
    assert judge(spark, draft_reply="go http://y", retrieved_cases=link).groundedness_score == 4
    stripped = [("t", 0.9, "i", "p", None)]
    assert judge(spark, draft_reply="go http://y", retrieved_cases=stripped).groundedness_score == 3
    assert judge(spark, customer_message="Delivery?").relevance_score == 4
    risky = "missing_stolen_delivery"
    assert judge(spark, intent=risky).escalation_score == 1
    assert judge(spark, intent=risky, decision="escalate").escalation_score == 4
    gold = dict(gold_auto_or_escalate="escalate")
    assert judge(spark, **gold).escalation_notes == packs.NOTE_FALSE_AUTO
    same = judge(spark, decision="escalate", **gold)
    assert same.escalation_notes == "Decision matches human ground truth (escalate)."
    assert judge(spark, decision="escalate", gold_auto_or_escalate="auto_handle").escalation_score == 2


def test_evidence_text(spark):
    df = spark.createDataFrame(
        [([("7", 0.5, "late", "where?", "soon")],)], f"cases {CASES}"
    )
    text = df.select(decisions.evidence_block(F.lit("hey"), F.lit("late"), F.col("cases"))).first()[0]
    assert text.startswith('Incoming Customer Message:\n"hey"\n\nPredicted Intent: late\n')
    assert "(Thread 7 | Intent: late) ---\nCustomer Problem: where?\nVerified" in text
