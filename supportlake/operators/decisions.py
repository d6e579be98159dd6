"""Replies, decisions, audits and rubric scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.rules import RulePack, contains_pattern, matches
from supportlake.functions.text import HANDLE, nvl, strip
from supportlake.operators.intents import add_keyword_intent


def draft_reply(coverage_tier: Column, top_resolution: Column) -> Column:
    """The top case's resolution without initials and handles, greeted; a fixed disclosure
    where the evidence is thin or no case is there."""
    bare = F.regexp_replace(nvl(top_resolution), r"\^[A-Z]{2,3}", "")
    bare = strip(F.regexp_replace(bare, HANDLE, ""))
    greeted = F.lower(bare).startswith("hi") | F.lower(bare).startswith("hello")
    return (
        F.when(
            (coverage_tier == "THIN_OR_ABSENT") | top_resolution.isNull(),
            F.lit(packs.REPLY_NO_EVIDENCE),
        )
        .when(greeted, bare)
        .otherwise(F.concat(F.lit(packs.REPLY_GREETING), bare))
    )


def evidence_block(message: Column, intent: Column, cases: Column) -> Column:
    """Message, intent and the retrieved cases as one text."""
    body = F.array_join(
        F.transform(
            cases,
            lambda c: F.concat(
                F.lit("\n--- Reference Case (Thread "),
                c["thread_id"].cast("string"),
                F.lit(" | Intent: "),
                c["intent"],
                F.lit(") ---\nCustomer Problem: "),
                c["customer_problem"],
                F.lit("\nVerified Amazon Resolution: "),
                c["resolution"],
                F.lit("\n"),
            ),
        ),
        "",
    )
    # FIXED VALUES: the frame of the text.
    return F.concat(
        F.lit('Incoming Customer Message:\n"'),
        message,
        F.lit('"\n\nPredicted Intent: '),
        intent,
        F.lit(
            "\n\nHistorical Grounding Evidence (from verified AmazonHelp resolutions):\n"
        ),
        body,
        F.lit("\n\nDraft a public Twitter support reply following all operational rules:"),
    )


def _policy(intent: Column, confidence: Column, tier: Column, draft: Column):
    """The ordered gates: (test, decision, name)."""
    gates = [
        (intent == label, packs.ESCALATE, label) for label in packs.MANDATORY_ESCALATION
    ]
    return gates + [
        (confidence < packs.MIN_CONFIDENCE, packs.ESCALATE, "confidence"),
        (tier == "THIN_OR_ABSENT", packs.ESCALATE, "evidence"),
        (matches(draft, packs.UNSUPPORTED_CLAIMS), packs.ESCALATE, "claim"),
    ]


def decision(intent: Column, confidence: Column, tier: Column, draft: Column) -> Column:
    """`escalate` at the first gate that holds, else `auto_handle`."""
    out = None
    for test, action, _ in _policy(intent, confidence, tier, draft):
        out = F.when(test, F.lit(action)) if out is None else out.when(test, F.lit(action))
    return out.otherwise(F.lit(packs.AUTO))


def decision_reason(
    intent: Column, confidence: Column, tier: Column, top_similarity: Column, draft: Column
) -> Column:
    # FIXED VALUES: reason texts with two-digit numbers.
    texts = {label: F.lit(text) for label, text in packs.MANDATORY_ESCALATION.items()}
    texts["confidence"] = F.format_string(
        "Low intent classification confidence (%.2f < 0.60); query is ambiguous.", confidence
    )
    texts["evidence"] = F.format_string(
        "Insufficient historical evidence (top similarity: %.2f); lack of grounded resolution "
        "cases to guarantee answer correctness.",
        top_similarity,
    )
    texts["claim"] = F.lit(packs.REASON_UNSUPPORTED)
    out = None
    for test, _, name in _policy(intent, confidence, tier, draft):
        out = F.when(test, texts[name]) if out is None else out.when(test, texts[name])
    return out.otherwise(
        F.format_string(
            "Confident intent (%s, conf: %.2f) with verified historical procedural guidance "
            "(similarity: %.2f).",
            intent,
            confidence,
            top_similarity,
        )
    )


def decide(df: DataFrame) -> DataFrame:
    """Add draft_reply, decision, decision_reason to rows with intent, intent_confidence,
    coverage_tier, top_similarity, retrieved_cases."""
    top = F.try_element_at("retrieved_cases", F.lit(1))["resolution"]
    drafted = df.withColumn("draft_reply", draft_reply(F.col("coverage_tier"), top))
    args = [F.col("intent"), F.col("intent_confidence"), F.col("coverage_tier")]
    return drafted.withColumns(
        {
            "decision": decision(*args, F.col("draft_reply")),
            "decision_reason": decision_reason(
                *args, F.col("top_similarity"), F.col("draft_reply")
            ),
        }
    )


def keyword_decisions(df: DataFrame, text: str, pack: RulePack) -> DataFrame:
    """Keyword baseline: intent, reply, decision and reason from the message alone."""
    labelled = add_keyword_intent(df, text, pack)
    intent = F.col("intent")
    refund = F.contains(F.lower(nvl(F.col(text))), F.lit(packs.KEYWORD_REFUND_WORD)) | (
        intent == packs.KEYWORD_REFUND_INTENT
    )
    promise = intent.isin(*packs.KEYWORD_PROMISE_INTENTS)
    other = (intent == pack.fallback) & (F.col("intent_confidence") < packs.MIN_CONFIDENCE)
    template = F.concat(
        F.lit(packs.KEYWORD_TEMPLATE_HEAD),
        F.replace(intent, F.lit("_"), F.lit(" ")),
        F.lit(packs.KEYWORD_TEMPLATE_TAIL),
    )

    def choose(a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.when(refund, a).when(promise, b).when(other, c).otherwise(d)

    return labelled.withColumns(
        {
            "draft_reply": choose(
                F.lit(packs.KEYWORD_REFUND_REPLY),
                F.lit(packs.KEYWORD_REPLACEMENT_REPLY),
                F.lit(packs.KEYWORD_OTHER_REPLY),
                template,
            ),
            "decision": choose(
                F.lit(packs.AUTO), F.lit(packs.AUTO), F.lit(packs.ESCALATE), F.lit(packs.AUTO)
            ),
            "decision_reason": choose(
                F.lit(packs.KEYWORD_REFUND_REASON),
                F.lit(packs.KEYWORD_REPLACEMENT_REASON),
                F.lit(packs.KEYWORD_OTHER_REASON),
                F.lit(packs.KEYWORD_TEMPLATE_REASON),
            ),
        }
    )


def verbatim_decisions(
    df: DataFrame, threshold: float = packs.VERBATIM_MIN_SIMILARITY
) -> DataFrame:
    """Verbatim baseline: the best case's resolution as is; a score threshold decides.

    Rows have intent_confidence and retrieved_cases (similarity to four digits).
    """
    top = F.try_element_at("retrieved_cases", F.lit(1))
    scored = df.select(
        "*",
        F.coalesce(top["similarity"], F.lit(0.0)).alias("top_score"),
        F.coalesce(top["resolution"], F.lit(packs.VERBATIM_DEFAULT_REPLY)).alias("draft_reply"),
    )
    low = (F.col("top_score") < threshold) | (
        F.col("intent_confidence") < packs.VERBATIM_MIN_CONFIDENCE
    )
    return scored.withColumns(
        {
            "decision": F.when(low, F.lit(packs.ESCALATE)).otherwise(F.lit(packs.AUTO)),
            "decision_reason": F.when(
                low,
                F.format_string(
                    f"Top retrieval similarity (%.3f) below threshold ({threshold}).",
                    F.col("top_score"),
                ),
            ).otherwise(
                F.format_string(
                    "Top retrieval similarity (%.3f) above threshold.", F.col("top_score")
                )
            ),
        }
    )


def reply_safety(
    df: DataFrame,
    reply: str,
    actions: tuple[str, ...] = packs.UNTAKEN_ACTION_PATTERNS,
    private: tuple[str, ...] = packs.PUBLIC_PII_PATTERNS,
) -> DataFrame:
    """Add unexecuted_action_claim, public_pii_solicitation, is_safe."""
    audited = df.select(
        "*",
        contains_pattern(F.col(reply), actions).alias("unexecuted_action_claim"),
        contains_pattern(F.col(reply), private).alias("public_pii_solicitation"),
    )
    return audited.withColumn(
        "is_safe", ~(F.col("unexecuted_action_claim") | F.col("public_pii_solicitation"))
    )


def _chain(cases: list[tuple[Column | None, int, Column]]) -> tuple[Column, Column]:
    """(score, notes) of the first case whose test holds; the last has none."""
    score = notes = None
    for test, value, text in cases[:-1]:
        score = F.when(test, F.lit(value)) if score is None else score.when(test, F.lit(value))
        notes = F.when(test, text) if notes is None else notes.when(test, text)
    return score.otherwise(F.lit(cases[-1][1])), notes.otherwise(cases[-1][2])


def judge_scores(
    df: DataFrame,
    actions: tuple[str, ...] = packs.UNTAKEN_ACTION_PATTERNS,
    private: tuple[str, ...] = packs.PUBLIC_PII_PATTERNS,
    high_risk: tuple[str, ...] = tuple(packs.MANDATORY_ESCALATION),
    link: str = packs.SITE_LINK,
) -> DataFrame:
    """Add score and notes for safety, groundedness, relevance, escalation, and the mean.

    Rows have customer_message, intent, draft_reply, decision, retrieved_cases (array with a
    resolution field, null or empty where none) and gold_auto_or_escalate (null or empty where
    there is no gold).
    """
    message = F.lower(nvl(F.col("customer_message")))
    reply = F.lower(nvl(F.col("draft_reply")))
    chosen = F.col("decision")
    references = F.lower(
        F.array_join(
            F.transform("retrieved_cases", lambda c: F.coalesce(c["resolution"], F.lit(""))), " "
        )
    )
    words = F.split(nvl(F.col("intent")), "_")
    gold = nvl(F.col("gold_auto_or_escalate"))
    tested = df.select(
        "*",
        contains_pattern(F.col("draft_reply"), actions).alias("_action"),
        contains_pattern(F.col("draft_reply"), private).alias("_private"),
        F.contains(reply, F.lit("refund")).alias("_refund"),
        F.contains(reply, F.lit("http")).alias("_http"),
        F.contains(reply, F.lit(link)).alias("_site"),
        (
            F.contains(reply, F.lit("historical evidence"))
            | F.contains(reply, F.lit("escalat"))
            | (chosen == packs.ESCALATE)
        ).alias("_admits"),
        F.coalesce(F.contains(references, F.lit("http")), F.lit(False)).alias("_ref_http"),
        (F.coalesce(F.size("retrieved_cases"), F.lit(0)) <= 0).alias("_no_case"),
        F.exists(words, lambda w: F.contains(message, w) | F.contains(reply, w)).alias("_about"),
        nvl(F.col("intent")).isin(*high_risk).alias("_risk"),
        gold.alias("_gold"),
    )
    lit = F.lit
    auto, escalated = chosen == packs.AUTO, chosen == packs.ESCALATE
    safety = _chain(
        [
            (F.col("_action") | F.col("_private"), 1, lit(packs.NOTE_SAFETY_1)),
            (F.col("_refund") & ~F.col("_http") & auto, 2, lit(packs.NOTE_SAFETY_2)),
            (None, 4, lit(packs.NOTE_SAFETY_4)),
        ]
    )
    groundedness = _chain(
        [
            (F.col("_no_case") & F.col("_admits"), 3, lit(packs.NOTE_GROUND_NO_CASE_3)),
            (F.col("_no_case"), 1, lit(packs.NOTE_GROUND_NO_CASE_1)),
            (F.col("_action"), 1, lit(packs.NOTE_GROUND_1)),
            (
                (F.col("_http") & F.col("_ref_http")) | F.col("_site"),
                4,
                lit(packs.NOTE_GROUND_4),
            ),
            (None, 3, lit(packs.NOTE_GROUND_3)),
        ]
    )
    relevance = _chain(
        [
            (F.col("_about"), 4, lit(packs.NOTE_RELEVANT_4)),
            (None, 2, lit(packs.NOTE_RELEVANT_2)),
        ]
    )
    has_gold = F.col("_gold") != ""
    agreed = F.concat(lit(packs.NOTE_ESCALATION_MATCH_HEAD), F.col("_gold"), lit(")."))
    escalation = _chain(
        [
            (has_gold & (chosen == F.col("_gold")), 4, agreed),
            (
                has_gold & (F.col("_gold") == packs.ESCALATE) & auto,
                1,
                lit(packs.NOTE_FALSE_AUTO),
            ),
            (has_gold, 2, lit(packs.NOTE_FALSE_ESCALATION)),
            (F.col("_risk") & escalated, 4, lit(packs.NOTE_RISK_ESCALATED)),
            (~F.col("_risk") & auto, 4, lit(packs.NOTE_ROUTINE_AUTO)),
            (F.col("_risk") & auto, 1, lit(packs.NOTE_RISK_AUTO)),
            (None, 3, lit(packs.NOTE_CAUTIOUS)),
        ]
    )
    names = ["safety", "groundedness", "relevance", "escalation"]
    parts = dict(zip(names, [safety, groundedness, relevance, escalation]))
    scored = tested.withColumns(
        {f"{n}_score": s for n, (s, _) in parts.items()}
        | {f"{n}_notes": t for n, (_, t) in parts.items()}
    )
    total = sum((F.col(f"{n}_score") for n in names), F.lit(0))
    scored = scored.withColumn("overall_score", F.round(total / 4.0, 2))
    return scored.drop(*[c for c in scored.columns if c.startswith("_")])
