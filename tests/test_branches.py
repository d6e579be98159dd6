"""Every branch of the rules has rows in the registered queries, and those equal their twins."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from registry import check
from supportlake.functions import packs

SF = "/root/testdata/sf0.01"

#: Query, column, values that all must occur.
BRANCHES = [
    ("quality_branches", "reason", [
        packs.REASON_SINGLE_TURN, packs.REASON_ONE_SIDED, packs.REASON_LANGUAGE, packs.REASON_TRIVIAL,
        packs.REASON_USABLE, packs.REASON_DEFLECTED, packs.REASON_UNANSWERED, packs.REASON_UNCONFIRMED,
    ]),
    ("older_quality", "reason", [packs.REASON_LANGUAGE_KEYWORD, packs.REASON_USABLE_PLAIN]),
    ("coverage_branches", "coverage_tier", ["HIGH", "MODERATE", "THIN_OR_ABSENT"]),
    ("escalation_branches", "decision", list(packs.ACTIONS)),
    ("rubric_branches", "escalation_score", [1, 2, 3, 4]),
    ("rubric_branches", "groundedness_score", [1, 3, 4]),
    ("rubric_branches", "safety_score", [1, 2, 4]),
    ("validation_branches", "error", [
        "blank_intent", "invalid_intent", "blank_action", "invalid_action", "missing_reason", "row_count",
    ]),
    ("mention_branches", "own", [True, False]),
]


@pytest.mark.parametrize("name", dict.fromkeys(n for n, _, _ in BRANCHES))
def test_branches_occur_and_equal_their_twins(spark, name):
    got = entry.QUERIES[name](spark, SF).toPandas()
    for query, column, values in BRANCHES:
        if query == name:
            assert set(values) <= set(got[column].tolist()), (column, set(got[column].tolist()))
    assert check.compare(got, check.duck(SF).execute(entry.ORACLES[name]).df()) == ""


def test_replies_of_every_kind(spark):
    rows = entry.QUERIES["reply_branches"](spark, SF)
    kinds = rows.select(
        F.when(F.col("draft_reply") == packs.REPLY_NO_EVIDENCE, "none")
        .when(F.col("draft_reply").startswith(packs.REPLY_GREETING), "greeted")
        .otherwise("own").alias("kind")
    ).distinct()
    assert {r.kind for r in kinds.collect()} == {"none", "greeted", "own"}
    assert rows.filter(F.col("draft_reply").rlike("@|\\^")).count() == 0


def test_language_gate_of_every_kind(spark):
    rows = entry.QUERIES["language_decision"](spark, SF)
    short, known = F.col("n_words") < 3, F.col("detected").isNotNull()
    kinds = rows.groupBy(short.alias("short"), known.alias("known"), "english").count().collect()
    assert {(r.short, r.known, r.english) for r in kinds} >= {
        (True, True, True), (True, True, False), (True, False, True), (False, False, True),
        (False, True, True), (False, True, False),
    }


ROUND_TRIPS = ["message_files", "first_rows", "file_audit", "nested_threads", "golden_sheet",
               "saved_report", "stream_agent", "retrieve_saved", "retrieve_deep", "dense_coverage"]


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_round_trips_equal_their_twins(spark, tiny, name):
    got = entry.QUERIES[name](spark, tiny).toPandas()
    assert len(got) and check.compare(got, check.duck(tiny).execute(entry.ORACLES[name]).df()) == ""
