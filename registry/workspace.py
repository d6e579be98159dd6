"""Shared stages of the registered queries, built once per session and input folder.

Each stage is a written table, so several queries of one session do not redo the thread walk
or the case index.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registry import probe
from supportlake.functions import packs
from supportlake.functions.text import clean_text
from supportlake.operators import case_store, clusters, quality, retrieval, tfidf
from supportlake.operators.classifier import train_and_test
from supportlake.operators.intents import weak_intent
from supportlake.plans import support
from supportlake.session import drop_folder, materialize, scratch_dir, scratch_scope, tune
from supportlake.sources.messages import coerce_messages, last_version

_OPEN: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, sf_dir: str) -> "Workspace":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]


def forget() -> None:
    """Drop all built stages; the bench calls this to time every query from the tables."""
    _OPEN.clear()


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return probe.table(self.spark, self.sf_dir, name)

    @cached_property
    def messages(self) -> DataFrame:
        raw = probe.raw_messages(self.spark, self.sf_dir)
        return materialize(last_version(coerce_messages(raw)), "messages")

    @cached_property
    def graded(self) -> support.Graded:
        """Messages that only the threads are made of are deleted when the turns are written."""
        if "messages" in vars(self):
            turns = support.written_turns(self.messages, probe.BRAND)
        else:
            with scratch_scope(self.spark, keep=True) as folder:
                raw = probe.raw_messages(self.spark, self.sf_dir)
                rows = materialize(last_version(coerce_messages(raw)), "messages")
            turns = support.written_turns(rows, probe.BRAND)
            drop_folder(self.spark, folder)
        return support.graded_turns(turns, probe.MESSAGES, gate=probe.GATE)

    @cached_property
    def first_messages(self) -> DataFrame:
        return quality.first_messages(self.graded.threads)

    @cached_property
    def labelled(self) -> DataFrame:
        return weak_intent(self.first_messages, "cleaned_text", probe.MESSAGES)

    @cached_property
    def asked(self) -> DataFrame:
        """Agent input with the weak label in the model's place; short messages are given a
        lower confidence."""
        unsure = F.when(F.length("cleaned_text") < 150, F.lit(0.25)).otherwise(F.lit(0.0))
        rows = self.labelled.select(
            F.col("thread_id").alias("query_id"),
            F.col("raw_text").alias("customer_message"),
            "cleaned_text",
            "intent",
            (F.col("label_confidence") - unsure).alias("intent_confidence"),
        )
        return materialize(rows, "asked")

    @cached_property
    def cases(self) -> DataFrame:
        return retrieval.case_base(self.graded.threads, probe.MESSAGES)

    @cached_property
    def index(self) -> retrieval.CaseIndex:
        return retrieval.CaseIndex(self.cases)

    @cached_property
    def ranked(self) -> DataFrame:
        """Written without the texts of the cases, which are joined where they are asked for."""
        return retrieval.with_cases(retrieval.rank_cases(self.asked, self.index, k=3), self.index)

    @cached_property
    def decided(self) -> DataFrame:
        return materialize(support.agent_decisions(self.asked, self.index, k=2), "decided")

    @cached_property
    def gold(self) -> DataFrame:
        """Gold labels from the end of the thread: intent of the last customer text; handled
        threads and unconfirmed ones count as auto-handled."""
        graded = self.graded.threads.select(
            F.col("thread_id").alias("query_id"),
            clean_text(F.col("last_customer_text")).alias("last_customer_text"),
            F.when(
                (F.col("tier") == packs.USABLE) | (F.col("reason") == packs.REASON_UNCONFIRMED),
                F.lit(packs.AUTO),
            )
            .otherwise(F.lit(packs.ESCALATE))
            .alias("gold_auto_or_escalate"),
        )
        named = weak_intent(graded, "last_customer_text", probe.MESSAGES)
        return named.select(
            "query_id", F.col("intent").alias("gold_intent"), "gold_auto_or_escalate"
        )

    @cached_property
    def pairs(self) -> DataFrame:
        predictions = support.three_systems(self.asked, self.index, probe.MESSAGES)
        return materialize(
            support.audited_pairs(
                predictions,
                self.gold,
                packs.UNTAKEN_ACTION_PATTERNS + probe.ACTION_PATTERNS,
                packs.PUBLIC_PII_PATTERNS + probe.PRIVATE_PATTERNS,
            ),
            "pairs",
        )

    @cached_property
    def document_labels(self) -> DataFrame:
        return weak_intent(self.table("documents"), "text", probe.DOCUMENTS)

    def _features(self, base: tfidf.Vectorizer) -> clusters.Features:
        words = tfidf.united_stop_words(probe.STOP_WORDS, probe.NOISE_WORDS)
        words = probe.STOP_WORDS if base == tfidf.EXPLORE else words
        return clusters.features(
            self.table("documents"), "doc_id", "text", tfidf.with_stop_words(base, words)
        )

    @cached_property
    def explored_features(self) -> clusters.Features:
        return self._features(tfidf.EXPLORE)

    @cached_property
    def refined_features(self) -> clusters.Features:
        """One table for the refined run, the split run and the sweep."""
        return self._features(tfidf.REFINE)

    @cached_property
    def clustering(self) -> clusters.Clustering:
        return clusters.cluster_features(self.explored_features, k=7)

    @cached_property
    def refined(self) -> clusters.Clustering:
        return clusters.cluster_features(self.refined_features, k=8)

    @cached_property
    def split(self) -> clusters.Clustering:
        return clusters.cluster_features(self.refined_features, k=10)

    @cached_property
    def by_language(self) -> clusters.Clustering:
        """A run whose centers are fixed: the mean row of each language, without the unusual
        words that explore leaves out."""
        docs, weights = self.table("documents"), self.explored_features.weights
        langs = docs.groupBy("lang").agg(F.count("*").alias("n")).withColumn(
            "cluster_id", F.row_number().over(Window.orderBy("lang")) - 1  # a row per language
        )
        centers = (
            weights.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
            .groupBy("lang", "term")
            .agg(F.sum("weight").alias("total"))
            .join(langs, "lang")
            .select("cluster_id", "term", (F.col("total") / F.col("n")).alias("weight"))
        )
        ids = docs.select(F.col("doc_id").alias("id"))
        return clusters.assigned(weights, ids, materialize(centers, "language-centers"))

    @cached_property
    def saved_index(self) -> case_store.CaseStore:
        """A kept index that was written with nine tenths of the cases, opened, and extended."""
        path = f"{scratch_dir(self.spark)}/case-store-{uuid.uuid4().hex[:12]}"
        late = F.pmod(F.xxhash64("case_id"), F.lit(10)) == 0
        cases = materialize(self.cases, "all-cases")
        case_store.CaseStore.create(path, cases.filter(~late), buckets=8)
        case_store.CaseStore.open(self.spark, path).append(cases.filter(late))
        return case_store.CaseStore.open(self.spark, path)

    @cached_property
    def tested(self) -> DataFrame:
        _, rows = train_and_test(self.document_labels, "doc_id", "text")
        return materialize(rows, "tested")
