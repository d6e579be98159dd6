"""User-level jobs: grading, training, the agent, the three-system benchmark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.rules import RulePack
from supportlake.functions.text import clean_text
from supportlake.operators import classifier, decisions, metrics, quality, retrieval, threads
from supportlake.operators.case_store import CaseStore
from supportlake.operators.dense import DenseIndex, dense_retrieve
from supportlake.operators.language import bare_text, detect_language
from supportlake.session import materialize

KEYWORD, VERBATIM, AGENT = "baseline1", "baseline2", "agent"


@dataclass
class Graded:
    """Turns of all two-sided threads and one graded row per thread, both written tables."""

    turns: DataFrame
    threads: DataFrame


def _each_text_once(rows: DataFrame, name: str, texts: Sequence[str]) -> DataFrame:
    """`rows` as a written table in which equal values of the columns `texts` lie once per row,
    in an array that the columns are read from."""
    held, at = "texts_", [f"{c}_at_" for c in texts]
    written = materialize(
        rows.withColumn(held, F.array_distinct(F.array(*texts)))
        .withColumns({a: F.array_position(held, F.col(c)).cast("int") for a, c in zip(at, texts)})
        .drop(*texts),
        name,
    )
    of = {c: F.get(held, F.col(a) - 1).alias(c) for a, c in zip(at, texts)}
    return written.select(*[of.get(c, F.col(c)) for c in rows.columns])


#: The texts of a graded thread: of a short one, several are the same message.
THREAD_TEXTS = (
    "root_text", "first_customer_text", "last_customer_text", "first_brand_text", "last_brand_text",
    "last_text", "cleaned_problem",
)


def graded_threads(
    messages: DataFrame,
    brand: str,
    pack: RulePack = packs.SUPPORT,
    gate: Callable[[Column], Column] | None = None,
    profiles: DataFrame | None = None,
    confirmation: str = "tightened",
    ignore_case: bool = False,
    language: str = "detected",
) -> Graded:
    """Messages to graded threads. The first customer text must pass the language gate: short
    texts by their letters, others by the language that `profiles` find or by common words.
    Without profiles no language is found, and the letters decide. `gate` is another test in its
    place; `language="keyword"` takes the older one, by foreign words."""
    turns = written_turns(messages, brand, ignore_case)
    return graded_turns(turns, pack, gate, profiles, confirmation, language)


def written_turns(messages: DataFrame, brand: str, ignore_case: bool = False) -> DataFrame:
    """The turns of all two-sided threads as a written table; the messages are not needed after."""
    return materialize(threads.thread_turns(messages, brand, ignore_case), "thread-turns")


def graded_turns(
    turns: DataFrame,
    pack: RulePack = packs.SUPPORT,
    gate: Callable[[Column], Column] | None = None,
    profiles: DataFrame | None = None,
    confirmation: str = "tightened",
    language: str = "detected",
) -> Graded:
    """As `graded_threads`, from `written_turns`."""
    ends = threads.thread_endpoints(turns)
    if gate is None and language == "detected":
        if profiles is None:
            ends = ends.withColumn("detected", F.lit(None).cast("string"))
        else:
            ends = materialize(ends, "endpoints")
            said = ends.select("thread_id", bare_text(F.col("first_customer_text")).alias("said"))
            found = detect_language(said, "thread_id", "said", profiles)
            ends = ends.join(
                found.select(F.col("id").alias("thread_id"), "detected"), "thread_id", "left"
            )
    graded = quality.grade_threads(ends, pack, gate, confirmation, language)
    return Graded(turns, _each_text_once(graded, "graded", THREAD_TEXTS))


def train_intents(
    queries: DataFrame, pack: RulePack = packs.SUPPORT, seed: int = 42
) -> tuple[classifier.IntentModel, DataFrame, DataFrame]:
    """Weak-label, split, fit, test: model, per-class metrics, overall metrics. The labels are
    rule output, so the scores measure agreement with the rules."""
    from supportlake.operators.intents import weak_intent

    labelled = materialize(weak_intent(queries, "cleaned_text", pack), "labelled")
    model, tested = classifier.train_and_test(labelled, "tweet_id", "cleaned_text", seed=seed)
    tested = materialize(tested, "tested")
    labels = list(pack.intents)
    return (
        model,
        metrics.class_metrics(tested, "gold", "intent", labels),
        metrics.overall_metrics(tested, "gold", "intent", labels),
    )


Index = retrieval.CaseIndex | CaseStore | DenseIndex


def find_cases(queries: DataFrame, index: Index, k: int = 3, method: str = "auto") -> DataFrame:
    """Ranked cases per query, in the columns of `retrieval.retrieve` whatever the method.

    method: "sparse" ranks by words and needs cleaned_text, "dense" by embeddings and needs
    embedding; "auto" is what the index is for. Queries that a method cannot place (a dense
    one without an embedding) have no rows.
    """
    found = "dense" if isinstance(index, DenseIndex) else "sparse"
    if method not in ("auto", found):
        raise ValueError(f"a {found} index cannot answer by method {method!r}")
    if found == "dense":
        if len(index.texts) < 2:
            raise ValueError("the dense index was made without customer_problem and resolution")
        return dense_retrieve(queries.select("query_id", "embedding", "intent"), index, k)
    return retrieval.retrieve(queries.select("query_id", "cleaned_text", "intent"), index, k)


def with_evidence(
    labelled: DataFrame, index: Index, k: int = 2, method: str = "auto"
) -> DataFrame:
    """Add coverage and the retrieved cases to (query_id, customer_message, cleaned_text,
    intent, intent_confidence; embedding for a dense index)."""
    found = retrieval.coverage(find_cases(labelled, index, k, method)).drop("predicted_intent")
    joined = labelled.join(found, "query_id", "left")
    return joined.withColumns(
        {
            "top_similarity": F.coalesce("top_similarity", F.lit(0.0)),
            "relevant_hit_count": F.coalesce("relevant_hit_count", F.lit(0)),
            "coverage_tier": F.coalesce("coverage_tier", F.lit("THIN_OR_ABSENT")),
        }
    )


def agent_decisions(labelled: DataFrame, index: Index, k: int = 2) -> DataFrame:
    """The agent over a table of classified messages: evidence, reply, decision, reason."""
    return decisions.decide(with_evidence(labelled, index, k))


def agent_output(decided: DataFrame) -> DataFrame:
    """The per-message output record."""
    cases = F.transform(
        "retrieved_cases",
        lambda c: F.struct(c["thread_id"].alias("thread_id"), c["similarity"].alias("similarity")),
    )
    return decided.select(
        "query_id", "intent", "intent_confidence", cases.alias("retrieved_cases"), "draft_reply",
        "decision", "decision_reason",
    )


def classify_messages(
    messages: DataFrame, model: classifier.IntentModel, id_col: str, text_col: str
) -> DataFrame:
    """(query_id, customer_message, cleaned_text, intent, intent_confidence)."""
    rows = messages.select(
        F.col(id_col).alias("query_id"),
        F.col(text_col).alias("customer_message"),
        clean_text(F.col(text_col)).alias("cleaned_text"),
    )
    return model.predict(rows, "query_id", "cleaned_text")


def run_agent(
    messages: DataFrame,
    model: classifier.IntentModel,
    index: Index,
    id_col: str = "tweet_id",
    text_col: str = "text",
    k: int = 2,
) -> DataFrame:
    """Raw messages to the agent's output records."""
    labelled = materialize(classify_messages(messages, model, id_col, text_col), "classified")
    return agent_output(agent_decisions(labelled, index, k))


def three_systems(
    labelled: DataFrame, index: Index, pack: RulePack = packs.SUPPORT
) -> DataFrame:
    """Predictions of the keyword baseline, the verbatim baseline and the agent, stacked long.

    The two retrieving systems share one retrieval: the verbatim one reads its first case.
    """
    evidence = materialize(with_evidence(labelled, index, 2), "evidence")
    columns = [
        "query_id", "customer_message", "intent", "intent_confidence", "retrieved_cases",
        "draft_reply", "decision", "decision_reason",
    ]
    no_case = F.filter("retrieved_cases", lambda c: F.lit(False))
    keyword = decisions.keyword_decisions(
        evidence.withColumn("retrieved_cases", no_case), "customer_message", pack
    )
    first = F.slice("retrieved_cases", 1, 1)
    verbatim = decisions.verbatim_decisions(evidence.withColumn("retrieved_cases", first))
    agent = decisions.decide(evidence)
    out = None
    for name, part in ((KEYWORD, keyword), (VERBATIM, verbatim), (AGENT, agent)):
        part = part.select(F.lit(name).alias("system"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def audited_pairs(
    predictions: DataFrame,
    gold: DataFrame,
    actions: tuple[str, ...] = packs.UNTAKEN_ACTION_PATTERNS,
    private: tuple[str, ...] = packs.PUBLIC_PII_PATTERNS,
) -> DataFrame:
    """Predictions with gold fields (query_id, gold_intent, gold_auto_or_escalate) and the
    reply audit."""
    pairs = metrics.pair_gold(gold, predictions, "query_id")
    return decisions.reply_safety(pairs, "draft_reply", actions, private)


@dataclass
class Benchmark:
    """All reports of one evaluation, over one written prediction table."""

    pairs: DataFrame
    table: DataFrame
    per_class: DataFrame
    rubric: DataFrame
    failures: DataFrame


def benchmark(
    labelled: DataFrame,
    gold: DataFrame,
    index: Index,
    pack: RulePack = packs.SUPPORT,
    target_intents: Sequence[str] = tuple(packs.MANDATORY_ESCALATION),
    stripped_cases: bool = False,
) -> Benchmark:
    """Three systems on the gold rows. `stripped_cases` hides the case texts from the rubric,
    as an agent record with ids and similarities only does."""
    gold = metrics.labelled_rows(gold)
    wanted = labelled.join(gold.select("query_id"), "query_id", "left_semi")
    pairs = materialize(audited_pairs(three_systems(wanted, index, pack), gold), "pairs")
    judged = pairs
    if stripped_cases:
        judged = pairs.withColumn(
            "retrieved_cases",
            F.transform("retrieved_cases", lambda c: c.withField("resolution", F.lit(""))),
        )
    labels = list(pack.intents)
    return Benchmark(
        pairs,
        metrics.benchmark_table(pairs, labels),
        metrics.class_metrics(pairs, "gold_intent", "intent", labels, by=["system"]),
        metrics.judge_summary(decisions.judge_scores(judged)),
        metrics.failure_cases(pairs, AGENT, target_intents),
    )
