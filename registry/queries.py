"""Registered queries: name -> Spark callable, and name -> SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import probe
from registry.fragments import (
    ESC_COLUMNS,
    clean,
    first_of,
    grams,
    hit,
    keyword_source,
    q,
    query,
    ratio,
    tfidf as sql_tfidf,
    tokens as sql_tokens,
    FRAGMENTS,
    S,
    W,
)
from registry.workspace import Workspace, workspace
from supportlake.functions import packs
from supportlake.functions.text import clean_text
from supportlake.operators import (
    clusters,
    decisions,
    dense,
    intents,
    labels,
    language,
    metrics,
    quality,
    retrieval,
    sampling,
    tfidf,
    threads,
)
from supportlake.session import materialize
from supportlake.sources import messages as sources
from supportlake.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_M, _D = probe.MESSAGES, probe.DOCUMENTS


def register(name: str, sql: str | None = None):
    """Add a query over a Workspace, and its SQL twin."""

    def add(build: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(workspace(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# --- sources, filters -------------------------------------------------------------------

_PROFILE_COLUMNS = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
    ("n_chars", "bigint"),
]


@register(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, "
        f"count({c}) AS non_null, count(*) - count({c}) AS nulls FROM documents"
        for c, t in _PROFILE_COLUMNS
    ),
)
def column_profile(w):
    return sources.column_profile(w.table("documents"))


@register(
    "messages_clean",
    query(
        "SELECT tweet_id, author_id, inbound, text, coalesce(parent_id, -1) AS parent_id FROM msgs",
        "msgs",
    ),
)
def messages_clean(w):
    return w.messages.select(
        "tweet_id", "author_id", "inbound", "text",
        F.coalesce("parent_id", F.lit(-1)).alias("parent_id"),
    )


_STRICT = (
    f"author_id = {q(probe.MENTION_BRAND)} OR (inbound AND contains(lower(text), "
    f"{q('@' + probe.MENTION_BRAND.lower())}))"
)


@register(
    "brand_filter_strict",
    query(f"SELECT tweet_id, author_id, inbound FROM doc_msgs WHERE {_STRICT}", "doc_msgs"),
)
def brand_filter_strict(w):
    rows = probe.document_messages(w.spark, w.sf_dir)
    return sources.brand_filter(rows, probe.MENTION_BRAND, strict=True).select(
        "tweet_id", "author_id", "inbound"
    )


@register(
    "brand_filter_loose",
    query(
        f"""SELECT tweet_id, author_id, inbound FROM doc_msgs
  WHERE lower(author_id) = {q(probe.MENTION_BRAND.lower())}
  OR contains(lower(text), {q('@' + probe.MENTION_BRAND.lower())})""",
        "doc_msgs",
    ),
)
def brand_filter_loose(w):
    rows = probe.document_messages(w.spark, w.sf_dir)
    return sources.brand_filter(rows, probe.MENTION_BRAND.lower()).select(
        "tweet_id", "author_id", "inbound"
    )


@register(
    "brand_extract",
    query(f"SELECT tweet_id, author_id, text FROM doc_msgs WHERE {_STRICT}", "doc_msgs"),
)
def brand_extract(w):
    import uuid

    from supportlake.session import scratch_dir

    path = f"{scratch_dir(w.spark)}/extract-{uuid.uuid4().hex[:12]}"
    rows = probe.document_messages(w.spark, w.sf_dir)
    return sources.extract_brand(rows, probe.MENTION_BRAND, path).select(
        "tweet_id", "author_id", "text"
    )


@register(
    "brand_volume",
    """SELECT user_id::varchar AS brand_author_id, count(*) AS tweet_volume FROM events
  WHERE event_type IN ('purchase', 'error') GROUP BY 1
  ORDER BY tweet_volume DESC, brand_author_id LIMIT 30""",
)
def brand_volume(w):
    return sources.top_authors(probe.event_messages(w.spark, w.sf_dir), 30)


@register("clean_text", f"SELECT doc_id, {clean('text')} AS cleaned_text FROM documents")
def clean_text_query(w):
    return w.table("documents").select("doc_id", clean_text(F.col("text")).alias("cleaned_text"))


# --- threads ----------------------------------------------------------------------------


@register("thread_roots", query("SELECT tweet_id FROM roots", "roots"))
def thread_roots(w):
    return threads.thread_roots(w.messages)


@register(
    "reply_fanout", query("SELECT parent_id, n_replies, primary_child FROM fanout", "fanout")
)
def reply_fanout(w):
    return threads.reply_fanout(w.messages)


@register("primary_edges", query("SELECT parent_id, child_id FROM prim", "prim"))
def primary_edges(w):
    return threads.primary_edges(w.messages)


@register(
    "thread_turns",
    query("SELECT thread_id, turn_no, tweet_id, author_id, speaker, text FROM turns", "turns"),
)
def thread_turns(w):
    return w.graded.turns.drop("created_at")


@register(
    "threads",
    query(
        """SELECT thread_id, count(*) AS turns_count, string_agg(speaker, '>' ORDER BY turn_no)
  AS speakers, string_agg(tweet_id::varchar, '>' ORDER BY turn_no) AS tweet_ids
  FROM turns GROUP BY thread_id""",
        "turns",
    ),
)
def nested_threads(w):
    nested = threads.nest_threads(w.graded.turns, w.graded.threads, probe.BRAND)
    return nested.select(
        "thread_id",
        "turns_count",
        F.array_join(F.col("messages.speaker"), ">").alias("speakers"),
        F.array_join(F.col("messages.tweet_id").cast("array<string>"), ">").alias("tweet_ids"),
    )


_ENDS = (
    "thread_id, turns_count, customer_turns, brand_turns, tweet_id, author_id, root_text, "
    "first_customer_text, last_customer_text, first_brand_text, last_brand_text, last_speaker, "
    "last_text"
)


@register("thread_endpoints", query(f"SELECT {_ENDS} FROM ends", "ends"))
def thread_endpoints(w):
    return threads.thread_endpoints(w.graded.turns)


@register(
    "thread_quality",
    query("SELECT thread_id, turns_count, cleaned_problem, tier, reason FROM graded", "graded"),
)
def thread_quality(w):
    return w.graded.threads.select("thread_id", "turns_count", "cleaned_problem", "tier", "reason")


@register(
    "quality_distribution",
    query(
        """SELECT position, tier, threads,
  round(CASE WHEN total = 0 THEN 0.0 ELSE threads * 100.0 / total END, 1) AS pct FROM (
  SELECT position, tier, (SELECT count(*) FROM graded g WHERE g.tier = t.tier) AS threads,
    (SELECT count(*) FROM graded) AS total
  FROM (VALUES (0, 'usable'), (1, 'partially_usable'), (2, 'unusable')) t(position, tier)
  UNION ALL SELECT 3, 'total', (SELECT count(*) FROM graded), (SELECT count(*) FROM graded))""",
        "graded",
    ),
)
def quality_distribution(w):
    return quality.quality_distribution(w.graded.threads)


_LOOKUP = ["1", "2", "3", "5", "8", "13", "21", "34", "55", "89"]
_LOOKUP_IDS = [str(int(x) * probe.ID_STEP) for x in _LOOKUP]


@register(
    "thread_lookup",
    query(
        f"""SELECT thread_id, tier AS quality_label, reason AS quality_reason,
  last_text AS closing_text FROM graded WHERE thread_id IN ({", ".join(map(q, _LOOKUP_IDS))})""",
        "graded",
    ),
)
def thread_lookup(w):
    return threads.lookup_threads(w.graded.threads, _LOOKUP_IDS)


@register(
    "resolution_status",
    query("SELECT thread_id, resolved, resolution FROM status", "status"),
)
def resolution_status(w):
    ends = threads.thread_endpoints(w.graded.turns)
    return quality.resolution_status(ends, _M).select("thread_id", "resolved", "resolution")


@register(
    "resolution_share",
    query(
        """SELECT resolved, count(*) AS threads,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM status GROUP BY resolved""",
        "status",
    ),
)
def resolution_share(w):
    ends = threads.thread_endpoints(w.graded.turns)
    return quality.resolution_share(quality.resolution_status(ends, _M))


@register(
    "first_messages",
    query(
        "SELECT thread_id, tweet_id, author_id, raw_text, cleaned_text, tier FROM firsts",
        "firsts",
    ),
)
def first_messages(w):
    return w.first_messages


# --- rules ------------------------------------------------------------------------------


@register(
    "rule_flags",
    "SELECT doc_id, "
    + ", ".join(f"{hit('text', a)} AS {f}" for f, a in _D.flags.items())
    + " FROM documents",
)
def rule_flags(w):
    docs = w.table("documents").select("doc_id", "text")
    return quality.rule_flags(docs, "text", _D).drop("text")


@register(
    "confirmation_flag",
    f"""SELECT conv_id, turn, {hit('text', _M.flags['positive'])} AND NOT
  {hit('text', _M.flags['negation'])} AS confirmed FROM conversations""",
)
def confirmation_flag(w):
    return w.table("conversations").select(
        "conv_id", "turn", quality.confirmed(F.col("text"), _M).alias("confirmed")
    )


@register(
    "weak_intent",
    query("SELECT doc_id, intent, label_confidence FROM doc_labels", "doc_labels"),
)
def weak_intent(w):
    return w.document_labels.select("doc_id", "intent", "label_confidence")


_KW = keyword_source("doc_id, text", "text", _D, "documents")


@register(
    "keyword_intent",
    f"SELECT doc_id, kint AS intent, kconf AS intent_confidence FROM ({_KW})",
)
def keyword_intent(w):
    docs = w.table("documents").select("doc_id", "text")
    return intents.add_keyword_intent(docs, "text", _D).drop("text")


@register(
    "baseline1_decisions",
    f"""SELECT doc_id, kint AS intent, kconf AS intent_confidence, kreply AS draft_reply,
  kaction AS decision, kreason AS decision_reason FROM ({_KW})""",
)
def baseline1_decisions(w):
    docs = w.table("documents").select("doc_id", "text")
    return decisions.keyword_decisions(docs, "text", _D).drop("text")


@register(
    "topic_distribution",
    query(
        f"""SELECT topic, count(*) AS threads,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct,
  string_agg(thread_id, ',' ORDER BY thread_id) FILTER (WHERE rn <= 3) AS sample_ids,
  string_agg(substring(translate(root_text, chr(10), ' '), 1, 110), ' | ' ORDER BY thread_id)
    FILTER (WHERE rn <= 3) AS sample_texts
  FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY thread_id) AS rn FROM (
    SELECT thread_id, root_text, {first_of("root_text", _M.topics, packs.OTHER_TOPIC)} AS topic
    FROM graded WHERE tier = 'usable')) GROUP BY topic""",
        "graded",
    ),
)
def topic_distribution(w):
    usable = w.graded.threads.filter(F.col("tier") == packs.USABLE)
    return intents.topic_distribution(usable, "root_text", "thread_id", _M)


@register(
    "intent_distribution",
    query(
        """SELECT intent, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
  FROM doc_labels GROUP BY intent""",
        "doc_labels",
    ),
)
def intent_distribution(w):
    return intents.label_distribution(w.document_labels)


@register(
    "class_weights",
    query(
        """SELECT intent, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
  FROM (SELECT intent, count(*) AS n FROM doc_labels GROUP BY intent)""",
        "doc_labels",
    ),
)
def class_weights(w):
    out = intents.class_weights(w.document_labels)
    return out.withColumn("weight", F.round("weight", 6))


# --- sampling ---------------------------------------------------------------------------


@register(
    "tier_sample",
    query(
        """SELECT thread_id, tier FROM (SELECT thread_id, tier, row_number() OVER (
  PARTITION BY tier ORDER BY md5('42|' || thread_id), thread_id) AS rn FROM graded)
  WHERE rn <= 10""",
        "graded",
    ),
)
def tier_sample(w):
    return sampling.tier_sample(w.graded.threads).select("thread_id", "tier")


_NAMES = ", ".join(f"({q(i)})" for i in packs.INTENTS)
_STRATA = f"""SELECT d.intent, count(*) FILTER (WHERE tier = 'usable') AS usable_available,
  count(*) FILTER (WHERE tier = 'partially_usable') AS partially_available
  FROM (VALUES {_NAMES}) d(intent) LEFT JOIN labelled l ON l.intent = d.intent GROUP BY d.intent"""
FRAGMENTS["strata"] = (["labelled"], _STRATA)
FRAGMENTS["quota"] = (
    ["strata"],
    """SELECT *, least(partially_available, 22 - usable_quota) AS partially_quota FROM (
  SELECT *, least(usable_available, 7) AS usable_quota FROM strata)""",
)


@register(
    "strata_counts",
    query("SELECT intent, usable_available, partially_available FROM strata", "strata"),
)
def strata_counts(w):
    return sampling.strata_counts(w.labelled, packs.INTENTS)


@register(
    "golden_sample",
    query(
        """SELECT thread_id, tweet_id, raw_text AS customer_message, '' AS gold_intent,
  '' AS gold_auto_or_escalate, '' AS escalation_reason, '' AS acceptable_resolution,
  '' AS retrieval_relevance_flag, '' AS groundedness_flag, '' AS unsupported_claims_flag,
  tier AS evidence_tier, intent AS model_suggested_intent FROM (
  SELECT l.*, row_number() OVER (PARTITION BY l.intent, tier
      ORDER BY md5('42|' || tweet_id), tweet_id) AS rn,
    CASE tier WHEN 'usable' THEN usable_quota ELSE partially_quota END AS quota
  FROM labelled l JOIN quota USING (intent)) WHERE rn <= quota
  ORDER BY md5('42|' || tweet_id), tweet_id LIMIT 198""",
        "labelled",
        "quota",
    ),
)
def golden_sample(w):
    return sampling.golden_sample(w.labelled, packs.INTENTS)


@register(
    "sampling_log",
    query(
        """SELECT intent, usable_available, partially_available,
  usable_quota + partially_quota AS allocated,
  least(sum(usable_quota + partially_quota) OVER (), 198)::bigint AS actual_sampled_total
  FROM quota""",
        "quota",
    ),
)
def sampling_log(w):
    return sampling.sampling_log(w.labelled, packs.INTENTS)


FRAGMENTS["split"] = (
    ["doc_labels"],
    """SELECT doc_id, intent, CASE WHEN rn <= base + CASE WHEN place <= goal - tot THEN 1 ELSE 0 END
  THEN 'test' ELSE 'train' END AS split FROM (
  SELECT d.doc_id, c.*, row_number() OVER (PARTITION BY c.intent
    ORDER BY md5('42|' || doc_id), doc_id) AS rn FROM doc_labels d JOIN (
    SELECT *, sum(base) OVER () AS tot,
      row_number() OVER (ORDER BY round(exact - base, 9) DESC, intent) AS place FROM (
      SELECT intent, n, goal, n * goal / total AS exact, floor(n * goal / total) AS base FROM (
        SELECT intent, count(*)::double AS n, sum(count(*)) OVER ()::double AS total,
          ceil(sum(count(*)) OVER () * 0.2::double) AS goal FROM doc_labels GROUP BY intent)))
    c USING (intent))""",
)


@register("stratified_split", query("SELECT doc_id, intent, split FROM split", "split"))
def stratified_split(w):
    return sampling.stratified_split(
        w.document_labels.select("doc_id", "intent"), "intent", "doc_id"
    )


# --- TF-IDF and retrieval ---------------------------------------------------------------


@register(
    "ngrams",
    f"""SELECT term, count(*) AS total, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, unnest({grams('toks', 2)}) AS term FROM (
    SELECT doc_id, {sql_tokens('text', probe.STOP_WORDS)} AS toks FROM documents))
  GROUP BY term""",
)
def ngram_query(w):
    counts = tfidf.term_counts(
        w.table("documents"), "doc_id", "text",
        tfidf.Vectorizer(1, 2, stop_words=probe.STOP_WORDS),
    )
    return counts.groupBy("term").agg(
        F.sum("tf").alias("total"), F.count("*").alias("docs")
    )


FRAGMENTS.update(
    sql_tfidf("docx", "documents", "doc_id", "text", 2, probe.STOP_WORDS, 3000, 3)
)


def _explore(w):
    return tfidf.with_stop_words(tfidf.EXPLORE, probe.STOP_WORDS)


@register(
    "term_stats",
    query("SELECT term, df, total_tf, round(idf, 6) AS idf FROM docx_stats", "docx_stats"),
)
def term_stats(w):
    stats = tfidf.fit(w.table("documents"), "doc_id", "text", _explore(w))
    return stats.withColumn("idf", F.round("idf", 6))


@register(
    "tfidf_weights",
    query("SELECT id, term, tf, round(weight, 6) AS weight FROM docx_weights", "docx_weights"),
)
def tfidf_weights(w):
    docs = w.table("documents")
    settings = _explore(w)
    _, out = tfidf.fit_transform(docs, "doc_id", "text", settings)
    return out.withColumn("weight", F.round("weight", 6))


@register(
    "case_base",
    query(
        "SELECT case_id, customer_problem, cleaned_problem, resolution, intent FROM cases",
        "cases",
    ),
)
def case_base(w):
    return w.cases


@register(
    "case_postings",
    query(
        """SELECT term, id AS case_id, round(weight, 6) AS weight FROM case_weights""",
        "case_weights",
    ),
)
def case_postings(w):
    return w.index.postings.join(
        w.index.cases.select("gid", "case_id"), "gid"
    ).select("term", "case_id", F.round("weight", 6).alias("weight"))


FRAGMENTS["pair_groups"] = (
    ["asked", "cases", "ask_weights", "case_weights"],
    """SELECT min(query_id) AS query_id, count(DISTINCT query_id) AS query_copies,
  min(case_id) AS case_id, case_intent, count(DISTINCT case_id) AS case_copies,
  any_value(sim) AS sim FROM (
  SELECT a.query_id, a.cleaned_text, c.case_id, c.intent AS case_intent, c.cleaned_problem, sim
  FROM (SELECT query_id, id AS case_id, sum(q.weight * w.weight) AS sim
    FROM ask_weights q JOIN case_weights w USING (term) GROUP BY query_id, id) s
  JOIN asked a USING (query_id) JOIN cases c USING (case_id) WHERE sim >= 0.18)
  GROUP BY cleaned_text, cleaned_problem, case_intent""",
)


@register(
    "sparse_similarity",
    query(
        """SELECT query_id, query_copies, case_id, case_intent, case_copies,
  round(sim, 6) AS similarity FROM pair_groups""",
        "pair_groups",
    ),
)
def sparse_similarity(w):
    out = retrieval.similar_pairs(w.asked, w.index)
    return out.withColumn("similarity", F.round("similarity", 6))


@register(
    "retrieve_topk",
    query(
        """SELECT query_id, predicted_intent, rank, case_id, case_intent, customer_problem,
  resolution, round(sim, 6) AS similarity, round(final, 6) AS final_score, relevant_hit_count
  FROM ranked WHERE rank <= 3""",
        "ranked",
    ),
)
def retrieve_topk(w):
    return w.ranked.withColumns(
        {c: F.round(c, 6) for c in ("similarity", "final_score")}
    )


@register(
    "coverage_tier",
    query(
        """SELECT query_id, predicted_intent, top_similarity, relevant_hit_count, coverage_tier,
  coverage_reason FROM covered""",
        "covered",
    ),
)
def coverage_tier(w):
    return retrieval.coverage(w.ranked).drop("retrieved_cases")


@register(
    "dense_topk",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v
    FROM embeddings),
  u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v
    FROM e),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS case_id, a.label AS predicted_intent,
    b.label AS case_intent, list_dot_product(a.v, b.v) AS sim FROM u a CROSS JOIN u b),
  r AS (SELECT *, sim + CASE WHEN predicted_intent = case_intent THEN 0.25 ELSE 0 END AS final
    FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY round(final, 9) DESC, case_id) AS rank,
    count(*) FILTER (WHERE sim >= 0.18 AND predicted_intent = case_intent)
      OVER (PARTITION BY query_id) AS relevant_hit_count FROM r)
  SELECT query_id, predicted_intent::varchar AS predicted_intent, rank, case_id,
    case_intent::varchar AS case_intent, round(sim, 6) AS similarity,
    round(final, 6) AS final_score, relevant_hit_count FROM k WHERE rank <= 3""",
)
def dense_topk(w):
    vectors = w.table("embeddings")
    index = dense.DenseIndex(
        vectors.select(F.col("vec_id").alias("case_id"), "embedding", F.col("label").alias("intent"))
    )
    asked = vectors.select(
        F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("intent")
    )
    out = dense.dense_retrieve(asked, index, 3)
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "final_score")})


@register("retrieve_saved", ORACLES["retrieve_topk"])
def retrieve_saved(w):
    """From a kept index that was written, opened, extended by a segment and opened again."""
    out = retrieval.retrieve(w.asked, w.saved_index, k=3)
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "final_score")})


@register(
    "retrieve_deep",
    query(
        """SELECT query_id, rank, case_id, round(sim, 6) AS similarity,
  round(final, 6) AS final_score, relevant_hit_count FROM ranked WHERE rank <= 12""",
        "ranked",
    ),
)
def retrieve_deep(w):
    """Twelve cases a query, from lists that are cut early and go on where they must."""
    out = retrieval.retrieve(w.asked, w.index, k=12, depth=16)
    return out.select(
        "query_id", "rank", "case_id", F.round("similarity", 6).alias("similarity"),
        F.round("final_score", 6).alias("final_score"), "relevant_hit_count",
    )


@register(
    "dense_topk_cells",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v
    FROM embeddings),
  u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v
    FROM e),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS case_id,
    CASE WHEN a.vec_id % 3 > 0 THEN a.label END AS predicted_intent,
    b.label AS case_intent, list_dot_product(a.v, b.v) AS sim FROM u a CROSS JOIN u b),
  r AS (SELECT *, sim + CASE WHEN predicted_intent = case_intent THEN 0.25 ELSE 0 END AS final
    FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY round(final, 9) DESC, case_id) AS rank,
    count(*) FILTER (WHERE sim >= 0.18
      AND (predicted_intent IS NULL OR predicted_intent = case_intent))
      OVER (PARTITION BY query_id) AS relevant_hit_count FROM r)
  SELECT query_id, predicted_intent::varchar AS predicted_intent, rank, case_id,
    case_intent::varchar AS case_intent, round(sim, 6) AS similarity,
    round(final, 6) AS final_score, relevant_hit_count FROM k WHERE rank <= 5""",
)
def dense_topk_cells(w):
    """Through a tree of several levels; a third of the queries have no intent."""
    vectors = w.table("embeddings")
    label = F.col("label").alias("intent")
    index = dense.DenseIndex(
        vectors.select(F.col("vec_id").alias("case_id"), "embedding", label), block_rows=32, fan=6
    )
    asked = vectors.select(
        F.col("vec_id").alias("query_id"), "embedding",
        F.when(F.col("vec_id") % 3 > 0, F.col("label")).alias("intent"),
    )
    out = dense.dense_retrieve(asked, index, 5)
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "final_score")})


# --- replies, decisions, rubric ---------------------------------------------------------


@register("draft_reply", query("SELECT query_id, coverage_tier, draft_reply FROM drafted", "drafted"))
def draft_reply(w):
    return w.decided.select("query_id", "coverage_tier", "draft_reply")


@register(
    "evidence_block",
    query(
        """SELECT a.query_id, 'Incoming Customer Message:' || chr(10) || '"' || a.customer_message
  || '"' || chr(10) || chr(10) || 'Predicted Intent: ' || a.intent || chr(10) || chr(10)
  || 'Historical Grounding Evidence (from verified AmazonHelp resolutions):' || chr(10)
  || string_agg(chr(10) || '--- Reference Case (Thread ' || case_id || ' | Intent: '
    || case_intent || ') ---' || chr(10) || 'Customer Problem: ' || customer_problem || chr(10)
    || 'Verified Amazon Resolution: ' || resolution || chr(10), '' ORDER BY rank)
  || chr(10) || chr(10) || 'Draft a public Twitter support reply following all operational rules:'
  AS evidence FROM asked a JOIN ranked USING (query_id) WHERE rank <= 2
  GROUP BY a.query_id, a.customer_message, a.intent""",
        "asked",
        "ranked",
    ),
)
def evidence_block(w):
    return w.decided.select(
        "query_id",
        decisions.evidence_block(
            F.col("customer_message"), F.col("intent"), F.col("retrieved_cases")
        ).alias("evidence"),
    )


@register(
    "escalation_decision",
    query("SELECT query_id, intent, decision, decision_reason FROM decided", "decided"),
)
def escalation_decision(w):
    return w.decided.select("query_id", "intent", "decision", "decision_reason")


@register(
    "agent_decisions",
    query(
        """SELECT query_id, intent, intent_confidence, cases, draft_reply, decision,
  decision_reason FROM decided JOIN (SELECT query_id, string_agg(
    case_id || ':' || printf('%.4f', round(sim, 4)), ',' ORDER BY rank) AS cases
    FROM ranked WHERE rank <= 2 GROUP BY query_id) USING (query_id)""",
        "decided",
        "ranked",
    ),
)
def agent_decisions(w):
    from supportlake.plans.support import agent_output

    shown = F.transform(
        "retrieved_cases",
        lambda c: F.concat(c["thread_id"], F.lit(":"), F.format_string("%.4f", c["similarity"])),
    )
    out = agent_output(w.decided)
    return out.withColumn("cases", F.array_join(shown, ",")).drop("retrieved_cases")


@register(
    "baseline2_decisions",
    query(
        """SELECT query_id, intent, intent_confidence, top_score, draft_reply, decision,
  decision_reason FROM verb""",
        "verb",
    ),
)
def baseline2_decisions(w):
    first = F.slice("retrieved_cases", 1, 1)
    rows = w.decided.drop("draft_reply", "decision", "decision_reason")
    out = decisions.verbatim_decisions(rows.withColumn("retrieved_cases", first))
    return out.select(
        "query_id", "intent", "intent_confidence", "top_score", "draft_reply", "decision",
        "decision_reason",
    )


_ACTIONS = packs.UNTAKEN_ACTION_PATTERNS + probe.ACTION_PATTERNS
_PRIVATE = packs.PUBLIC_PII_PATTERNS + probe.PRIVATE_PATTERNS


def _any(patterns: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(lower(text), {q(p)})" for p in patterns)


@register(
    "reply_safety",
    f"""SELECT doc_id, unexecuted_action_claim, public_pii_solicitation,
  NOT (unexecuted_action_claim OR public_pii_solicitation) AS is_safe FROM (
  SELECT doc_id, {_any(_ACTIONS)} AS unexecuted_action_claim,
    {_any(_PRIVATE)} AS public_pii_solicitation FROM documents)""",
)
def reply_safety(w):
    docs = w.table("documents").select("doc_id", "text")
    return decisions.reply_safety(docs, "text", _ACTIONS, _PRIVATE).drop("text")


def _judged(w):
    return decisions.judge_scores(w.pairs, _ACTIONS, _PRIVATE)


@register(
    "judge_scores",
    query(
        """SELECT system, query_id, safety_score, groundedness_score, relevance_score,
  escalation_score, overall_score FROM judged""",
        "judged",
    ),
)
def judge_scores(w):
    return _judged(w).select(
        "system", "query_id", "safety_score", "groundedness_score", "relevance_score",
        "escalation_score", "overall_score",
    )


@register(
    "judge_summary",
    query(
        "SELECT system, count(*) AS count, "
        + ", ".join(
            f"round(avg({c}_score)::decimal(18, 9), 2)::double AS mean_{c}"
            for c in ("groundedness", "relevance", "safety", "escalation", "overall")
        )
        + """
  FROM judged GROUP BY system""",
        "judged",
    ),
)
def judge_summary(w):
    return metrics.judge_summary(_judged(w))


@register(
    "judge_histogram",
    query(
        " UNION ALL ".join(
            f"SELECT system, '{d}' AS dimension, {d}_score AS score, count(*) AS n FROM judged "
            f"GROUP BY ALL"
            for d in ("groundedness", "relevance", "safety", "escalation")
        ),
        "judged",
    ),
)
def judge_histogram(w):
    return metrics.score_histogram(_judged(w))


# --- metrics ----------------------------------------------------------------------------


@register(
    "gold_vs_pred",
    query(
        """SELECT system, query_id, gold_intent, intent, gold_auto_or_escalate, decision, is_safe
  FROM pairs""",
        "pairs",
    ),
)
def gold_vs_pred(w):
    return w.pairs.select(
        "system", "query_id", "gold_intent", "intent", "gold_auto_or_escalate", "decision",
        "is_safe",
    )


@register(
    "system_disagreement",
    query(
        """SELECT a.query_id, a.intent AS first_label, b.intent AS second_label
  FROM pairs a JOIN pairs b USING (query_id)
  WHERE a.system = 'baseline1' AND b.system = 'agent' AND a.intent <> b.intent""",
        "pairs",
    ),
)
def system_disagreement(w):
    return metrics.system_disagreement(w.pairs, "baseline1", "agent", key="query_id")


@register(
    "confusion_matrix",
    query(
        f"""SELECT g.gold, p.pred, count(d.doc_id) AS n
  FROM (VALUES {_NAMES}) g(gold) CROSS JOIN (VALUES {_NAMES}) p(pred)
  LEFT JOIN doc_pairs d ON d.gintent = g.gold AND d.pred = p.pred GROUP BY g.gold, p.pred""",
        "doc_pairs",
    ),
)
def confusion_matrix(w):
    pairs = probe.document_pairs(w.spark, w.sf_dir)
    return metrics.confusion_matrix(pairs, "gold", "pred", packs.INTENTS)


@register(
    "class_metrics",
    query(
        """SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall,
  round(f1, 4) AS f1, support FROM doc_scores""",
        "doc_scores",
    ),
)
def class_metrics(w):
    pairs = probe.document_pairs(w.spark, w.sf_dir)
    return metrics.class_metrics(pairs, "gold", "pred")


_MEANS = """round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall,
  round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1"""


@register(
    "overall_metrics",
    query(
        f"""SELECT {_MEANS}, (SELECT count(*) FROM doc_pairs) AS rows,
  (SELECT round(avg((gintent = pred)::int), 4) FROM doc_pairs) AS accuracy FROM doc_scores""",
        "doc_scores",
        "doc_pairs",
    ),
)
def overall_metrics(w):
    pairs = probe.document_pairs(w.spark, w.sf_dir)
    return metrics.overall_metrics(pairs, "gold", "pred")


@register("escalation_metrics", query(f"SELECT system, {ESC_COLUMNS} FROM esc", "esc"))
def escalation_metrics(w):
    return metrics.escalation_metrics(w.pairs, "gold_auto_or_escalate", "decision")


@register(
    "safety_summary",
    query(
        f"""SELECT system, count(*) AS rows, count(*) FILTER (WHERE NOT is_safe)
  AS safety_violations_count, {ratio("count(*) FILTER (WHERE NOT is_safe)", "count(*)")}
  AS safety_violation_rate FROM pairs GROUP BY system""",
        "pairs",
    ),
)
def safety_summary(w):
    return metrics.safety_summary(w.pairs)


@register(
    "benchmark_table",
    query(
        f"""SELECT system, rows, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1,
  {ESC_COLUMNS}, bad AS safety_violations_count, {ratio("bad", "rows")} AS safety_violation_rate
  FROM esc JOIN (SELECT system, {_MEANS} FROM sys_scores GROUP BY system) USING (system)
  JOIN (SELECT system, count(*) AS rows, round(avg((gold_intent = intent)::int), 4) AS accuracy,
    count(*) FILTER (WHERE NOT is_safe) AS bad FROM pairs GROUP BY system) USING (system)""",
        "esc",
        "sys_scores",
        "pairs",
    ),
)
def benchmark_table(w):
    return metrics.benchmark_table(w.pairs)


@register(
    "agreement_pairs",
    query(
        """SELECT gintent AS gold, pred, count(*) AS n, gintent = pred AS agrees,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM doc_pairs GROUP BY gintent, pred""",
        "doc_pairs",
    ),
)
def agreement_pairs(w):
    return metrics.agreement_pairs(probe.document_pairs(w.spark, w.sf_dir), "gold", "pred")


FRAGMENTS["failures"] = (
    ["pairs"],
    f"""SELECT query_id, gold_intent, intent, gold_auto_or_escalate, decision, failure FROM (
  SELECT *, unnest(list_filter([
    CASE WHEN gold_auto_or_escalate = 'escalate' AND decision = 'auto_handle'
      THEN 'false_auto_handle' END,
    CASE WHEN gold_auto_or_escalate = 'auto_handle' AND decision = 'escalate'
      THEN 'false_escalation' END,
    CASE WHEN gold_intent IN ({", ".join(map(q, packs.MANDATORY_ESCALATION))})
      AND gold_intent <> intent THEN 'misclassified' END], lambda x: x IS NOT NULL)) AS failure
  FROM pairs WHERE system = 'agent')""",
)


def _failures(w):
    return metrics.failure_cases(w.pairs, "agent", tuple(packs.MANDATORY_ESCALATION)).select(
        "query_id", "gold_intent", "intent", "gold_auto_or_escalate", "decision", "failure"
    )


@register("failure_cases", query("SELECT * FROM failures", "failures"))
def failure_cases(w):
    return _failures(w)


@register(
    "failure_samples",
    query(
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY failure,
    CASE WHEN failure = 'misclassified' THEN gold_intent ELSE '' END ORDER BY query_id) AS rn
  FROM failures) WHERE failure = 'false_auto_handle'
  OR rn <= CASE failure WHEN 'misclassified' THEN 4 ELSE 20 END""",
        "failures",
    ),
)
def failure_samples(w):
    return metrics.failure_samples(
        _failures(w),
        {"false_auto_handle": None, "false_escalation": 20, "misclassified": 4},
        key="query_id",
    )


# --- evaluation sheet -------------------------------------------------------------------


_DONE = "gold_intent <> '' AND gold_auto_or_escalate <> ''"


@register(
    "label_progress",
    query(
        f"""SELECT count(*) AS total, count(*) FILTER (WHERE {_DONE}) AS labeled,
  count(*) FILTER (WHERE NOT ({_DONE})) AS remaining,
  round(count(*) FILTER (WHERE {_DONE}) * 100.0 / count(*), 1) AS percentage FROM sheet""",
        "sheet",
    ),
)
def label_progress(w):
    return labels.label_progress(probe.sheet(w.spark, w.sf_dir))


@register(
    "label_counts",
    query(
        """SELECT 'intent' AS field, gold_intent AS value, count(*) AS n FROM sheet
  WHERE gold_intent <> '' GROUP BY gold_intent
  UNION ALL SELECT 'action', gold_auto_or_escalate, count(*) FROM sheet
  WHERE gold_auto_or_escalate <> '' GROUP BY gold_auto_or_escalate""",
        "sheet",
    ),
)
def label_counts(w):
    return labels.label_counts(probe.sheet(w.spark, w.sf_dir))


@register(
    "label_validation",
    query(
        f"""SELECT idx, 'blank_intent' AS error, tweet_id AS detail FROM sheet WHERE gold_intent = ''
  UNION ALL SELECT idx, 'invalid_intent', gold_intent FROM sheet WHERE gold_intent <> ''
    AND gold_intent NOT IN ({", ".join(map(q, packs.INTENTS))})
  UNION ALL SELECT idx, 'blank_action', '' FROM sheet WHERE gold_auto_or_escalate = ''
  UNION ALL SELECT idx, 'missing_reason', '' FROM sheet
    WHERE gold_auto_or_escalate = 'escalate' AND escalation_reason = ''
  UNION ALL SELECT -1, 'row_count', 'expected 198, got ' || count(*) FROM sheet
    HAVING count(*) <> 198""",
        "sheet",
    ),
)
def label_validation(w):
    return labels.validation_errors(probe.sheet(w.spark, w.sf_dir), expected_count=198)


@register(
    "next_unlabeled",
    query(
        f"""SELECT coalesce(min(idx) FILTER (WHERE idx > 100), min(idx), -1) AS index
  FROM sheet WHERE NOT ({_DONE})""",
        "sheet",
    ),
)
def next_unlabeled(w):
    return labels.next_unlabelled(probe.sheet(w.spark, w.sf_dir), 100)


_PRESET = " ".join(
    f"WHEN why = '{i}' THEN {q(t)}" for i, t in enumerate(packs.PRESET_REASONS, start=1)
)


@register(
    "label_merge",
    query(
        f"""SELECT s.idx, s.tweet_id, coalesce(u.gold_intent, s.gold_intent) AS gold_intent,
  coalesce(u.action, s.gold_auto_or_escalate) AS gold_auto_or_escalate,
  coalesce(u.reason, s.escalation_reason) AS escalation_reason,
  CASE WHEN u.res <> '' THEN u.res ELSE s.acceptable_resolution END AS acceptable_resolution
  FROM sheet s LEFT JOIN (SELECT *, CASE WHEN act = 'auto_handle' THEN 'auto_handle'
      ELSE 'escalate' END AS action,
    CASE WHEN act = 'auto_handle' THEN '' {_PRESET} WHEN trim(why) = '' THEN
      {q(packs.DEFAULT_REASON)} ELSE why END AS reason,
    row_number() OVER (PARTITION BY idx ORDER BY seq DESC) AS rn FROM updates) u
  ON u.idx = s.idx AND u.rn = 1""",
        "sheet",
        "updates",
    ),
)
def label_merge(w):
    return labels.merge_labels(
        probe.sheet(w.spark, w.sf_dir), probe.sheet_updates(w.spark, w.sf_dir)
    )


# --- language ---------------------------------------------------------------------------

_LETTERS = (
    r"' ' || trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]+|[0-9_]+', ' ', 'g'), "
    r"' +', ' ', 'g')) || ' '"
)
FRAGMENTS["grams3"] = (
    [],
    f"""SELECT id, lang, gram, count(*) AS tf FROM (SELECT doc_id AS id, lang,
  unnest(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) AS gram
  FROM (SELECT doc_id, lang, {_LETTERS} AS s FROM documents) WHERE length(s) >= 3) GROUP BY ALL""",
)
FRAGMENTS["profiles"] = (
    ["grams3"],
    """SELECT lang, gram, ln(1.0 + n / total * 1e6) AS gain FROM (
  SELECT lang, gram, sum(tf)::double AS n, sum(sum(tf)) OVER (PARTITION BY lang)::double AS total,
    row_number() OVER (PARTITION BY lang ORDER BY sum(tf) DESC, gram) AS rn
  FROM grams3 GROUP BY lang, gram) WHERE rn <= 300""",
)
FRAGMENTS["lang_scores"] = (
    ["grams3", "profiles"],
    """SELECT g.id, p.lang, sum(tf * gain) AS score FROM grams3 g JOIN profiles p USING (gram)
  GROUP BY g.id, p.lang""",
)


@register(
    "language_profile_score",
    query("SELECT id, lang, round(score, 4) AS score FROM lang_scores", "lang_scores"),
)
def language_profile_score(w):
    docs = w.table("documents")
    profiles = language.fit_profiles(docs, "text", "lang", size=300)
    scores = language.language_scores(docs, "doc_id", "text", profiles)
    return scores.withColumn("score", F.round("score", 4))


@register(
    "language_gate",
    query(
        """SELECT id, lang AS detected FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY round(score, 6) DESC, lang) AS rn FROM lang_scores) WHERE rn = 1""",
        "lang_scores",
    ),
)
def language_gate(w):
    docs = w.table("documents")
    profiles = language.fit_profiles(docs, "text", "lang", size=300)
    return language.detect_language(docs, "doc_id", "text", profiles).select("id", "detected")


FRAGMENTS["gate_messages"] = (
    [],
    """SELECT 'c-' || conv_id || '-' || turn AS id, text FROM conversations
  UNION ALL SELECT 'd' || doc_id, text FROM documents
  UNION ALL SELECT 'w' || doc_id, split_part(text, ' ', 1) || CASE WHEN contains(text, ' ')
    THEN ' ' || split_part(text, ' ', 2) ELSE '' END FROM documents
  UNION ALL SELECT 'h' || doc_id, '@' || source || ' https://x.y/' || doc_id FROM documents
  UNION ALL SELECT 'n' || doc_id, doc_id || ' ' || n_chars || ' ' || doc_id || ' 7' FROM documents""",
)
FRAGMENTS["whole_profiles"] = (
    ["grams3"],
    """SELECT lang, gram, ln(1.0 + n / total * 1e6) AS gain FROM (
  SELECT lang, gram, sum(tf)::double AS n, sum(sum(tf)) OVER (PARTITION BY lang)::double AS total
  FROM grams3 GROUP BY lang, gram)""",
)
_BARE = (
    f"regexp_replace(regexp_replace(regexp_replace(text, {q(f'@[{W}]+')}, '', 'g'), "
    f"{q(f'https?://[^{S}]+')}, '', 'g'), {q(f'[^{W}{S}]')}, ' ', 'g')"
)
FRAGMENTS["gate_words"] = (
    ["gate_messages"],
    f"""SELECT id, ws, array_to_string(ws, ' ') AS text FROM (SELECT id, list_filter(
    string_split_regex(lower({_BARE}), {q(f'[{S}]+')}), lambda x: x <> '') AS ws FROM gate_messages)""",
)
FRAGMENTS["gate_found"] = (
    ["gate_words", "whole_profiles"],
    f"""SELECT id, arg_min(lang, (-round(score, 6), lang)) AS detected FROM (
  SELECT id, lang, sum(gain) AS score FROM (SELECT id,
    unnest(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) AS gram
    FROM (SELECT id, {_LETTERS} AS s FROM gate_words) WHERE length(s) >= 3)
  JOIN whole_profiles USING (gram) GROUP BY id, lang) GROUP BY id""",
)


@register(
    "language_decision",
    query(
        f"""SELECT id, detected, len(ws) AS n_words, CASE
    WHEN len(ws) < 3 OR detected IS NULL THEN NOT regexp_matches(text, '[^\x00-\x7F]')
    ELSE detected = 'en' OR {" + ".join(f"list_contains(ws, {q(x)})::int" for x in _M.common_words)} >= 2
    END AS english FROM gate_words LEFT JOIN gate_found USING (id)""",
        "gate_words",
        "gate_found",
    ),
)
def language_decision(w):
    """The language gate with profiles of all trigrams: short texts, known and unknown ones. Words
    are cut once; the gate's answers to no, English and another language wait for what is detected,
    so no text is moved."""
    texts = probe.gate_messages(w.spark, w.sf_dir)
    profiles = language.fit_profiles(w.table("documents"), "text", "lang")
    said = F.array_join("words", " ")
    gates = {
        name: quality.short_text_gate(F.col("text"), _M.common_words, F.lit(lang).cast("string"))
        for name, lang in (("unknown", None), ("en", "en"), ("other", ""))
    }
    bare = materialize(
        texts.select("id", language.language_words(F.col("text")).alias("words"))
        .select("id", F.size("words").cast("long").alias("n_words"), said.alias("text")),
        "bare-texts",
    )
    found = language.detect_language(bare, "id", "text", profiles).select("id", "detected")
    english = F.when(F.col("detected").isNull(), F.col("unknown")).when(
        F.col("detected") == "en", F.col("en")
    )
    return (
        bare.select("id", "n_words", *[g.alias(name) for name, g in gates.items()])
        .join(found, "id")
        .select("id", "detected", "n_words", english.otherwise(F.col("other")).alias("english"))
    )


# --- clusters and models (no SQL twin but for the fixed-centroid assignment) --------------


@register("cluster_summary")
def cluster_summary(w):
    docs = w.table("documents").select("doc_id", "text", "lang", "source")
    return clusters.cluster_summary(w.clustering, docs, "doc_id")


@register("cluster_summary_refined")
def cluster_summary_refined(w):
    docs = w.table("documents").select("doc_id", "text", "lang", "source")
    return clusters.cluster_summary(w.refined, docs, "doc_id")


@register("cluster_top_terms")
def cluster_top_terms(w):
    return clusters.top_terms(w.clustering.centers)


@register("cluster_representatives")
def cluster_representatives(w):
    run = w.clustering
    near = clusters.representatives(
        run.weights, run.members, run.centers, vocab=run.vocab, rows=run.rows
    )
    return clusters.with_texts(near, w.table("documents").select("doc_id", "text"), "doc_id")


@register("cluster_summary_split")
def cluster_summary_split(w):
    docs = w.table("documents").select("doc_id", "text", "lang", "source")
    return clusters.cluster_summary(w.split, docs, "doc_id")


@register("kmeans_sweep")
def kmeans_sweep(w):
    return clusters.inertia_sweep(w.refined_features)


@register("residual_sample")
def residual_sample(w):
    docs = w.table("documents").select("doc_id", "text")
    return clusters.largest_cluster_sample(w.split.members, docs, "doc_id")


FRAGMENTS["lang_centers"] = (
    ["docx_weights"],
    """SELECT dense_rank() OVER (ORDER BY lang) - 1 AS cluster_id, term, weight FROM (
  SELECT lang, term, sum(weight) / any_value(n) AS weight FROM docx_weights
  JOIN documents ON doc_id = id JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
  USING (lang) GROUP BY lang, term)""",
)


@register(
    "nearest_centroid",
    query(
        """SELECT id, cluster_id, round(greatest(d, 0), 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), cluster_id) AS rn FROM (
    SELECT i.doc_id AS id, c.cluster_id,
      coalesce(s.sq, 0) - 2 * coalesce(p.product, 0) + c.csq AS d
    FROM documents i CROSS JOIN (SELECT cluster_id, sum(weight * weight) AS csq
      FROM lang_centers GROUP BY cluster_id) c
    LEFT JOIN (SELECT id, sum(weight * weight) AS sq FROM docx_weights GROUP BY id) s
      ON s.id = i.doc_id
    LEFT JOIN (SELECT w.id, k.cluster_id, sum(w.weight * k.weight) AS product
      FROM docx_weights w JOIN lang_centers k USING (term) GROUP BY w.id, k.cluster_id) p
      ON p.id = i.doc_id AND p.cluster_id = c.cluster_id)) WHERE rn = 1""",
        "docx_weights",
        "lang_centers",
    ),
)
def nearest_centroid(w):
    """Fixed centers: the mean TF-IDF row per language."""
    run = w.by_language
    ids = w.table("documents").select(F.col("doc_id").alias("id"))
    out = clusters.nearest_center(run.weights, ids, run.centers)
    return out.withColumn("distance", F.round("distance", 6))


FRAGMENTS["lang_members"] = (
    ["docx_weights", "lang_centers"],
    """SELECT id, cluster_id FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), cluster_id) AS rn FROM (
    SELECT i.doc_id AS id, c.cluster_id,
      coalesce(s.sq, 0) - 2 * coalesce(p.product, 0) + c.csq AS d
    FROM documents i CROSS JOIN (SELECT cluster_id, sum(weight * weight) AS csq
      FROM lang_centers GROUP BY cluster_id) c
    LEFT JOIN (SELECT id, sum(weight * weight) AS sq FROM docx_weights GROUP BY id) s
      ON s.id = i.doc_id
    LEFT JOIN (SELECT w.id, k.cluster_id, sum(w.weight * k.weight) AS product
      FROM docx_weights w JOIN lang_centers k USING (term) GROUP BY w.id, k.cluster_id) p
      ON p.id = i.doc_id AND p.cluster_id = c.cluster_id)) WHERE rn = 1""",
)


@register(
    "fixed_cluster_sizes",
    query(
        """SELECT cluster_id, count(*) AS count,
  round(count(*) * 100.0::double / sum(count(*)) OVER (), 2) AS percentage
  FROM lang_members GROUP BY cluster_id""",
        "lang_members",
    ),
)
def fixed_cluster_sizes(w):
    return clusters.cluster_sizes(w.by_language.members)


@register(
    "fixed_cluster_terms",
    query(
        """SELECT cluster_id, term, round(weight, 6) AS weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 9) DESC, term) AS rank
  FROM lang_centers) WHERE rank <= 10""",
        "lang_centers",
    ),
)
def fixed_cluster_terms(w):
    top = clusters.top_terms(w.by_language.centers)
    return top.withColumn("weight", F.round("weight", 6))


@register(
    "fixed_cluster_representatives",
    query(
        """SELECT cluster_id, rank, doc_id, text, round(closeness, 6) AS closeness FROM (
  SELECT m.id, m.cluster_id, coalesce(closeness, 0) AS closeness, row_number() OVER (
    PARTITION BY m.cluster_id ORDER BY round(coalesce(closeness, 0), 9) DESC, m.id) AS rank
  FROM lang_members m LEFT JOIN (SELECT w.id, sum(w.weight * c.weight) AS closeness
    FROM docx_weights w JOIN lang_members USING (id) JOIN lang_centers c USING (cluster_id, term)
    GROUP BY w.id) USING (id)) JOIN documents ON doc_id = id WHERE rank <= 5""",
        "docx_weights",
        "lang_centers",
        "lang_members",
    ),
)
def fixed_cluster_representatives(w):
    run = w.by_language
    near = clusters.representatives(run.weights, run.members, run.centers)
    out = clusters.with_texts(near, w.table("documents").select("doc_id", "text"), "doc_id")
    return out.withColumn("closeness", F.round("closeness", 6))


@register(
    "fixed_residual_sample",
    query(
        """SELECT doc_id, text FROM documents JOIN lang_members ON id = doc_id
  WHERE cluster_id = (SELECT cluster_id FROM lang_members GROUP BY cluster_id
    ORDER BY count(*) DESC, cluster_id LIMIT 1)
  ORDER BY md5('42|' || doc_id), doc_id LIMIT 25""",
        "lang_members",
    ),
)
def fixed_residual_sample(w):
    docs = w.table("documents").select("doc_id", "text")
    return clusters.largest_cluster_sample(w.by_language.members, docs, "doc_id")


@register("intent_classifier_metrics")
def intent_classifier_metrics(w):
    return metrics.class_metrics(w.tested, "gold", "intent")


@register(
    "intent_test_rows",
    query(
        """SELECT gold, count(*) AS rows, count(*) AS known, count(*) AS likely FROM (
  SELECT intent AS gold FROM split WHERE split = 'test') GROUP BY gold""",
        "split",
    ),
)
def intent_test_rows(w):
    """What must hold of any fit: the test rows are those of the split, predictions are learned
    labels, and the best of K probabilities is at least 1 / K."""
    labels_ = [r["intent"] for r in w.document_labels.select("intent").distinct().collect()]
    fair = F.col("intent_confidence").between(round(1 / len(labels_), 4) - 1e-4, 1)
    return w.tested.groupBy("gold").agg(
        F.count("*").alias("rows"), F.count_if(F.col("intent").isin(labels_)).alias("known"),
        F.count_if(fair).alias("likely"),
    )


@register("intent_predictions")
def intent_predictions(w):
    return w.tested.select("doc_id", "gold", "intent", "intent_confidence")


# --- streams ----------------------------------------------------------------------------


@register(
    "stream_author_volume",
    """SELECT user_id::varchar AS author_id, count(*) AS tweet_volume FROM events
  WHERE event_type IN ('purchase', 'error') GROUP BY 1""",
)
def stream_author_volume(w):
    import uuid

    from supportlake.session import scratch_dir

    events = w.table("events")
    stream = scoring.message_stream(
        w.spark, f"{w.sf_dir}/events.parquet", events.schema, "parquet"
    ).select(
        F.col("user_id").cast("string").alias("author_id"),
        (~F.col("event_type").isin("purchase", "error")).alias("inbound"),
    )
    base = f"{scratch_dir(w.spark)}/stream-{uuid.uuid4().hex[:12]}"
    run = scoring.run_volume_stream(
        scoring.author_volume_stream(stream), f"{base}/out", f"{base}/checkpoint"
    )
    run.awaitTermination()
    out = w.spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("batch")).scalar()
    return out.filter(F.col("batch") == last).drop("batch")


@register(
    "stream_scores",
    f"""SELECT conv_id, turn, {clean('text')} AS cleaned_text, """
    + ", ".join(f"{hit('text', a)} AS {f}" for f, a in _M.flags.items())
    + " FROM conversations",
)
def stream_scores(w):
    import uuid

    from supportlake.session import scratch_dir

    conv = w.table("conversations")
    stream = scoring.message_stream(
        w.spark, f"{w.sf_dir}/conversations.parquet", conv.schema, "parquet"
    )
    scored = scoring.score_messages(stream, _M).drop(
        "text", "role", "intent", "label_confidence"
    )
    base = f"{scratch_dir(w.spark)}/stream-{uuid.uuid4().hex[:12]}"
    run = (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/out")
    )
    run.awaitTermination()
    return w.spark.read.parquet(f"{base}/out")
