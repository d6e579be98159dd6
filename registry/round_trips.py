"""Queries that write and read again: message files, nested threads, the evaluation sheet,
reports, and the agent as a stream; and queries whose rows reach every branch of a rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry import probe
from registry.fragments import FRAGMENTS, hit, q, query
from registry.queries import ORACLES, register
from supportlake.functions import packs
from supportlake.functions.text import clean_text
from supportlake.operators import decisions, dense, labels, quality, retrieval, sampling, threads
from supportlake.operators.intents import weak_intent
from supportlake.plans import support
from supportlake.session import scratch_dir
from supportlake.sources import messages as sources
from supportlake.sources import tables
from supportlake.streaming import scoring

_M = probe.MESSAGES
_F = _M.flags


def _folder(w, name: str) -> str:
    return f"{scratch_dir(w.spark)}/{name}-{uuid.uuid4().hex[:12]}"


# --- message files ----------------------------------------------------------------------

#: What is added to every third text, so that records have line breaks, quotes and commas.
_TAIL = '\n\n"so, it says",\nagain'
FRAGMENTS["filed"] = (
    ["msgs"],
    f"""SELECT tweet_id, author_id, inbound, parent_id, text || CASE WHEN tweet_id % 3 = 0 THEN
  {" || chr(10) || ".join(q(x) for x in _TAIL.split(chr(10)))} ELSE '' END AS text FROM msgs""",
)


def _message_files(w) -> str:
    """The messages as CSV files, in order over three of them."""
    rows = probe.raw_messages(w.spark, w.sf_dir)
    tail = F.when(F.col("ord") % 3 == 0, F.lit(_TAIL)).otherwise(F.lit(""))
    path = _folder(w, "message-files")
    (
        rows.withColumn("text", F.concat("text", tail))
        .withColumn("response_tweet_id", F.lit(None).cast("string"))
        .repartitionByRange(3, "ord")
        .sortWithinPartitions("ord")
        .select(*sources.RAW_SCHEMA.names)
        .write.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )
    return path


def _typed(raw: DataFrame) -> DataFrame:
    return sources.coerce_messages(raw).select(
        "tweet_id", "author_id", "inbound", "text",
        F.coalesce("parent_id", F.lit(-1)).alias("parent_id"),
    )


_FILED = "SELECT tweet_id, author_id, inbound, text, coalesce(parent_id, -1) AS parent_id FROM filed"


@register("message_files", query(_FILED, "filed"))
def message_files(w):
    """Files whose records have line breaks, split like any text."""
    return _typed(sources.scan_messages_csv(w.spark, _message_files(w)))


@register("first_rows", query(f"{_FILED} ORDER BY tweet_id LIMIT 300", "filed"))
def first_rows(w):
    """The row cap of a scan."""
    return _typed(sources.scan_messages_csv(w.spark, _message_files(w), max_rows=300))


@register(
    "file_audit",
    query(
        f"""SELECT count(*) AS total_records,
  sum(1 + CASE WHEN tweet_id % 3 = 0 THEN {_TAIL.count(chr(10))} ELSE 0 END
    + length(regexp_replace(text, '[^\\n]', '', 'g'))
    - CASE WHEN tweet_id % 3 = 0 THEN {_TAIL.count(chr(10))} ELSE 0 END)::bigint AS total_rows
  FROM filed""",
        "filed",
    ),
)
def file_audit(w):
    """Records and physical lines of all files, less their headers."""
    audit = sources.file_audit(w.spark, _message_files(w))
    return audit.agg(
        F.sum("total_records").alias("total_records"), F.sum("total_rows").alias("total_rows")
    )


# --- sinks ------------------------------------------------------------------------------


@register(
    "nested_threads",
    query("SELECT thread_id, turn_no, tweet_id, author_id, speaker, text FROM turns", "turns"),
)
def nested_threads(w):
    """Turns after a trip through nested JSON, one folder per tier, read with a schema."""
    path = _folder(w, "nested")
    nested = threads.nest_threads(w.graded.turns, w.graded.threads, probe.BRAND)
    tables.write_threads(nested, path)
    back = tables.read_threads(w.spark, path, corrupt=True)
    sound = back.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return threads.unnest_threads(sound).select(
        "thread_id", F.col("turn_no").cast("long").alias("turn_no"), "tweet_id", "author_id",
        "speaker", "text",
    )


_SHEET_COLUMNS = ", ".join(
    "model_suggested_intent AS gold_intent" if c == "gold_intent" else f"{c}::varchar AS {c}"
    for c in packs.GOLDEN_COLUMNS
)
_WITH, _SELECT = ORACLES["golden_sample"].rsplit("SELECT thread_id", 1)


@register("golden_sheet", f"{_WITH} SELECT {_SHEET_COLUMNS} FROM (SELECT thread_id{_SELECT})")
def golden_sheet(w):
    """The evaluation sheet as CSV, labelled and written over itself."""
    path = _folder(w, "sheet")
    tables.write_golden(sampling.golden_sample(w.labelled, packs.INTENTS), path)
    sheet = tables.read_golden(w.spark, path, numbered=True)
    tables.write_golden(sheet.withColumn("gold_intent", F.col("model_suggested_intent")), path)
    return tables.read_golden(w.spark, path)


@register("saved_report", ORACLES["quality_distribution"])
def saved_report(w):
    """A report as JSON lines, read again with its schema."""
    path = _folder(w, "report")
    report = quality.quality_distribution(w.graded.threads)
    tables.write_report(report, path)
    return tables.read_report(w.spark, path, report.schema)


# --- streams ----------------------------------------------------------------------------


@register("stream_agent", ORACLES["agent_decisions"])
def stream_agent(w):
    """The agent over files that arrive, a micro-batch a file."""
    base = _folder(w, "agent-stream")
    first = w.first_messages.select("thread_id", "raw_text")
    first.repartition(3, "thread_id").write.parquet(f"{base}/in")
    stream = scoring.message_stream(
        w.spark, f"{base}/in", first.schema, "parquet", maxFilesPerTrigger="2"
    )

    def classify(batch: DataFrame) -> DataFrame:
        rows = batch.withColumn("cleaned_text", clean_text(F.col("raw_text")))
        unsure = F.when(F.length("cleaned_text") < 150, F.lit(0.25)).otherwise(F.lit(0.0))
        return weak_intent(rows, "cleaned_text", _M).select(
            F.col("thread_id").alias("query_id"), F.col("raw_text").alias("customer_message"),
            "cleaned_text", "intent", (F.col("label_confidence") - unsure).alias("intent_confidence"),
        )

    run = scoring.run_agent_stream(stream, w.saved_index, classify, f"{base}/out", f"{base}/checkpoint")
    run.awaitTermination()
    shown = F.transform(
        "retrieved_cases",
        lambda c: F.concat(c["thread_id"], F.lit(":"), F.format_string("%.4f", c["similarity"])),
    )
    out = w.spark.read.parquet(f"{base}/out").drop("batch")
    return out.withColumn("cases", F.array_join(shown, ",")).drop("retrieved_cases")


# --- every branch of a rule -------------------------------------------------------------


@register(
    "older_quality",
    query(
        f"""SELECT thread_id, CASE WHEN turns_count < 2 OR customer_turns = 0 OR brand_turns = 0
    OR foreign_ OR trivial THEN 'unusable' WHEN done THEN 'usable' ELSE 'partially_usable' END AS tier,
  CASE WHEN turns_count < 2 THEN {q(packs.REASON_SINGLE_TURN)}
    WHEN customer_turns = 0 OR brand_turns = 0 THEN {q(packs.REASON_ONE_SIDED)}
    WHEN foreign_ THEN {q(packs.REASON_LANGUAGE_KEYWORD)} WHEN trivial THEN {q(packs.REASON_TRIVIAL)}
    WHEN done THEN {q(packs.REASON_USABLE_PLAIN)} WHEN ldef OR bdef THEN {q(packs.REASON_DEFLECTED)}
    WHEN last_speaker = 'customer' THEN {q(packs.REASON_UNANSWERED)}
    ELSE {q(packs.REASON_UNCONFIRMED)} END AS reason
  FROM (SELECT *, {hit("first_customer_text", _F["foreign_words"])}
      OR {hit("first_brand_text", _F["foreign_words"])} AS foreign_,
    length(cleaned_problem) < 10
      OR regexp_matches(cleaned_problem, {q('(?i)^(?:' + packs.TRIVIAL + ')$')}) AS trivial,
    ((last_speaker = 'customer' AND {hit("last_customer_text", _F["positive_plain"])}) OR act
      OR (pol AND NOT bdef AND longer)) AND NOT ldef AS done FROM tested)""",
        "tested",
    ),
)
def older_quality(w):
    """The older grading: foreign words, thanks without a look at negations."""
    ends = threads.thread_endpoints(w.graded.turns)
    graded = quality.grade_threads(ends, _M, confirmation="plain", language="keyword")
    return graded.select("thread_id", "tier", "reason")


#: Endpoints of threads with what the given ones never have: no answer yet, nothing asked,
#: one turn, one side.
_VARIED = {
    "first_customer_text": "CASE WHEN tweet_id % 7 = 0 THEN '@desk the of' WHEN tweet_id % 11 = 0 "
    "THEN 'der die das und nichts' ELSE first_customer_text END",
    "last_speaker": "CASE WHEN tweet_id % 3 = 0 THEN 'customer' ELSE last_speaker END",
    "last_text": "CASE WHEN tweet_id % 5 > 0 THEN 'ok then' ELSE last_text END",
    "last_brand_text": "CASE WHEN tweet_id % 4 > 0 THEN 'hm' ELSE last_brand_text END",
    "last_customer_text": "CASE WHEN tweet_id % 5 > 2 THEN 'well' ELSE last_customer_text END",
    "turns_count": "CASE WHEN tweet_id % 13 = 0 THEN 1 ELSE turns_count END",
    "brand_turns": "CASE WHEN tweet_id % 17 = 0 THEN 0 ELSE brand_turns END",
}
_STEP = f"tweet_id // {probe.ID_STEP}"
FRAGMENTS["varied_ends"] = (
    ["ends"],
    "SELECT * REPLACE ("
    + ", ".join(f"{e.replace('tweet_id', f'({_STEP})')} AS {c}" for c, e in _VARIED.items())
    + ") FROM ends",
)
for _name, _source in (("tested", "ends"), ("graded", "tested")):
    _deps, _sql = FRAGMENTS[_name]
    FRAGMENTS[f"varied_{_name}"] = (
        [f"varied_{_source}"], _sql.replace(f"FROM {_source}", f"FROM varied_{_source}")
    )


@register(
    "quality_branches",
    query("SELECT thread_id, tier, reason FROM varied_graded", "varied_graded"),
)
def quality_branches(w):
    ends = threads.thread_endpoints(w.graded.turns)
    step = f"(tweet_id div {probe.ID_STEP})"
    varied = ends.withColumns({c: F.expr(e.replace("tweet_id", step)) for c, e in _VARIED.items()})
    return quality.grade_threads(varied, _M, gate=probe.GATE).select("thread_id", "tier", "reason")


#: Evidence and drafts for every line item: similarities around the limits, drafts that claim
#: what nobody did, intents of every kind.
_DRAFTS = (
    "we have processed your refund today", "hi there, see http://x.y", "please send a photo",
    "Hello, it should arrive by friday", "i have cancelled your order",
)
_INTENTS = (*packs.MANDATORY_ESCALATION, *packs.INTENTS[:5])
FRAGMENTS["evidence_rows"] = (
    [],
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_tax * 5 AS top, (l_quantity::bigint) % 4 AS hits,
  round(l_discount * 10, 4)::double AS intent_confidence,
  [{", ".join(map(q, _INTENTS))}][1 + (l_partkey % {len(_INTENTS)})] AS intent,
  [{", ".join(map(q, _DRAFTS))}][1 + (l_suppkey % {len(_DRAFTS)})] AS draft_reply
  FROM lineitem""",
)
_TIER = """CASE WHEN top >= 0.35 AND hits >= 2 THEN 'HIGH' WHEN top >= 0.20 OR hits >= 1
  THEN 'MODERATE' ELSE 'THIN_OR_ABSENT' END"""


def _evidence_rows(w) -> DataFrame:
    pick = lambda names, key: F.get(
        F.array(*map(F.lit, names)), (F.col(key) % len(names)).cast("int")
    )
    return w.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_tax") * 5).alias("top"),
        (F.col("l_quantity").cast("long") % 4).alias("hits"),
        F.round(F.col("l_discount") * 10, 4).cast("double").alias("intent_confidence"),
        pick(_INTENTS, "l_partkey").alias("intent"), pick(_DRAFTS, "l_suppkey").alias("draft_reply"),
    )


@register(
    "coverage_branches",
    query(
        f"SELECT {_TIER} AS coverage_tier, hits, count(*) AS n FROM evidence_rows GROUP BY ALL",
        "evidence_rows",
    ),
)
def coverage_branches(w):
    tier = retrieval.coverage_tier(F.col("top"), F.col("hits")).alias("coverage_tier")
    return _evidence_rows(w).groupBy(tier, "hits").agg(F.count("*").alias("n"))


@register(
    "escalation_branches",
    query(
        f"""SELECT l_orderkey, l_linenumber, coverage_tier, CASE
    WHEN intent IN ({", ".join(map(q, packs.MANDATORY_ESCALATION))}) OR intent_confidence < 0.60
      OR coverage_tier = 'THIN_OR_ABSENT' OR {hit("draft_reply", packs.UNSUPPORTED_CLAIMS)}
    THEN 'escalate' ELSE 'auto_handle' END AS decision
  FROM (SELECT *, {_TIER} AS coverage_tier FROM evidence_rows)""",
        "evidence_rows",
    ),
)
def escalation_branches(w):
    tier = retrieval.coverage_tier(F.col("top"), F.col("hits"))
    rows = _evidence_rows(w).withColumn("coverage_tier", tier)
    chosen = decisions.decision(
        F.col("intent"), F.col("intent_confidence"), F.col("coverage_tier"), F.col("draft_reply")
    )
    return rows.select("l_orderkey", "l_linenumber", "coverage_tier", chosen.alias("decision"))


@register(
    "rubric_branches",
    query(
        f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN gold <> '' THEN CASE WHEN decision = gold THEN 4
      WHEN gold = 'escalate' AND decision = 'auto_handle' THEN 1 ELSE 2 END
    WHEN risk AND decision = 'escalate' THEN 4 WHEN NOT risk AND decision = 'auto_handle' THEN 4
    WHEN risk AND decision = 'auto_handle' THEN 1 ELSE 3 END AS escalation_score,
  CASE WHEN hits = 0 THEN CASE WHEN decision = 'escalate' THEN 3 ELSE 1 END
    WHEN act THEN 1 WHEN contains(draft_reply, 'http') AND hits = 2 THEN 4 ELSE 3
    END AS groundedness_score,
  CASE WHEN act OR pii THEN 1 WHEN contains(draft_reply, 'refund') AND decision = 'auto_handle'
    THEN 2 ELSE 4 END AS safety_score
  FROM (SELECT *, [{", ".join(map(q, ("", *packs.ACTIONS)))}][1 + l_linenumber % 3] AS gold,
    [{", ".join(map(q, packs.ACTIONS))}][1 + l_orderkey % 2] AS decision,
    intent IN ({", ".join(map(q, packs.MANDATORY_ESCALATION))}) AS risk,
    {" OR ".join(f"regexp_matches(lower(draft_reply), {q(p)})" for p in packs.UNTAKEN_ACTION_PATTERNS)} AS act,
    {" OR ".join(f"regexp_matches(lower(draft_reply), {q(p)})" for p in packs.PUBLIC_PII_PATTERNS)} AS pii
  FROM evidence_rows)""",
        "evidence_rows",
    ),
)
def rubric_branches(w):
    """With and without gold, with and without cases, with and without a linked case."""
    pick = lambda names, key: F.get(
        F.array(*map(F.lit, names)), (F.col(key) % len(names)).cast("int")
    )
    case = F.struct(F.when(F.col("hits") == 2, F.lit("see HTTP://x")).otherwise(F.lit("-")).alias("resolution"))
    rows = _evidence_rows(w).withColumns(
        {
            "customer_message": F.lit("?"),
            "gold_auto_or_escalate": pick(("", *packs.ACTIONS), "l_linenumber"),
            "decision": pick(packs.ACTIONS, "l_orderkey"),
            "retrieved_cases": F.when(F.col("hits") > 0, F.array(case)),
        }
    )
    return decisions.judge_scores(rows).select(
        "l_orderkey", "l_linenumber",
        *(F.col(f"{c}_score").cast("long").alias(f"{c}_score") for c in ("escalation", "groundedness", "safety")),
    )


#: Replies from resolutions with initials, handles, greetings, and from none.
_RESOLUTIONS = ("^AB @you all done", "HI @you, done ^XYZ", "hello again", "  ^ABC", "plain words @a @b")


@register(
    "reply_branches",
    query(
        f"""SELECT l_orderkey, l_linenumber, CASE WHEN tier = 'THIN_OR_ABSENT' OR r IS NULL
    THEN {q(packs.REPLY_NO_EVIDENCE)}
    WHEN starts_with(lower(bare), 'hi') OR starts_with(lower(bare), 'hello') THEN bare
    ELSE {q(packs.REPLY_GREETING)} || bare END AS draft_reply FROM (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(r, '\\^[A-Z]{{2,3}}', '', 'g'),
    '@[\\p{{L}}\\p{{N}}_]+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS bare FROM (
  SELECT *, {_TIER} AS tier, CASE WHEN hits <> 3 THEN
    [{", ".join(map(q, _RESOLUTIONS))}][1 + l_partkey % {len(_RESOLUTIONS)}] END AS r
  FROM evidence_rows))""",
        "evidence_rows",
    ),
)
def reply_branches(w):
    rows = _evidence_rows(w)
    which = (F.col("l_partkey") % len(_RESOLUTIONS)).cast("int")
    resolution = F.when(F.col("hits") != 3, F.get(F.array(*map(F.lit, _RESOLUTIONS)), which))
    tier = retrieval.coverage_tier(F.col("top"), F.col("hits"))
    return rows.select(
        "l_orderkey", "l_linenumber", decisions.draft_reply(tier, resolution).alias("draft_reply")
    )


#: Sheet rows with every fault, from orders.
_ACTION = ("", " auto_handle ", "escalate", "Escalate", "ignore")
_INTENT = ("", "unheard_of", *packs.INTENTS[:3])
_WHY = ("", "  ", "text")


@register(
    "validation_branches",
    f"""WITH s AS (SELECT o_orderkey AS idx, trim(a) AS a, i, trim(y) AS y FROM (
    SELECT o_orderkey, [{", ".join(map(q, _ACTION))}][1 + o_orderkey % {len(_ACTION)}] AS a,
      [{", ".join(map(q, _INTENT))}][1 + o_custkey % {len(_INTENT)}] AS i,
      [{", ".join(map(q, _WHY))}][1 + o_custkey % {len(_WHY)}] AS y FROM orders))
  SELECT idx, 'blank_intent' AS error, idx::varchar AS detail FROM s WHERE i = ''
  UNION ALL SELECT idx, 'invalid_intent', i FROM s WHERE i = 'unheard_of'
  UNION ALL SELECT idx, 'blank_action', '' FROM s WHERE a = ''
  UNION ALL SELECT idx, 'invalid_action', a FROM s WHERE a IN ('Escalate', 'ignore')
  UNION ALL SELECT idx, 'missing_reason', '' FROM s WHERE a = 'escalate' AND y = ''
  UNION ALL SELECT -1, 'row_count', 'expected 198, got ' || count(*) FROM s HAVING count(*) <> 198""",
)
def validation_branches(w):
    pick = lambda names, key: F.get(
        F.array(*map(F.lit, names)), (F.col(key) % len(names)).cast("int")
    )
    sheet = w.table("orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_orderkey").cast("string").alias("tweet_id"),
        pick(_INTENT, "o_custkey").alias("gold_intent"),
        pick(_ACTION, "o_orderkey").alias("gold_auto_or_escalate"),
        pick(_WHY, "o_custkey").alias("escalation_reason"),
    )
    return labels.validation_errors(sheet, expected_count=198)


@register(
    "mention_branches",
    query(
        f"""SELECT tweet_id, lower(author_id) = {q(probe.MENTION_BRAND.lower())} AS own, inbound
  FROM (SELECT tweet_id, inbound, CASE WHEN tweet_id % 5 = 0 THEN upper(author_id) ELSE author_id END
    AS author_id, CASE WHEN tweet_id % 4 = 0 THEN text || ' @MAIL5x' ELSE text END AS text FROM doc_msgs)
  WHERE lower(author_id) = {q(probe.MENTION_BRAND.lower())}
    OR contains(lower(text), {q('@' + probe.MENTION_BRAND.lower())})""",
        "doc_msgs",
    ),
)
def mention_branches(w):
    """Loose filter: authors in other case, mentions on rows of either side."""
    rows = probe.document_messages(w.spark, w.sf_dir)
    rows = rows.withColumns(
        {
            "author_id": F.when(F.col("tweet_id") % 5 == 0, F.upper("author_id")).otherwise(F.col("author_id")),
            "text": F.when(F.col("tweet_id") % 4 == 0, F.concat("text", F.lit(" @MAIL5x"))).otherwise(F.col("text")),
        }
    )
    kept = sources.brand_filter(rows, probe.MENTION_BRAND)
    own = F.lower("author_id") == probe.MENTION_BRAND.lower()
    return kept.select("tweet_id", own.alias("own"), "inbound")


# --- retrieval by either method ---------------------------------------------------------


@register(
    "dense_coverage",
    f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN label::varchar END AS asked,
    label::varchar AS label, text, source, list_transform(embedding, lambda x: x::double) AS v
    FROM embeddings JOIN documents ON doc_id = vec_id),
  u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS n FROM e),
  s AS (SELECT a.vec_id AS query_id, a.asked, b.vec_id AS case_id, b.label, b.text, b.source,
    list_dot_product(a.n, b.n) AS sim FROM u a CROSS JOIN u b),
  r AS (SELECT *, sim + CASE WHEN asked = label THEN 0.25 ELSE 0 END AS final FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY round(final, 9) DESC, case_id) AS rank,
    count(*) FILTER (WHERE sim >= 0.18 AND (asked IS NULL OR asked = label))
      OVER (PARTITION BY query_id) AS hits FROM r)
  SELECT query_id, round(sim, 4) AS top_similarity, hits AS relevant_hit_count, text AS first_problem,
    source AS first_resolution, {_TIER.replace("top", "sim")} AS coverage_tier
  FROM k WHERE rank = 1""",
)
def dense_coverage(w):
    """Evidence by embeddings, in the columns that evidence by words has."""
    rows = w.table("embeddings").join(w.table("documents"), F.col("doc_id") == F.col("vec_id"))
    index = dense.DenseIndex(
        rows.select(
            F.col("vec_id").alias("case_id"), "embedding", F.col("label").alias("intent"),
            F.col("text").alias("customer_problem"), F.col("source").alias("resolution"),
        )
    )
    asked = rows.select(
        F.col("vec_id").alias("query_id"), "embedding",
        F.when(F.col("vec_id") % 4 > 0, F.col("label")).alias("intent"),
    )
    first = F.get("retrieved_cases", F.lit(0))
    return support.with_evidence(asked, index, k=2, method="dense").select(
        "query_id", "top_similarity", "relevant_hit_count", "coverage_tier",
        first["customer_problem"].alias("first_problem"), first["resolution"].alias("first_resolution"),
    )
