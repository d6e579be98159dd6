"""SQL building blocks of the twins, written for DuckDB and independent of the Spark code.

A fragment is one named common table expression; `query` puts the needed ones in front of a
final SELECT.
"""

from __future__ import annotations

from registry import probe
from supportlake.functions import packs
from supportlake.functions.rules import re2_regex

W = r"\p{L}\p{N}_"
S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(expr: str, alternatives: tuple[str, ...]) -> str:
    return f"regexp_matches(coalesce({expr}, ''), {q(re2_regex(alternatives))})"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q(f'^[{S}]+|[{S}]+$')}, '', 'g')"


def clean(expr: str) -> str:
    bare = f"regexp_replace({expr}, {q(f'@[{W}]+')}, '', 'g')"
    bare = f"regexp_replace({bare}, {q(f'https?://[^{S}]+')}, '', 'g')"
    return f"trim(regexp_replace({bare}, {q(f'[{S}]+')}, ' ', 'g'))"


def no_handles(expr: str) -> str:
    return strip(f"regexp_replace({strip(expr)}, {q(f'@[{W}]+')}, '', 'g')")


def tokens(expr: str, stop_words: tuple[str, ...] = ()) -> str:
    found = f"regexp_extract_all(lower({expr}), {q(f'[{W}]{{2,}}')})"
    if stop_words:
        words = ", ".join(q(w) for w in stop_words)
        found = f"list_filter({found}, lambda t: t NOT IN ({words}))"
    return found


def grams(toks: str, high: int) -> str:
    parts = [toks]
    for n in range(2, high + 1):
        parts.append(
            f"list_transform(range(1, len({toks}) - {n - 2}), "
            f"lambda i: array_to_string({toks}[i:i + {n - 1}], ' '))"
        )
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


def weak(expr: str, pack, prefix: str = "") -> str:
    """Columns intent and label_confidence."""
    tests = {label: hit(expr, alts) for label, alts in pack.intents.items()}
    whens = " ".join(f"WHEN {tests[label]} THEN {q(label)}" for label in pack.priority)
    n = " + ".join(f"({t})::int" for t in tests.values())
    return (
        f"CASE {whens} ELSE {q(pack.fallback)} END AS {prefix}intent, "
        f"CASE WHEN {n} = 0 THEN 0.5::double WHEN {n} = 1 THEN 1.0::double "
        f"ELSE 0.8::double END AS {prefix}label_confidence"
    )


def first_of(expr: str, rules: dict, default: str) -> str:
    whens = " ".join(f"WHEN {hit(expr, a)} THEN {q(k)}" for k, a in rules.items())
    return f"CASE {whens} ELSE {q(default)} END"


def tfidf(name: str, source: str, id_col: str, text: str, high: int, stop=(), max_features=None,
          min_df: int = 1) -> dict[str, tuple[list[str], str]]:
    """Fragments <name>_counts, <name>_stats, <name>_weights over `source`."""
    toks = f"SELECT {id_col} AS id, {tokens(text, stop)} AS toks FROM {source}"
    deps = [source] if source in FRAGMENTS else []
    cut = f"ORDER BY total_tf DESC, term LIMIT {max_features}" if max_features else ""
    return {
        f"{name}_counts": (
            deps,
            f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({grams('toks', high)}) "
            f"AS term FROM ({toks})) GROUP BY id, term",
        ),
        f"{name}_stats": (
            [f"{name}_counts", *deps],
            f"SELECT term, count(*) AS df, sum(tf)::bigint AS total_tf, "
            f"ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1.0 AS idf "
            f"FROM {name}_counts GROUP BY term HAVING count(*) >= {min_df} {cut}",
        ),
        f"{name}_weights": (
            [f"{name}_counts", f"{name}_stats"],
            f"SELECT id, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS weight FROM "
            f"(SELECT id, term, tf, (1.0 + ln(tf)) * idf AS r FROM {name}_counts "
            f"JOIN {name}_stats USING (term))",
        ),
    }


FRAGMENTS: dict[str, tuple[list[str], str]] = {}

_M, _D = probe.MESSAGES, probe.DOCUMENTS
_F = _M.flags

FRAGMENTS["msgs"] = (
    [],
    f"""SELECT conv_id * {probe.ID_STEP} + turn AS tweet_id,
  CASE WHEN role = 'user' THEN 'c' || conv_id ELSE {q(probe.BRAND)} END AS author_id,
  role = 'user' AS inbound, text,
  CASE WHEN turn > 0 THEN conv_id * {probe.ID_STEP} + turn
    - CASE WHEN length(text) < {probe.SHORT_MESSAGE} AND turn >= 2 THEN 2 ELSE 1 END END AS parent_id
  FROM conversations WHERE role <> 'system'""",
)
FRAGMENTS["fanout"] = (
    ["msgs"],
    """SELECT parent_id, count(*) AS n_replies, min(tweet_id) AS primary_child
  FROM msgs WHERE parent_id IS NOT NULL GROUP BY parent_id""",
)
FRAGMENTS["prim"] = (
    ["fanout", "msgs"],
    """SELECT parent_id, primary_child AS child_id FROM fanout
  WHERE parent_id IN (SELECT tweet_id FROM msgs)""",
)
FRAGMENTS["roots"] = (
    ["msgs"],
    """SELECT tweet_id FROM msgs a WHERE inbound
  AND NOT EXISTS (SELECT 1 FROM msgs b WHERE b.tweet_id = a.parent_id)""",
)
FRAGMENTS["walk"] = (
    ["roots", "prim"],
    """SELECT tweet_id, tweet_id AS root_id, 1 AS turn_no FROM roots
  UNION ALL SELECT p.child_id, w.root_id, w.turn_no + 1 FROM walk w
  JOIN prim p ON p.parent_id = w.tweet_id""",
)
FRAGMENTS["all_turns"] = (
    ["walk", "msgs"],
    f"""SELECT root_id::varchar AS thread_id, turn_no, tweet_id, author_id, text,
  CASE WHEN author_id = {q(probe.BRAND)} OR NOT inbound THEN 'brand' ELSE 'customer' END AS speaker
  FROM walk JOIN msgs USING (tweet_id)""",
)
FRAGMENTS["turns"] = (
    ["all_turns"],
    """SELECT * FROM all_turns WHERE thread_id IN (SELECT thread_id FROM all_turns
  GROUP BY thread_id HAVING bool_or(speaker = 'customer') AND bool_or(speaker = 'brand'))""",
)
FRAGMENTS["ends"] = (
    ["turns"],
    """SELECT thread_id, count(*) AS turns_count,
  count(*) FILTER (WHERE speaker = 'customer') AS customer_turns,
  count(*) FILTER (WHERE speaker = 'brand') AS brand_turns,
  arg_min(tweet_id, turn_no) AS tweet_id, arg_min(author_id, turn_no) AS author_id,
  arg_min(text, turn_no) AS root_text,
  arg_min(text, turn_no) FILTER (WHERE speaker = 'customer') AS first_customer_text,
  arg_max(text, turn_no) FILTER (WHERE speaker = 'customer') AS last_customer_text,
  arg_min(text, turn_no) FILTER (WHERE speaker = 'brand') AS first_brand_text,
  arg_max(text, turn_no) FILTER (WHERE speaker = 'brand') AS last_brand_text,
  arg_max(speaker, turn_no) AS last_speaker, arg_max(text, turn_no) AS last_text
  FROM turns GROUP BY thread_id""",
)
_words = " + ".join(
    f"list_contains(words, {q(w)})::int" for w in _M.common_words
)
FRAGMENTS["tested"] = (
    ["ends"],
    f"""SELECT *, {_words} >= 2 AS speaks FROM (SELECT *,
  {no_handles("first_customer_text")} AS cleaned_problem,
  string_split_regex(regexp_replace(regexp_replace(regexp_replace(
    lower(first_customer_text), {q(f"@[{W}]+")}, '', 'g'), {q(f"https?://[^{S}]+")}, '', 'g'),
    {q(f"[^{W}{S}]")}, ' ', 'g'), {q(f"[{S}]+")}) AS words,
  {hit("last_customer_text", _F["positive"])} AND NOT
  {hit("last_customer_text", _F["negation"])} AS thanks,
  {hit("last_brand_text", _F["completed_action"])} AS act,
  {hit("last_brand_text", _F["policy_instruction"])} AS pol,
  {hit("last_brand_text", _F["deflection"])} AS bdef,
  {hit("last_text", _F["deflection"])} AS ldef,
  length({strip("last_brand_text")}) > 50 AS longer FROM ends)""",
)
_res = "((last_speaker = 'customer' AND thanks) OR act OR (pol AND NOT bdef AND longer)) AND NOT ldef"
_trivial = f"regexp_matches(cleaned_problem, {q('(?i)^(?:' + packs.TRIVIAL + ')$')})"


def _grade(kind: int) -> str:
    cases = [
        ("turns_count < 2", packs.UNUSABLE, packs.REASON_SINGLE_TURN),
        ("customer_turns = 0 OR brand_turns = 0", packs.UNUSABLE, packs.REASON_ONE_SIDED),
        ("NOT speaks", packs.UNUSABLE, packs.REASON_LANGUAGE),
        (
            f"length(cleaned_problem) < 10 OR {_trivial}",
            packs.UNUSABLE,
            packs.REASON_TRIVIAL,
        ),
        (_res, packs.USABLE, packs.REASON_USABLE),
        ("ldef OR bdef", packs.PARTIAL, packs.REASON_DEFLECTED),
        ("last_speaker = 'customer'", packs.PARTIAL, packs.REASON_UNANSWERED),
        ("true", packs.PARTIAL, packs.REASON_UNCONFIRMED),
    ]
    return "CASE " + " ".join(f"WHEN {c[0]} THEN {q(c[kind])}" for c in cases) + " END"


FRAGMENTS["graded"] = (
    ["tested"],
    f"SELECT *, {_grade(1)} AS tier, {_grade(2)} AS reason FROM tested",
)
FRAGMENTS["status"] = (
    ["ends"],
    f"""SELECT *, NOT red AND clos AS resolved, CASE WHEN red THEN {q(packs.NOTE_REDIRECTED)}
  WHEN clos THEN last_brand_text ELSE {q(packs.NOTE_OPEN)} END AS resolution
  FROM (SELECT *, last_speaker = 'customer' OR {hit("last_brand_text", _F["old_deflection"])} AS red,
  {hit("last_brand_text", _F["closing"])} OR {hit("last_text", _F["closing"])} AS clos FROM ends)""",
)
FRAGMENTS["firsts"] = (
    ["graded"],
    f"""SELECT thread_id, tweet_id, author_id, root_text AS raw_text,
  {clean("root_text")} AS cleaned_text, tier FROM graded
  WHERE tier <> 'unusable' AND length({clean("root_text")}) >= 10""",
)
FRAGMENTS["labelled"] = (
    ["firsts"],
    f"SELECT *, {weak('cleaned_text', _M)} FROM firsts",
)
FRAGMENTS["asked"] = (
    ["labelled"],
    """SELECT thread_id AS query_id, raw_text AS customer_message, cleaned_text, tier, intent,
  label_confidence - CASE WHEN length(cleaned_text) < 150 THEN 0.25 ELSE 0 END AS intent_confidence
  FROM labelled""",
)
FRAGMENTS["cases"] = (
    ["graded"],
    f"""SELECT *, {weak("cleaned_problem", _M)} FROM (SELECT thread_id AS case_id,
  root_text AS customer_problem, {clean("root_text")} AS cleaned_problem,
  coalesce(last_brand_text, '') AS resolution FROM graded WHERE tier = 'usable')""",
)
FRAGMENTS.update(tfidf("case", "cases", "case_id", "cleaned_problem", 3))
FRAGMENTS["ask_weights"] = (
    ["asked", "case_stats"],
    f"""SELECT query_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY query_id)) AS weight FROM (
  SELECT query_id, term, (1.0 + ln(count(*))) * any_value(idf) AS r FROM (
    SELECT query_id, unnest({grams("toks", 3)}) AS term FROM (
      SELECT query_id, {tokens("cleaned_text")} AS toks FROM asked))
  JOIN case_stats USING (term) GROUP BY query_id, term)""",
)
FRAGMENTS["sims"] = (
    ["asked", "cases", "ask_weights", "case_weights"],
    """SELECT a.query_id, c.case_id, a.intent AS predicted_intent, c.intent AS case_intent,
  coalesce(s.sim, 0.0) AS sim,
  coalesce(s.sim, 0.0) + CASE WHEN a.intent = c.intent THEN 0.25 ELSE 0 END AS final,
  c.customer_problem, c.resolution
  FROM asked a CROSS JOIN cases c LEFT JOIN (
    SELECT query_id, id AS case_id, sum(q.weight * w.weight) AS sim
    FROM ask_weights q JOIN case_weights w USING (term) GROUP BY query_id, id) s
  ON s.query_id = a.query_id AND s.case_id = c.case_id""",
)
FRAGMENTS["ranked"] = (
    ["sims"],
    """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, case_id)
  AS rank, count(*) FILTER (WHERE sim >= 0.18 AND predicted_intent = case_intent)
  OVER (PARTITION BY query_id) AS relevant_hit_count FROM sims""",
)
FRAGMENTS["covered"] = (
    ["ranked"],
    """SELECT query_id, predicted_intent, round(sim, 4) AS top_similarity, relevant_hit_count,
  resolution, case_id,
  CASE WHEN sim >= 0.35 AND relevant_hit_count >= 2 THEN 'HIGH'
  WHEN sim >= 0.20 OR relevant_hit_count >= 1 THEN 'MODERATE'
  ELSE 'THIN_OR_ABSENT' END AS coverage_tier,
  CASE WHEN sim >= 0.35 AND relevant_hit_count >= 2 THEN
    'Strong evidence found (' || relevant_hit_count || ' matching cases, top similarity: '
    || printf('%.2f', round(sim, 2)) || ').'
  WHEN sim >= 0.20 OR relevant_hit_count >= 1 THEN
    'Partial/moderate evidence found (top similarity: ' || printf('%.2f', round(sim, 2)) || ').'
  ELSE 'Insufficient grounding evidence in historical resolved cases (top similarity: '
    || printf('%.2f', round(sim, 2)) || ' < 0.20).' END AS coverage_reason
  FROM ranked WHERE rank = 1""",
)
_bare = strip(
    f"regexp_replace(regexp_replace(resolution, {q(chr(92) + '^[A-Z]{2,3}')}, '', 'g'), "
    f"{q(f'@[{W}]+')}, '', 'g')"
)
FRAGMENTS["drafted"] = (
    ["asked", "covered"],
    f"""SELECT *, CASE WHEN coverage_tier = 'THIN_OR_ABSENT' THEN {q(packs.REPLY_NO_EVIDENCE)}
  WHEN starts_with(lower(bare), 'hi') OR starts_with(lower(bare), 'hello') THEN bare
  ELSE {q(packs.REPLY_GREETING)} || bare END AS draft_reply FROM (
  SELECT a.*, c.top_similarity, c.relevant_hit_count, c.coverage_tier, c.resolution, c.case_id,
  {_bare} AS bare
  FROM asked a JOIN covered c USING (query_id))""",
)
_policy = [
    (f"intent = {q(label)}", "escalate", q(text))
    for label, text in packs.MANDATORY_ESCALATION.items()
] + [
    (
        "intent_confidence < 0.60",
        "escalate",
        "'Low intent classification confidence (' || printf('%.2f', round(intent_confidence, 2)) "
        "|| ' < 0.60); query is ambiguous.'",
    ),
    (
        "coverage_tier = 'THIN_OR_ABSENT'",
        "escalate",
        "'Insufficient historical evidence (top similarity: ' || "
        "printf('%.2f', round(top_similarity, 2)) || "
        "'); lack of grounded resolution cases to guarantee answer correctness.'",
    ),
    (hit("draft_reply", packs.UNSUPPORTED_CLAIMS), "escalate", q(packs.REASON_UNSUPPORTED)),
]
FRAGMENTS["decided"] = (
    ["drafted"],
    "SELECT *, CASE "
    + " ".join(f"WHEN {t} THEN {q(a)}" for t, a, _ in _policy)
    + " ELSE 'auto_handle' END AS decision, CASE "
    + " ".join(f"WHEN {t} THEN {r}" for t, _, r in _policy)
    + " ELSE 'Confident intent (' || intent || ', conf: ' || "
    "printf('%.2f', round(intent_confidence, 2)) || ') with verified historical procedural "
    "guidance (similarity: ' || printf('%.2f', round(top_similarity, 2)) || ').' END "
    "AS decision_reason FROM drafted",
)


def keyword_columns(message: str, pack) -> str:
    """Intent, confidence, reply, decision and reason of the keyword baseline, as a subquery
    body over a relation `src` with column k = matched intent or ''."""
    def pick(a, b, c, d):
        return (
            f"CASE WHEN contains(lower({message}), 'refund') OR kint = {q(packs.KEYWORD_REFUND_INTENT)} "
            f"THEN {a} WHEN kint IN ({', '.join(q(x) for x in packs.KEYWORD_PROMISE_INTENTS)}) THEN {b} "
            f"WHEN kint = {q(pack.fallback)} AND kconf < 0.60 THEN {c} ELSE {d} END"
        )

    template = (
        f"{q(packs.KEYWORD_TEMPLATE_HEAD)} || replace(kint, '_', ' ') || {q(packs.KEYWORD_TEMPLATE_TAIL)}"
    )
    reply = pick(
        q(packs.KEYWORD_REFUND_REPLY), q(packs.KEYWORD_REPLACEMENT_REPLY),
        q(packs.KEYWORD_OTHER_REPLY), template,
    )
    action = pick("'auto_handle'", "'auto_handle'", "'escalate'", "'auto_handle'")
    reason = pick(
        q(packs.KEYWORD_REFUND_REASON), q(packs.KEYWORD_REPLACEMENT_REASON),
        q(packs.KEYWORD_OTHER_REASON), q(packs.KEYWORD_TEMPLATE_REASON),
    )
    return f"{reply} AS kreply, {action} AS kaction, {reason} AS kreason"


def keyword_source(columns: str, message: str, pack, source: str) -> str:
    label = first_of(f"lower({message})", pack.keywords, "")
    return (
        f"SELECT *, {keyword_columns(message, pack)} FROM (SELECT *, "
        f"CASE WHEN k = '' THEN {q(pack.fallback)} ELSE k END AS kint, "
        f"CASE WHEN k = '' THEN 0.5::double ELSE 0.85::double END AS kconf FROM "
        f"(SELECT {columns}, {label} AS k FROM {source}))"
    )


FRAGMENTS["kw"] = (
    ["asked"],
    keyword_source("query_id, customer_message", "customer_message", _M, "asked"),
)
FRAGMENTS["verb"] = (
    ["asked", "covered"],
    """SELECT query_id, customer_message, intent, intent_confidence, resolution AS draft_reply,
  top_similarity AS top_score,
  CASE WHEN top_similarity < 0.25 OR intent_confidence < 0.40 THEN 'escalate'
    ELSE 'auto_handle' END AS decision,
  'Top retrieval similarity (' || printf('%.3f', round(top_similarity, 3)) ||
  CASE WHEN top_similarity < 0.25 OR intent_confidence < 0.40 THEN ') below threshold (0.25).'
    ELSE ') above threshold.' END AS decision_reason
  FROM asked JOIN covered USING (query_id)""",
)
_unsafe = " OR ".join(
    f"regexp_matches(lower(draft_reply), {q(p)})"
    for p in packs.UNTAKEN_ACTION_PATTERNS + packs.PUBLIC_PII_PATTERNS + probe.ACTION_PATTERNS
    + probe.PRIVATE_PATTERNS
)
FRAGMENTS["gold"] = (
    ["graded", "asked"],
    f"""SELECT query_id, gintent AS gold_intent, gaction AS gold_auto_or_escalate FROM (
  SELECT thread_id AS query_id, {weak(clean("last_customer_text"), _M, "g")},
  CASE WHEN tier = 'usable' OR reason = {q(packs.REASON_UNCONFIRMED)} THEN 'auto_handle'
    ELSE 'escalate' END AS gaction FROM graded
  WHERE thread_id IN (SELECT query_id FROM asked))""",
)
FRAGMENTS["pairs"] = (
    ["kw", "verb", "decided", "gold", "ranked"],
    f"""SELECT s.*, g.gold_intent, g.gold_auto_or_escalate, NOT ({_unsafe}) AS is_safe FROM (
  SELECT 'baseline1' AS system, query_id, customer_message, kint AS intent,
    kconf AS intent_confidence, kreply AS draft_reply, kaction AS decision,
    kreason AS decision_reason, NULL AS refs FROM kw
  UNION ALL SELECT 'baseline2', query_id, customer_message, intent, intent_confidence,
    draft_reply, decision, decision_reason, draft_reply FROM verb
  UNION ALL SELECT 'agent', query_id, customer_message, intent, intent_confidence, draft_reply,
    decision, decision_reason, refs FROM decided JOIN (SELECT query_id,
      string_agg(resolution, ' ' ORDER BY rank) AS refs FROM ranked WHERE rank <= 2
      GROUP BY query_id) USING (query_id)) s
  JOIN gold g USING (query_id)""",
)
_act = " OR ".join(
    f"regexp_matches(r, {q(p)})" for p in packs.UNTAKEN_ACTION_PATTERNS + probe.ACTION_PATTERNS
)
_pii = " OR ".join(
    f"regexp_matches(r, {q(p)})" for p in packs.PUBLIC_PII_PATTERNS + probe.PRIVATE_PATTERNS
)
_risk = ", ".join(q(x) for x in packs.MANDATORY_ESCALATION)
FRAGMENTS["judged"] = (
    ["pairs"],
    f"""SELECT *, round((safety_score + groundedness_score + relevance_score + escalation_score)
    / 4.0, 2) AS overall_score FROM (SELECT *,
  CASE WHEN act OR pii THEN 1 WHEN contains(r, 'refund') AND NOT contains(r, 'http')
    AND decision = 'auto_handle' THEN 2 ELSE 4 END AS safety_score,
  CASE WHEN refs IS NULL THEN CASE WHEN contains(r, 'historical evidence')
      OR contains(r, 'escalat') OR decision = 'escalate' THEN 3 ELSE 1 END
    WHEN act THEN 1 WHEN (contains(r, 'http') AND contains(lower(refs), 'http'))
      OR contains(r, 'amazon.com') THEN 4 ELSE 3 END AS groundedness_score,
  CASE WHEN len(list_filter(string_split(intent, '_'),
      lambda w: contains(m, w) OR contains(r, w))) > 0 THEN 4 ELSE 2 END AS relevance_score,
  CASE WHEN decision = gold_auto_or_escalate THEN 4
    WHEN gold_auto_or_escalate = 'escalate' AND decision = 'auto_handle' THEN 1
    ELSE 2 END AS escalation_score FROM (
  SELECT *, ({_act}) AS act, ({_pii}) AS pii FROM (
    SELECT *, lower(draft_reply) AS r, lower(customer_message) AS m FROM pairs)))""",
)
FRAGMENTS["doc_pairs"] = (
    [],
    f"""SELECT doc_id, {weak("text", _D, "g")},
  {first_of("lower(text)", _D.keywords, _D.fallback)} AS pred FROM documents""",
)
FRAGMENTS["doc_labels"] = (
    [],
    f"SELECT doc_id, text, lang, source, {weak('text', _D)} FROM documents",
)
FRAGMENTS["doc_msgs"] = (
    [],
    f"""SELECT doc_id AS tweet_id, CASE WHEN source = 'src3' THEN {q(probe.MENTION_BRAND)}
  ELSE source END AS author_id, source <> 'src3' AS inbound, text, doc_id AS ord FROM documents""",
)
FRAGMENTS["sheet"] = (
    ["doc_labels"],
    """SELECT d.doc_id AS idx, d.doc_id::varchar AS tweet_id,
  CASE WHEN quality IS NULL THEN '' WHEN toxic = 1 THEN 'unheard_of' ELSE intent END AS gold_intent,
  CASE WHEN quality IS NULL THEN '' WHEN quality = 0 THEN 'escalate' ELSE 'auto_handle' END
    AS gold_auto_or_escalate,
  CASE WHEN quality = 0 AND lang <> 'en' THEN 'text in ' || lang ELSE '' END AS escalation_reason,
  CASE WHEN quality = 1 THEN source ELSE '' END AS acceptable_resolution
  FROM doc_labels d LEFT JOIN labels USING (doc_id)""",
)
FRAGMENTS["updates"] = (
    [],
    """SELECT event_id AS seq, user_id AS idx, 'intent_' || event_type AS gold_intent,
  CASE event_type WHEN 'view' THEN 'auto_handle' WHEN 'click' THEN 'undecided'
    ELSE 'escalate' END AS act,
  CASE WHEN round(value * 100) < 200 THEN '1' WHEN round(value * 100) < 500 THEN '4'
    WHEN round(value * 100) < 1000 THEN ' ' ELSE 'value above ten' END AS why,
  CASE WHEN round(value * 100) < 800 THEN '' ELSE 'see event log' END AS res FROM events""",
)


def scores_for(name: str, by: str, gold: str, pred: str, labels, source: str):
    """Fragment <name>: unrounded precision, recall, f1, support per (by, label)."""
    key = f"{by}, " if by else ""
    names = ", ".join(f"({q(x)})" for x in labels)
    left = f"(SELECT DISTINCT {by} FROM {source}) CROSS JOIN" if by else ""
    on = f"p.{by} = d.{by} AND" if by else ""
    pick = f"d.{by}, " if by else ""
    return (
        [source] if source in FRAGMENTS else [],
        f"""SELECT {key}label, support, p AS precision, r AS recall,
  CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END AS f1 FROM (
  SELECT *, CASE WHEN npred = 0 THEN 0.0 ELSE tp * 1.0 / npred END AS p,
    CASE WHEN support = 0 THEN 0.0 ELSE tp * 1.0 / support END AS r FROM (
  SELECT {pick}d.label, count(*) FILTER (WHERE p.{gold} = d.label) AS support,
    count(*) FILTER (WHERE p.{pred} = d.label) AS npred,
    count(*) FILTER (WHERE p.{gold} = d.label AND p.{pred} = d.label) AS tp
  FROM (SELECT * FROM {left} (VALUES {names}) l(label)) d
  LEFT JOIN {source} p ON {on} (p.{gold} = d.label OR p.{pred} = d.label)
  GROUP BY {pick}d.label))""",
    )


FRAGMENTS["doc_scores"] = scores_for("doc_scores", "", "gintent", "pred", packs.INTENTS, "doc_pairs")
FRAGMENTS["sys_scores"] = scores_for(
    "sys_scores", "system", "gold_intent", "intent", packs.INTENTS, "pairs"
)
FRAGMENTS["esc"] = (
    ["pairs"],
    """SELECT system, count(*) AS n, count(*) FILTER (WHERE g = p) AS ok,
  count(*) FILTER (WHERE g = 'auto_handle' AND p = 'auto_handle') AS aa,
  count(*) FILTER (WHERE g = 'escalate' AND p = 'escalate') AS ee,
  count(*) FILTER (WHERE g = 'escalate' AND p = 'auto_handle') AS ea,
  count(*) FILTER (WHERE g = 'auto_handle' AND p = 'escalate') AS ae,
  count(*) FILTER (WHERE g = 'auto_handle') AS ga, count(*) FILTER (WHERE g = 'escalate') AS ge,
  count(*) FILTER (WHERE p = 'auto_handle') AS pa, count(*) FILTER (WHERE p = 'escalate') AS pe
  FROM (SELECT system, gold_auto_or_escalate AS g, decision AS p FROM pairs) GROUP BY system""",
)


def ratio(a: str, b: str, digits: int = 4) -> str:
    return f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) * 1.0 / ({b}) END, {digits})"


ESC_COLUMNS = ", ".join(
    [
        f"{ratio('ok', 'n')} AS escalation_accuracy",
        f"{ratio('ea', 'ge')} AS false_auto_handle_rate",
        "ea AS false_auto_handle_count",
        f"{ratio('ae', 'ga')} AS false_escalation_rate",
        "ae AS false_escalation_count",
        f"{ratio('aa', 'pa')} AS auto_precision",
        f"{ratio('aa', 'ga')} AS auto_recall",
        f"{ratio('2 * aa', '(pa + ga)')} AS auto_f1",
        "ga AS auto_support",
        f"{ratio('ee', 'pe')} AS escalate_precision",
        f"{ratio('ee', 'ge')} AS escalate_recall",
        f"{ratio('2 * ee', '(pe + ge)')} AS escalate_f1",
        "ge AS escalate_support",
    ]
)


def query(final: str, *needs: str) -> str:
    """WITH RECURSIVE of the needed fragments in dependency order, then the final SELECT."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in FRAGMENTS[name][0]:
            add(dep)
        order.append(name)

    for name in needs:
        add(name)
    if not order:
        return final
    parts = []
    for name in order:
        body = FRAGMENTS[name][1]
        shown = "walk(tweet_id, root_id, turn_no)" if name == "walk" else name
        kind = "" if name == "walk" else "MATERIALIZED "
        parts.append(f"{shown} AS {kind}({body})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final
