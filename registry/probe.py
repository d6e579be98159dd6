"""How the given tables play the support data, and rules whose words occur in them.

The tables hold invented prose, which the stock vocabulary never matches; the probe packs have
the same shape with other words. MESSAGES is for single messages, DOCUMENTS for whole
documents, where rarer words are needed to reach every branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.rules import RulePack
from supportlake.operators.intents import weak_intent
from supportlake.operators.quality import common_word_gate
from supportlake.sources.tables import read_table

BRAND = "DeskTeam"
MENTION_BRAND = "Mail5"
ID_STEP = 1_000_000
SHORT_MESSAGE = 180
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "der", "die", "und", "la", "de", "en")

#: The second list that refined runs leave out.
NOISE_WORDS = ("this", "with", "for", "von", "mit", "les", "que", "por", "of")

_FLAGS = {
    "deflection": ("this", "las", "den", "aux"),
    "positive": ("that", "von", "les", "por"),
    "positive_plain": ("that", "von", "les", "por", "with"),
    "negation": ("with", "lich", "pa", "ja"),
    "completed_action": ("not", "ein", "mentai", "ll"),
    "policy_instruction": ("by", "zu", "un", "el"),
    "foreign_words": ("der", "los", "une"),
    "old_deflection": ("this", "auf", "sur", "para"),
    "closing": ("with", "mit", "avec", "con", "from"),
}

MESSAGES = RulePack(
    name="probe_messages",
    flags=_FLAGS,
    common_words=("the", "of", "and", "to", "in", "is"),
    intents=dict(
        zip(
            packs.INTENTS,
            (
                ("with", "mit"), ("are", "sind"), ("from", "von"), ("by", "des"), ("on", "und"),
                ("this", "les"), ("for", "las"), ("was", "que"), ("be", "auf"),
            ),
        )
    ),
    priority=packs.SUPPORT.priority,
    fallback=packs.OTHER_INTENT,
    topics=dict(
        zip(
            packs.SUPPORT.topics,
            (
                ("with", "mit"), ("are", "das"), ("from", "von"), ("by", "des"), ("thth", "im"),
                ("this", "les"), ("for", "las"), ("was", "que"),
            ),
        )
    ),
    keywords=dict(
        zip(
            packs.SUPPORT.keywords,
            (
                ("are", "on the"), ("from", "von der"), ("th(?:is|at)",), ("on", "und"),
                ("with", "mit"), ("for", "las"), ("was", "que"), ("by", "des"),
            ),
        )
    ),
)

DOCUMENTS = RulePack(
    name="probe_documents",
    flags=_FLAGS,
    common_words=MESSAGES.common_words,
    intents=dict(
        zip(
            packs.INTENTS,
            (
                ("edin", "dans"), ("heor", "mit"), ("inst", "nicht"), ("hast", "para"),
                ("ingre", "avec"), ("heth", "con"), ("ndes", "une"), ("hant", "las"),
                ("idiot", "ja"),
            ),
        )
    ),
    priority=packs.SUPPORT.priority,
    fallback=packs.OTHER_INTENT,
    topics=MESSAGES.topics,
    keywords=dict(
        zip(
            packs.SUPPORT.keywords,
            (
                ("mit", "edea"), ("inst", "nicht"), ("hast", "der das"), ("ingre", "avec"),
                ("heth", "del"), ("ndes", "sch"), ("hant", "por"), ("edin", "aux"),
            ),
        )
    ),
)

# Reply-audit patterns that occur in the tables.
ACTION_PATTERNS = ("th(is|at) (with|from)", "un(d|e) (die|les)", "(los|las) con")
PRIVATE_PATTERNS = ("mail[0-9]+", "(be|by) (the|and)")

GATE = common_word_gate(MESSAGES.common_words)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = {"documents": "doc_id"}.get(name)
    return read_table(spark, f"{sf_dir}/{name}.parquet", key)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw text rows. A turn answers the one before it; a short one answers
    the one two before, which makes branches. System turns are not in the set, so what
    answers them is a root or an orphan."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") != "system")
    base = F.col("conv_id") * ID_STEP
    user = F.col("role") == "user"
    step = F.when(
        (F.length("text") < SHORT_MESSAGE) & (F.col("turn") >= 2), F.lit(2)
    ).otherwise(F.lit(1))
    parent = F.when(F.col("turn") > 0, base + F.col("turn") - step)
    return conv.select(
        (base + F.col("turn")).cast("string").alias("tweet_id"),
        F.when(user, F.concat(F.lit("c"), F.col("conv_id").cast("string")))
        .otherwise(F.lit(BRAND))
        .alias("author_id"),
        F.when(user, F.lit("True")).otherwise(F.lit("False")).alias("inbound"),
        F.lit(None).cast("string").alias("created_at"),
        "text",
        F.concat(parent.cast("string"), F.lit(".0")).alias("in_response_to_tweet_id"),
        (base + F.col("turn")).alias("ord"),
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: source src3 is the brand, everything else is inbound."""
    by_brand = F.col("source") == "src3"
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("tweet_id"),
        F.when(by_brand, F.lit(MENTION_BRAND)).otherwise(F.col("source")).alias("author_id"),
        (~by_brand).alias("inbound"),
        "text",
        F.col("doc_id").alias("ord"),
    )


def gate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for the language gate: documents, turns, and what is left of a document in two
    words, in handles and links, in numbers."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    key = F.col("doc_id").cast("string")
    of = {
        "d": F.col("text"),
        "w": F.substring_index("text", " ", 2),
        "h": F.concat(F.lit("@"), "source", F.lit(" https://x.y/"), key),
        "n": F.concat_ws(" ", key, F.col("n_chars").cast("string"), key, F.lit("7")),
    }
    parts = [docs.select(F.concat(F.lit(p), key).alias("id"), t.alias("text")) for p, t in of.items()]
    turn = F.concat_ws("-", F.lit("c"), "conv_id", "turn")
    out = turns.select(turn.alias("id"), "text")
    for part in parts:
        out = out.unionByName(part)
    return out


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: purchases and errors are outbound."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("author_id"),
        (~F.col("event_type").isin("purchase", "error")).alias("inbound"),
    )


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation sheet from documents and labels: unlabelled documents are blank rows, toxic
    ones carry an unknown intent, English escalations lack a reason."""
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels")
    named = weak_intent(docs, "text", DOCUMENTS).join(marks, "doc_id", "left")
    low = F.col("quality") == 0
    return named.select(
        F.col("doc_id").alias("idx"),
        F.col("doc_id").cast("string").alias("tweet_id"),
        F.when(F.col("quality").isNull(), F.lit(""))
        .when(F.col("toxic") == 1, F.lit("unheard_of"))
        .otherwise(F.col("intent"))
        .alias("gold_intent"),
        F.when(F.col("quality").isNull(), F.lit(""))
        .when(low, F.lit(packs.ESCALATE))
        .otherwise(F.lit(packs.AUTO))
        .alias("gold_auto_or_escalate"),
        F.when(low & (F.col("lang") != "en"), F.concat(F.lit("text in "), F.col("lang")))
        .otherwise(F.lit(""))
        .alias("escalation_reason"),
        F.when(F.col("quality") == 1, F.col("source")).otherwise(F.lit("")).alias(
            "acceptable_resolution"
        ),
    )


def sheet_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as label updates of the row numbered like their user; reason and resolution from
    the event's value."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("idx"),
        F.concat(F.lit("intent_"), F.col("event_type")).alias("gold_intent"),
        F.when(F.col("event_type") == "view", F.lit(packs.AUTO))
        .when(F.col("event_type") == "click", F.lit("undecided"))
        .otherwise(F.lit(packs.ESCALATE))
        .alias("gold_auto_or_escalate"),
        F.when(cents < 200, F.lit("1"))
        .when(cents < 500, F.lit("4"))
        .when(cents < 1000, F.lit(" "))
        .otherwise(F.lit("value above ten"))
        .alias("escalation_reason"),
        F.when(cents < 800, F.lit("")).otherwise(F.lit("see event log")).alias(
            "acceptable_resolution"
        ),
    )


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted intents of documents by two rule sets."""
    from supportlake.operators.intents import add_keyword_intent

    docs = table(spark, sf_dir, "documents")
    gold = weak_intent(docs, "text", DOCUMENTS).select(
        "doc_id", "text", F.col("intent").alias("gold")
    )
    return add_keyword_intent(gold, "text", DOCUMENTS).select(
        "doc_id", "gold", F.col("intent").alias("pred")
    )
