"""Evidence grading of threads and what follows from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.rules import RulePack, matches
from supportlake.functions.text import (
    clean_text,
    is_ascii,
    language_words,
    nvl,
    strip,
    strip_handles,
)


def rule_flags(df: DataFrame, text: str, pack: RulePack) -> DataFrame:
    """One boolean column per flag rule of the pack."""
    return df.select(
        "*", *[matches(F.col(text), alts).alias(flag) for flag, alts in pack.flags.items()]
    )


def is_trivial(problem: Column) -> Column:
    """The stripped problem text is a greeting or punctuation only."""
    return nvl(problem).rlike(f"(?iu)^(?:{packs.TRIVIAL})\\z")


def confirmed(text: Column, pack: RulePack) -> Column:
    """A positive word and no negation anywhere in the text."""
    return matches(text, pack.flags["positive"]) & ~matches(text, pack.flags["negation"])


def common_word_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the given words the text holds."""
    return F.size(F.array_intersect(language_words(text), F.array(*[F.lit(w) for w in words])))


def short_text_gate(text: Column, words: tuple[str, ...], language: Column) -> Column:
    """Language gate: under three words plain ASCII decides; else the detected language, or
    two common words. `language` is null where detection failed: then ASCII decides."""
    found = language_words(text)
    bare = F.array_join(found, " ")
    hits = common_word_hits(text, words) >= 2
    return (
        F.when(F.size(found) < 3, is_ascii(bare))
        .when(language.isNull(), is_ascii(bare))
        .otherwise((language == "en") | hits)
    )


def common_word_gate(words: tuple[str, ...]) -> Callable[[Column], Column]:
    """Gate on the common words alone, where no language column is at hand."""
    return lambda text: common_word_hits(text, words) >= 2


def keyword_gate(pack: RulePack) -> Callable[[Column, Column], Column]:
    """Older gate: a foreign word in the first customer or first brand text closes it."""
    foreign = pack.flags["foreign_words"]
    return lambda text, brand: ~(matches(text, foreign) | matches(brand, foreign))


def grade_threads(
    endpoints: DataFrame,
    pack: RulePack,
    gate: Callable[[Column], Column] | None = None,
    confirmation: str = "tightened",
    language: str | None = None,
) -> DataFrame:
    """Add tier and reason to a thread table (see `thread_endpoints`).

    gate: test on the first customer text; without one, `language` names the column with the
    detected language of that text, or is "keyword" for the older foreign-word test.
    confirmation: "tightened" rejects negated thanks, "plain" does not.
    """
    first = strip(nvl(F.col("first_customer_text")))
    last_brand = strip(nvl(F.col("last_brand_text")))
    last_customer = strip(nvl(F.col("last_customer_text")))
    flags = pack.flags
    if gate is not None:
        speaks = gate(first)
        language_reason = packs.REASON_LANGUAGE
    elif language == "keyword":
        speaks = keyword_gate(pack)(first, nvl(F.col("first_brand_text")))
        language_reason = packs.REASON_LANGUAGE_KEYWORD
    elif language is not None:
        speaks = short_text_gate(first, pack.common_words, F.col(language))
        language_reason = packs.REASON_LANGUAGE
    else:
        speaks = F.lit(True)
        language_reason = packs.REASON_LANGUAGE
    plain = confirmation == "plain"
    thanks = matches(last_customer, flags["positive_plain"]) if plain else confirmed(
        last_customer, pack
    )

    # Every rule is evaluated once; the CASE below only reads booleans.
    tested = endpoints.select(
        "*",
        strip_handles(F.col("first_customer_text")).alias("cleaned_problem"),
        speaks.alias("_speaks"),
        thanks.alias("_thanks"),
        matches(last_brand, flags["completed_action"]).alias("_action"),
        matches(last_brand, flags["policy_instruction"]).alias("_policy"),
        matches(last_brand, flags["deflection"]).alias("_brand_deflects"),
        matches(F.col("last_text"), flags["deflection"]).alias("_last_deflects"),
        (F.length(last_brand) > 50).alias("_long"),
    )
    by_customer = F.col("last_speaker") == "customer"
    resolved = (
        (by_customer & F.col("_thanks"))
        | F.col("_action")
        | (F.col("_policy") & ~F.col("_brand_deflects") & F.col("_long"))
    ) & ~F.col("_last_deflects")
    problem = F.col("cleaned_problem")
    cases = [
        (F.col("turns_count") < 2, packs.UNUSABLE, packs.REASON_SINGLE_TURN),
        (
            (F.col("customer_turns") == 0) | (F.col("brand_turns") == 0),
            packs.UNUSABLE,
            packs.REASON_ONE_SIDED,
        ),
        (~F.col("_speaks"), packs.UNUSABLE, language_reason),
        ((F.length(problem) < 10) | is_trivial(problem), packs.UNUSABLE, packs.REASON_TRIVIAL),
        (resolved, packs.USABLE, packs.REASON_USABLE_PLAIN if plain else packs.REASON_USABLE),
        (
            F.col("_last_deflects") | F.col("_brand_deflects"),
            packs.PARTIAL,
            packs.REASON_DEFLECTED,
        ),
        (by_customer, packs.PARTIAL, packs.REASON_UNANSWERED),
        (F.lit(True), packs.PARTIAL, packs.REASON_UNCONFIRMED),
    ]
    tier = reason = None
    for test, label, why in cases:
        tier = F.when(test, F.lit(label)) if tier is None else tier.when(test, F.lit(label))
        reason = F.when(test, F.lit(why)) if reason is None else reason.when(test, F.lit(why))
    graded = tested.withColumns({"tier": tier, "reason": reason})
    return graded.drop(*[c for c in graded.columns if c.startswith("_")])


def resolution_status(endpoints: DataFrame, pack: RulePack) -> DataFrame:
    """The older resolved flag: a closing word, no redirection, and the brand spoke last."""
    redirected = matches(F.col("last_brand_text"), pack.flags["old_deflection"]) | (
        F.col("last_speaker") == "customer"
    )
    closing = matches(F.col("last_brand_text"), pack.flags["closing"]) | matches(
        F.col("last_text"), pack.flags["closing"]
    )
    return endpoints.select(
        "*", redirected.alias("_redirected"), closing.alias("_closing")
    ).select(
        *endpoints.columns,
        (~F.col("_redirected") & F.col("_closing")).alias("resolved"),
        F.when(F.col("_redirected"), F.lit(packs.NOTE_REDIRECTED))
        .when(F.col("_closing"), F.col("last_brand_text"))
        .otherwise(F.lit(packs.NOTE_OPEN))
        .alias("resolution"),
    )


def share(count: Column, total: Column, digits: int) -> Column:
    """count as a percentage of total, 0 for an empty total."""
    return F.round(F.coalesce(F.try_divide(count * 100.0, total), F.lit(0.0)), digits)


def quality_distribution(graded: DataFrame) -> DataFrame:
    """Threads and share per tier, empty tiers kept, and a total row."""
    spark = graded.sparkSession
    tiers = spark.createDataFrame(
        [(i, t) for i, t in enumerate(packs.TIERS)], "position int, tier string"
    )
    counts = graded.groupBy("tier").agg(F.count("*").alias("n"))
    filled = tiers.join(counts, "tier", "left").fillna(0, ["n"])
    everything = Window.partitionBy()  # three rows, one per tier
    rows = filled.select(
        "position", "tier", "n", F.sum("n").over(everything).alias("total")
    ).select(
        "position",
        "tier",
        F.col("n").alias("threads"),
        share(F.col("n"), F.col("total"), 1).alias("pct"),
    )
    total = rows.agg(
        F.lit(len(packs.TIERS)).alias("position"),
        F.lit("total").alias("tier"),
        F.sum("threads").alias("threads"),
        F.when(F.sum("threads") > 0, F.lit(100.0)).otherwise(F.lit(0.0)).alias("pct"),
    )
    return rows.unionByName(total)


def resolution_share(status: DataFrame) -> DataFrame:
    """Threads and share per resolved flag."""
    counts = status.groupBy("resolved").agg(F.count("*").alias("threads"))
    everything = Window.partitionBy()  # two rows
    return counts.select(
        "resolved",
        "threads",
        share(F.col("threads"), F.sum("threads").over(everything), 1).alias("pct"),
    )


def first_messages(graded: DataFrame, min_length: int = 10) -> DataFrame:
    """Root messages of usable and partially usable threads, cleaned, long enough to read."""
    return (
        graded.filter(F.col("tier").isin(packs.USABLE, packs.PARTIAL))
        .select(
            "thread_id",
            "tweet_id",
            F.coalesce("author_id", F.lit("customer")).alias("author_id"),
            F.col("root_text").alias("raw_text"),
            clean_text(F.col("root_text")).alias("cleaned_text"),
            "tier",
        )
        .filter(F.length("cleaned_text") >= min_length)
    )


def first_messages_from_threads(usable: DataFrame, partial: DataFrame) -> DataFrame:
    """The same from two nested thread tables."""

    def roots(threads: DataFrame, tier: str) -> DataFrame:
        m = F.element_at("messages", 1)
        return threads.select(
            "thread_id",
            m["tweet_id"].alias("tweet_id"),
            m["author_id"].alias("author_id"),
            m["text"].alias("root_text"),
            F.lit(tier).alias("tier"),
        )

    return first_messages(
        roots(usable, packs.USABLE).unionByName(roots(partial, packs.PARTIAL))
    )
