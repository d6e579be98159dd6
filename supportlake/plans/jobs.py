"""Command-line jobs: spark-submit this file with a job name and paths.

    inspect   raw CSV -> file audit, top outbound authors
    profiles  parquet table (text, lang) -> language profiles for `grade`
    grade     raw CSV -> graded threads as JSON, one folder per tier, and tier counts
    explore   threads -> cluster summaries
    train     threads -> intent model and its metrics
    golden    threads -> blind evaluation sheet and sampling log
    progress  sheet -> labelling progress
    validate  sheet -> faults
    index     threads -> kept retrieval index; with one there already, threads not yet in it
              are added
    agent     messages, model, threads or index -> decisions
    evaluate  sheet, model, threads -> benchmark, per-class metrics, rubric, failures
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.text import clean_text
from supportlake.operators import (
    clusters,
    intents,
    labels,
    language,
    quality,
    retrieval,
    sampling,
    tfidf,
    threads,
)
from supportlake.operators.case_store import BUCKETS, CaseStore
from supportlake.operators.classifier import IntentModel
from supportlake.plans import support
from supportlake.session import materialize, tune
from supportlake.sources import messages as sources
from supportlake.sources import tables


def _raw(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    raw = sources.scan_messages_csv(spark, a.raw, a.max_rows, False if a.single_line else None)
    return sources.coerce_messages(raw)


def _queries(spark: SparkSession, path: str) -> DataFrame:
    """First messages of the usable and partially usable threads at `path`."""
    nested = tables.read_threads(spark, path)
    usable = nested.filter(F.col("quality_label") == packs.USABLE)
    partial = nested.filter(F.col("quality_label") == packs.PARTIAL)
    return materialize(quality.first_messages_from_threads(usable, partial), "first-messages")


def _cases(spark: SparkSession, path: str) -> DataFrame:
    nested = tables.read_threads(spark, path).filter(F.col("quality_label") == packs.USABLE)
    ends = threads.thread_endpoints(threads.unnest_threads(nested))
    return retrieval.case_base(ends.withColumn("tier", F.lit(packs.USABLE)), packs.SUPPORT)


def _index(spark: SparkSession, a: argparse.Namespace) -> retrieval.CaseIndex | CaseStore:
    """The kept index if there is one, else one of the threads for this run."""
    if a.index:
        return CaseStore.open(spark, a.index)
    return retrieval.CaseIndex(_cases(spark, a.threads))


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    cases = _cases(spark, a.threads)
    try:
        store = CaseStore.open(spark, a.index)
    except FileNotFoundError:
        CaseStore.create(a.index, cases, buckets=a.buckets)
        return
    for segment in store.segments():
        cases = cases.join(segment.cases.select("case_id"), "case_id", "left_anti")
    cases = materialize(cases, "new-cases")
    if not cases.isEmpty():
        store = store.append(cases)
    if len(store.segments()) > a.segments:
        store.merge()


def profiles(spark: SparkSession, a: argparse.Namespace) -> None:
    found = language.fit_profiles(spark.read.parquet(a.texts), "text", "lang")
    found.write.mode("overwrite").parquet(a.out)


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_report(sources.file_audit(spark, a.raw), f"{a.out}/audit")
    tables.write_report(sources.top_authors(_raw(spark, a), 30), f"{a.out}/authors")


def grade(spark: SparkSession, a: argparse.Namespace) -> None:
    # The filter comes first: a later version that no longer names the brand is no version of
    # its conversation, and texts of other brands are not shuffled.
    rows = sources.last_version(sources.brand_filter(_raw(spark, a), a.brand))
    rows = materialize(rows, "messages")
    known = spark.read.parquet(a.profiles) if a.profiles else None
    graded = support.graded_threads(rows, a.brand, profiles=known, ignore_case=True, language=a.language)
    nested = threads.nest_threads(graded.turns, graded.threads, a.brand)
    tables.write_threads(nested, f"{a.out}/threads")
    tables.write_report(quality.quality_distribution(graded.threads), f"{a.out}/tiers")
    usable = graded.threads.filter(F.col("tier") == packs.USABLE)
    topics = intents.topic_distribution(usable, "root_text", "thread_id", packs.SUPPORT)
    tables.write_report(topics, f"{a.out}/topics")
    tables.write_report(sampling.tier_sample(graded.threads), f"{a.out}/samples")


def explore(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _queries(spark, a.threads)
    english = tfidf.english_stop_words()
    domain = tfidf.united_stop_words(english, packs.NOISE_WORDS)
    plain = tfidf.with_stop_words(tfidf.EXPLORE, english)
    refined = tfidf.with_stop_words(tfidf.REFINE, domain)
    once = clusters.features(rows, "tweet_id", "cleaned_text", plain)
    again = clusters.features(rows, "tweet_id", "cleaned_text", refined)
    for name, found, k in (("first", once, 7), ("refined", again, 8), ("split", again, 10)):
        run = clusters.cluster_features(found, k)
        tables.write_report(clusters.cluster_summary(run, rows, "tweet_id"), f"{a.out}/{name}")
        if name == "split":
            sample = clusters.largest_cluster_sample(run.members, rows, "tweet_id")
            tables.write_report(sample, f"{a.out}/residual")
    tables.write_report(clusters.inertia_sweep(again), f"{a.out}/inertia")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    model, per_class, overall = support.train_intents(_queries(spark, a.threads))
    model.save(f"{a.out}/model")
    tables.write_report(per_class, f"{a.out}/per_class")
    tables.write_report(overall, f"{a.out}/overall")


def golden(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = intents.weak_intent(_queries(spark, a.threads), "cleaned_text", packs.SUPPORT)
    rows = materialize(rows, "labelled")
    tables.write_golden(sampling.golden_sample(rows, packs.INTENTS), f"{a.out}/sheet")
    tables.write_report(sampling.sampling_log(rows, packs.INTENTS), f"{a.out}/log")


def progress(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_report(labels.progress_record(tables.read_golden(spark, a.sheet, numbered=True)), f"{a.out}/progress")


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    errors = labels.validation_errors(tables.read_golden(spark, a.sheet, numbered=True), expected_count=a.expected)
    tables.write_report(labels.validation_report(errors), f"{a.out}/faults")


def agent(spark: SparkSession, a: argparse.Namespace) -> None:
    model = IntentModel.load(spark, a.model)
    rows = sources.last_version(_raw(spark, a).filter("inbound"))
    out = support.run_agent(rows, model, _index(spark, a))
    tables.write_report(out, f"{a.out}/decisions")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    from supportlake.operators.metrics import failure_samples

    sheet = tables.read_golden(spark, a.sheet).withColumn(
        "cleaned_text", clean_text(F.col("customer_message"))
    )
    model = IntentModel.load(spark, a.model)
    asked = model.predict(
        sheet.select(F.col("tweet_id").alias("query_id"), "customer_message", "cleaned_text"),
        "query_id", "cleaned_text",
    )
    gold = sheet.select(
        F.col("tweet_id").alias("query_id"), "gold_intent", "gold_auto_or_escalate"
    )
    run = support.benchmark(materialize(asked, "asked"), gold, _index(spark, a))
    limits = {"false_auto_handle": None, "false_escalation": 20, "misclassified": 4}
    failures = failure_samples(run.failures.drop("retrieved_cases"), limits, "query_id")
    for name, report in (
        ("benchmark", run.table), ("per_class", run.per_class), ("rubric", run.rubric),
        ("failures", failures),
    ):
        tables.write_report(report, f"{a.out}/{name}")


JOBS = {
    f.__name__: f
    for f in (
        inspect, profiles, grade, explore, train, golden, progress, validate, index, agent, evaluate,
    )
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    p.add_argument("job", choices=JOBS)
    p.add_argument("--raw", help="raw message CSV file or folder")
    p.add_argument("--single-line", action="store_true", help="no line breaks inside quotes")
    p.add_argument("--max-rows", type=int, help="keep the first raw rows only")
    p.add_argument("--brand", help="brand handle")
    p.add_argument("--texts", help="parquet table with text and lang, to learn profiles from")
    p.add_argument("--profiles", help="language profiles; without them only letters and words count")
    p.add_argument(
        "--language", choices=("detected", "keyword"), default="detected",
        help="keyword: the older gate, by foreign words",
    )
    p.add_argument("--index", help="folder of a kept retrieval index")
    p.add_argument("--buckets", type=int, default=BUCKETS, help="buckets of a new index")
    p.add_argument("--segments", type=int, default=8, help="segments beyond which all are merged")
    p.add_argument("--threads", help="graded threads, as written by `grade`")
    p.add_argument("--model", help="intent model folder")
    p.add_argument("--sheet", help="evaluation sheet")
    p.add_argument("--expected", type=int, default=198, help="rows the sheet should have")
    p.add_argument("--out", required=True, help="output folder")
    a = p.parse_args(argv)
    spark = tune(SparkSession.builder.appName(f"supportlake-{a.job}").getOrCreate())
    JOBS[a.job](spark, a)


if __name__ == "__main__":
    main()
