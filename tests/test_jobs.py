"""Composite jobs on hand-made messages, models, streams, and the registered queries."""

import json

from pyspark.sql import functions as F

from registry import check
from registry.queries import ORACLES, QUERIES
from supportlake.functions import packs
from supportlake.operators import dense, classifier, clusters, intents, language, quality, retrieval, tfidf
from supportlake.plans import support
from supportlake.sources import tables
from supportlake.streaming import scoring

ISSUES = [
    ("my parcel is late and the courier says nothing", "Please allow one more day, refund processed"),
    ("the bowl arrived broken and the box was wet", "A replacement sent today, sorry about that"),
    ("how do I get a refund for this return", "Go to your account and choose the order you want to send back"),
    ("I cannot log in, the password is refused", "Please navigate to the sign in page and choose a new password"),
]
SCHEMA = (
    "tweet_id bigint, author_id string, inbound boolean, created_at string, text string, "
    "parent_id bigint, ord bigint"
)


def messages(spark, copies=4):
    rows = []
    for n in range(copies):
        for i, (ask, answer) in enumerate(ISSUES):
            base = (n * len(ISSUES) + i) * 10 + 10
            rows.append((base, f"c{base}", True, None, f"@Desk {ask} number {n}", None, base))
            rows.append((base + 1, "Desk", False, None, f"@c{base} {answer} ^JM", base, base + 1))
            if n % 2:
                rows.append((base + 2, f"c{base}", True, None, "Thanks, that worked", base + 1, base + 2))
    return spark.createDataFrame(rows, SCHEMA)


def queries_of(graded):
    return quality.first_messages(graded.threads)


def test_messages_to_benchmark(spark, tmp_path):
    graded = support.graded_threads(messages(spark), "Desk")
    tiers = {r.tier: r["count"] for r in graded.threads.groupBy("tier").count().collect()}
    assert sum(tiers.values()) == 16 and tiers[packs.USABLE] == 16
    labelled = intents.weak_intent(queries_of(graded), "cleaned_text", packs.SUPPORT)
    asked = labelled.select(
        F.col("thread_id").alias("query_id"), F.col("raw_text").alias("customer_message"),
        "cleaned_text", "intent", F.col("label_confidence").alias("intent_confidence"))
    gold = asked.select(
        "query_id", F.col("intent").alias("gold_intent"),
        F.lit(packs.AUTO).alias("gold_auto_or_escalate")
    ).unionByName(spark.createDataFrame([("none", "", "")], "query_id string, gold_intent string, gold_auto_or_escalate string"))
    index = retrieval.CaseIndex(retrieval.case_base(graded.threads, packs.SUPPORT))
    run = support.benchmark(asked, gold, index)
    table = {r.system: r for r in run.table.collect()}
    assert set(table) == {"baseline1", "baseline2", "agent"} and table["agent"].rows == 16
    assert table["agent"].accuracy == 1.0 and table["baseline1"].safety_violations_count > 0
    assert table["agent"].safety_violations_count == 0
    assert {r.count_ for r in run.rubric.withColumnRenamed("count", "count_").collect()} == {16}
    assert run.failures.count() > 0 and run.per_class.count() == 27
    stripped = support.benchmark(asked, gold, index, stripped_cases=True)
    assert stripped.rubric.count() == 3
    tables.write_report(run.table, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_thread_file_of_arrays(spark, tmp_path):
    record = {"thread_id": "5", "brand": "Desk", "turns_count": 1, "messages": [
        {"tweet_id": 5, "speaker": "customer", "text": "@Desk where is my parcel http://t.co/x"}]}
    path = tmp_path / "usable.json"
    path.write_text(json.dumps([record, record | {"thread_id": "6"}], indent=2))
    threads = tables.read_thread_file(spark, str(path))
    rows = quality.first_messages_from_threads(threads, threads.limit(0)).collect()
    assert len(rows) == 2 and rows[0].cleaned_text == "where is my parcel"
    assert rows[0].author_id == "customer" and rows[0].tier == "usable"


def test_classifier_learns_saves_and_loads(spark, tmp_path):
    graded = support.graded_threads(messages(spark, 10), "Desk")
    queries = queries_of(graded)
    model, per_class, overall = support.train_intents(queries)
    row = overall.first()
    assert row.rows == 8 and row.accuracy >= 0.75 and per_class.count() == 9
    model.save(str(tmp_path / "model"))
    loaded = classifier.IntentModel.load(spark, str(tmp_path / "model"))
    assert loaded.labels == sorted(loaded.labels) and len(loaded.labels) == 4
    fields = ["tweet_id", "intent", "intent_confidence"]
    first = model.predict(queries, "tweet_id", "cleaned_text").select(*fields)
    second = loaded.predict(queries, "tweet_id", "cleaned_text").select(*fields)
    assert sorted(first.collect()) == sorted(second.collect())
    index = retrieval.CaseIndex(retrieval.case_base(graded.threads, packs.SUPPORT))
    out = support.run_agent(messages(spark, 1).filter("inbound"), loaded, index)
    rows = out.collect()
    assert len(rows) == 4
    assert all(len(r.retrieved_cases) == 2 and r.decision in packs.ACTIONS for r in rows)


def test_clusters(spark):
    docs = spark.createDataFrame(
        [(i, f"{ISSUES[i % 4][0]} again {'soon' if i % 8 < 4 else 'later'}") for i in range(48)],
        "id bigint, text string")
    settings = tfidf.with_stop_words(tfidf.EXPLORE, tfidf.english_stop_words())
    run = clusters.cluster_queries(docs, "id", "text", settings, k=4, restarts=3)
    rows = clusters.cluster_summary(run, docs, "id").collect()
    assert sum(r["count"] for r in rows) == 48 and len(rows) == 4
    assert abs(sum(r.percentage for r in rows) - 100) < 0.1
    assert all(len(r.top_terms) == 10 and 1 <= len(r.representative_samples) <= 5 for r in rows)
    near = clusters.nearest_center(run.weights, docs.select("id"), run.centers)
    both = near.join(run.members.withColumnRenamed("cluster_id", "m"), "id")
    assert both.filter("cluster_id <> m").count() == 0
    sample = clusters.largest_cluster_sample(run.members, docs, "id", 25)
    assert sample.count() == min(25, max(r["count"] for r in rows))


def test_language_profiles(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    profiles = language.fit_profiles(docs, "text", "lang")
    found = language.detect_language(docs, "doc_id", "text", profiles)
    right = found.join(docs, F.col("id") == F.col("doc_id")).select(
        F.avg((F.col("detected") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.95
    odd = spark.createDataFrame([(1, "12 34 !!"), (2, None)], "doc_id bigint, text string")
    got = language.detect_language(odd, "doc_id", "text", profiles).collect()
    assert len(got) == 2 and got[0].detected is None
    graded = support.graded_threads(messages(spark, 1), "Desk", profiles=profiles)
    assert graded.threads.count() == 4


def test_stream_equals_batch(spark, tmp_path):
    rows = messages(spark, 2)
    rows.repartition(3).write.json(str(tmp_path / "in"))
    stream = scoring.message_stream(spark, str(tmp_path / "in"), rows.schema, maxFilesPerTrigger="1")
    counts = scoring.run_volume_stream(
        scoring.author_volume_stream(stream), str(tmp_path / "counts"), str(tmp_path / "c1"))
    counts.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "counts"))
    last = out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch").collect()
    assert [tuple(r) for r in last] == [("Desk", 8)]

    from supportlake.session import scratch_dir

    graded = support.graded_threads(rows, "Desk")
    index = retrieval.CaseIndex(retrieval.case_base(graded.threads, packs.SUPPORT))

    def classify(batch):
        scored = scoring.score_messages(batch.filter("inbound"), packs.SUPPORT)
        return scored.select(
            F.col("tweet_id").alias("query_id"), F.col("text").alias("customer_message"),
            "cleaned_text", "intent", F.col("label_confidence").alias("intent_confidence"))

    run = scoring.run_agent_stream(
        stream, index, classify, str(tmp_path / "agent"), str(tmp_path / "c2"))
    run.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "agent")).drop("batch")
    left = spark.sparkContext._jvm.java.io.File(scratch_dir(spark)).list()
    assert not [name for name in left if name.startswith("scope-")]  # a batch's tables are gone
    batch = support.agent_output(support.agent_decisions(classify(rows), index))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_either_method_gives_the_same_columns(spark):
    graded = support.graded_threads(messages(spark, 3), "Desk")
    cases = retrieval.case_base(graded.threads, packs.SUPPORT)
    sparse = retrieval.CaseIndex(cases)
    vector = F.array(*[F.length(F.regexp_replace("cleaned_problem", f"[^{x}]", "")).cast("double") for x in "aeiourst"])
    dense_index = dense.DenseIndex(cases.withColumn("embedding", vector))
    asked = cases.select(
        F.col("case_id").alias("query_id"), F.col("cleaned_problem").alias("cleaned_text"), "intent",
        vector.alias("embedding"))
    by_words = support.find_cases(asked, sparse, 2, "sparse")
    by_vectors = support.find_cases(asked, dense_index, 2, "dense")
    assert by_words.dtypes == by_vectors.dtypes
    for rows in (by_words, by_vectors):
        first = rows.filter("rank = 1").collect()
        assert len(first) == asked.count() and all(abs(r.similarity - 1) < 1e-9 for r in first)
    for index, method in ((sparse, "dense"), (dense_index, "sparse")):
        try:
            support.find_cases(asked, index, 2, method)
            raise AssertionError
        except ValueError:
            pass
    assert support.with_evidence(asked, dense_index).columns == support.with_evidence(asked, sparse).columns


def test_scratch_of_a_scope_goes(spark, tmp_path):
    import os

    from supportlake.session import materialize, scratch_dir, scratch_scope

    with scratch_scope(spark) as folder:
        inner = materialize(spark.range(3), "x")
        with scratch_scope(spark) as deeper:
            materialize(spark.range(3), "y")
            assert deeper.startswith(folder) and os.listdir(deeper)
        assert not os.path.exists(deeper) and inner.count() == 3
    assert not os.path.exists(folder)
    try:
        with scratch_scope(spark) as folder:
            materialize(spark.range(3), "x")
            raise RuntimeError("batch fails")
    except RuntimeError:
        assert not os.path.exists(folder)
    outside = materialize(spark.range(3), "z")
    assert outside.count() == 3 and not [n for n in os.listdir(scratch_dir(spark)) if n.startswith("scope")]


def test_skewed_join_is_split(spark):
    """A parent with most of the replies: AQE splits its partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    from supportlake.operators.threads import thread_roots

    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 400_000
        wide = spark.range(1, n, 1, 8).select(
            F.col("id").alias("tweet_id"), F.lit("c").alias("author_id"), F.lit(True).alias("inbound"),
            F.when(F.col("id") % 3 != 0, F.lit(-5)).otherwise(F.col("id") - 1).alias("parent_id"),
            F.col("id").alias("ord"))
        roots = thread_roots(wide)
        assert roots.count() == n - 1 - (n - 1) // 3
        roots.collect()
        assert "skew=true" in roots._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


VARIED = {  # probe queries must not be the same everywhere
    "thread_quality": "tier", "weak_intent": "intent", "keyword_intent": "intent",
    "confirmation_flag": "confirmed", "resolution_status": "resolved", "coverage_tier": "coverage_tier",
    "escalation_decision": "decision", "reply_safety": "is_safe", "baseline2_decisions": "decision",
}
QUICK = [
    "messages_clean", "brand_filter_strict", "thread_turns", "thread_endpoints", "golden_sample",
    "retrieve_topk", "agent_decisions", "benchmark_table", "judge_summary", "label_merge",
    "stratified_split", "topic_distribution", "failure_cases",
]


def test_probe_queries_vary(spark):
    sf = "/root/testdata/sf0.01"
    for name, column in VARIED.items():
        assert QUERIES[name](spark, sf).select(column).distinct().count() >= 2, name


def test_registered_queries_equal_their_twins(spark, tiny):
    con = check.duck(tiny)
    for name in QUICK:
        got = QUERIES[name](spark, tiny).toPandas()
        assert check.compare(got, con.execute(ORACLES[name]).df()) == "", name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    """A table is one file or a folder of part files; a stream over either has all its rows."""
    from registry import queries

    rows = [(c, t, "user", f"with that {c} {t}") for c in range(5) for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    events = spark.createDataFrame(
        [(i % 3, "purchase") for i in range(9)], "user_id long, event_type string"
    )
    for name, files in (("folder", 4), ("single", 1)):
        base = tmp_path / name
        for table, df in (("conversations", turns), ("events", events)):
            path = base / f"{table}.parquet"
            df.repartition(files).write.parquet(str(path))
            if name == "single":
                part = next(path.glob("part-*"))
                part.rename(base / "part")
                for left in path.iterdir():
                    left.unlink()
                path.rmdir()
                (base / "part").rename(path)
        scored = queries.QUERIES["stream_scores"](spark, str(base))
        assert sorted((r.conv_id, r.turn) for r in scored.collect()) == [r[:2] for r in rows]
        volume = queries.QUERIES["stream_author_volume"](spark, str(base))
        assert sorted(map(tuple, volume.collect())) == [("0", 3), ("1", 3), ("2", 3)]


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    """A job of many steps does not hold the shuffle files of all its steps on disk."""
    import os
    import time

    from supportlake.session import materialize, tune

    top = tune(spark).sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    folders = [str(f) for f in top.diskBlockManager().localDirs()]

    def held():
        names = [(d, n) for top in folders for d, _, files in os.walk(top) for n in files]
        return {(d, n) for d, n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = held()
    keys = spark.range(50_000).select((F.col("id") % 10_007).alias("k"), F.col("id").cast("string").alias("v"))
    out = materialize(keys.groupBy("k").agg(F.max("v").alias("v")).repartition(3, "v"), "grouped")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert out.count() == 10_007 and not held() - before


def test_messages_go_when_the_turns_are_written(spark, tiny):
    import os

    from registry.workspace import Workspace
    from supportlake.session import scratch_scope

    with scratch_scope(spark) as folder:
        w = Workspace(spark, tiny)
        graded = w.graded
        tables = {n.rsplit("-", 1)[0] for d, names, _ in os.walk(folder) for n in names}
        assert "thread-turns" in tables and "messages" not in tables
        assert graded.threads.count() == graded.turns.select("thread_id").distinct().count()
        assert w.messages.count() >= graded.turns.count()  # made again where they are asked for
