"""Retrieval against brute force over all pairs, also where long posting lists are cut."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.operators import dense, retrieval, tfidf
from supportlake.operators.case_store import CaseStore


def grams(text):
    toks = re.findall(r"\w{2,}", text.lower())
    return [" ".join(toks[i : i + n]) for n in (1, 2, 3) for i in range(len(toks) - n + 1)]


def brute(queries, cases, k, weight=0.25):
    """{query: ([(case, sim, final)], hits)}"""
    counts = {c: Counter(grams(t)) for c, t, _ in cases}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(cases)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(counter):
        v = {t: (1 + math.log(n)) * idf[t] for t, n in counter.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    vectors = {c: vector(n) for c, n in counts.items()}
    out = {}
    for q, text, intent in queries:
        v = vector(Counter(grams(text)))
        scored, hits = [], 0
        for c, _, case_intent in cases:
            sim = sum(x * vectors[c].get(t, 0.0) for t, x in v.items())
            same = intent is not None and intent == case_intent
            scored.append((c, sim, sim + (weight if same else 0.0)))
            hits += sim >= packs.HIT_SIMILARITY and (same or intent is None)
        scored.sort(key=lambda s: (-round(s[2], 9), s[0]))
        out[q] = (scored[:k], hits)
    return out


def make(seed, n_cases, n_queries):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]  # a few words are in most texts
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 9))) for _ in range(n_cases)]
    # A third of the cases are copies of one text.
    for i in range(0, n_cases, 3):
        texts[i] = "w0 w1 w2 w0"
    cases = [(f"c{i:03d}", t, rng.choice(["a", "b", "c"])) for i, t in enumerate(texts)]
    queries = []
    for i in range(n_queries):
        text = rng.choice(texts) if rng.random() < 0.3 else " ".join(
            rng.choices(words + ["new"], weights + [0.3], k=rng.randint(1, 8))
        )
        queries.append((f"q{i:03d}", text, rng.choice(["a", "b", "c", "d", None])))
    return queries, cases


@pytest.mark.parametrize("seed, depth, k", [(1, 4, 3), (2, 256, 2), (3, 1, 1), (4, 16, 12)])
def test_topk_equals_brute_force(spark, seed, depth, k):
    queries, cases = make(seed, 90, 40)
    case_df = spark.createDataFrame(cases, "case_id string, cleaned_problem string, intent string")
    case_df = case_df.withColumns({"customer_problem": F.lit("p"), "resolution": F.lit("r")})
    query_df = spark.createDataFrame(queries, "query_id string, cleaned_text string, intent string")
    index = retrieval.CaseIndex(case_df)
    got = {}
    for r in retrieval.retrieve(query_df, index, k, depth=depth).collect():
        got.setdefault(r.query_id, []).append(r)
    expected = brute(queries, cases, k)
    assert got.keys() == expected.keys()
    for q, (top, hits) in expected.items():
        rows = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, k + 1))
        assert [r.case_id for r in rows] == [c for c, _, _ in top], q
        np.testing.assert_allclose([r.similarity for r in rows], [s for _, s, _ in top], atol=1e-9)
        assert {r.relevant_hit_count for r in rows} == {hits}, q


def check_ranked(rows, queries, cases, k):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    expected = brute(queries, cases, k)
    assert got.keys() == expected.keys()
    for q, (top, hits) in expected.items():
        found = sorted(got[q], key=lambda r: r["rank"])
        assert [r.case_id for r in found] == [c for c, _, _ in top], q
        np.testing.assert_allclose([r.similarity for r in found], [s for _, s, _ in top], atol=1e-9)
        assert {r.relevant_hit_count for r in found} == {hits}, q


CASES = "case_id string, cleaned_problem string, intent string"
QUERIES = "query_id string, cleaned_text string, intent string"


@pytest.mark.parametrize("depth, k, part_rows", [(4, 3, 7), (256, 2, 65536)])
def test_store_grows_and_merges_exactly(spark, tmp_path, depth, k, part_rows):
    queries, cases = make(11 + k, 120, 40)
    # Later cases have other words and copies of earlier texts, so idf moves and groups meet.
    cases = cases[:60] + [(c, t.replace("w1", "new"), i) for c, t, i in cases[60:]]
    asked = spark.createDataFrame(queries, QUERIES)

    def frame(rows):
        return spark.createDataFrame(rows, CASES).withColumns(
            {"customer_problem": F.lit("p"), "resolution": F.lit("r")}
        )

    path = str(tmp_path / "store")
    CaseStore.create(path, frame(cases[:60]), buckets=3, part_rows=part_rows)
    for upto in (100, 120):
        store = CaseStore.open(spark, path)
        store.append(frame(cases[60 if upto == 100 else 100 : upto]))
        store = CaseStore.open(spark, path)
        assert store.manifest["n_cases"] == upto
        rows = retrieval.retrieve(asked, store, k, depth=depth).collect()
        check_ranked(rows, queries, cases[:upto], k)
    assert len(store.segments()) == 3 and store.segments()[0].drift > 1
    CaseStore.open(spark, path).merge()
    merged = CaseStore.open(spark, path)
    assert len(merged.segments()) == 1 and merged.segments()[0].scales is None
    merged.vacuum()
    check_ranked(retrieval.retrieve(asked, merged, k, depth=depth).collect(), queries, cases, k)


def test_store_versions(spark, tmp_path):
    case = spark.createDataFrame([("c1", "late parcel", "a", "p", "r")], f"{CASES}, customer_problem string, resolution string")
    path = str(tmp_path / "it's a store")
    with pytest.raises(FileNotFoundError):
        CaseStore.open(spark, path)
    first = CaseStore.create(path, case, buckets=2)
    with pytest.raises(ValueError):
        CaseStore.create(path, case)
    first.append(case.withColumn("case_id", F.lit("c2")))
    with pytest.raises(RuntimeError):  # another writer was faster
        first.append(case.withColumn("case_id", F.lit("c3")))
    asked = spark.createDataFrame([("q", "parcel", None)], QUERIES)
    old = retrieval.retrieve(asked, first, 3).collect()
    assert [r.case_id for r in old] == ["c1"]  # an opened version stays as it is
    now = retrieval.retrieve(asked, CaseStore.open(spark, path), 3).collect()
    assert sorted(r.case_id for r in now) == ["c1", "c2"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_lists_are_read_where_they_lie(spark, tmp_path):
    """No exchange between a posting list's scan and the join with what is asked of it."""
    queries, cases = make(5, 90, 30)
    frame = spark.createDataFrame(cases, CASES).withColumns(
        {"customer_problem": F.lit("p"), "resolution": F.lit("r")}
    )
    store = CaseStore.create(str(tmp_path / "store"), frame, buckets=16)
    segment = store.segments()[0]
    facts = segment.in_parts(segment.terms.select("term", "parts"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = segment.postings.join(facts, ["term", "part"])
        looked_up = segment.postings.join(
            segment.postings.select("term", "part", "gid").distinct(), ["term", "part", "gid"]
        )
        for plan in (plan_of(joined), plan_of(looked_up)):
            lines = plan.splitlines()
            at = next(i for i, x in enumerate(lines) if "FileScan" in x and "bucket#" in x)
            above = lines[:at]
            join = max(i for i, x in enumerate(above) if "SortMergeJoin" in x)
            assert "Bucketed: true" in lines[at]
            assert not any("Exchange" in x for x in above[join:]), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_word_of_every_case_is_many_parts(spark):
    n = 6000
    cases = spark.range(n).select(
        F.format_string("c%05d", "id").alias("case_id"),
        F.concat(F.lit("common w"), (F.col("id") % 1500).cast("string"), F.lit(" x"), F.col("id").cast("string")).alias("cleaned_problem"),
        F.lit("a").alias("intent"), F.lit("p").alias("customer_problem"), F.lit("r").alias("resolution"),
    )
    index = retrieval.CaseIndex(cases, part_rows=200)
    lists = index.postings.filter("term = 'common'").groupBy("part").count().collect()
    assert len(lists) == n // 200 and sum(r["count"] for r in lists) == n
    # Dealt by (term, part), no task holds much more than others.
    dealt = index.postings.repartition(16, "term", "part").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in dealt.collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    asked = cases.limit(50).select(
        F.col("case_id").alias("query_id"), F.col("cleaned_problem").alias("cleaned_text"), "intent"
    )
    rows = retrieval.retrieve(asked, index, 1, depth=100).collect()
    assert len(rows) == 50 and all(abs(r.similarity - 1) < 1e-9 for r in rows)


def test_similar_pairs_equal_brute_force(spark):
    queries, cases = make(7, 60, 30)
    case_df = spark.createDataFrame(cases, "case_id string, cleaned_problem string, intent string")
    query_df = spark.createDataFrame(queries, "query_id string, cleaned_text string, intent string")
    index = retrieval.CaseIndex(case_df)
    texts = {c: t for c, t, _ in cases}
    kinds = {c: i for c, _, i in cases}
    asked = {q: t for q, t, _ in queries}
    expected = {}
    for q, (scored, _) in brute(queries, cases, len(cases)).items():
        for c, sim, _ in scored:
            if sim >= 0.18:
                expected[(asked[q], texts[c], kinds[c])] = sim
    got = {
        (asked[r.query_id], texts[r.case_id], r.case_intent): r
        for r in retrieval.similar_pairs(query_df, index).collect()
    }
    assert got.keys() == expected.keys()
    for key, row in got.items():
        assert abs(row.similarity - expected[key]) < 1e-9
        assert row.query_copies == sum(t == key[0] for t in asked.values())
        assert row.case_copies == sum((t, i) == key[1:] for _, t, i in cases)


def test_more_asked_than_cases(spark):
    cases = [("c1", "late parcel", "a", "p", "r")]
    case_df = spark.createDataFrame(
        cases, "case_id string, cleaned_problem string, intent string, customer_problem string, "
        "resolution string")
    query_df = spark.createDataFrame(
        [("q1", "late parcel again", "a"), ("q2", "nothing known", None)],
        "query_id string, cleaned_text string, intent string")
    rows = retrieval.retrieve(query_df, retrieval.CaseIndex(case_df), 3).collect()
    assert {(r.query_id, r["rank"]) for r in rows} == {("q1", 1), ("q2", 1)}


def test_coverage_edges(spark):
    rows = [
        ("HIGH", 0.35, 2), ("MODERATE", 0.349999, 2), ("MODERATE", 0.35, 1), ("MODERATE", 0.20, 0),
        ("THIN_OR_ABSENT", 0.199999, 0), ("MODERATE", 0.0, 1), ("THIN_OR_ABSENT", 0.0, 0),
    ]
    df = spark.createDataFrame(rows, "want string, top double, hits bigint")
    for r in df.select(
        "want", retrieval.coverage_tier(F.col("top"), F.col("hits")).alias("got"),
        retrieval.coverage_reason(F.col("top"), F.col("hits")).alias("why"),
    ).collect():
        assert r.got == r.want
        assert ("< 0.20" in r.why) == (r.want == "THIN_OR_ABSENT")


@pytest.mark.parametrize("block_rows, fan, k", [(7, 3, 3), (7, 64, 12), (2, 2, 1), (1000, 64, 3)])
def test_dense_topk_equals_brute_force(spark, block_rows, fan, k):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    vectors = base[rng.integers(0, 6, 80)] + 0.3 * rng.normal(size=(80, 8))
    vectors[::3] = vectors[0]  # a third are copies
    vectors[7] = 0.0
    labels = [str(x) if x else None for x in rng.integers(0, 4, 80)]
    rows = [(i, [float(x) for x in v], l) for i, (v, l) in enumerate(zip(vectors, labels))]
    df = spark.createDataFrame(rows, "case_id bigint, embedding array<float>, intent string")
    index = dense.DenseIndex(df.unionAll(df.limit(1).selectExpr("-1L", "null", "'x'")), block_rows, fan)
    leaves = index.nodes.filter("leaf").agg(F.sum("groups"), F.max("groups"), F.count("*")).first()
    assert leaves[0] == index.groups.count() and (leaves[2] > 8) == (block_rows < 10)
    asked = df.withColumnRenamed("case_id", "query_id").withColumn(
        "intent", F.when(F.col("query_id") % 5 != 0, F.coalesce("intent", F.lit("unknown")))
    )
    got = {}
    for r in dense.dense_retrieve(asked, index, k).collect():
        got.setdefault(r.query_id, []).append(r)
    unit = np.float32(vectors).astype(float)
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    unit /= np.where(norm == 0, 1, norm)
    sims = unit @ unit.T
    for i in range(80):
        intent = None if i % 5 == 0 else labels[i] or "unknown"
        same = np.array([intent is not None and x == intent for x in labels])
        final = sims[i] + np.where(same, 0.25, 0.0)
        order = sorted(range(80), key=lambda j: (-round(final[j], 9), j))[:k]
        near = sims[i] >= 0.18
        hits = near.sum() if intent is None else (near & same).sum()
        found = sorted(got[i], key=lambda r: r["rank"])
        assert [r.case_id for r in found] == order
        assert {r.relevant_hit_count for r in found} == {hits}


def test_dense_search_leaves_far_cells_out(spark):
    """Queries look into few of the leaves, and count whole ones without looking."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    vectors = np.repeat(base, 20, axis=0) + 0.02 * rng.normal(size=(600, 16))
    rows = [(i, [float(x) for x in v], "a") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "case_id bigint, embedding array<double>, intent string")
    index = dense.DenseIndex(df, block_rows=20, fan=8)
    asked = df.select(F.col("case_id").alias("qid"), "embedding", "intent").filter("qid % 10 = 0")
    start = asked.select("qid", F.lit(1).cast("long").alias("node"), F.lit(False).alias("counted"))
    first = dense._first_leaf(start, asked, index, 0.25)
    kth = asked.select("qid", F.lit(3).alias("n"), F.lit(1.2).alias("kth"))
    leaves, sure = dense._open_leaves(start, first, kth, asked, index, 3, 0.25)
    n_leaves = index.nodes.filter("leaf").count()
    assert n_leaves > 20 and leaves.count() < 0.6 * 60 * n_leaves
    assert sum(s.count() for s in sure) > 60


def test_tfidf_cuts_vocabulary(spark):
    docs = spark.createDataFrame(
        [(1, "aa bb aa"), (2, "aa cc"), (3, "bb dd")], "id bigint, text string")
    stats = tfidf.fit(docs, "id", "text", tfidf.Vectorizer(1, 1, 2, 1))
    assert sorted(r.term for r in stats.collect()) == ["aa", "bb"]
    weights = tfidf.transform(docs, "id", "text", stats, tfidf.Vectorizer(1, 1, 2, 1))
    squares = weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in squares) and len(squares) == 3


@pytest.mark.parametrize("size, min_df, high", [(25, 1, 2), (25, 2, 3), (400, 2, 3), (100_000, 1, 2), (7, 3, 3)])
def test_one_cut_equals_fit_and_transform(spark, size, min_df, high):
    """Also where the vocabulary is larger than the single words, and where rows do not teach."""
    rng = random.Random(size)
    words = [f"w{i}" for i in range(50)]
    weights = [1 / (i + 1) for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 12))), i % 4 > 0) for i in range(120)]
    rows += [(500, None, True), (501, "", False), (502, "unheard of", False)]
    docs = spark.createDataFrame(rows, "id bigint, text string, learn boolean")
    settings = tfidf.Vectorizer(1, high, size, min_df, ("w3",))
    vocab, got = tfidf.fit_transform(docs, "id", "text", settings, "learn")
    stats = tfidf.fit(docs.filter("learn"), "id", "text", settings)
    expected = tfidf.transform(docs, "id", "text", stats, settings)

    def shown(frame):
        return sorted((r.id, r.term, r.tf, round(r.weight, 9)) for r in frame.collect())

    assert sorted(r.term for r in vocab.collect()) == sorted(r.term for r in stats.collect())
    assert shown(got) == shown(expected) and shown(got)


@pytest.mark.parametrize("seed, depth, k", [(1, 4, 3), (2, 256, 2), (3, 1, 1), (4, 16, 12)])
def test_joined_lists_equal_brute_force(spark, monkeypatch, seed, depth, k):
    """Where lists are short enough to be joined, the cut and its completion."""
    monkeypatch.setattr(retrieval, "PAIR_SHARE", 0)
    test_topk_equals_brute_force(spark, seed, depth, k)
    if seed == 1:
        test_similar_pairs_equal_brute_force(spark)


def test_many_cells_and_strips_equal_brute_force(spark, monkeypatch):
    from supportlake.operators import cells

    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 10)
    monkeypatch.setattr(retrieval, "BLOCK_ENTRIES", 200)
    # Tasks take a module's values anew, so what they read is tested here.
    test_topk_equals_brute_force(spark, 4, 16, 12)
    test_similar_pairs_equal_brute_force(spark)
    rng = np.random.default_rng(1)
    frames = []
    for n in (40, 90):
        rows = [np.sort(rng.choice(60, rng.integers(0, 20), replace=False)) for _ in range(n)]
        frames.append(pd.DataFrame({"terms": rows, "weights": [rng.random(len(r)) for r in rows]}))
    q, c = frames
    full = np.zeros((2, 90, 60))
    for i, frame in enumerate(frames):
        for j, (terms, weights) in enumerate(zip(frame["terms"], frame["weights"])):
            full[i, j, terms] = weights
    for strip, columns in ((100, 3), (7, 0), (10_000, 60)):
        monkeypatch.setattr(cells, "STRIP", strip)
        monkeypatch.setattr(cells, "COLUMNS", columns)
        scores = cells.sparse_scores(q, c)
        got = np.concatenate([scores(s) for s in cells.strips(len(q), len(c))])
        np.testing.assert_allclose(got, full[0, :40] @ full[1].T, atol=1e-12)


@pytest.mark.parametrize("kept", [False, True])
def test_common_words_do_not_write_pairs(spark, monkeypatch, tmp_path, kept):
    """Texts of common words meet in nearly all pairs; what is written grows with the texts."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(12)], k=8))
    rows = [(f"c{i:03d}", text(), "a", "p", "r") for i in range(300)]
    cases = spark.createDataFrame(rows, f"{CASES}, customer_problem string, resolution string")
    asked = spark.createDataFrame([(f"q{i:03d}", text(), "a") for i in range(300)], QUERIES)
    index = retrieval.CaseIndex(cases)
    if kept:
        CaseStore.create(str(tmp_path / "store"), cases, buckets=2)
        index = CaseStore.open(spark, str(tmp_path / "store"))
    sizes, write = {}, retrieval.materialize

    def counted(df, name, *schema):
        out = write(df, name, *schema)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(retrieval, "materialize", counted)
    assert retrieval.retrieve(asked, index, 3, depth=16).count() == 900
    if not kept:
        retrieval.similar_pairs(asked, index, 0.9).count()
    assert max(sizes.values()) < 300 * 30, sizes


def test_counts_of_large_texts_are_dealt_further(spark, monkeypatch, tmp_path):
    """More texts are more partitions, whatever the session's number; small ones take its number."""
    rows = [(i, f"aa bb cc {i}") for i in range(400)]
    spark.createDataFrame(rows, "id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tfidf.by_id(docs).rdd.getNumPartitions() <= usual
    monkeypatch.setattr(tfidf, "TEXT_BYTES", 64)
    assert tfidf.by_id(docs).rdd.getNumPartitions() > 4 * usual
    unsized = spark.createDataFrame(rows, "id long, text string")
    assert tfidf.by_id(unsized).rdd.getNumPartitions() <= usual


def test_cells_move_no_row_more_than_once(spark, monkeypatch):
    """Chunks and blocks are read where they lie, however many meet, and what a task finds for a
    chunk is the best over its blocks."""
    from supportlake.operators import cells

    written, write = [], cells.materialize
    monkeypatch.setattr(cells, "materialize", lambda df, *a, **b: written.append(write(df, *a, **b)) or written[-1])
    left = spark.range(60).selectExpr("cast(id as string) AS qid", "id AS x")
    right = spark.range(90).selectExpr("cast(id as string) AS gid", "id AS y")

    def cell(q, c):
        both = q.merge(c, how="cross").assign(hits=1)
        both["final"] = -((both["x"] - both["y"]) ** 2).astype(float)
        return both[["qid", "gid", "y", "final", "hits"]].rename(columns={"y": "first_id"})

    schema = "qid string, gid string, first_id long, final double, hits long"
    met = cells.meet(left, "qid", 7, right, "gid", 9, cell, schema)
    assert sum(w.selectExpr(f"size({w.columns[0]}) AS n").agg(F.sum("n")).first()[0] for w in written) == 150
    plan = plan_of(met)
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert met.count() == 60 * 90
    best = lambda found: cells.best_of(found, 2)
    folded = cells.meet(left, "qid", 7, right, "gid", 9, cell, schema, best)
    rows = folded.groupBy("qid").agg(F.sum("hits").alias("hits"), F.max(F.struct("final", "gid")).alias("b"))
    assert all(r.hits == 90 and r.b.gid == r.qid and r.b.final == 0 for r in rows.collect())
    assert folded.count() < 60 * 90 / 2


def test_weights_of_large_texts_are_dealt_further(spark, monkeypatch, tmp_path):
    """What a task sorts for a document's norm is bounded by what it reads, too."""
    rows = [(i, f"aa bb cc {i % 40}") for i in range(400)]
    spark.createDataFrame(rows, "id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settings = tfidf.Vectorizer(1, 2, 50, 1)
    few = tfidf.fit_transform(docs, "id", "text", settings)[1]
    expected = {(r.id, r.term): round(r.weight, 9) for r in few.collect()}
    monkeypatch.setattr(tfidf, "TEXT_BYTES", 1024)
    many = tfidf.fit_transform(docs, "id", "text", settings)[1]
    assert many.rdd.getNumPartitions() > 4 * usual
    assert {(r.id, r.term): round(r.weight, 9) for r in many.collect()} == expected
    plan = plan_of(many)
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_vectors_are_made_once_and_only_for_fits(spark, monkeypatch):
    from supportlake.operators import clusters

    rows = [(i, f"aa{i % 3} bb{i % 3} cc") for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string")
    made, make_them = [], clusters.sparse_vectors
    monkeypatch.setattr(clusters, "sparse_vectors", lambda *a: made.append(1) or make_them(*a))
    found = clusters.features(docs, "id", "text", tfidf.Vectorizer(1, 1, 20, 1))
    assert found.weights.count() == 180 and not made
    run = clusters.cluster_features(found, 3, restarts=2)
    clusters.inertia_sweep(found, (2, 3), restarts=1)
    assert len(made) == 1 and found.vectors.storageLevel.useMemory
    assert run.members.groupBy("cluster_id").count().filter("count = 20").count() == 3


def test_search_that_prunes_little_multiplies_in_cells(spark, monkeypatch):
    """Where bounds exclude hardly any node, rows per query and node are not written level by level."""
    sizes, write = {}, dense.materialize

    def counted(df, name, *schema):
        out = write(df, name, *schema)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(dense, "OPEN_NODES", 2)
    monkeypatch.setattr(dense, "materialize", counted)
    test_dense_topk_equals_brute_force(spark, 2, 2, 12)
    assert sizes["dense-judged"] <= 80 * 2 * 2 and sizes["dense-cells"] >= 80
    assert "dense-second" not in sizes


def test_a_search_leaves_its_ranks_only(spark):
    """What a search and an index write on their way is gone when they are there; ranks hold no texts."""
    import os

    from supportlake.session import scratch_dir

    def tables():
        return {n for n in os.listdir(scratch_dir(spark)) if not n.startswith("walk")}

    rows = [(f"c{i}", f"late parcel {i % 7}", "a", f"p{i}", None if i % 2 else "r") for i in range(40)]
    cases = spark.createDataFrame(rows, f"{CASES}, customer_problem string, resolution string")
    asked = spark.createDataFrame([(f"q{i}", f"late parcel {i}", "a") for i in range(9)], QUERIES)
    spark.range(1).write.mode("overwrite").parquet(f"{scratch_dir(spark)}/walk-folder")
    start = tables()
    index = retrieval.CaseIndex(cases)
    built = tables()
    names = sorted(n.rsplit("-", 1)[0] for n in built - start)
    assert names == ["cases", "groups", "lengths", "postings", "stats", "terms"]
    found = retrieval.retrieve(asked, index, 3)
    assert [n.rsplit("-", 1)[0] for n in tables() - built] == ["ranked"]
    by_id = {r[0]: r for r in rows}
    for r in found.collect():
        assert (r.case_id, r.customer_problem, r.resolution) == (
            r.case_id, by_id[r.case_id][3], by_id[r.case_id][4])
    assert found.count() == 27


def test_what_cells_return_does_not_grow_with_chunks_times_blocks(spark):
    from supportlake.operators import cells

    left = spark.range(200).selectExpr("cast(id as string) AS qid", "id AS x")
    right = spark.range(200).selectExpr("cast(id as string) AS gid", "id AS y")

    def cell(q, c):
        both = q.merge(c, how="cross").assign(hits=1)
        both["final"] = -((both["x"] - both["y"]) ** 2).astype(float)
        return both[["qid", "gid", "y", "final", "hits"]].rename(columns={"y": "first_id"})

    schema = "qid string, gid string, first_id long, final double, hits long"
    cost = "spark.sql.files.openCostInBytes"
    usual = spark.conf.get(cost)
    spark.conf.set(cost, str(1 << 28))  # a file is a partition, as large ones are
    try:
        best = lambda found: cells.best_of(found, 1)
        folded = cells.meet(left, "qid", 20, right, "gid", 20, cell, schema, best).collect()
    finally:
        spark.conf.set(cost, usual)
    assert len(folded) <= 200
    assert all(r.gid == r.qid and r.final == 0 and r.hits == 200 for r in folded)
