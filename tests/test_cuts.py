"""Texts cut where they lie, in Arrow's buffers, against the same work in SQL functions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from supportlake.functions.letters import only_letters, word_letters
from supportlake.functions.text import tokens
from supportlake.operators import clusters, language, tfidf

ODD = [
    "Don't stop_me now, 42 times!", "\u00fcber \u00c9cole \u00a0na\u00efve\u2014caf\u00e9", "\u4f60\u597d\u4e16\u754c \u3053\u3093\u306b\u3061\u306f",
    "a \U0001f600b\U0001f600 \U00010400\U00010401x", "e\u0301e\u0301 \u0915\u094d\u0937 \u00b2\u00bd x\u00b2", "", "   ", None, "\u0130stanbul \u03a3\u03a3 ab\ncd\tef",
]


def texts(spark, n=150, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["\u00e9t\u00e9", "stra\u00dfe", "x", "ab-cd"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 15))), "en" if i % 3 else "de") for i in range(n)]
    rows += [(n + i, t, None if i % 2 else "fr") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)


def test_letters_are_those_of_the_regular_expressions(spark):
    docs = texts(spark).select(F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    rows = docs.select("text", tokens(F.col("text")).alias("toks")).collect()
    column = pa.array(["cut off", *[r.text for r in rows]])[1:]  # an array that begins inside its buffers
    bare = only_letters(column, word_letters(spark)).to_pylist()
    assert [[w for w in t.split(" ") if len(w) > 1] for t in bare] == [r.toks for r in rows]


@pytest.mark.parametrize("size, min_df, high", [(20, 1, 2), (60, 2, 3), (500, 1, 2)])
def test_texts_are_counted_where_they_lie(spark, size, min_df, high):
    docs, settings = texts(spark), tfidf.Vectorizer(1, high, size, min_df, ("w3",))
    found = tfidf.cut_texts(docs, "id", "text", settings)
    asked = docs.select("id", F.lit(True).alias("fitted"), "text")
    expected = tfidf._cut_in_rows(asked, settings, asked.count())
    shown = lambda w: sorted((r.id, r.term, r.tf, round(r.weight, 9)) for r in w.collect())
    assert shown(found.weights) == shown(expected.weights) != []
    assert found.rows.count() == docs.count()  # also documents without a known word
    terms = lambda v: sorted((r.term, r.df, r.total_tf, round(r.idf, 9)) for r in v.collect())
    assert terms(found.vocab) == terms(expected.vocab)


def test_repeated_ids_are_counted_as_one_document(spark, monkeypatch):
    docs, settings = texts(spark), tfidf.Vectorizer(1, 2, 50, 1)
    twice = docs.unionByName(docs.filter("id < 5"))
    found = tfidf.cut_texts(twice, "id", "text", settings)
    assert found.rows is None
    squares = found.weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in squares)
    monkeypatch.setattr(tfidf, "MAX_KNOWN", 10)  # as where the frequent words do not fit a task
    few = tfidf.Vectorizer(1, 2, 10, 1)
    many = tfidf.cut_texts(docs, "id", "text", few)
    monkeypatch.undo()
    shown = lambda w: sorted((r.id, r.term, r.tf, round(r.weight, 9)) for r in w.collect())
    assert shown(many.weights) == shown(tfidf.cut_texts(docs, "id", "text", few).weights)


def test_fits_keep_their_vectors_and_samples_move_no_weights(spark, monkeypatch):
    """A kept table given to a fit is decoded in every round."""
    docs, kept, fitted = texts(spark), [], clusters.KMeans

    class Seen(fitted):
        def fit(self, dataset, params=None):
            kept.append(dataset.storageLevel)
            return super().fit(dataset, params)

    monkeypatch.setattr(clusters, "KMeans", Seen)
    found = clusters.features(docs, "id", "text", tfidf.Vectorizer(1, 2, 60, 1))
    run = clusters.cluster_features(found, 4, restarts=2)
    assert len(kept) == 2 and not any(level.useMemory or level.useDisk for level in kept)
    near = clusters.representatives(run.weights, run.members, run.centers, 3, run.vocab, run.rows)
    expected = clusters.representatives(run.weights, run.members, run.centers, 3)
    shown = lambda n: sorted((r.cluster_id, r["rank"], r.id, round(r.closeness, 9)) for r in n.collect())
    assert shown(near) == shown(expected) != []


@pytest.mark.parametrize("wide", [False, True])
def test_trigrams_are_scored_where_they_lie(spark, wide):
    """Also with more letters than a table of all their trigrams holds."""
    docs = texts(spark)
    if wide:
        many = " ".join(chr(0x4E00 + i) * 2 + chr(0x5E00 + i) for i in range(300))
        docs = docs.unionByName(spark.createDataFrame([(900, many, "zh")], docs.schema))
    profiles = language.fit_profiles(docs, "text", "lang")
    grams = docs.filter("lang IS NOT NULL").select("lang", F.explode(language.trigrams(F.col("text"))).alias("gram"))
    counts = grams.groupBy("lang", "gram").count()
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    gain = F.log(1.0 + F.col("count") / F.col("total") * 1e6).alias("gain")
    expected = counts.join(totals, "lang").select("lang", "gram", gain)
    shown = lambda p: sorted((r.lang, r.gram, round(r.gain, 9)) for r in p.collect())
    assert shown(profiles) == shown(expected) != []
    twice = docs.unionByName(docs.filter("id < 4"))
    scores = language.language_scores(twice, "id", "text", profiles)
    joined = language._joined_scores(twice, "id", "text", profiles)
    scored = lambda s: sorted((r.id, r.lang, round(r.score, 6)) for r in s.collect())
    assert scored(scores) == scored(joined) != []
    plan = scores._jdf.queryExecution().toString()
    assert "gram" not in plan  # no row per text and trigram is made or moved
