"""k-means over TF-IDF vectors and the summaries of its clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.operators import tfidf
from supportlake.operators.sampling import sample_key, smallest_per_group
from supportlake.session import SMALL_BYTES, materialize

#: A vocabulary that may be numbered by one task; settings ask for a few thousand terms.
MAX_TERMS = 1_000_000


def vocabulary(stats: DataFrame) -> DataFrame:
    """(term, idf, term_index), indexes by term; for a vocabulary cut to max_features, whose few
    thousand rows one task numbers."""
    if stats.count() > MAX_TERMS:
        raise ValueError("a vocabulary that was not cut cannot be numbered")
    return stats.select("term", "idf").withColumn(
        "term_index", F.row_number().over(Window.orderBy("term")) - 1
    )


def sparse_vectors(
    weights: DataFrame, vocab: DataFrame, ids: DataFrame, size: int, rows: DataFrame | None = None
) -> DataFrame:
    """(id, features) for every row of `ids`; documents without a known term get zeros. The
    `rows` of the cut that gave the weights, if there are any, have them already.

    A written table: the parts of a sparse vector are stored as the struct that the ML vector
    type is made of and read back as vectors, so no row goes through Python. A row holds at
    most `size` entries.
    """
    kinds = T.StructType([ids.schema["id"], T.StructField("features", VectorUDT())])
    if rows is not None:
        return tfidf.read_as(rows, kinds)
    pair = F.struct(
        F.col("term_index").cast("int").alias("i"), F.col("weight").cast("double").alias("w")
    )
    packed = (
        tfidf.together(weights.join(F.broadcast(vocab.select("term", "term_index")), "term"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    )
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),  # 0: sparse
        F.lit(size).cast("int").alias("size"),
        F.coalesce("pairs.i", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("pairs.w", F.array().cast("array<double>")).alias("values"),
    )
    return materialize(
        ids.join(packed, "id", "left").select("id", vector.alias("features")), "vectors", kinds
    )


#: Rows whose dot products a task takes at once.
CLOSE_ROWS = 4096
#: Rows that are worth a task of their own in each round of a fit.
FIT_ROWS = 2048


#: Rows of vectors that lie together, and partitions that are not joined for it. Each round of
#: k-means has two short tasks for a partition.
VECTOR_ROWS = 16_384
VECTOR_PARTS = 16


def dealt(
    features: DataFrame, rows: int | None = None, each: int = FIT_ROWS, least: int = 1
) -> DataFrame:
    """Rows by a hash of their id, in order, over the session's shuffle partitions: what a fit
    draws depends neither on the cores nor on the table's files. Few `rows`, if their number is
    given, take fewer partitions, `each` so many, but not fewer than `least`: a fit's rounds are
    then one short stage each."""
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        parts = min(parts, max(least, -(-rows // each)))
    return features.repartition(parts, "id").sortWithinPartitions("id")


@dataclass
class Clustering:
    """A fitted run: its vocabulary, weights, members (id, cluster_id) and centers
    (cluster_id, term, weight). `rows`: the documents' rows of the cut, if it gave any, whose
    terms are numbered by the vocabulary."""

    vocab: DataFrame
    weights: DataFrame
    members: DataFrame
    centers: DataFrame
    cost: float
    model: KMeansModel | None
    rows: DataFrame | None = None


@dataclass
class Features:
    """TF-IDF rows of a document table (ids: id), written once and shared by fits, sweeps and
    summaries."""

    vocab: DataFrame
    weights: DataFrame
    ids: DataFrame
    rows: DataFrame | None = None

    @cached_property
    def vectors(self) -> DataFrame:
        """The rows as vectors, made for the first fit. Every fit reads them in the same order, so
        they are dealt once and kept; large ones on disk, as memory is for what a fit makes of
        them and goes through many times."""
        size = max(1, self.vocab.count())
        found = sparse_vectors(self.weights, self.vocab, self.ids, size, self.rows)
        stored = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        level = StorageLevel.DISK_ONLY if stored >= SMALL_BYTES else StorageLevel.MEMORY_AND_DISK_DESER
        return dealt(found, found.count(), VECTOR_ROWS, VECTOR_PARTS).persist(level)


def features(
    docs: DataFrame, id_col: str, text_col: str, settings: tfidf.Vectorizer = tfidf.EXPLORE
) -> Features:
    if settings.max_features is None:
        raise ValueError("clustering needs a vocabulary cut to max_features")
    found = tfidf.cut_texts(docs, id_col, text_col, settings)
    vocab, weights = materialize(vocabulary(found.vocab), "vocab"), found.weights
    if found.rows is None:
        weights = materialize(weights, "weights")
    return Features(vocab, weights, docs.select(F.col(id_col).alias("id")), found.rows)


def _best_model(features: DataFrame, k: int, seed: int, restarts: int) -> KMeansModel:
    """Lowest cost over restarts with consecutive seeds.

    A fit that is given a kept table itself decodes its rows in every round; given a selection
    of it, it keeps the vectors with their norms, in memory as far as it goes.
    """
    best, given = None, features.select("features")
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, maxIter=300, tol=1e-4).fit(given)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def cluster_queries(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    settings: tfidf.Vectorizer = tfidf.EXPLORE,
    k: int = 7,
    seed: int = 42,
    restarts: int = 10,
) -> Clustering:
    """k-means over the texts' TF-IDF rows."""
    return cluster_features(features(docs, id_col, text_col, settings), k, seed, restarts)


def cluster_features(
    found: Features, k: int = 7, seed: int = 42, restarts: int = 10
) -> Clustering:
    """k-means over rows that are there already."""
    vocab, weights = found.vocab, found.weights
    model = _best_model(found.vectors, k, seed, restarts)
    members = materialize(
        model.transform(found.vectors).select("id", F.col("prediction").alias("cluster_id")),
        "members",
    )
    spark = weights.sparkSession
    # k centers of at most max_features numbers each.
    table = np.array(model.clusterCenters())
    k, size = table.shape
    rows = {
        "cluster_id": np.repeat(np.arange(k, dtype=np.int32), size),
        "term_index": np.tile(np.arange(size, dtype=np.int32), k),
        "weight": table.ravel(),
    }
    centers = (
        spark.createDataFrame(pa.table(rows))
        .join(F.broadcast(vocab.select("term", "term_index")), "term_index")
        .select("cluster_id", "term", "weight")
    )
    cost = model.summary.trainingCost
    return Clustering(vocab, weights, members, centers, cost, model, found.rows)


def assigned(weights: DataFrame, ids: DataFrame, centers: DataFrame) -> Clustering:
    """The run that fixed centers (cluster_id, term, weight) give: every id goes to the nearest;
    its cost is the sum of the squared distances."""
    near = materialize(nearest_center(weights, ids, centers), "assigned")
    vocab = centers.select("term").distinct()
    cost = near.agg(F.sum("distance")).first()[0]
    return Clustering(vocab, weights, near.select("id", "cluster_id"), centers, cost or 0.0, None)


def top_terms(centers: DataFrame, n: int = 10) -> DataFrame:
    """Heaviest terms per center, ties by term."""
    rank = F.row_number().over(
        Window.partitionBy("cluster_id").orderBy(F.desc("weight"), F.asc("term"))
    )
    return centers.withColumn("rank", rank).filter(F.col("rank") <= n)


def _closeness(rows: DataFrame, vocab: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, by_center): the dot products of the documents' rows with all centers, which a task
    holds: k times max_features numbers."""
    held = centers.join(F.broadcast(vocab.select("term", "term_index")), "term").select(
        "cluster_id", "term_index", "weight"
    ).toPandas()
    k, size = int(held["cluster_id"].max()) + 1, max(1, vocab.count())
    table = np.zeros((size, k))
    table[held["term_index"], held["cluster_id"]] = held["weight"]
    schema = T.StructType([rows.schema["id"]]).add("by_center", T.ArrayType(T.DoubleType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CLOSE_ROWS):
                part = batch.slice(at, CLOSE_ROWS)
                n, terms, weights = part.num_rows, part.column("indices"), part.column("values")
                of = np.repeat(np.arange(n), pc.list_value_length(terms).to_numpy())
                terms, weights = terms.flatten().to_numpy(), weights.flatten().to_numpy()
                dots = [np.bincount(of, weights * c[terms], minlength=n) for c in table.T]
                flat = pa.array(np.array(dots, np.float64).T.ravel())
                ends = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, flat)
                yield pa.record_batch([part.column("id"), lists], schema.names)

    entries = rows.select("id", F.col("features.indices").alias("indices"), F.col("features.values").alias("values"))
    return entries.mapInArrow(task, schema)


def representatives(
    weights: DataFrame, members: DataFrame, centers: DataFrame, n: int = 5,
    vocab: DataFrame | None = None, rows: DataFrame | None = None,
) -> DataFrame:
    """Members with the largest dot product with their center, to nine digits, ties by id.

    With the documents' `rows`, whose terms `vocab` numbers, no weight is moved. Otherwise the
    centers are k times max_features numbers, which Spark broadcasts by their size; the sum runs
    per document.
    """
    if rows is not None:
        own = F.get("by_center", F.col("cluster_id")).alias("closeness")
        dot = members.join(_closeness(rows, vocab, centers), "id").select("id", "cluster_id", own)
    else:
        dot = (
            weights.join(members, "id")
            .join(centers.withColumnRenamed("weight", "center_weight"), ["cluster_id", "term"])
            .groupBy("id", "cluster_id")
            .agg(F.sum(F.col("weight") * F.col("center_weight")).alias("closeness"))
        )
        dot = members.join(dot, ["id", "cluster_id"], "left")
    every = dot.fillna(0.0, ["closeness"])
    order = [F.desc(F.round("closeness", 9)), F.asc("id")]
    near = smallest_per_group(every, ["cluster_id"], order, n)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))
    return near.withColumn("rank", rank)


def with_texts(near: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Representatives (k times n rows) with the columns of `docs`."""
    rows = near.select(F.col("id").alias(id_col), "cluster_id", "rank", "closeness")
    return docs.join(F.broadcast(rows), id_col)


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Members and share (2 dp) per cluster."""
    counts = members.groupBy("cluster_id").agg(F.count("*").alias("count"))
    everything = Window.partitionBy()  # k rows
    return counts.select(
        "cluster_id",
        "count",
        F.round(F.col("count") * 100.0 / F.sum("count").over(everything), 2).alias("percentage"),
    )


def cluster_summary(
    run: Clustering, docs: DataFrame, id_col: str, samples: int = 5, terms: int = 10
) -> DataFrame:
    """One row per cluster: size, share, top terms, representative rows of `docs`."""
    ranked = F.struct("rank", "term")
    words = top_terms(run.centers, terms).groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["term"]).alias("top_terms")
    )
    near = representatives(run.weights, run.members, run.centers, samples, run.vocab, run.rows)
    fields = docs.columns
    rows = docs.join(
        F.broadcast(near.select(F.col("id").alias(id_col), "cluster_id", "rank")), id_col
    )
    sample = F.struct("rank", *[c for c in fields])
    picked = rows.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(sample)).alias("representative_samples")
    )
    return (
        cluster_sizes(run.members)
        .join(words, "cluster_id", "left")
        .join(picked, "cluster_id", "left")
    )


def kmeans_sweep(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    settings: tfidf.Vectorizer = tfidf.REFINE,
    ks: tuple[int, ...] = (8, 10, 12, 14),
    seed: int = 42,
    restarts: int = 5,
) -> DataFrame:
    """Inertia (2 dp) per k over one feature table."""
    return inertia_sweep(features(docs, id_col, text_col, settings), ks, seed, restarts)


def inertia_sweep(
    found: Features, ks: tuple[int, ...] = (8, 10, 12, 14), seed: int = 42, restarts: int = 5
) -> DataFrame:
    """Inertia (2 dp) per k over rows that are there already: only the fits are added."""
    rows = [
        (k, round(_best_model(found.vectors, k, seed, restarts).summary.trainingCost, 2))
        for k in ks
    ]
    return found.vectors.sparkSession.createDataFrame(rows, "k int, inertia double")


def nearest_center(weights: DataFrame, ids: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, cluster_id, distance) of the nearest fixed center, ties to the lower cluster.

    |x - c|^2 = |x|^2 - 2 x.c + |c|^2, with the dot products from one join on term. Centers
    are k rows per term; Spark broadcasts them if their size allows it.
    """
    sizes = centers.groupBy("cluster_id").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("center_sq")
    )
    squares = weights.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("sq"))
    products = (
        weights.join(centers.withColumnRenamed("weight", "center_weight"), "term")
        .groupBy("id", "cluster_id")
        .agg(F.sum(F.col("weight") * F.col("center_weight")).alias("product"))
    )
    per_center = F.struct(F.lit(0.0).alias("product"), "cluster_id", "center_sq")
    all_centers = sizes.agg(F.array_sort(F.collect_list(per_center)).alias("c")).scalar()
    candidates = ids.select("id", F.explode(all_centers).alias("c")).select(
        "id", "c.cluster_id", "c.center_sq"
    )
    scored = (
        candidates.join(products, ["id", "cluster_id"], "left")
        .join(squares, "id", "left")
        .select(
            "id",
            "cluster_id",
            (
                F.coalesce("sq", F.lit(0.0))
                - 2.0 * F.coalesce("product", F.lit(0.0))
                + F.col("center_sq")
            ).alias("distance"),
        )
    )
    best = F.min_by(
        F.struct("cluster_id", "distance"), F.struct(F.round("distance", 9), F.col("cluster_id"))
    )
    return scored.groupBy("id").agg(best.alias("b")).select(
        "id", "b.cluster_id", F.greatest(F.col("b.distance"), F.lit(0.0)).alias("distance")
    )


def largest_cluster_sample(
    members: DataFrame, docs: DataFrame, id_col: str, n: int = 25, seed: int = 42
) -> DataFrame:
    """n random members of the largest cluster, all of them if it is smaller."""
    largest = (
        members.groupBy("cluster_id")
        .count()
        .orderBy(F.desc("count"), F.asc("cluster_id"))
        .limit(1)
        .select("cluster_id")
    )
    drawn = (
        members.join(F.broadcast(largest), "cluster_id")
        .orderBy(sample_key(seed, "id"), "id")
        .limit(n)
        .select(F.col("id").alias(id_col))
    )
    return docs.join(F.broadcast(drawn), id_col, "left_semi")

