"""TF-IDF in long form: one row per (document, term).

Term frequency 1 + ln(tf), idf ln((1 + n) / (1 + df)) + 1, rows scaled to length 1.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, StructType

from supportlake.functions.letters import only_letters, slices, word_letters
from supportlake.functions.text import ngrams, nvl, tokens
from supportlake.session import materialize, scratch_folder, scratch_scope


#: Rows of a term that lie together, and how many terms may be dealt in parts.
PART_ROWS = 65_536
HEAVY_TERMS = 10_000


#: Stored bytes of texts that one task cuts into n-grams and counts.
TEXT_BYTES = 8 * 1024 * 1024
#: Text that a task cuts at once; its words take some ten times that.
SLICE_BYTES = 8 * 1024 * 1024
#: Rows (id, term, tf, weight) are some four times what a document's row holds.
UNFOLDS = 4
#: Frequent words, or n-grams of a length, that every task may hold.
MAX_KNOWN = 500_000
#: Spark gives inputs of unknown size a size beyond any table's.
UNKNOWN_BYTES = 1 << 60


@dataclass(frozen=True)
class Vectorizer:
    """Settings of one use of TF-IDF."""

    low: int = 1
    high: int = 2
    max_features: int | None = None
    min_df: int = 1
    stop_words: tuple[str, ...] = ()


# FIXED VALUES: settings per use; stop words are passed by the caller.
EXPLORE = Vectorizer(1, 2, 3000, 3)
REFINE = Vectorizer(1, 2, 4000, 3)
CLASSIFY = Vectorizer(1, 2, 5000, 2)
RETRIEVE = Vectorizer(1, 3, None, 1)


def english_stop_words() -> tuple[str, ...]:
    """Spark's own English list."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def with_stop_words(settings: Vectorizer, words: Sequence[str]) -> Vectorizer:
    return Vectorizer(
        settings.low, settings.high, settings.max_features, settings.min_df, tuple(words)
    )


def united_stop_words(*lists: Sequence[str]) -> tuple[str, ...]:
    """All words of the lists, each once, in order."""
    return tuple(sorted(set().union(*lists)))


def _partitions(rows: DataFrame) -> tuple[int, int]:
    """The session's number of partitions, and how many hold TEXT_BYTES of what `rows` read."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return usual, -(-sum(s for s in sizes if s < UNKNOWN_BYTES) // TEXT_BYTES)


def by_id(docs: DataFrame) -> DataFrame:
    """Rows dealt by id over the session's partitions, or more for large inputs: an n-gram table
    is many times its texts, so what a task counts is bounded by its texts, and small partitions
    must not be put together again."""
    usual, needed = _partitions(docs)
    return docs.repartition(needed, "id") if needed > usual else docs.repartition("id")


def together(rows: DataFrame, unfolds: int = 1) -> DataFrame:
    """Rows for a grouping by id: large inputs are dealt over more partitions than the session's,
    which a group or window by id then needs no exchange for, so what a task sorts is bounded.
    A stored byte unfolds to so many."""
    usual, needed = _partitions(rows)
    needed *= unfolds
    return rows.repartition(needed, "id") if needed > usual else rows


def term_counts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    settings: Vectorizer,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """(id, term, tf). Ids are unique.

    The texts are spread by id before they are blown up to n-grams; counting per (id, term)
    then needs no further shuffle. With a `vocabulary` cut to max_features, n-grams outside it
    are dropped right where they are made.
    """
    toks = tokens(F.col(text_col), settings.stop_words)
    grams = (
        by_id(docs.select(F.col(id_col).alias("id"), F.col(text_col)))
        .select("id", toks.alias("toks"))
        .select("id", F.explode(ngrams("toks", settings.low, settings.high)).alias("term"))
    )
    if vocabulary is not None and settings.max_features is not None:
        grams = grams.join(F.broadcast(vocabulary.select("term")), "term", "left_semi")
    return grams.groupBy("id", "term").agg(F.count("*").alias("tf"))


def term_stats(counts: DataFrame, n_docs: int, settings: Vectorizer) -> DataFrame:
    """(term, df, total_tf, idf) of the vocabulary, by min_df and max_features.

    Counts have one row per document and term, so df is a plain count. The cut to
    max_features keeps the most frequent terms, ties by term.
    """
    stats = counts.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total_tf")
    )
    if settings.min_df > 1:
        stats = stats.filter(F.col("df") >= settings.min_df)
    if settings.max_features is not None:
        stats = stats.orderBy(F.desc("total_tf"), F.asc("term")).limit(settings.max_features)
    idf = F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0
    return stats.withColumn("idf", idf)


class HeavyTerms:
    """Terms with very many rows, each dealt over parts of about `part_rows` rows, so that a
    join on (term, part) has no hot key.

    At most `most` terms, the most frequent ones, are listed; that is the bound of what is
    broadcast. A term not listed has fewer than 1 / `most` of all rows, or fits one part.
    """

    def __init__(self, sizes: DataFrame, part_rows: int = PART_ROWS, most: int = HEAVY_TERMS):
        """sizes: (term, n), a row per term."""
        heavy = (
            sizes.filter(F.col("n") > part_rows)
            .orderBy(F.desc("n"), F.asc("term"))
            .limit(most)
            .select("term", F.ceil(F.col("n") / part_rows).cast("int").alias("heavy_parts"))
        )
        self.table = materialize(heavy, "heavy-terms")

    def _parts(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        return rows.join(F.broadcast(self.table), "term", "left"), F.coalesce("heavy_parts", F.lit(1))

    def deal(self, rows: DataFrame, by: str, part: str = "part") -> DataFrame:
        """Adds the part that a row of its term belongs to, by the value of column `by`."""
        marked, parts = self._parts(rows)
        return marked.withColumn(part, F.pmod(F.xxhash64(by), parts).cast("int")).drop("heavy_parts")

    def spread(self, facts: DataFrame, part: str = "part") -> DataFrame:
        """Rows that belong to a whole term, once for each of its parts."""
        marked, parts = self._parts(facts)
        return marked.withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))).drop("heavy_parts")


def tfidf_weights(
    counts: DataFrame, stats: DataFrame, bounded: bool = False, heavy: HeavyTerms | None = None
) -> DataFrame:
    """(id, term, tf, weight), each document's weights scaled to length 1.

    bounded: the vocabulary is cut to max_features, so its few thousand rows are broadcast;
    otherwise the join shuffles on the term, and on parts of the `heavy` terms if given.
    """
    idf = stats.select("term", "idf")
    if bounded:
        joined = counts.join(F.broadcast(idf), "term")
    elif heavy is not None:
        joined = heavy.deal(counts, "id").join(heavy.spread(idf), ["term", "part"])
    else:
        joined = counts.join(idf, "term")
    raw = together(
        joined.select("id", "term", "tf", ((1.0 + F.log(F.col("tf"))) * F.col("idf")).alias("raw"))
    )
    # The window holds one document's distinct terms.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "tf", (F.col("raw") / norm).alias("weight"))


def fit(docs: DataFrame, id_col: str, text_col: str, settings: Vectorizer) -> DataFrame:
    """Vocabulary with idf of a document table, as a written table."""
    counts = term_counts(docs, id_col, text_col, settings)
    return materialize(term_stats(counts, docs.count(), settings), "vocabulary")


def transform(
    docs: DataFrame, id_col: str, text_col: str, stats: DataFrame, settings: Vectorizer
) -> DataFrame:
    """Weights of documents under a fitted vocabulary; unseen terms are left out."""
    counts = term_counts(docs, id_col, text_col, settings, stats)
    return tfidf_weights(counts, stats, bounded=settings.max_features is not None)


@dataclass
class Cut:
    """One cut of a document table: the vocabulary with idf as a written table, the weights as
    rows (id, term, tf, weight) and, where every id has one row, as `rows`: a written table
    (id, features, tfs) of one row per document, terms numbered in the order of their text.
    `features` are the parts that the ML vector type is made of."""

    vocab: DataFrame
    weights: DataFrame
    rows: DataFrame | None = None


def fit_transform(
    docs: DataFrame, id_col: str, text_col: str, settings: Vectorizer, fitted: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary with idf, weights of all documents), both from one cut of the texts; the
    first as a written table. Only rows where the column `fitted` is true, or all, make the
    vocabulary."""
    found = cut_texts(docs, id_col, text_col, settings, fitted)
    return found.vocab, found.weights


def cut_texts(
    docs: DataFrame, id_col: str, text_col: str, settings: Vectorizer, fitted: str | None = None
) -> Cut:
    """As `fit_transform`, with the documents' rows.

    The vocabulary is the max_features most frequent n-grams, and an n-gram is no more
    frequent than the two shorter ones it begins and ends with. So the first level's counts
    give a frequency that the vocabulary does not go below, and longer n-grams are only counted
    where both parts reach it: most of them never leave the task that makes them.

    Texts are counted where they lie, as numbers of words, if every id has one row and the
    frequent words fit each task; otherwise as rows (id, term, tf).
    """
    if settings.max_features is None or settings.low != 1:
        raise ValueError("needs a vocabulary from single words on, cut to max_features")
    mark = F.lit(True) if fitted is None else F.coalesce(F.col(fitted), F.lit(False))
    docs = docs.select(F.col(id_col).alias("id"), mark.alias("fitted"), F.col(text_col).alias("text"))
    seen = (
        docs.groupBy("id").agg(F.count("*").alias("n"), F.count_if("fitted").alias("fitted"))
        .agg(F.sum("fitted").alias("fitted"), F.bool_and((F.col("n") == 1) & F.col("id").isNotNull()).alias("once"))
        .first()
    )
    n_docs = seen["fitted"] or 0
    found = None
    if seen["once"] and settings.max_features <= MAX_KNOWN:
        found = _cut_where_they_lie(docs, settings, n_docs)
    return found or _cut_in_rows(docs, settings, n_docs)


def _least(level: DataFrame, most: int) -> int:
    """The frequency that the `most` most frequent terms reach; 0 if there are fewer."""
    row = (
        level.orderBy(F.desc("total_tf")).limit(most)
        .agg(F.min("total_tf").alias("least"), F.count("*").alias("n")).first()
    )
    return row["least"] if row["n"] == most else 0


def _vocabulary(
    stats: DataFrame, settings: Vectorizer, n_docs: int, folder: str | None = None
) -> DataFrame:
    """The most frequent of (term, df, total_tf), ties by term, with idf; a written table."""
    kept = stats.orderBy(F.desc("total_tf"), F.asc("term")).limit(settings.max_features)
    idf = F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0
    return materialize(kept.withColumn("idf", idf), "vocabulary", folder=folder)


def _cut_in_rows(docs: DataFrame, settings: Vectorizer, n_docs: int) -> Cut:
    """Counts as rows (id, term, tf) of documents (id, fitted, text)."""
    toks = tokens(F.col("text"), settings.stop_words)
    # Rows are dealt by id, so counting per id needs no further shuffle.
    cut = by_id(docs).select("id", "fitted", toks.alias("toks"))
    parts, stats, least = [], None, 0
    for n in range(1, settings.high + 1):
        if n == 1:
            grams = cut.select("id", "fitted", F.explode("toks").alias("term"))
        else:
            grams = _longer(cut, n, frequent)
        counts = materialize(
            grams.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("fitted").alias("fitted")),
            "gram-counts",
        )
        parts.append(counts)
        level = (
            counts.filter("fitted")
            .groupBy("term")
            .agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
            .filter(F.col("df") >= settings.min_df)
        )
        level = materialize(level, "gram-stats")
        if n == 1:
            least = _least(level, settings.max_features)
        frequent = level.filter(F.col("total_tf") >= least).select("term")
        stats = level if stats is None else stats.unionByName(level)
    vocab = _vocabulary(stats, settings, n_docs)
    counts = parts[0]
    for more in parts[1:]:
        counts = counts.unionByName(more)
    known = counts.join(F.broadcast(vocab.select("term")), "term", "left_semi")
    return Cut(vocab, tfidf_weights(known.select("id", "term", "tf"), vocab, bounded=True))


def _longer(cut: DataFrame, n: int, frequent: DataFrame) -> DataFrame:
    """(id, fitted, term) of the n-grams whose first and last n - 1 words are both frequent."""
    toks, at = F.col("toks"), [f"w{i}" for i in range(n)]
    grams = F.arrays_zip(*[F.slice(toks, i + 1, F.size(toks) - (n - 1)) for i in range(n)])
    return (
        cut.filter(F.size("toks") >= n)
        .select("id", "fitted", F.inline(grams).alias(*at))
        .select(
            "id", "fitted", F.concat_ws(" ", *at[:-1]).alias("head"),
            F.concat_ws(" ", *at[1:]).alias("tail"), F.col(at[-1]).alias("last"),
        )
        .join(frequent.withColumnRenamed("term", "head"), "head", "left_semi")
        .join(frequent.withColumnRenamed("term", "tail"), "tail", "left_semi")
        .select("id", "fitted", F.concat_ws(" ", "head", "last").alias("term"))
    )


# --- texts as numbers of words ----------------------------------------------------------


def _words(
    texts: pa.Array, stop: Sequence[str], letters: bytes
) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of at least two letters that are no stop words, in order: the text each is in, its
    place in the last array, which has every word once."""
    lists = pc.split_pattern(only_letters(texts, letters), " ")
    words = lists.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    known = words.dictionary
    good = pc.and_(
        pc.greater_equal(pc.utf8_length(known), 2),
        pc.invert(pc.is_in(known, value_set=pa.array(stop, known.type))),
    ).to_numpy(zero_copy_only=False)
    codes = words.indices.to_numpy()
    keep = good[codes]
    return of[keep], codes[keep], known


def _frequencies(of: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each code below `size`, and its occurrences."""
    pairs = of.astype(np.int64) * size + codes
    pairs.sort()
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    return np.bincount(pairs[first] % size, minlength=size), np.bincount(codes, minlength=size)


def _lists(of: np.ndarray, n: int, *values: pa.Array) -> list[pa.Array]:
    """Values of n rows as a list per row; `of` is in order."""
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(of, minlength=n), out=ends[1:])
    return [pa.ListArray.from_arrays(pa.array(ends), v) for v in values]


def _grams(
    of: np.ndarray, codes: np.ndarray, n: int, sizes: list[int], frequent: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of rows of codes, 0 for a word that is not frequent: the row each is in and its
    number, made of those of its first and last n - 1 words. sizes: how many are frequent from
    single words on; frequent: their numbers, in order, from pairs on."""
    codes = codes.astype(np.int64)
    for level in range(2, n + 1):
        both = (of[1:] == of[:-1]) & (codes[1:] > 0) & (codes[:-1] > 0)
        numbers = codes[:-1] * (sizes[level - 2] + 1) + codes[1:]
        of = of[:-1]
        if level == n:
            return of[both], numbers[both]
        codes = np.where(both, _place(frequent[level - 2], numbers) + 1, 0)
    return of[codes > 0], codes[codes > 0]


def _place(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Place of each number in an ordered table, -1 if it is not there."""
    if not len(table):
        return np.full(len(numbers), -1)
    at = np.minimum(np.searchsorted(table, numbers), len(table) - 1)
    return np.where(table[at] == numbers, at, -1)


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("codes")
    of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    return of, lists.flatten().to_numpy()


def _word_stats(docs: DataFrame, settings: Vectorizer) -> DataFrame:
    stop, letters = settings.stop_words, word_letters(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            of, codes, words = _words(batch.column("text"), stop, letters)
            if len(codes):
                df, tf = _frequencies(of, codes, len(words))
                met = np.flatnonzero(tf)
                yield pa.record_batch(
                    [words.take(pa.array(met)), pa.array(df[met]), pa.array(tf[met])],
                    ["term", "df", "total_tf"],
                )

    return docs.filter("fitted").select("text").mapInArrow(task, "term string, df long, total_tf long")


def _coded_texts(docs: DataFrame, settings: Vectorizer, words: list[str]) -> DataFrame:
    """(id, fitted, codes): the number of each word of a text, 0 for one or more in a row that are
    not among `words`."""
    stop, letters = settings.stop_words, word_letters(docs.sparkSession)
    schema = StructType([*docs.select("id", "fitted").schema]).add("codes", ArrayType(IntegerType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            of, codes, known = _words(batch.column("text"), stop, letters)
            number = pc.index_in(known, value_set=pa.array(words, known.type))
            codes = (pc.fill_null(number, -1).to_numpy() + 1)[codes]
            keep = np.ones(len(codes), bool)
            keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (of[1:] != of[:-1])
            lists = _lists(of[keep], batch.num_rows, pa.array(codes[keep], pa.int32()))
            yield pa.record_batch([batch.column("id"), batch.column("fitted"), *lists], schema.names)

    return docs.mapInArrow(task, schema)


def _gram_stats(
    coded: DataFrame, n: int, sizes: list[int], frequent: list[np.ndarray]
) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "codes", SLICE_BYTES):
            of, numbers = _grams(*_coded(batch), n, sizes, frequent)
            if len(numbers):
                met, codes = np.unique(numbers, return_inverse=True)
                df, tf = _frequencies(of, codes, len(met))
                yield pa.record_batch([pa.array(met), pa.array(df), pa.array(tf)], ["gram", "df", "total_tf"])

    return coded.filter("fitted").select("codes").mapInArrow(task, "gram long, df long, total_tf long")


def _weighted(
    coded: DataFrame, idf: np.ndarray, wanted: list[tuple[np.ndarray, np.ndarray]],
    sizes: list[int], frequent: list[np.ndarray],
) -> DataFrame:
    """(id, features, tfs) of coded texts. wanted: for each n, the numbers of the n-grams in the
    vocabulary, in order, and their places in it."""
    size = max(1, len(idf))
    whole = ArrayType(IntegerType())
    parts = (
        StructType().add("type", ByteType()).add("size", IntegerType()).add("indices", whole)
        .add("values", ArrayType(DoubleType()))
    )
    schema = StructType([*coded.select("id").schema]).add("features", parts).add("tfs", whole)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "codes", SLICE_BYTES):
            n, (of, codes), pairs = batch.num_rows, _coded(batch), []
            for level, (numbers, places) in enumerate(wanted, start=1):
                rows, met = _grams(of, codes, level, sizes, frequent)
                at = _place(numbers, met)
                pairs.append(rows[at >= 0] * size + places[at[at >= 0]])
            pairs, tf = np.unique(np.concatenate(pairs), return_counts=True)
            rows, terms = np.divmod(pairs, size)
            raw = (1.0 + np.log(tf)) * idf[terms]
            norm = np.sqrt(np.bincount(rows, raw * raw, minlength=n))
            terms, values, tfs = _lists(
                rows, n, pa.array(terms, pa.int32()), pa.array(raw / norm[rows]), pa.array(tf, pa.int32())
            )
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), terms, values]
            features = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.record_batch([batch.column("id"), features, tfs], schema.names)

    return coded.select("id", "codes").mapInArrow(task, schema)


def _cut_where_they_lie(docs: DataFrame, settings: Vectorizer, n_docs: int) -> Cut | None:
    """Documents (id, fitted, text) with an id each are cut twice, for the words' counts and for
    the numbers of those that are frequent; a task holds no more than a slice of its texts and
    the frequent ones. None if there are more of these than MAX_KNOWN."""
    spark, outer = docs.sparkSession, scratch_folder(docs.sparkSession)
    texts = docs.select("id", "fitted", F.lower(nvl(F.col("text"))).alias("text"))

    def summed(stats: DataFrame, key: str) -> DataFrame:
        sums = stats.groupBy(key).agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))
        return materialize(sums.filter(F.col("df") >= settings.min_df), "gram-stats")

    with scratch_scope(spark):
        level = summed(_word_stats(texts, settings), "term")
        least = _least(level, settings.max_features)
        stats, names, sizes, frequent = level, None, [], []
        for n in range(1, settings.high + 1):
            if n > 1:
                grams = summed(_gram_stats(coded, n, sizes, frequent), "gram").filter(F.col("total_tf") >= least)
                level = _named(grams, names, sizes[-1])
                stats = stats.unionByName(level.select("term", "df", "total_tf"))
            if n == settings.high and n > 1:
                break
            often = level.filter(F.col("total_tf") >= least)
            if often.count() > MAX_KNOWN:
                return None
            if n == 1:
                words = sorted(r["term"] for r in often.select("term").collect())
                names = [(i, w, w) for i, w in enumerate(words, start=1)]
                coded = materialize(_coded_texts(texts, settings, words), "coded-texts")
            else:
                found = sorted((r["gram"], r["term"], r["last"]) for r in often.collect())
                names = [(i, term, last) for i, (_, term, last) in enumerate(found, start=1)]
                frequent.append(np.array([r[0] for r in found], np.int64))
            sizes.append(len(names))
            names = _table(spark, names, "code long, term string, last string")
        vocab = _vocabulary(stats, settings, n_docs, outer)
        found = sorted(vocab.select("term", "idf").collect(), key=lambda r: r["term"].encode())
        number = {w: i for i, w in enumerate(words, start=1)}

        def gram(term: list[str]) -> int:
            if len(term) == 1:
                return number[term[0]]
            head, tail = gram(term[:-1]), gram(term[1:])
            if len(term) > 2:
                head, tail = (int(_place(frequent[len(term) - 3], np.array([x]))[0]) + 1 for x in (head, tail))
            return head * (sizes[len(term) - 2] + 1) + tail

        wanted = []
        for n in range(1, settings.high + 1):
            split = [(r["term"].split(" "), i) for i, r in enumerate(found)]
            of_n = sorted((gram(term), i) for term, i in split if len(term) == n)
            wanted.append(tuple(np.array([x[k] for x in of_n], np.int64) for k in (0, 1)))
        idf = np.array([r["idf"] for r in found], np.float64)
        rows = materialize(_weighted(coded, idf, wanted, sizes, frequent), "tfidf-rows", folder=outer)
    terms = _table(spark, [(i, r["term"]) for i, r in enumerate(found)], "term_index int, term string")
    return Cut(vocab, _long(rows, terms), rows)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local table, which no task has to make."""
    columns = zip(*rows) if rows else [()] * (schema.count(",") + 1)
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [{"string": pa.string(), "int": pa.int32()}.get(c.split()[1], pa.int64()) for c in schema.split(",")]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return spark.createDataFrame(pa.table(arrays, names=names), schema)


def _named(grams: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """Adds to numbered n-grams their terms and last words, by the names of shorter ones."""
    head, tail = (names.select(*[F.col(c).alias(f"{x}_{c}") for c in names.columns]) for x in ("head", "tail"))
    return (
        grams.withColumn("head_code", F.expr(f"gram div {size + 1}"))
        .withColumn("tail_code", F.col("gram") % (size + 1))
        .join(F.broadcast(head), "head_code")
        .join(F.broadcast(tail), "tail_code")
        .select(
            "gram", "df", "total_tf", F.concat_ws(" ", "head_term", "tail_last").alias("term"),
            F.col("tail_last").alias("last"),
        )
    )


def _long(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, tf, weight) of the documents' rows."""
    entry = F.arrays_zip(
        F.col("features.indices").alias("term_index"), F.col("tfs").alias("tf"),
        F.col("features.values").alias("weight"),
    )
    return (
        together(rows, UNFOLDS).select("id", F.inline(entry).alias("term_index", "tf", "weight"))
        .join(F.broadcast(terms), "term_index")
        .select("id", "term", "tf", "weight")
    )


def read_as(written: DataFrame, schema: StructType) -> DataFrame:
    """Columns of a written table with other types that are stored alike."""
    return written.sparkSession.read.schema(schema).parquet(os.path.dirname(written.inputFiles()[0]))
