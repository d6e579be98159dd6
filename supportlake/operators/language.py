"""Language of a text by letter-trigram profiles.

A profile is learned from texts with known language: the trigrams of each language with
smoothed log frequencies. A text gets the language with the largest sum over its trigrams.
Profiles are tables: `fit_profiles` makes one, a job writes it, and grading reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructType

from supportlake.functions.letters import CODES, only_letters, slices, word_letters
from supportlake.functions.rules import WORD
from supportlake.functions.text import language_words, nvl
from supportlake.operators.sampling import smallest_per_group
from supportlake.session import materialize


#: Text whose trigrams a task counts at once.
SLICE_BYTES = 4 * 1024 * 1024
#: Numbers of a table that every task may hold: of all trigrams of the letters that occur, or of the
#: gains of a profile's trigrams in each language.
MOST_NUMBERS = 1 << 22


def trigrams(text: Column) -> Column:
    """Letter trigrams of the text, words framed and joined by blanks."""
    letters = F.regexp_replace(F.lower(nvl(text)), f"[^{WORD}]+|[0-9_]+", " ")
    framed = F.concat(F.lit(" "), F.trim(F.regexp_replace(letters, " +", " ")), F.lit(" "))
    # The look-ahead yields overlapping matches in one pass over the text.
    return F.regexp_extract_all(framed, F.lit("(?s)(?=(.{3}))"), F.lit(1))


def _codes(texts: pa.Array, letters: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as `trigrams` frames them, and the text each is in."""
    bare = only_letters(texts, letters)
    framed = pc.binary_join_element_wise(pa.scalar(" "), bare, pa.scalar(" "), "")
    of = np.repeat(np.arange(len(framed)), pc.utf8_length(framed).to_numpy())
    ends = np.frombuffer(framed.buffers()[1], np.int32)[framed.offset : framed.offset + len(framed) + 1]
    data = memoryview(framed.buffers()[2])[ends[0] : ends[-1]]
    codes = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (of[1:] != of[:-1])
    return codes[keep], of[keep]


def _alphabet(codes: np.ndarray) -> np.ndarray:
    """The code points that occur, in order."""
    met = np.zeros(CODES, bool)
    met[codes] = True
    return np.flatnonzero(met)


def _numbers(codes: np.ndarray, of: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each trigram, by the places of its letters in the alphabet, and its text; those
    with another letter are left out."""
    place = np.full(CODES, -1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    at = place[codes]
    whole = of[2:] == of[:-2]
    whole &= (at[2:] >= 0) & (at[1:-1] >= 0) & (at[:-2] >= 0)
    numbers = (at[:-2] * len(alphabet) + at[1:-1]) * len(alphabet) + at[2:]
    return numbers[whole], of[:-2][whole]


def _spelled(numbers: np.ndarray, alphabet: np.ndarray) -> list[str]:
    size = len(alphabet)
    codes = np.stack([numbers // size // size, numbers // size % size, numbers % size], 1)
    letters = alphabet[codes].astype("<u4").tobytes().decode("utf-32-le")
    return [letters[i : i + 3] for i in range(0, len(letters), 3)]


def _gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n), several rows for each; n adds up."""
    letters = word_letters(docs.sparkSession, "0-9_")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            codes, of = _codes(batch.column("text"), letters)
            alphabet = _alphabet(codes)
            numbers, of = _numbers(codes, of, alphabet)
            lang = batch.column("lang").dictionary_encode()
            spoken, size = lang.indices.to_numpy()[of].astype(np.int64), len(alphabet) ** 3
            if len(lang.dictionary) * size <= MOST_NUMBERS:
                n = np.bincount(spoken * size + numbers)
                met = np.flatnonzero(n)
                spoken, numbers, n = met // size, met % size, n[met]
            else:
                grams, places = np.unique(numbers, return_inverse=True)
                met, n = np.unique(spoken * len(grams) + places, return_counts=True)
                spoken, numbers = met // max(1, len(grams)), grams[met % max(1, len(grams))]
            yield pa.record_batch(
                [
                    lang.dictionary.take(pa.array(spoken)),
                    pa.array(_spelled(numbers, alphabet), pa.string()), pa.array(n, pa.int64()),
                ],
                ["lang", "gram", "n"],
            )

    known = docs.filter(F.col(lang_col).isNotNull())
    texts = known.select(F.col(lang_col).alias("lang"), F.lower(nvl(F.col(text_col))).alias("text"))
    return texts.mapInArrow(task, StructType([texts.schema["lang"]]).add("gram", "string").add("n", "long"))


def bare_text(text: Column) -> Column:
    """What the language of a message is told by: its words without handles and links."""
    return F.array_join(language_words(text), " ")


def fit_profiles(
    docs: DataFrame, text_col: str, lang_col: str, size: int | None = None
) -> DataFrame:
    """(lang, gram, gain): all trigrams of each language, or its `size` most frequent ones.
    `gain` is how much more likely, in logs, the trigram is than one seen once: always above 0.
    Texts without a language teach nothing."""
    counts = materialize(
        _gram_counts(docs, text_col, lang_col).groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "gram-counts",
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    top = counts
    if size is not None:
        top = smallest_per_group(counts, ["lang"], [F.desc("n"), F.asc("gram")], size)
    share = F.col("n") / F.col("total")
    gain = F.log(1.0 + share * 1e6).alias("gain")
    return materialize(top.join(totals, "lang").select("lang", "gram", gain), "profiles")


def language_scores(
    docs: DataFrame, id_col: str, text_col: str, profiles: DataFrame
) -> DataFrame:
    """(id, lang, score) for the languages that share a trigram with the text.

    The profile is a written table with one row per trigram and language. Trigrams meet one that
    fits each task where the text is read, as a table of gains, and a task returns a row per text
    and language; a larger one is joined.
    """
    found = profiles.toPandas() if profiles.count() <= MOST_NUMBERS else None
    if found is not None and not found.isna().any(axis=None):
        grams, langs = sorted(set(found["gram"])), sorted(set(found["lang"]))
        if len(grams) * len(langs) <= MOST_NUMBERS and all(len(g) == 3 for g in grams):
            of = profiles.schema["lang"].dataType
            return _scores_where_they_lie(docs, id_col, text_col, found, grams, langs, of)
    return _joined_scores(docs, id_col, text_col, profiles)


def _scores_where_they_lie(
    docs: DataFrame, id_col: str, text_col: str, found: pd.DataFrame, grams: list[str], langs: list,
    of_lang: DataType,
) -> DataFrame:
    letters = word_letters(docs.sparkSession, "0-9_")
    alphabet = np.array(sorted({ord(c) for g in grams for c in g}), np.int64)
    place = {c: i for i, c in enumerate(alphabet.tolist())}
    size = len(alphabet)
    number = {
        g: (place[ord(g[0])] * size + place[ord(g[1])]) * size + place[ord(g[2])] for g in grams
    }
    order = np.array(sorted(number.values()), np.int64)
    gains = np.zeros((len(langs), len(order) + 1))
    rows = np.searchsorted(order, found["gram"].map(number).to_numpy(np.int64))
    line = found["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy(np.int64)
    np.add.at(gains, (line, rows), found["gain"])
    names = pa.array(langs)
    schema = StructType([docs.select(F.col(id_col).alias("id")).schema["id"]])
    schema = schema.add("lang", of_lang).add("score", DoubleType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        if size**3 <= MOST_NUMBERS:
            held = np.full(size**3, len(order), np.int32)  # the last column gains nothing
            held[order] = np.arange(len(order))
        for batch in slices(batches, "text", SLICE_BYTES):
            numbers, of = _numbers(*_codes(batch.column("text"), letters), alphabet)
            if held is not None:
                at = held[numbers]
            else:
                at = np.minimum(np.searchsorted(order, numbers), max(0, len(order) - 1))
                at = np.where(order[at] == numbers, at, len(order)) if len(order) else at
            score = [np.bincount(of, gain[at], minlength=batch.num_rows) for gain in gains]
            for name, sums in zip(names, score):
                met = pa.array(np.flatnonzero(sums > 0))
                lang = pa.repeat(name, len(met))
                yield pa.record_batch(
                    [batch.column("id").take(met), lang, pa.array(sums, pa.float64()).take(met)],
                    schema.names,
                )

    texts = docs.select(F.col(id_col).alias("id"), F.lower(nvl(F.col(text_col))).alias("text"))
    # Texts of the same id count as one.
    return texts.mapInArrow(task, schema).groupBy("id", "lang").agg(F.sum("score").alias("score"))


def _joined_scores(docs: DataFrame, id_col: str, text_col: str, profiles: DataFrame) -> DataFrame:
    """Trigrams are counted per text and meet the profile's, which Spark broadcasts or shuffles by
    its size."""
    grams = docs.select(
        F.col(id_col).alias("id"), F.explode(trigrams(F.col(text_col))).alias("gram")
    )
    # One row per trigram of all languages, so a text's trigrams are not multiplied by them.
    by_gram = profiles.groupBy("gram").agg(F.collect_list(F.struct("lang", "gain")).alias("of"))
    return (
        grams.groupBy("id", "gram")
        .agg(F.count("*").alias("n"))
        .join(by_gram, "gram")
        .select("id", "n", F.inline("of"))
        .groupBy("id", "lang")
        .agg(F.sum(F.col("n") * F.col("gain")).alias("score"))
    )


def detect_language(
    docs: DataFrame, id_col: str, text_col: str, profiles: DataFrame
) -> DataFrame:
    """(id, detected, score) for every text; `detected` is null where no trigram is known."""
    scores = language_scores(docs, id_col, text_col, profiles)
    rank = F.row_number().over(
        Window.partitionBy("id").orderBy(F.desc(F.round("score", 6)), F.asc("lang"))
    )  # one row per language
    best = scores.withColumn("rank", rank).filter(F.col("rank") == 1)
    return docs.select(F.col(id_col).alias("id")).join(best.drop("rank"), "id", "left").select(
        "id", F.col("lang").alias("detected"), "score"
    )
