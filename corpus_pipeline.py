"""A training corpus from `documents`, in five stages; each is written and reread."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm import decontaminate, line_dedup, packing, quality, simhash
from supportlake.llm.common import materialize, table
from supportlake.llm.queries import word_tokenizer
from supportlake.session import drop_folder, scratch_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that no name of theirs can meet one
    that an operator adds."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *rest).alias("rest"))


def _widen(rows: DataFrame, columns: list[str], changed: Column | None = None) -> DataFrame:
    """Back to `columns`; n_chars follows a text that changed."""

    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col(name)
        own = F.col("rest").getField(name)
        if changed is not None and name == "n_chars":
            own = F.when(changed, F.char_length("text").cast("long")).otherwise(own)
        return own.alias(name)

    return rows.select(*map(column, columns))


#: Folder of the tables that the stage before made on its way.
_LEFT: dict[str, str] = {}


def _tidy(stage: Stage) -> Stage:
    """A stage whose intermediate tables go when the next stage begins: by then its result is
    written and read again. They stay if the next one's documents still come from them."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _LEFT.pop(app, None)
        if left and not any(left in file for file in docs.inputFiles()):
            drop_folder(spark, left)
        with scratch_scope(spark, keep=True) as _LEFT[app]:
            return stage(spark, docs, sf_dir)

    return run_stage


@_tidy
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A null text is scored as an empty one;
    rows that repeat, with or without an id, are judged each; an empty table stays empty; all
    columns are handed on."""
    kept = quality.filter_quality(_narrow(docs), table(spark, sf_dir, "labels"))
    return _widen(kept, docs.columns)


@_tidy
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that others repeat; n_chars follows. A null text has
    one empty line and becomes empty; a line that only rows of one id hold is in one document;
    an empty table stays empty; other columns are handed on."""
    kept = line_dedup.dedup_lines(_narrow(docs))
    return _widen(kept, docs.columns, F.col("n_dropped") > 0)


@_tidy
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash links (three-word shingles, at most three bits): the
    one with the least id, null ids last, then by text.

    Rows are told apart by a number of their own, not by doc_id: a row without an id is a
    document like any other, of repeated rows one stays, texts that share an id are apart. All
    null and empty texts are one group. An empty table stays empty; all columns are handed on.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = simhash.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("group_"))
    place = F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text"),
        F.col(row).alias("row"),
    )
    kept = (
        numbered.select(row, place.alias("place_"))
        .join(groups, row)
        .groupBy("group_")
        .agg(F.min("place_").alias("least_"))
        .select(F.col("least_.row").alias(row))
    )
    return numbered.join(kept.hint("shuffle_hash"), row, "left_semi").select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )


@_tidy
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents of which nothing is left go, others
    stay, null and empty texts too. Rows that repeat are each cut; an empty table stays empty;
    other columns are handed on."""
    found = decontaminate.find_phrases(_narrow(docs), table(spark, sf_dir, "benchmark"))
    cut = decontaminate.remove_spans(materialize(found, "spans"))
    kept = cut.filter(~F.col("_changed") | F.col("text").rlike("\\S"))
    return _widen(kept, docs.columns, F.col("_changed"))


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: a row per piece with its token ids (binary, little-endian
    unsigned 32-bit) and their CRC-32. A null or empty text is its end id; rows that repeat are
    packed each; an empty table gives no rows."""
    return packing.pack(docs, word_tokenizer()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: Hashes, the trained network and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
