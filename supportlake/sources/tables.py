"""Readers and writers of the derived tables: nested threads, evaluation sheet, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.functions.packs import GOLDEN_COLUMNS
from supportlake.session import spread
from supportlake.sources.messages import with_file_order

MESSAGE_TYPE = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
THREAD_SCHEMA = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("turns_count", T.IntegerType()),
        T.StructField("messages", T.ArrayType(MESSAGE_TYPE)),
        T.StructField("quality_reason", T.StringType()),
        T.StructField("quality_label", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A parquet table; a small one is spread by `key` for the work on its texts."""
    df = spark.read.parquet(path)
    return df if key is None else spread(df, key)


def write_threads(threads: DataFrame, path: str, fmt: str = "json") -> None:
    """Nested threads, one folder per tier."""
    threads.write.mode("overwrite").partitionBy("quality_label").format(fmt).save(path)


def read_threads(
    spark: SparkSession, path: str, fmt: str = "json", corrupt: bool = False
) -> DataFrame:
    """Nested threads. `corrupt` adds _corrupt_record, the text of a JSON line that does not
    parse, whose other columns are null; without it such lines give rows of nulls."""
    schema = THREAD_SCHEMA
    if corrupt:
        schema = T.StructType([*THREAD_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).format(fmt).load(path)


def read_thread_file(spark: SparkSession, path: str) -> DataFrame:
    """Threads from JSON array files, one file per tier."""
    return spark.read.schema(THREAD_SCHEMA).option("multiLine", True).json(path)


def read_golden(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Evaluation sheet: every column text, blanks as empty strings. `numbered` adds `idx`,
    the 0-based row number in file order."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in GOLDEN_COLUMNS])
    rows = (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, quote='"', escape='"')
        .csv(path)
    )
    if numbered:
        rows = with_file_order(rows).withColumnRenamed("ord", "idx")
    return rows.fillna("", subset=list(GOLDEN_COLUMNS))


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What `write` puts into a folder takes the place of `path` as a whole: it is written
    beside it, the old folder is moved aside and removed when the new one has its name. So
    `path` may be what the written rows are read from. A failure leaves the old folder there,
    or beside it, complete."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex[:8]
    name = target.getName()
    staged, aside = (
        jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{name}-{x}-{mark}") for x in ("new", "old")
    )
    write(staged.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        fs.delete(staged, True)
        raise OSError(f"could not move {path}")
    if not fs.rename(staged, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"could not replace {path}")
    if had:
        fs.delete(aside, True)


def write_golden(rows: DataFrame, path: str) -> None:
    """Evaluation sheet in its fixed column order, in the order of `idx` if the rows have it.
    The sheet is replaced as a whole and may be the one that `rows` was read from."""
    sheet = rows.orderBy("idx") if "idx" in rows.columns else rows
    sheet = sheet.select(*[F.col(c).cast("string").alias(c) for c in GOLDEN_COLUMNS])
    replace_folder(
        rows.sparkSession, path,
        lambda new: sheet.write.options(header=True, quote='"', escape='"').csv(new),
    )


def write_report(report: DataFrame, path: str) -> None:
    """Metric or report rows as JSON lines."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a report; a line that does not parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
