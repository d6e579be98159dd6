"""Message tables: tolerant CSV scan, coercion, brand filter, file audit, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.functions.text import nvl, strip
from supportlake.session import materialize

RAW_SCHEMA = T.StructType(
    [
        T.StructField("tweet_id", T.StringType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("response_tweet_id", T.StringType()),
        T.StructField("in_response_to_tweet_id", T.StringType()),
    ]
)


def read_messages_csv(
    spark: SparkSession, path: str, multi_line: bool = True, max_rows: int | None = None
) -> DataFrame:
    """Raw message rows plus `ord`, the row number over the files in path order.

    `multi_line` keeps line breaks inside quotes but reads each file as one task; pass False
    for large files without such breaks. `max_rows` keeps the first raw rows.
    """
    raw = (
        spark.read.schema(RAW_SCHEMA)
        .options(header=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE")
        .csv(path)
    )
    raw = with_file_order(raw)
    if max_rows is not None:
        raw = raw.filter(F.col("ord") < max_rows)
    return raw


def _file_key(path: Column, block: Column) -> Column:
    """Place of a row: file, start of its split, number within the split's scan."""
    return F.struct(
        path.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row")
    ).alias("ord")


def _odd_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their place and number of quote characters."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        quotes.alias("quotes"),
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, record) of CSV files whose quoted fields may hold line breaks, split
    like any text: a record's text, and the place of its first line.

    A line begins inside quotes if an odd number of quotes stands before it in its file. Counts
    per split say so for a split's first line, counts within the split for the others. Only
    lines of records with breaks are brought together, each record on its own. A quote that is
    never closed makes the rest of its file one record, as it does for any CSV reader. Line
    ends inside quotes become a line feed.
    """
    lines = _odd_lines(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(
        lines.groupBy("file", "block").agg(F.sum("quotes").alias("n")), "csv-splits"
    ).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("file", "block").orderBy("row")
    earlier = F.coalesce(
        F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    inside = (F.col("ahead") + earlier) % 2 == 1
    marked = materialize(
        lines.join(splits, ["file", "block"])
        .withColumn("inside", inside)
        .withColumn("whole", ~F.col("inside") & (F.col("quotes") % 2 == 0))
        .drop("ahead", "quotes"),
        "csv-lines",
    )
    broken = marked.filter(~F.col("whole"))
    start = F.when(~F.col("inside"), F.struct("block", "row"))
    # The record a line belongs to began in its split, or is the last that earlier ones began.
    last = broken.groupBy("file", "block").agg(F.max(start).alias("last"))
    open_ = last.select(
        "file", "block", F.last("last", ignorenulls=True).over(before).alias("carried")
    )
    of = F.coalesce(F.last(start, ignorenulls=True).over(within), F.col("carried"))
    pieces = F.transform(
        F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]
    )
    joined = (
        broken.join(open_, ["file", "block"])
        .withColumn("of", of)
        .groupBy("file", "of")
        .agg(F.array_join(pieces, "\n").alias("record"))
        .select("file", "of.block", "of.row", "record")
    )
    blank = F.col("value") == ""
    plain = marked.filter(F.col("whole") & ~blank).select(
        "file", "block", "row", F.col("value").alias("record")
    )
    return plain.unionByName(joined)


def scan_messages_csv(
    spark: SparkSession, path: str, max_rows: int | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Raw message rows plus `ord`, their place (file, block, row): it orders rows without
    numbering them, so nothing is shuffled or joined.

    multi_line: whether quoted fields hold line breaks; None: look, by counting each line's
    quotes. Files without breaks are split and parsed by the CSV reader, in one scan; with
    breaks, records are put together first (`csv_records`), still split. `max_rows` keeps the
    first raw rows.
    """
    if multi_line is None:
        multi_line = not _odd_lines(spark, path).filter(F.col("quotes") % 2 == 1).isEmpty()
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if multi_line:
        header = ",".join(RAW_SCHEMA.names)
        cells = F.from_csv("record", RAW_SCHEMA.simpleString()[7:-1].replace(":", " "), options)
        key = F.struct("file", "block", "row").alias("ord")
        bare = F.regexp_replace(F.trim("record"), '"', "")
        raw = (
            csv_records(spark, path).filter(bare != header).select(cells.alias("c"), key)
            .select("c.*", "ord")
        )
    else:
        place = _file_key(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
        raw = (
            spark.read.schema(RAW_SCHEMA).options(header=True, **options).csv(path)
            .select(*RAW_SCHEMA.names, place)
        )
    return raw if max_rows is None else first_rows(raw, max_rows)


def with_file_order(df: DataFrame) -> DataFrame:
    """Add `ord`, the position of the row in (file path, offset) order.

    Rows are counted per file split; only those counts are put in order, so no task sees
    more than one row per split.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    splits = placed.groupBy("_file", "_block").agg(
        F.min("_seq").alias("_first"), F.count("*").alias("_rows")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")
    )
    return (
        placed.join(splits, ["_file", "_block"])
        .withColumn("ord", F.col("_base") + F.col("_seq") - F.col("_first"))
        .drop("_file", "_block", "_seq", "_first", "_base")
    )


def parse_created_at(created_at: Column) -> Column:
    """`Tue Oct 31 22:10:47 +0000 2017` as a timestamp; null where it does not parse."""
    return F.try_to_timestamp(F.substr(created_at, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))


def coerce_messages(raw: DataFrame) -> DataFrame:
    """Typed message rows. Rows whose id is not an integer are dropped; `123.0` is a valid
    parent; `inbound` is the text `true` in any case. Null text becomes empty."""
    number = F.col("in_response_to_tweet_id").try_cast("double")
    return raw.select(
        strip(F.col("tweet_id").cast("string")).try_cast("bigint").alias("tweet_id"),
        nvl(F.col("author_id")).alias("author_id"),
        (F.lower(strip(nvl(F.col("inbound").cast("string")))) == "true").alias("inbound"),
        F.col("created_at"),
        nvl(F.col("text")).alias("text"),
        F.coalesce(
            strip(F.col("in_response_to_tweet_id").cast("string")).try_cast("bigint"),
            number.try_cast("bigint"),
        ).alias("parent_id"),
        F.col("ord"),
    ).filter(F.col("tweet_id").isNotNull())


def last_version(messages: DataFrame) -> DataFrame:
    """One row per message id, the one latest in file order."""
    fields = [c for c in messages.columns if c != "tweet_id"]
    packed = F.max_by(F.struct(*fields), F.col("ord")).alias("m")
    return messages.groupBy("tweet_id").agg(packed).select("tweet_id", "m.*")


def brand_filter(messages: DataFrame, brand: str, strict: bool = False) -> DataFrame:
    """Messages the brand wrote or that mention it.

    strict: author equal in case, mentions count only on inbound rows. Otherwise the author
    compares without case and any row may mention. A mention is a substring.
    """
    mention = F.contains(F.lower(nvl(F.col("text"))), F.lit("@" + brand.lower()))
    if strict:
        keep = (F.col("author_id") == brand) | (F.col("inbound") & mention)
    else:
        keep = (F.lower("author_id") == brand.lower()) | mention
    return messages.filter(F.coalesce(keep, F.lit(False)))


#: Order numbers that are counted together.
STRETCH = 65_536


def _order_levels(messages: DataFrame) -> list[Column]:
    """The order key from its coarsest part to its finest: rows with the same coarser parts
    lie together and are few enough to be sorted."""
    kind = messages.schema["ord"].dataType
    if isinstance(kind, T.StructType):
        return [F.col("ord").getField(f.name) for f in kind.fields]
    return [F.floor(F.col("ord") / F.lit(STRETCH)), F.col("ord")]


def first_rows(messages: DataFrame, max_rows: int) -> DataFrame:
    """The first `max_rows` rows by `ord`, a unique number or a unique (file, block, row) key: the
    row cap of an extract.

    The place of the cut is found first, by counts per file and per block (or per stretch of
    numbers), read in order only as far as the cap reaches, so the result is a plain filter: no
    row is moved, and files behind the cut are not read.
    """
    if max_rows <= 0:
        return messages.filter(F.lit(False))
    *coarse, fine = _order_levels(messages)
    left, found, there = max_rows, [], messages.select("ord")
    for part in coarse:
        here = None
        sizes = there.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part")
        for row in sizes.toLocalIterator():
            if row["n"] >= left:
                here = row["part"]
                break
            left -= row["n"]
        if here is None:
            return messages
        found.append((part, F.lit(here)))
        there = there.filter(part == F.lit(here))
    last = there.select(fine.alias("part")).orderBy("part").limit(left).agg(F.max("part")).first()[0]
    keep = fine <= F.lit(last)
    for part, here in reversed(found):
        keep = (part < here) | ((part == here) & keep)
    return messages.filter(keep)


def extract_brand(
    messages: DataFrame, brand: str, path: str, max_rows: int | None = None
) -> DataFrame:
    """Write the brand's rows to `path` unless something is there already; return the table."""
    rows = brand_filter(messages, brand, strict=True)
    if max_rows is not None:
        rows = first_rows(rows, max_rows)
    rows.write.mode("ignore").parquet(path)
    return messages.sparkSession.read.parquet(path)


def file_audit(spark: SparkSession, path: str) -> DataFrame:
    """Per file: bytes, MB, physical lines, lines less the header, and CSV records."""
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    lines = (
        spark.read.text(path)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.count("*").alias("total_lines"))
    )
    records = csv_records(spark, path).groupBy(F.col("file").alias("path")).agg(
        (F.count("*") - 1).alias("total_records")  # less the header
    )
    total = F.coalesce("total_lines", F.lit(0))
    plain = F.regexp_replace("path", "^file:/+", "/")
    return (
        sizes.withColumn("path", plain)
        .join(lines.withColumn("path", plain), "path", "left")
        .join(records.withColumn("path", plain), "path", "left")
        .select(
            F.col("path").alias("file_path"),
            F.col("length").alias("file_size_bytes"),
            F.round(F.col("length") / (1024 * 1024), 2).alias("file_size_mb"),
            total.alias("total_lines"),
            F.greatest(F.lit(0), total - 1).alias("total_rows"),
            F.coalesce("total_records", F.lit(0)).alias("total_records"),
        )
    )


def head_sample(df: DataFrame, n: int = 100) -> DataFrame:
    """The first n rows as the scan yields them, for a look at the schema."""
    return df.limit(n)


def column_profile(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """One row per column: type, rows, non-null and null counts, in one pass over the table."""
    aggs = [F.count("*").alias("_rows")]
    for i, name in enumerate(df.columns):
        aggs.append(F.count(F.col(name)).alias(f"_n{i}"))
        if approximate_distinct:
            aggs.append(F.approx_count_distinct(F.col(name)).alias(f"_d{i}"))
    cells = []
    for i, (name, kind) in enumerate(df.dtypes):
        fields = [
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col("_rows").alias("row_count"),
            F.col(f"_n{i}").alias("non_null"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"),
        ]
        if approximate_distinct:
            fields.append(F.col(f"_d{i}").alias("approx_distinct"))
        cells.append(F.struct(*fields))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def author_volume(messages: DataFrame) -> DataFrame:
    """Outbound messages per author."""
    return (
        messages.filter(~F.col("inbound"))
        .groupBy("author_id")
        .agg(F.count("*").alias("tweet_volume"))
    )


def top_authors(messages: DataFrame, n: int = 30) -> DataFrame:
    """The n most active outbound authors, ties by name."""
    return (
        author_volume(messages)
        .orderBy(F.desc("tweet_volume"), F.asc("author_id"))
        .limit(n)
        .withColumnRenamed("author_id", "brand_author_id")
    )
