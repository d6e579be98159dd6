"""Line deduplication over levelled sorted runs, in DataFrame operations only.

Documents come in batches, largest ids first. A run is a table of line hashes, bucketed and
sorted by hash, with the least and greatest document that held each. A batch is merge-joined to the
runs so far: hashes they lack are new and go into the batch's own run as such, hashes they have
become counts of the same run. After every `fanout` runs of a level these are compacted into
one run of the next. Runs are bucketed tables, so neither the joins nor the compactions move
their rows again.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm.common import materialize, prepare
from supportlake.session import drop_folder, scratch_dir

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 4
#: Ids that the bounds of batches are found from where ids are no numbers.
SAMPLED_IDS = 4096
FANOUT = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


@dataclass
class Runs:
    """Sorted runs of line hashes: levels[i] holds fewer than `fanout` runs of level i."""

    spark: SparkSession
    buckets: int
    fanout: int
    levels: list[list[str]] = field(default_factory=list)
    made: list[str] = field(default_factory=list)

    def _path(self, name: str) -> str:
        return os.path.join(scratch_dir(self.spark), name)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:16]}"
        (
            rows.select("hash", "docs", "keeper")
            .repartition(self.buckets, "hash")
            .sortWithinPartitions("hash")
            .write.bucketBy(self.buckets, "hash")
            .sortBy("hash")
            .option("path", self._path(name))
            .saveAsTable(name)
        )
        self.made.append(name)
        return name

    def tables(self) -> list[DataFrame]:
        """All runs, the oldest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def add(self, rows: DataFrame) -> None:
        """Append a batch's (hash, docs, keeper) as a run; compact levels that are full."""
        run, level = self._write(rows), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._write(_merged([self.spark.table(x) for x in self.levels[level]]))
            self.levels[level] = []
            level += 1

    def drop(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_folder(self.spark, self._path(name))


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """An older run and a newer one as one. A merge join of sorted buckets; each run has a hash
    once. Of a hash that both have, the newer one has no keeper, as it was known then."""
    other = b.select("hash", F.col("docs").alias("docs2"), F.col("keeper").alias("keeper2"))
    zero = F.lit(0)
    return a.join(other.hint("merge"), "hash", "full").select(
        "hash",
        (F.coalesce("docs", zero) + F.coalesce("docs2", zero)).alias("docs"),
        F.coalesce("keeper2", "keeper").alias("keeper"),
    )


def _merged(tables: list[DataFrame]) -> DataFrame:
    return reduce(_merge, tables)


def _batch_bounds(lines: DataFrame, batches: int) -> list:
    """Document ids that cut the table into about equal batches."""
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    kind = lines.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        # Ids that are no numbers: the quantiles of a bounded sample, by the ids' hash.
        drawn = (
            lines.select("doc_id").filter("doc_id is not null").distinct()
            .orderBy(F.xxhash64("doc_id")).limit(SAMPLED_IDS).orderBy("doc_id").collect()
        )
        at = sorted({int(share * len(drawn)) for share in shares})
        return [drawn[i]["doc_id"] for i in at] if len(drawn) >= batches else []
    found = lines.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)))).first()[0]
    return sorted(set(found or []))


def repeated_lines(
    lines: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, buckets: int | None = None
) -> tuple[DataFrame, Runs]:
    """(hash, docs, keeper) of every hash of `lines` (doc_id, hash): number of documents that
    hold it and the largest of them; and the runs, to be dropped when that is read."""
    spark = lines.sparkSession
    runs = Runs(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    cuts = _batch_bounds(lines, batches)
    edges = [None, *cuts, None]
    for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
        batch = lines.select("doc_id", "hash")
        if low is not None:
            batch = batch.filter(F.col("doc_id") > low)
        if high is not None:
            over = F.col("doc_id") <= high
            batch = batch.filter(over if low is not None else over | F.col("doc_id").isNull())
        counted = batch.distinct().groupBy("hash").agg(
            F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")
        )
        # A hash that some run has only adds to the count; a new one brings its keeper.
        for run in runs.tables():
            known = run.select("hash", F.lit(True).alias("_known")).hint("merge")
            counted = counted.join(known, "hash", "left").select(
                "hash", "docs", F.when(F.col("_known").isNull(), F.col("keeper")).alias("keeper")
            )
        runs.add(counted)
    return _merged(runs.tables()), runs


def dedup_lines(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """All columns of `docs`, `text` without its repeated lines, and n_lines, n_dropped.

    A line of at least `least_chars` code points (trimmed) that stands in at least
    `least_docs` documents stays in the one with the largest doc_id and goes elsewhere. A null
    or empty text is one empty line and becomes an empty text. Rows with the same doc_id count
    as one document; each keeps its own text. A row without doc_id is a document below all
    others. An empty table gives no rows. Columns of `docs` may have any names but n_lines,
    n_dropped and those that start with `_`.
    """
    prepare(docs.sparkSession)
    print_ = F.xxhash64("text")
    keyed = docs.select(
        "doc_id", print_.alias("print"),
        F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"),
    )
    hashed = materialize(
        keyed.filter(F.char_length("key") >= least_chars).select(
            "doc_id", "print", "pos", F.unhex(F.md5("key")).alias("hash")
        ),
        "line-hashes",
    )
    counted, runs = repeated_lines(hashed, batches, fanout)
    repeated = materialize(
        counted.filter(F.col("docs") >= least_docs).select("hash", "keeper"), "repeated"
    )
    runs.drop()
    drops = (
        hashed.join(repeated, "hash")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"))
        .agg(F.sort_array(F.collect_set("pos")).alias("_drop"))
    )
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    joined = docs.select(row, print_.alias("_own")).join(
        drops.hint("shuffle_hash"),
        F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_print")),
        "left",
    )
    lines, drop = F.col("_lines"), F.col("_drop")
    # What lies between two dropped lines stays, stretch by stretch.
    start = lambda i: F.when(i == 0, 1).otherwise(F.get(drop, i - 1) + 2)
    end = lambda i: F.coalesce(F.get(drop, i), F.size(lines))
    kept = F.when(drop.isNull(), lines).otherwise(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(drop)),
                lambda i: F.slice(lines, start(i), end(i) - start(i) + 1),
            )
        )
    )
    columns = [
        F.array_join(kept, "\n").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return joined.withColumn("_lines", lines_of(F.col("_row.text"))).select(
        *columns,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )
