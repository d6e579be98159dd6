"""Helpers shared by the operators: Arrow maps, written stages, distributed running sums."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from supportlake import session
from supportlake.session import tune

__all__ = ["arrow_map", "lean", "materialize", "prepare", "running_totals", "sha256_hex", "table"]

#: Rows and bytes that reach a Python worker at once.
BATCH_ROWS = 2000
BATCH_BYTES = 16 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: AQE with skew splits, bounded Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def materialize(
    df: DataFrame, name: str, schema: StructType | None = None, rows_per_file: int = 0
) -> DataFrame:
    """A written stage, in the session's codec: these tables are hashes and numbers for the most
    part, or texts that are read once."""
    return session.materialize(df, name, schema, rows_per_file, codec=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(
    df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(task, schema)


def _give_back() -> None:
    """Hand memory that is no longer used back to the system: a worker lives on between tasks,
    and the next stage's share of the executor is what idle workers leave."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(
    task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that gives its memory back when it ends, for those that hold large arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        _give_back()

    return run


#: Slices of a running sum; fewer where it is kept for each of many values.
SLICES, SLICES_WITHIN = 4096, 128


def running_totals(
    df: DataFrame, key: str, sums: dict[str, Column], within: list[str] | None = None
) -> DataFrame:
    """Adds, for each name in `sums`, the total of the expression over all rows that come
    before this one, in an arbitrary but fixed order, separately for each value of `within`.

    Rows are dealt over hashed slices of the unique `key`. A slice is summed on its own; the
    totals of the slices, a table of at most slices x values of `within`, are summed once more
    and added. No group is ever in one task. `within` must have a bounded number of values.
    """
    within = within or []
    n = SLICES_WITHIN if within else SLICES
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(F.col(key)), F.lit(n)))
    before = Window.partitionBy(*within, "_slice").orderBy(key).rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0).cast("long")
    local = dealt
    for name, value in sums.items():
        local = local.withColumn(name, F.coalesce(F.sum(value).over(before), zero))
    order = Window.partitionBy(*within).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = dealt.groupBy(*within, "_slice").agg(
        *(F.sum(value).alias(f"_sum_{name}") for name, value in sums.items())
    )
    starts = totals.select(
        *within,
        "_slice",
        *(F.coalesce(F.sum(f"_sum_{x}").over(order), zero).alias(f"_at_{x}") for x in sums),
    )
    joined = local.join(F.broadcast(starts), [*within, "_slice"])
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_at_{name}"))
    return joined.drop("_slice", *(f"_at_{name}" for name in sums))


def sha256_hex(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)
