"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime settings every job here relies on. Skewed equi-joins are split by AQE, also where
# the split costs one more shuffle. A query's shuffle files go when it has ended; else they stay
# until the driver's memory is collected, and a job of many steps holds those of all its steps.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, name: str = "supportlake", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the cluster's shared checkpoint folder.

    Only a session without that setting gets a folder of its own, which must be local mode:
    a machine-local folder would be lost with its executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if shared:
        return os.path.join(shared, f"supportlake-{app}")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="supportlake-")
    return _LOCAL_SCRATCH[app]


_SCOPE = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession, keep: bool = False) -> Iterator[str]:
    """Tables that this thread materializes inside are deleted at the end, so results must be
    written elsewhere by then; with `keep` they stay until `drop_folder`. Yields their folder."""
    outer = getattr(_SCOPE, "path", None)
    kind = "kept" if keep else "scope"
    path = os.path.join(outer or scratch_dir(spark), f"{kind}-{uuid.uuid4().hex[:12]}")
    _SCOPE.path = path
    try:
        yield path
    finally:
        _SCOPE.path = outer
        if not keep:
            drop_folder(spark, path)


def scratch_folder(spark: SparkSession) -> str:
    """Where this thread materializes now: the folder of its scope, or the scratch folder."""
    return getattr(_SCOPE, "path", None) or scratch_dir(spark)


#: Scratch tables are mostly texts and lists of terms, which zstd writes at about half the size.
CODEC = "zstd"


def materialize(
    df: DataFrame, name: str, schema: StructType | None = None, rows_per_file: int = 0,
    folder: str | None = None, codec: str | None = CODEC,
) -> DataFrame:
    """Write `df` to the scratch folder and read it back, as `schema` if given: computed once,
    lineage cut, and a lost executor costs a re-read instead of a re-run. Files hold at most
    `rows_per_file` rows, if given. `folder` takes the place of the scope's, for what is to
    outlive it; without a `codec` the session's is used."""
    spark = df.sparkSession
    path = os.path.join(folder or scratch_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    writer = df.write.option("maxRecordsPerFile", rows_per_file)
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def outliving(folder: str, df: DataFrame, name: str) -> DataFrame:
    """`materialize` into the folder of an outer scope."""
    return materialize(df, name, folder=folder)


SMALL_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small scan over all cores, by `keys` if given.

    A small file often is one row group, which one task would work through alone. From
    SMALL_BYTES on a scan has splits enough and is left as it lies.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call when no result built on them is needed."""
    drop_folder(spark, scratch_dir(spark))
