"""Message streams: stateless scoring, full agent per micro-batch, running author volume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from supportlake.functions.rules import RulePack
from supportlake.functions.text import clean_text
from supportlake.operators.intents import weak_intent
from supportlake.operators.quality import rule_flags
from supportlake.operators.case_store import CaseStore
from supportlake.operators.retrieval import CaseIndex
from supportlake.plans.support import agent_decisions, agent_output
from supportlake.session import scratch_scope


def message_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options: str
) -> DataFrame:
    """Files arriving in a folder as a stream, or the one file at `path`."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place) and fs.getFileStatus(place).isFile():
        path, options = str(place.getParent()), {**options, "pathGlobFilter": place.getName()}
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def score_messages(stream: DataFrame, pack: RulePack) -> DataFrame:
    """Clean text, rule flags and weak intent per message: no state, works on batch and
    stream alike."""
    cleaned = stream.withColumn("cleaned_text", clean_text(F.col("text")))
    return weak_intent(rule_flags(cleaned, "text", pack), "cleaned_text", pack)


def run_agent_stream(
    stream: DataFrame,
    index: CaseIndex | CaseStore,
    classify: Callable[[DataFrame], DataFrame],
    out_path: str,
    checkpoint: str,
    k: int = 2,
) -> StreamingQuery:
    """The agent over a stream, one micro-batch at a time. Ranking cases needs windows that
    streaming plans do not take, so each batch runs the batch plan.

    A batch is written under its own number: a batch replayed after a failure overwrites
    itself. Its intermediate tables go when it is written, so a stream that runs on holds no
    more than one batch of them. `classify` maps messages to the agent's input columns.
    """

    def batch(rows: DataFrame, number: int) -> None:
        with scratch_scope(rows.sparkSession):
            decided = agent_output(agent_decisions(classify(rows), index, k))
            decided.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def author_volume_stream(stream: DataFrame) -> DataFrame:
    """Running count of outbound messages per author (complete mode)."""
    return (
        stream.filter(~F.col("inbound"))
        .groupBy("author_id")
        .agg(F.count("*").alias("tweet_volume"))
    )


def run_volume_stream(
    counts: DataFrame, out_path: str, checkpoint: str
) -> StreamingQuery:
    """Keep the latest complete counts at `out_path`, one folder per batch."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
