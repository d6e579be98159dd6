"""Token counts by rank-synchronous array merging (`bpe`)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.bpe import batch_tokenizer
from supportlake.llm.common import arrow_map

LIMIT = 2048


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each document: UTF-8 bytes, tokens
    under the tokenizer file (the same path on every executor), whether tokens exceed `limit`.

    A null text counts as empty: no byte, no token. Texts are never cut short. Repeated rows and
    repeated or null ids are answered each on its own; an empty table gives no rows. Columns
    other than doc_id and text are not read. There is no shuffle, and nothing is remembered
    from one batch to the next.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = batch_tokenizer(tokenizer)
        for batch in batches:
            tokens = counter.count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = arrow_map(
        docs.select(
            "doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
            text.cast("binary").alias("text"),
        ),
        task,
        f"doc_id {kind}, n_bytes long, n_tokens long",
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
