"""Token counts: Arrow batches in, lengths only out.

Spark deals the scan out by bytes; inside a task the rows of an Arrow batch are taken in
runs of about equal bytes, long texts are split at safe boundaries, and the distinct units
are encoded in batches of about equal bytes (``encoding``).  Nothing is shuffled.

Defined cases: a null text is empty and has no token; repeated rows stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import encoding
from wakeline.session import ship

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(vocabulary, encoding.count_of)
        for batch in batches:
            texts = batch.column("text")
            found = [encoding.counts(enc, texts.slice(a, b - a)) for a, b in encoding.runs(texts)]
            n = np.concatenate([*found, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
