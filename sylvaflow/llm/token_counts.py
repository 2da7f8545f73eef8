"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvaflow.llm.encoding import encoder
from sylvaflow.llm.text import as_strings, by_bytes, offsets

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text).

    Batches hold about `batch_bytes` of text, so one long text forms its own; every text is cut into
    pieces at places where the vocabulary's pre-tokenizer always cuts. A null or empty text has
    0 bytes and 0 tokens. Repeated rows and null ids stay as they are; an empty table
    gives an empty result; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                texts = as_strings(part.column("text"))
                tokens = code.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets(texts))), pa.array(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
