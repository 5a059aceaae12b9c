"""Token counts by compiled finite-state transducers (see tokenizer.py)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_of
from .tokenizer import ROWS, count_tokens


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every document.

    Counts are those of the tokenizer file's library without added special tokens; its
    special strings inside a text count as one token each.  Null texts are empty (0, 0).
    Rows map one to one, whatever their ids; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            n = count_tokens(batch.column(1).to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], schema=schema)
        release_memory()  # the counts of words are kept for the next task: they are small

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
