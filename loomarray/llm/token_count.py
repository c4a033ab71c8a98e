"""Operator 9: token counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from loomarray.llm.common import id_text, texts_of
from loomarray.llm.tokens import Lengths


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than `limit` tokens.

    `path` names a file of the tokenizers (`.json`) or sentencepiece (`.model`) library.  No begin,
    end or added special tokens; special strings inside a text count as the library has them by
    default; nothing is truncated or padded.  The Arrow function returns lengths only: a batch is
    encoded in calls balanced by size, and texts longer than a segment are cut at safe boundaries.
    No shuffle.

    A null or empty text has 0 bytes and 0 tokens.  Repeated rows and null ids are counted row by
    row.  Other columns are dropped; an empty table gives an empty table.
    """

    def count(batches):
        lengths = Lengths(path)
        for batch in batches:
            texts = texts_of(batch)
            n = lengths(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
