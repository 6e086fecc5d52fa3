"""Token counts by the whole-token shortcut (see ``tokens``).

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings
inside a text count as the library counts them by default; very long texts are
counted whole; repeated rows count each; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import tokens
from vitrine.llm.common import ship_by_value, shipped

ship_by_value(__name__)

LIMIT = 1024


def token_counts(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    shared = shipped(docs.sparkSession, tokens.read_vocabulary(vocabulary))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = tokens.Encoder(shared())
        for texts in batches:
            yield pd.Series(list(encoder.counts(texts.tolist())), dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
