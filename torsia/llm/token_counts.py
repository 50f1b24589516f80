"""Token counts of whole texts by the whole-token shortcut.

The vocabulary is examined once: strings that encode alone as one token are
proven so by the library itself. Texts are cut into pre-tokens in place; a
pre-token in the proven set counts one, the rest are merged. No shuffle.

Defined results: null text counts as empty and has no token; control characters
that Python takes for spaces, special strings and letters outside Latin-1 go
through the library; all columns of the input stay. Where one is named like the
count, the count's name gets underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import WordCounts, whole_tokens
from .common import batch_rows, free, held


def counts_of(path: str, whole: Broadcast) -> WordCounts:
    """Kept for the tasks that follow in a worker."""
    return held("tokens", "counts", path, lambda: WordCounts(path, whole.value))


def token_count(path: str, text: Column, spark) -> Column:
    """Number of tokens of a text column."""
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counts_of(path, whole)
        for texts in batches:
            yield pd.Series([of.text(t) for t in texts], dtype="int64")

    return F.pandas_udf(counts, "long")(F.coalesce(text, F.lit("")))


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each text under ``out``."""
    batch_rows(df.sparkSession)
    return df.withColumn(*free(df, out), token_count(path, F.col(text_col), df.sparkSession))
