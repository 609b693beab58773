"""Operator 1: exact length histogram of encoded documents, with suffix sums.

One pass encodes whole texts and pre-aggregates lengths in each task, so that what is shuffled is a row for each
distinct length and task. Suffix sums over lengths then answer totals, quantiles and truncated totals for every
context limit without another look at the documents. They are made in two levels (sums of ranges of lengths, then
within a range), so no task sorts all lengths.

Nulls: a null text has length 0, as an empty one. Very long texts are encoded whole. Empty table: empty histogram.
Repeated rows count as often as they occur; documents of one length are one row. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import default_tokenizer, encoder
from .work import bound_batches, by_bytes, materialize, spread

#: Lengths in a range.
RANGE = 256


def length_histogram(df: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    path = tokenizer or default_tokenizer()

    def lengths(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in by_bytes(texts):
                n, c = np.unique(encoder(path).encode(texts[a:b])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["n_tokens", "n_docs"])

    each = spread(bound_batches(df).select(F.col(text_col).alias("text"))).mapInArrow(lengths, "n_tokens long, n_docs long")
    return each.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_ge, tokens_ge (documents this long or longer, and their ids), docs_le,
    truncated_total (ids left when every document is cut to n_tokens)."""
    hist = materialize(hist, "lengths")  # read twice below; the documents are encoded once
    hist = hist.withColumn("range", F.floor(F.col("n_tokens") / RANGE).cast("long"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    by_range = hist.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    # A row for each range: as many as the longest document has ids, over RANGE.
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_range = by_range.select(
        "range",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("d_all"),
        F.sum("t").over(whole).alias("t_all"),
    )
    down = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(by_range, "range").select(
        "n_tokens",
        "n_docs",
        (F.col("d_above") + F.sum("n_docs").over(down)).alias("docs_ge"),
        (F.col("t_above") + F.sum(tokens).over(down)).alias("tokens_ge"),
        "d_all",
        "t_all",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("d_all") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("t_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit_tokens, total: ids left when documents are cut to each limit, for limits between lengths as well."""
    first = [F.min(F.when(F.col("n_tokens") >= n, F.struct("n_tokens", "docs_ge", "tokens_ge"))).alias(f"a{i}") for i, n in enumerate(limits)]
    one = sums.agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"), *first)
    total = lambda i, n: F.col("t") - F.coalesce(F.col(f"a{i}.tokens_ge"), F.lit(0)) + n * F.coalesce(F.col(f"a{i}.docs_ge"), F.lit(0))
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("limit_tokens"), F.coalesce(total(i, n), F.lit(0)).alias("total")) for i, n in enumerate(limits)])
    return one.select(F.inline(rows))


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """probability, n_tokens: the smallest length that at least this share of documents does not exceed."""
    n = sums.agg(F.sum("n_docs")).first()[0] or 0
    one = sums.agg(*[F.min(F.when(F.col("docs_le") >= p * n, F.col("n_tokens"))).alias(f"a{i}") for i, p in enumerate(probabilities)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.col(f"a{i}").alias("n_tokens")) for i, p in enumerate(probabilities)])))
