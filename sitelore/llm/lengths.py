"""Exact token counts for every context limit from one length histogram.

Documents are encoded once and counted by length on the map side, so what moves is one row for each length and
task. Sums below and above each length then answer, for a context limit of that length, how many documents fit, how many tokens they
have, and the total when longer ones are cut. The sums run in two levels (blocks of ``BLOCK`` lengths, then
within a block), so no task holds the whole histogram, and the blocks are few: one for each 128 lengths up to the longest document.

Cases: null and empty texts have length 0 and are counted. Repeated rows count each. An empty table gives an empty histogram,
and ``at_limit`` gives 0 documents and tokens. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, slices, small_batches

BLOCK = 128


def encoded_lengths(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """One row for each document: n_tokens."""

    def run(batches):
        import gc

        encoder = bpe.load(path)
        gc.disable()
        try:
            for batch in batches:
                for _, texts in slices(batch, "__text"):
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in encoder.encode_many(texts)], pa.int64())], names=["n_tokens"])
        finally:
            encoder.rest()
            gc.enable()

    return small_batches(docs).select(F.col(text).alias("__text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Rows (n_tokens, n_docs) and, for a limit of n_tokens: docs_within, tokens_within, docs_over, tokens_over, tokens_cut (total with longer documents cut at the limit) and share_within (the quantile of the limit)."""
    counts = lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "tokens": F.col("n_tokens") * F.col("n_docs")})
    # one row for each length; cut, because the sums read it twice and the documents are encoded once
    counts = cut(counts)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for each block: as many as the longest document asks for, whatever the number of documents
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"])
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.join(blocks, "block").withColumns({"docs_within": F.col("d_before") + F.sum("n_docs").over(inside), "tokens_within": F.col("t_before") + F.sum("tokens").over(inside)})
    return out.select("n_tokens", "n_docs", "docs_within", "tokens_within", (F.col("d_all") - F.col("docs_within")).alias("docs_over"), (F.col("t_all") - F.col("tokens_within")).alias("tokens_over"), (F.col("tokens_within") + F.col("n_tokens") * (F.col("d_all") - F.col("docs_within"))).alias("tokens_cut"), (F.col("docs_within") / F.col("d_all")).alias("share_within"))


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs_within, tokens_within, docs_over, tokens_cut."""
    inside = F.col("n_tokens") <= limit
    sums = {
        "docs_within": F.when(inside, F.col("n_docs")),
        "tokens_within": F.when(inside, F.col("n_docs") * F.col("n_tokens")),
        "docs_over": F.when(~inside, F.col("n_docs")),
        "tokens_cut": F.col("n_docs") * F.least("n_tokens", F.lit(limit)),
    }
    return table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()])


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the shortest length within which that share of the documents is."""
    firsts = [F.min(F.when(F.col("share_within") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)]
    return table.agg(*firsts).select(F.inline(F.array(*pairs)))
