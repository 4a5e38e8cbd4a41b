"""Exact length histogram (4): documents by encoded length, and suffix sums that answer every context limit.

A row for each length that occurs: how many documents have it, and the totals at a context limit of that
length. Between two occurring lengths every answer is linear, so `at_limit` serves any limit from the rows.
Null and empty texts have length 0 and are counted. Repeated rows count each time. Empty table: no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import enter, materialize, ship
from ._tokens import encoder

BLOCK = 1024


def _lengths(batches):
    enc = encoder()
    for b in batches:
        yield pd.DataFrame({"length": [len(enc.encode(t)) // 2 for t in b["text"]]})


def lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col(text).alias("text")).mapInPandas(_lengths, "length long")


def histogram(lens: DataFrame) -> DataFrame:
    """(length, documents) with partial sums before the shuffle."""
    return lens.groupBy("length").agg(F.count("*").alias("documents"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds, for a limit equal to each length: documents and tokens at least that long, truncated total, rank from below.

    Sums run inside blocks of lengths in parallel; only the blocks' totals meet in one window.
    """
    h = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("documents"))
    blocks = h.groupBy("block").agg(F.sum("documents").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("ld"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("lt"),
                           F.sum("bd").over(Window.partitionBy()).alias("all_documents"), F.sum("bt").over(Window.partitionBy()).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("length"))
    h = h.join(blocks, "block").select("length", "documents", "tokens", (F.sum("documents").over(own) + F.col("ld")).alias("documents_from"), (F.sum("tokens").over(own) + F.col("lt")).alias("tokens_from"), "all_documents", "all_tokens")
    kept = F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("documents_from")
    return h.select("length", "documents", "tokens", "documents_from", "tokens_from", kept.alias("tokens_kept"), (F.col("all_tokens") - kept).alias("tokens_cut"),
                    (F.col("all_documents") - F.col("documents_from") + F.col("documents")).alias("documents_to"), "all_documents", "all_tokens")


def length_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    return suffix_sums(materialize(histogram(lengths(docs, text)), "lengths"))  # read by two branches: texts are encoded once


LIMITS = [1 << k for k in range(5, 21)]
SHARES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def answers(sums: DataFrame, limits: list[int] = LIMITS, shares: list[float] = SHARES) -> DataFrame:
    """(kind, length, share, documents, ...): the histogram's rows, then the answers for some limits and quantiles, in one table."""
    h = sums.withColumn("kind", F.lit("length")).withColumn("documents_cut", F.col("documents_from") - F.col("documents"))
    t = at_limits(sums, limits).filter("tokens_kept is not null").withColumnRenamed("limit", "length").withColumn("kind", F.lit("limit"))
    q = quantiles(sums, shares).filter("length is not null").withColumn("kind", F.lit("quantile"))
    return h.unionByName(t, allowMissingColumns=True).unionByName(q, allowMissingColumns=True)


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, documents_cut, tokens_kept, tokens_cut) for any limits, in one pass: the next longer length answers each."""
    over = [(F.col("length") > n, n) for n in limits]
    one = sums.agg(F.max("all_tokens").alias("t"), *[F.max(F.when(c, F.col("documents_from"))).alias(f"d{n}") for c, n in over], *[F.max(F.when(c, F.col("tokens_from"))).alias(f"k{n}") for c, n in over])
    rows = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("limit"), F.coalesce(F.col(f"d{n}"), F.lit(0)).alias("documents_cut"), F.coalesce(F.col(f"k{n}") - n * F.col(f"d{n}"), F.lit(0)).alias("tokens_cut")) for n in limits]))
    return one.select("t", rows.alias("x")).select("x.limit", "x.documents_cut", (F.col("t") - F.col("x.tokens_cut")).alias("tokens_kept"), "x.tokens_cut")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least each share of the documents does not exceed."""
    one = sums.agg(*[F.min(F.when(F.col("documents_to") >= F.lit(float(q)) * F.col("all_documents"), F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])).alias("x")).select("x.*")
