"""A training corpus from raw documents: five of the text operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last: pieces of
sequences); each is written as Parquet and read again before the next.

Cases: a document whose text is null, empty or without a letter is rejected by the first stage; a null doc_id is kept by all stages (each such text
a document of its own, alone in its near-duplicate group); repeated rows of one doc_id are one document: lines and near duplicates
treat them alike, and all of them are packed; of ties the smallest doc_id stays; texts of any length are read whole; extra columns pass through the first four
stages whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalis.llm import decontaminate, language_id, line_dedup, minhash_dedup, packing
from curalis.llm._common import free_name, materialize, ship, table

LEAST_SCORE = 0.5  # the posterior of the language told, among those learned
LEAST_FIT = -7.0  # mean log-likelihood of a letter: plain text of a learned language has about -2.5, letters that no model knows -11.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is learned and told from the others; those without a letter or mostly in letters that no model knows go."""
    langs, log_prob = language_id.fit(docs)
    got = language_id.identify(docs, langs, log_prob)
    lang, score, fit = (F.col(free_name(docs, c)) for c in ("lang_pred", "score", "fit"))
    return got.filter((lang != "und") & (score >= LEAST_SCORE) & (fit >= LEAST_FIT)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document that loses all its text goes with it."""
    got = line_dedup.drop_repeated_lines(docs)
    removed = F.col(free_name(docs, "n_removed"))
    return got.filter((removed == 0) | (F.length(F.trim("text")) > 0)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, each window in the sources' shares."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower(), alone=True)
    return docs
