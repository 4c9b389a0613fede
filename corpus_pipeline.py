"""From raw documents to packed sequences: each stage works on the rows that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.llm import langid, lines, mixing, packing, shingles
from spendweave.llm.common import fresh, ready, store, table
from spendweave.llm.queries import TOKENIZER, WEIGHTS, domains


#: Tokens of the mixture against those that use the good text once: with some to spare, good text isn't thinned by chance.
PLENTY = 1.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is mainly in one of the languages learned from them."""
    ready(spark)
    return langid.keep_identified(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that an earlier document has; those of which nothing is left go. ``n_chars`` follows."""
    ready(spark)
    removed = fresh("removed")
    kept = lines.dedup_lines(docs, removed_col=removed).where((F.col(removed) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    length = F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. A null id is not compared and stays.

    Near copies share four fifths or more of their five-word shingles.
    """
    ready(spark)
    hashed, key = fresh("hash"), fresh("id")
    later = shingles.near_copies(docs.where("doc_id is not null")).select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed))
    same = (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64("text") == F.col(hashed))
    return docs.join(later.hint("merge"), same, "left_anti").select(docs.columns)  # what goes grows with the corpus


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the target weights: each is left out, kept or repeated as its rate says."""
    labels = domains(table(spark, sf_dir, "labels"))
    return mixing.thin(docs, labels, WEIGHTS, plenty=PLENTY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    ready(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language", language),
    ("lines", repeated_lines),
    ("near_copies", near_copies),
    ("mixture", target_mixture),
    ("packing", packed),
]

#: Language inference, fingerprints, and the tokenizer aren't expressible in SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
