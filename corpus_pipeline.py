"""From raw documents to token digests: the stages of a training-data pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import mixing, quality_model, quality_rules, simhash
from threadloom.llm.common import load, staged
from threadloom.llm.queries import bpe_digests

#: The classifier's own decision, as in op6: below it a document is predicted to be of low quality.
MIN_QUALITY = 0.5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, and lines above the limits leave the others' texts."""
    kept = quality_rules.cleaned(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below ``MIN_QUALITY`` go."""
    vectors, network = quality_model.train(docs, load(spark, sf_dir, "labels"))
    return quality_model.kept(docs, vectors, network, MIN_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of similar texts (five words, 0.8) the document with the smallest id stays."""
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as the mix takes it."""
    return mixing.mixed(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: a row of digests for each row."""
    return bpe_digests(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: The quality classifier is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
