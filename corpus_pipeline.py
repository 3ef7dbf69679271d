"""The corpus pipeline: quality rules, quality classifier, line dedup, SimHash near-dedup, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept, and each but the last returns
the columns of documents; what a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import line_dedup, near_text, packing, quality_mil, quality_rules
from fieldloom.llm.common import saved, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or a risk-controlled cutoff."""
    return quality_rules.keep_by_rules(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls bad."""
    return quality_mil.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text, and a null text stays null."""
    out = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("lines.kept_text"))
    return out.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, with the smallest id: fingerprints within two bits, or 0.8 of five-word shingles shared.

    Of rows that repeat an id only the chosen one stays; a null id stays only in a group without another id.
    """
    return near_text.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("packing", packed),
]

#: Models and packing are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
