"""From raw documents to packed training sequences: toxicity, quality, exact copies, near copies, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of `docs`;
the last returns one row per packed piece. Labels come from the `labels` table, by the rules of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenstock.llm import quality, toxicity
from lumenstock.llm.common import stored, table
from lumenstock.llm.exact_dedup import exact_duplicates
from lumenstock.llm.ngram_join import links_and_components
from lumenstock.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_sha(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))


def _first_of_equal(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows with the same id and text the first by their other columns."""
    rest = [F.col(c) for c in columns if c not in ("doc_id", "text")]
    row = F.row_number().over(Window.partitionBy("doc_id", "_sha").orderBy(*(rest or [F.lit(0)])))
    return docs.withColumn("_row", row).where("_row = 1")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not predicted toxic. Repeated rows are judged one by one; rows without an id go."""
    return toxicity.clean_rows(docs.where("doc_id IS NOT NULL"), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted good; all of them where no label says what is good. Rows without an id go."""
    return quality.good_rows(docs.where("doc_id IS NOT NULL"), quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of equal texts (null is empty): that of the largest id, and of its repeats the first by the other columns."""
    kept = stored(exact_duplicates(docs).where("kept").select("doc_id", F.col("text_sha256").alias("_sha")).distinct(), "kept-copies")
    return _first_of_equal(_with_sha(docs), docs.columns).join(kept, ["doc_id", "_sha"], "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8, the one with the smallest id.

    Different texts of one id are one document and stay or go together; rows that repeat id and text become one.
    """
    kept = stored(links_and_components(docs, words=5, percent=80).where("doc_id = component_id").select("doc_id").distinct(), "kept-near-copies")
    return _first_of_equal(_with_sha(docs).join(kept, "doc_id", "left_semi"), docs.columns).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with an id, packed; rows that repeat an id are documents of their own."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack_sequences),
]

# The first stage is a trained classifier and the last an optimiser; tests compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
