"""The corpus pipeline: quality rules, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Between stages the rows are
written as Parquet to the shared folder and read back, so a lost executor repeats one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import op01_quality_rules, op03_line_dedup, op06_secret_scan, op07_packing, op10_minhash
from panelspark.llm.common import stage, table
from panelspark.llm.queries import tokenizer_path


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they now are, if there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the frequency limits are removed from the others."""
    return _sized(op01_quality_rules.kept_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing is left."""
    out = op03_line_dedup.line_dedup(docs.withColumnsRenamed({c: f"_doc_{i}" for i, c in enumerate(docs.columns)}),
                                     f"_doc_{docs.columns.index('doc_id')}", f"_doc_{docs.columns.index('text')}")
    out = out.filter((F.col("deleted_lines") == 0) | (F.col("deleted_lines") < F.col("n_lines")))
    return _sized(out.select(*[F.col("clean_text" if c == "text" else f"_doc_{i}").alias(c) for i, c in enumerate(docs.columns)]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return op10_minhash.first_documents(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return _sized(op06_secret_scan.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return op07_packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secrets),
          ("packing", packing)]

#: Packing works on a tokenizer's ids, which SQL can't make; tests hold the stages and run() against expected rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
