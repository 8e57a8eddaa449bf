"""A training corpus from `documents`: toxic texts out, near copies out, secrets masked, sources mixed, sequences packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes every stage's rows as
Parquet and reads them again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from tracehold.llm.storage import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 1/2; the classifier learns from the labels that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row as _row, written so that it stays the same: ids may be null or repeat."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "corpus-rows")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links connect, one with the least id (null comes last), and all rows without words."""
    rows = numbered(docs)
    joined = jaccard_join.join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
    groups = rows.select("_row", "doc_id").join(joined.where("n_shingles > 0"), "_row").groupBy("component_id")
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")).select("first._row")
    kept = joined.where("n_shingles = 0").select("_row").union(first)
    return rows.join(kept, "_row", "left_semi").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span replaced by its kind; n_chars follows the text."""
    masked = secret_scan.redact(secret_scan.scan(docs))
    changed = F.size("all_spans") > 0
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes: none, one or two."""
    rows = numbered(docs)
    copies = mixing.mix(rows, key="_row").where("copies > 0").select("_row", "copies")
    return rows.join(copies, "_row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", keep_one_of_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"corpus-{k}")
    return docs


#: The classifier, the join and the tokenizer are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None
