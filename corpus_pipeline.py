"""A corpus pipeline: drop toxic documents, repeated lines, near copies and leaked test items, then tokenize.

Each stage takes the documents its predecessor kept and returns them with the
columns of ``documents``; the last one adds the tokens. Rows with null or empty
text go through every stage, rows without an id too.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.storage import scratch_path
from packetloom.llm import bpe, decontaminate, jaccard_join, lines, toxicity
from packetloom.llm.queries import VOCABULARY, fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.score(docs, model, out="_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a smaller document has; ``n_chars`` counts what is left."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with like word shingles the one of the smallest id; repeated rows once."""
    groups = jaccard_join.similar_groups(docs, Fraction(4, 5), size=5)
    kept = groups.where("component_id = doc_id").select("doc_id").distinct()
    once = docs.withColumn("_mark", F.xxhash64("text")).dropDuplicates(["doc_id", "_mark"]).drop("_mark")
    return once.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens: ``n_tokens``, packed ``ids`` and the hash of the decoded text."""
    encoded = bpe.encode(docs, VOCABULARY, decoded="_decoded")
    return encoded.withColumns(
        {"n_tokens": (F.octet_length("ids") / 4).cast("long"), "decoded_sha256": F.sha2("_decoded", 256)}
    ).drop("_decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", tokenize),
]

#: SQL cannot express the toxicity model or the tokenizer; no test runs the pipeline or its stages, only operators they use
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``; what each one keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
