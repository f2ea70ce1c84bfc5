"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meristem.llm._session import shared_dir
from meristem.llm.minhash_dedup import minhash_dedup
from meristem.llm.mixing import mix_sources
from meristem.llm.packing import pack_documents
from meristem.llm.quality_qda import learn_quality, score_quality
from meristem.llm.quality_rules import apply_rules
from meristem.llm.queries import domain_of, mixing_weights, table
from meristem.llm.tokens import vocabulary_path


def _row(docs: DataFrame) -> Column:
    """A whole document as one value: it travels with its own verdict, and no column's name can clash."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, scores 0.7 or more.

    Each row is scored by its own text, repeated rows and null ids too; a null or empty text is scored
    as a text without anything in it. Whole texts are read, however long; a score of just 0.7 stays. An
    empty table stays empty.
    """
    model = learn_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    rows = docs.select(_row(docs), F.col("text").alias("_whole"))
    return score_quality(rows, model, id_col="_row", text_col="_whole").where("predicted = 1").select("_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Each row is judged by its own text, whole however long; null and empty texts have too few words, and a measure right at a rule's limit passes. An empty table stays empty."""
    rows = docs.select(_row(docs), F.col("text").alias("_whole"))
    return apply_rules(rows, text_col="_whole", id_col="_row", measured=False).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and similarity 0.8 or more: that with the smallest id, null ids last.

    Of rows that repeat an id and a text one stays (the first by row number); rows that share an id only
    are judged apart. Shingle sets are of whole texts, however long. Rows
    without a word are in no group and stay. The rows are written once with numbers of their own, by
    which they are told apart.
    """
    path = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    docs.select(_row(docs)).withColumn("_key", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    groups = minhash_dedup(rows, id_col="_key", text_col="_row.text").select(F.col("_key").alias("_number"), "component_id")
    several = groups.where("_number <> component_id").select("component_id").distinct()
    members = groups.join(several, "component_id", "left_semi").join(rows.select("_key", F.col("_row.doc_id").alias("_id")), F.col("_number") == F.col("_key"))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_number"))["_number"]
    stays = members.groupBy("component_id").agg(first.alias("_stays"))
    goes = members.join(stays, "component_id").where("_number <> _stays").select("_number")
    return rows.join(goes, F.col("_key") == F.col("_number"), "left_anti").select("_row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mixture takes tokens, each once: 0.9 of the tokens, dealt by target weights.

    Each row is dealt with by itself, repeated rows and null ids too; null languages and sources are
    leaves of their own, and rows without a word have no token that could be taken. A document of which
    the budget takes a prefix stays whole, however long; of documents with one id the shorter goes first.
    """
    taken = mix_sources(docs, domain_of(F.col("source")), share=0.9, epochs=1, weights=mixing_weights(spark), carry=_row(docs))
    return taken.where("taken > 0").select("carried.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens; null and empty texts are their end token, and repeated rows are separate documents. Very long texts are cut into pieces; of equally long pieces the smaller id goes first. An empty table gives no rows."""
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Packing needs token ids, which SQL can't express; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
