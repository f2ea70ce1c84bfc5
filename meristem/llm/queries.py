"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from ._session import cut, shared_dir
from .bpe_prefixes import encode_texts
from .hard_negatives import hard_negatives
from .language_mixture import identify_languages
from .language_model import score_texts
from .lexical_topk import lexical_topk
from .minhash_dedup import minhash_dedup
from .mixing import mix_sources
from .mtree_topk import exact_topk, integer_vectors
from .packing import pack_documents
from .quality_qda import quality_scores
from .quality_rules import apply_rules
from .rollups import TokenRollup, deletes, inserts, revisions
from .tokens import count_tokens, vocabulary_path
from .toxicity_nb import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def held_out(condition: Column) -> Column:
    """A row without id is not held out; nothing is learned from it either."""
    return F.coalesce(condition, F.lit(False)).alias("held_out")


def domain_of(source: Column) -> Column:
    """The tables have no domain; four are made of the sources' checksums."""
    return F.concat(F.lit("domain"), (F.crc32(source.cast("binary")) % 4).cast("string"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: provisional counts (words) of all documents, their revision by the tokenizer's counts, and the deletion of texts that are null or empty; the first is sent twice."""
    docs = table(spark, sf_dir, "documents")
    counted = count_tokens(docs.withColumn("_words", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")), "text", vocabulary_path(), ["doc_id", "lang", "source", "_words"])
    counted = cut(counted)
    tokenizer = lambda name: F.lit(name).alias("tokenizer")
    provisional = counted.select("source", "lang", tokenizer("byte_bpe_50k"), F.col("_words").alias("n_tokens"))
    exact = counted.select("source", "lang", tokenizer("byte_bpe_50k"), "n_tokens")
    words = counted.select("source", "lang", tokenizer("words"), F.col("_words").alias("n_tokens"))
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("inserts", inserts(provisional.unionByName(words)))
    rollup.commit("inserts", inserts(provisional.unionByName(words)))
    rollup.commit("revisions", revisions(provisional, exact))
    empty = counted.where("n_tokens = 0")
    rollup.commit("deletes", deletes(empty.select("source", "lang", tokenizer("byte_bpe_50k"), "n_tokens").unionByName(empty.select("source", "lang", tokenizer("words"), F.col("_words").alias("n_tokens")))))
    return rollup.totals()


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of two epochs of all documents' words, dealt by mixing_weights."""
    return mix_sources(table(spark, sf_dir, "documents"), domain_of(F.col("source")), weights=mixing_weights(spark))


def mixing_weights(spark: SparkSession) -> DataFrame:
    """Production targets: domains 4:3:2:1, and English at twice the other languages."""
    rows = [("domain", "domain0", 4.0), ("domain", "domain1", 3.0), ("domain", "domain2", 2.0), ("domain", "domain3", 1.0), ("lang", "en", 2.0)]
    return spark.createDataFrame(rows, "level string, name string, weight double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled ones that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_scores(docs, labels, remainder(4) != 2).select("doc_id", held_out(remainder(4) == 2), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the languages of those that are not held out."""
    found = identify_languages(table(spark, sf_dir, "documents"), remainder(5) != 0)
    return found.select("doc_id", held_out(remainder(5) == 0), "lang_pred", "score", "languages")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents linked by their two-word shingles."""
    return minhash_dedup(table(spark, sf_dir, "documents"), shingle=2)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that are not held out, with all their n-grams."""
    found = score_texts(table(spark, sf_dir, "documents"), remainder(7) != 2, least=1)
    return found.select("doc_id", held_out(remainder(7) == 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return apply_rules(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity_scores(docs, labels, remainder(5) != 0)
    return found.select("doc_id", held_out(remainder(5) == 0), "score", "predicted")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all the others."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return exact_topk(vectors, F.col("vec_id") % 100 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the five nearest rows of every hundredth vector's label; every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as counts and digests."""
    path = vocabulary_path("word_bpe_49k.json")
    encoded = encode_texts(table(spark, sf_dir, "documents"), path, decoded_col="decoded", keep=["doc_id"])
    digest = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces and sequences that corpus_pipeline.run leaves of all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_best_fit_packing, op3_mixing, op4_quality, op5_language,
        op6_minhash_dedup, op7_lm_scores, op8_quality_rules, op9_toxicity, op10_exact_topk,
        op11_hard_negatives, op12_lexical_topk, op13_bpe, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": oracles.MIXING, "op6_minhash_dedup": oracles.DEDUP, "op8_quality_rules": oracles.RULES, "op10_exact_topk": oracles.TOPK,
            "op11_hard_negatives": oracles.NEGATIVES, "op12_lexical_topk": oracles.LEXICAL}
