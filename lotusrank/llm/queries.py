"""The queries of this subpackage: name -> callable(spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusrank.llm import fuse, mixing, neighbours, overlap, pii, scripts, splitting, termfreq, tokens, topn


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(s, d):
    return topn.found(_t(s, d, "submission"), _t(s, d, "chunks"))


def p2_found(s, d):
    return scripts.found(_t(s, d, "context"), _t(s, d, "train"))


def p2_normalized(s, d):
    a = _t(s, d, "context").select(F.lit("context.passage").alias("fld"), F.col("doc_id").alias("rec_id"), F.col("passage").alias("text"))
    b = _t(s, d, "train").select(F.lit("train.question").alias("fld"), F.col("qid").alias("rec_id"), F.col("question").alias("text"))
    return scripts.normalize(a.unionByName(b).dropDuplicates(["fld", "rec_id"]), "text").select("fld", "rec_id", "normalized")


def p3_found(s, d):
    return overlap.found(_t(s, d, "train"), _t(s, d, "public_official"))


def p3_counts(s, d):
    return overlap.counts(_t(s, d, "train"), _t(s, d, "public_official"))


def p4_ranked(s, d):
    d = fuse.fuse(_t(s, d, "chunks"), "qid", "chunk_idx", {"bm25": 1, "dense": 1})
    return d.withColumn("projection", F.round("projection", 6) + 0.0)


def p5_found(s, d):
    return termfreq.found(_t(s, d, "chunks"))


def p5_terms(s, d):
    return termfreq.terms(_t(s, d, "chunks")).select("term", "occurrences", "records", "mark")


def p5_ngrams(s, d):
    """N-grams of one to three terms."""
    return termfreq.ngram_counts(_t(s, d, "chunks"), "chunk_id", "text", 3)


def p6_found(s, d):
    return neighbours.found(_t(s, d, "emb"))


def p7_found(s, d):
    return splitting.found(_t(s, d, "context"), _t(s, d, "chunks"))


def p7_pieces(s, d):
    return splitting.split_all(_t(s, d, "context"), _t(s, d, "chunks"))


def p8_ids(s, d):
    return tokens.encode(_t(s, d, "documents"))


def p9_mixture(s, d):
    return mixing.mixture(mixing.sized(_t(s, d, "documents")), _t(s, d, "mix_targets"))[0]


def p9_shares(s, d):
    return mixing.mixture(mixing.sized(_t(s, d, "documents")), _t(s, d, "mix_targets"))[1]


def p10_found(s, d):
    return pii.found(_t(s, d, "documents"))


def p10_redacted(s, d):
    return pii.redact(_t(s, d, "documents"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("p") and k[1].isdigit()}
