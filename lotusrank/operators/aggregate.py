"""From chunk scores to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotusrank.params import parse_agg


def value_of(agg: str, s: Column, nth: Column) -> Column:
    """The aggregate of a document's scores as an expression of the score and of its rank in the document; top3_log without
    its divisor."""
    kind, x = parse_agg(agg)
    if kind in ("max", "avg"):
        return F.max(s) if kind == "max" else F.avg(s)
    if kind == "max+":
        return F.sum(F.when(nth == 1, s).when(nth == 2, s * x))
    return F.avg(F.when(nth <= int(x), s))


def doc_scores(scores: DataFrame, agg: str, score: str = "score", doc_sizes: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score, best_chunk, n_chunks): scores of a document's chunks in the pool under one of the aggregates
    max, avg, topN (mean of the N best, or of those there are), max+W (the best plus W times the second) and top3_log
    (top3 over log1p of the document's chunks in the whole corpus: doc_sizes(doc_id, size))."""
    kind, s, d = parse_agg(agg)[0], F.col(score), scores
    if kind not in ("max", "avg"):
        d = scores.withColumn("__rn", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(s.desc(), F.col("chunk_idx"))))
    value = value_of(agg, s, F.col("__rn"))
    best = F.max(F.struct(s, -F.col("chunk_idx")))
    out = d.groupBy("qid", "doc_id").agg(value.alias("__v"), best.alias("__b"), F.count(F.lit(1)).alias("n_chunks"))
    out = out.select("qid", "doc_id", F.col("__v").alias("score"), (-F.col("__b.col2")).alias("best_chunk"), "n_chunks", F.col(f"__b.{score}").alias("best_score"))
    if kind == "top3_log":
        if doc_sizes is None:
            raise ValueError("top3_log needs the documents' sizes")
        out = out.join(doc_sizes, "doc_id").withColumn("score", F.col("score") / F.log1p(F.col("size"))).drop("size")
    return out


def rank_docs(scores: DataFrame, agg: str, topk: int = 5, score: str = "score", doc_sizes: DataFrame | None = None, total: str | None = None) -> DataFrame:
    """(qid, rank, doc_id, score, best_chunk, n_chunks); ties go to the document with the better best chunk, then to the
    smaller id. Scores are rounded to 6 decimals before they are compared. `total` names one more column, the chunks of the
    question's pool."""
    d = doc_scores(scores, agg, score, doc_sizes).withColumn("score", F.round("score", 6))
    if total:
        d = d.withColumn(total, F.sum("n_chunks").over(Window.partitionBy("qid")))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.round("best_score", 6).desc(), F.col("best_chunk"), F.col("doc_id"))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= topk).select("qid", "rank", "doc_id", "score", "best_chunk", "n_chunks", *[total] * bool(total))


def doc_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"))
