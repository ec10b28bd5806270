"""The second stage: which candidates are scored again, and how their scores are blended."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lotusrank.functions.text import tokens
from lotusrank.operators.aggregate import rank_docs
from lotusrank.operators.fusion import minmax

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def candidate_cut(fused: DataFrame, n_docs: int, m_chunks: int, score: str = "fused") -> DataFrame:
    """The walk down the fused ranking that ends before the first chunk of document n_docs + 1, with at most m_chunks of
    each document met before that; all by ranks, without a walk."""
    by_score = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col("chunk_idx"))
    d = fused.withColumn("rn", F.row_number().over(by_score))
    in_doc = Window.partitionBy("qid", "doc_id").orderBy("rn")
    d = d.withColumn("first_rn", F.min("rn").over(Window.partitionBy("qid", "doc_id"))).withColumn("m", F.row_number().over(in_doc))
    d = d.withColumn("doc_rank", F.dense_rank().over(Window.partitionBy("qid").orderBy("first_rn")))
    stop = F.min(F.when(F.col("doc_rank") == n_docs + 1, F.col("first_rn"))).over(Window.partitionBy("qid"))
    return d.withColumn("stop", stop).filter((F.col("stop").isNull() | (F.col("rn") < F.col("stop"))) & (F.col("m") <= m_chunks)).drop("first_rn", "m", "doc_rank", "stop")


def overlap_score(question: str = "question", text: str = "text"):
    """Stand-in for a model: the share of the question's distinct tokens that the text holds. It tests plumbing, not quality."""
    q, t = F.array_distinct(tokens(F.col(question))), F.array_distinct(tokens(F.col(text)))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def score_pairs(pairs: DataFrame, scorer: Scorer, question: str = "question", text: str = "text", out: str = "ce", segment: Callable[[str], str] | None = None) -> DataFrame:
    """Adds the score of a user's model, given as a function of two pandas Series; it runs in Arrow batches. `segment` joins the
    words of both texts first, for models that were trained on segmented text; null counts as empty."""
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        q, t = q.fillna(""), t.fillna("")
        return scorer(q.map(segment), t.map(segment)) if segment else scorer(q, t)
    return pairs.withColumn(out, F.pandas_udf(run, DoubleType())(F.col(question), F.col(text)))


def ensemble(scores: DataFrame) -> DataFrame:
    """(qid, chunk_idx, model, score) -> the mean over the models."""
    return scores.groupBy("qid", "chunk_idx").agg(F.avg("score").alias("ce"))


def blend(cands: DataFrame, beta: float, ce: str = "ce", fused: str = "fused") -> DataFrame:
    """Adds `score`: beta of the scaled model score and the rest of the scaled fused score; beta 1 is the raw model score."""
    if beta == 1:
        return cands.withColumn("score", F.col(ce))
    return cands.withColumn("score", beta * minmax(F.col(ce), ["qid"]) + (1 - beta) * minmax(F.col(fused), ["qid"]))


def rerank_docs(scored: DataFrame, beta: float, agg: str, topk: int = 5) -> DataFrame:
    return rank_docs(blend(scored, beta).withColumn("score", F.round("score", 9)), agg, topk)
