"""Popularity prior, padding and the final lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotusrank.operators.fusion import minmax


def gold(train: DataFrame) -> DataFrame:
    """(qid, doc_id): distinct labels."""
    return train.select("qid", F.explode("answer").alias("doc_id")).filter("doc_id is not null").distinct()


def prior_weights(train: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(doc_id, freq, w): how often a document answers, on a log scale from 0 to 1. Answers count as often as they are
    given; questions in `exclude` (qid) are left out, so that an evaluation doesn't see its own labels."""
    d = train.select("qid", "answer").distinct()
    if exclude is not None:
        d = d.join(exclude.select("qid"), "qid", "left_anti")
    freq = d.select(F.explode("answer").alias("doc_id")).filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("freq"))
    top = freq.agg(F.max("freq")).first()[0] or 1
    return freq.withColumn("w", F.log1p("freq") / F.log1p(F.lit(top)))


def apply_prior(cands: DataFrame, weights: DataFrame, lam: float, topk: int = 5) -> DataFrame:
    """(qid, rank, doc_id, score): scaled score plus lam times the prior weight, 0 for documents that never answered."""
    d = cands.join(weights.select("doc_id", "w"), "doc_id", "left")
    d = d.withColumn("score", F.round(minmax(F.col("score"), ["qid"], 1e-12) + lam * F.coalesce("w", F.lit(0.0)), 6))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id"))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= topk).select("qid", "rank", "doc_id", "score")


def fallback(train: DataFrame, n: int = 20) -> DataFrame:
    """(doc_id, pos): the n most frequent answers; ties go to the smaller id. A global top n, so no window is needed."""
    top = prior_weights(train).orderBy(F.col("freq").desc(), F.col("doc_id")).limit(n)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("freq").desc(), F.col("doc_id")))).select("doc_id", "pos")


def pad(ranked: DataFrame, questions: DataFrame, backup: DataFrame, topk: int = 5) -> DataFrame:
    """(qid, rank, doc_id, padded): lists shorter than topk are filled with backup documents they don't hold; `backup` is a
    short list by its nature (see fallback) and comes to the driver."""
    short = (questions.select("qid").distinct().join(ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left")
             .filter(F.coalesce("n", F.lit(0)) < topk).select("qid"))
    own = ranked.filter(F.col("rank") <= topk).select("qid", "doc_id", F.col("rank").alias("ord"), F.lit(False).alias("padded"))
    spare = [F.struct(F.lit(r["doc_id"]).alias("doc_id"), F.lit(r["pos"]).alias("pos")) for r in backup.collect()]
    extra = own.limit(0)
    if spare:
        extra = short.select("qid", F.explode(F.array(*spare)).alias("s")).select("qid", "s.doc_id", (F.col("s.pos") + 1000).alias("ord"), F.lit(True).alias("padded"))
    both = own.unionByName(extra).groupBy("qid", "doc_id").agg(F.min(F.struct("ord", "padded")).alias("o"))
    w = Window.partitionBy("qid").orderBy("o.ord")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= topk).select("qid", "rank", "doc_id", F.col("o.padded").alias("padded"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid): questions whose sets of documents differ."""
    sets = lambda d: d.groupBy("qid").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    a, b = sets(before), sets(after)
    return a.join(b.withColumnRenamed("docs", "docs2"), "qid", "full").filter(~F.col("docs").eqNullSafe(F.col("docs2"))).select("qid")


def answers(ranked: DataFrame) -> DataFrame:
    """(qid, answer): one ordered list of ids per question."""
    return ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("answer"))


def list_stats(answers: DataFrame) -> DataFrame:
    """(n_ids, questions): how many questions have how many ids."""
    return answers.groupBy(F.coalesce(F.size("answer"), F.lit(-1)).alias("n_ids")).agg(F.count(F.lit(1)).alias("questions"))


def output_stats(padded: DataFrame) -> DataFrame:
    """One row over final lists (qid, rank, doc_id, padded): questions, answers, distinct documents, questions with padding, and
    the shortest and longest list."""
    per = padded.groupBy("qid").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("padded").cast("int")).alias("p"))
    lists = per.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("k"), F.lit(0)).alias("answers"), F.coalesce(F.sum("p"), F.lit(0)).alias("padded"), F.min("k").alias("fewest"), F.max("k").alias("most"))
    docs = padded.agg(F.countDistinct("doc_id").alias("documents"))  # both are one row
    return lists.crossJoin(docs).select("questions", "answers", "documents", "padded", "fewest", "most")
