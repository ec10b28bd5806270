"""Training pairs: splits, positives, hard negatives and the rows of both kinds of encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotusrank.functions.scale import cut

#: Up to so many chosen chunks go to where the texts lie.
SENT = 500_000


def split(questions: DataFrame, n_val: int, seed: int = 42) -> DataFrame:
    """(qid, fold): the n_val questions of the smallest hash are `val`; the cut-off is one global top n, not a sort of all."""
    q = questions.select("qid").distinct().withColumn("h", F.md5(F.concat(F.col("qid"), F.lit(f":{seed}"))))
    edge = q.orderBy("h").limit(n_val).agg(F.max("h")).first()[0]
    return q.select("qid", F.when(F.col("h") <= F.lit(edge), "val").otherwise("train").alias("fold") if edge is not None else F.lit("train").alias("fold"))


def positives(fused: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_idx): the best fused chunk of a labelled document, else the first chunk of one; questions with
    neither are left out."""
    best = fused.join(gold, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.max(F.struct("fused", -F.col("chunk_idx"))).alias("m")).select("qid", (-F.col("m.col2")).alias("best"))
    first = gold.join(chunks.groupBy("doc_id").agg(F.min("chunk_idx").alias("c")), "doc_id").groupBy("qid").agg(F.min("c").alias("first"))
    return first.join(best, "qid", "full").select("qid", F.coalesce("best", "first").alias("chunk_idx"))


def positives_by_model(fused: DataFrame, gold: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """(qid, chunk_idx): of the n best fused chunks of labelled documents, the one a model scores highest; `scores`
    (qid, chunk_idx, ce). Chunks without a score come last, ties go to the better fused one."""
    w = Window.partitionBy("qid").orderBy(F.col("fused").desc(), F.col("chunk_idx"))
    top = fused.join(gold, ["qid", "doc_id"], "left_semi").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    d = top.join(scores.select("qid", "chunk_idx", "ce"), ["qid", "chunk_idx"], "left")
    return d.groupBy("qid").agg(F.max(F.struct(F.coalesce("ce", F.lit(float("-inf"))), -F.col("r"), "chunk_idx")).alias("m")).select("qid", F.col("m.chunk_idx").alias("chunk_idx"))


def negatives(fused: DataFrame, gold: DataFrame, skip: int = 5, until: int = 80, n: int = 6) -> DataFrame:
    """(qid, neg_no, chunk_idx): of the ranks skip..until - 1 (from 0), the first chunk of each document that is no
    label, the first n of them."""
    w = Window.partitionBy("qid").orderBy(F.col("fused").desc(), F.col("chunk_idx"))
    d = fused.withColumn("rn", F.row_number().over(w) - 1).filter(F.col("rn").between(skip, until - 1))
    d = d.join(gold, ["qid", "doc_id"], "left_anti")
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rn"))).filter("k = 1")
    d = d.withColumn("neg_no", F.row_number().over(Window.partitionBy("qid").orderBy("rn"))).filter(F.col("neg_no") <= n)
    return d.select("qid", "neg_no", "chunk_idx")


def pairs(questions: DataFrame, pos: DataFrame, neg: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, query, positive, negatives): texts are joined last, to the few chunks chosen."""
    chosen = cut(pos.select("qid", F.lit(0).alias("neg_no"), "chunk_idx").unionByName(neg.select("qid", F.col("neg_no").cast("int").alias("neg_no"), "chunk_idx")))
    if chosen.count() <= SENT:  # they go to where the texts lie, so that no other text is moved
        chosen = F.broadcast(chosen)
    got = chunks.select("chunk_idx", "text").join(chosen, "chunk_idx").dropDuplicates(["qid", "neg_no"])
    negs = F.filter(F.array_sort(F.collect_list(F.struct("neg_no", "text"))), lambda x: x["neg_no"] > 0)
    d = got.groupBy("qid").agg(F.max(F.struct((F.col("neg_no") == 0).alias("is"), "text")).alias("p"), F.transform(negs, lambda x: x["text"]).alias("negatives"))
    d = d.filter("p.is and size(negatives) > 0").select("qid", F.col("p.text").alias("positive"), "negatives")
    return questions.select("qid", F.col("question").alias("query")).join(d, "qid")


def biencoder_rows(pairs: DataFrame, n: int) -> DataFrame:
    """One row per question with negative_1..n; questions with fewer are left out."""
    return pairs.filter(F.size("negatives") >= n).select("qid", "query", "positive", *[F.col("negatives")[i].alias(f"negative_{i + 1}") for i in range(n)])


def crossencoder_rows(pairs: DataFrame, n: int) -> DataFrame:
    """(qid, query, text, label): the positive with 1 and the first n negatives with 0; questions with fewer are left out."""
    items = F.concat(F.array(F.struct(F.col("positive").alias("text"), F.lit(1).alias("label"))), F.transform(F.slice("negatives", 1, n), lambda x: F.struct(x.alias("text"), F.lit(0).alias("label"))))
    return pairs.filter(F.size("negatives") >= n).select("qid", "query", F.explode(items).alias("i")).select("qid", "query", "i.text", "i.label")


def listwise_rows(pairs: DataFrame, n: int) -> DataFrame:
    """One row per question for a scorer that sees the whole list: query, positive, negative_1..n; questions with fewer are left out."""
    return biencoder_rows(pairs, n).drop("qid")
