"""Top N items of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, *, tie: Column | None = None, salts: int = 32,
          extra: tuple[str, ...] = ()) -> DataFrame:
    """The n best distinct items of every group, with their rank.

    Every group is hashed by item into `salts` subgroups; each keeps its n best (Spark also cuts to n before the
    shuffle), and only those survivors meet in one task per group: at most salts * n rows, however large the group.
    An item's score is its highest. Ties go to the smaller `tie` (default: the item).

    Defined cases: null groups, null or blank items, null or NaN scores do not rank; repeated rows count once; groups
    without a rankable item and empty inputs give no row; columns other than those named are ignored.
    Result: (group, item, *extra, score, rank). `extra` columns must depend on the item alone.
    """
    num = dict(df.dtypes)[score] in ("double", "float")
    named = {"__g": F.col(group), "__i": F.col(item), "__s": F.col(score), "__t": tie if tie is not None else F.col(item)}
    named |= {f"__x{k}": F.col(c) for k, c in enumerate(extra)}
    d = df.select(*[v.alias(k) for k, v in named.items()])
    ok = F.col("__g").isNotNull() & F.col("__i").isNotNull() & F.col("__s").isNotNull()
    if dict(df.dtypes)[item] == "string":
        ok = ok & F.col("__i").rlike(r"[^\s\p{Z}]")
    if num:
        ok = ok & ~F.isnan("__s")
    d = d.filter(ok).withColumn("__salt", F.pmod(F.xxhash64("__i"), F.lit(salts)).cast("int"))
    order = [F.col("__s").desc(), F.col("__t").asc(), F.col("__i").asc()]
    rest = [f"__x{k}" for k in range(len(extra))]
    # stage 1: an item always falls into the same subgroup, so its repeats and lesser scores are settled there
    best = d.groupBy("__g", "__salt", "__i", "__t", *rest).agg(F.max("__s").alias("__s"))
    kept = best.withColumn("__r", F.row_number().over(Window.partitionBy("__g", "__salt").orderBy(*order))).filter(F.col("__r") <= n)
    # stage 2: the survivors of all subgroups
    out = kept.withColumn("__r", F.row_number().over(Window.partitionBy("__g").orderBy(*order))).filter(F.col("__r") <= n)
    return out.select(F.col("__g").alias(group), F.col("__i").alias(item), *[F.col(f"__x{k}").alias(c) for k, c in enumerate(extra)],
                      F.col("__s").alias(score), F.col("__r").alias("rank"))


def submission_items(submission: DataFrame) -> DataFrame:
    """One row (qid, item, score) for every candidate of every submission row; score and answer pair by position."""
    return (submission.select("qid", F.explode(F.arrays_zip(F.col("answer"), F.col("score").alias("score"))).alias("z"))
            .select("qid", F.col("z")["answer"].alias("item"), F.col("z")["score"].alias("score")))


def best_answers(submission: DataFrame, n: int = 5) -> DataFrame:
    return top_n(submission_items(submission), "qid", "item", "score", n)


def best_chunks(chunks: DataFrame, n: int = 3) -> DataFrame:
    return top_n(chunks.select("doc_id", "chunk_id", "chunk_idx", "bm25"), "doc_id", "chunk_id", "bm25", n, tie=F.col("chunk_idx"), extra=("chunk_idx",))


def found(submission: DataFrame, chunks: DataFrame) -> DataFrame:
    q = best_answers(submission).select(F.lit("question").alias("grp"), F.col("qid").alias("grp_key"), "item")
    d = best_chunks(chunks).select(F.lit("document").alias("grp"), F.col("doc_id").alias("grp_key"), F.col("chunk_id").alias("item"))
    return q.unionByName(d)
