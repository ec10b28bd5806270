"""Stages that keep their result and are skipped where it is complete."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusrank.functions.scale import prepare, shared_folder
from lotusrank.functions.text import header_title, snippet
from lotusrank.operators import aggregate, chunking, encode, fusion, index, prior, rerank
from lotusrank.params import Params
from lotusrank.sources.io import late_fetch


@dataclass
class Pipeline:
    """Runs named stages; each writes a table under `root` and counts as done only with Spark's _SUCCESS mark, so a
    half-written table is built again."""
    spark: SparkSession
    root: str
    force: bool = False
    ran: list[str] = field(default_factory=list)

    def done(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self.force or not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.root}/{name}")
            self.ran.append(name)
        return self.spark.read.parquet(f"{self.root}/{name}")


def session_stages(spark: SparkSession, folder: str) -> Pipeline:
    """Stages over the tables of a folder, kept in the shared folder of the session as long as it lives; a folder whose files
    have changed has others."""
    prepare(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = [fs.makeQualified(path).toString(), *sorted(f"{x.getPath().getName()} {x.getLen()} {x.getModificationTime()}" for x in fs.listStatus(path))]
    return Pipeline(spark, f"{shared_folder(spark)}/stages-{hashlib.md5('|'.join(state).encode()).hexdigest()}")


def stored_index(p: Pipeline, chunks: Callable[[], DataFrame], params: Params = Params()) -> index.Index:
    """The index stage: written once, then read. The vocabulary is written last, so its mark tells that all is there."""
    name = f"index-{params.min_df}-{params.max_df_ratio:g}"
    if p.force or not p.done(f"{name}/vocab"):
        index.write_index(chunks(), f"{p.root}/{name}", params)
        p.ran.append("index")
    return index.Index.read(p.spark, f"{p.root}/{name}")


def stored_vectors(p: Pipeline, chunks: DataFrame, model: encode.Encode, meta: encode.EncoderMeta) -> DataFrame:
    """The encoding stage: vectors of all chunks, written once with their maker; raises if those there are of another encoder."""
    if p.force or not p.done("vectors/meta"):
        encode.write_vectors(encode.encode(chunks, "chunk_idx", "text", model), f"{p.root}/vectors", meta)
        p.ran.append("vectors")
    return encode.read_vectors(p.spark, f"{p.root}/vectors", meta)[0]


def predict(tier: str, pool: DataFrame, params: Params = Params(), score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, rank, doc_id, score) from a pool (qid, chunk_idx, doc_id, bm25, dense): by BM25 alone (`bm25`), fused with the vectors'
    scores (`hybrid`), or with the candidates scored again by a model (`rerank`; `score` adds `ce` to them)."""
    if tier == "bm25":
        d = aggregate.rank_docs(pool, "max", params.topk, "bm25")
    elif tier in ("hybrid", "rerank"):
        fused = fusion.fuse(pool, params.fusion, params.alpha)
        if tier == "hybrid":
            d = aggregate.rank_docs(fused, params.agg, params.topk, "fused")
        else:
            if score is None:
                raise ValueError("the rerank tier needs a scorer")
            cands = rerank.candidate_cut(fused, params.n_docs, params.m_chunks).drop("rn", "bm25", "dense")
            d = rerank.rerank_docs(score(cands), params.beta, params.agg, params.topk)
    else:
        raise ValueError(f"unknown tier {tier!r}")
    return d.select("qid", "rank", "doc_id", "score")


def retrieve(p: Pipeline, docs: DataFrame, questions: DataFrame, params: Params = Params(), dense: Callable[[DataFrame], DataFrame] | None = None,
             encoder: tuple[encode.Encode, encode.EncoderMeta] | None = None) -> DataFrame:
    """docs (doc_id, name, link, passage) and questions (qid, question) to ranked documents. With an encoder, chunks are encoded
    in a stage and the pool gets the inner products with the questions' vectors; or `dense` adds such scores to the pool
    (qid, chunk_idx, doc_id, bm25); with neither, encoding is left out and BM25 alone ranks."""
    chunks = p.stage("chunks", lambda: chunking.ordinals(chunking.chunk(docs)))
    if encoder is not None:
        vectors = stored_vectors(p, chunks, *encoder).withColumnRenamed("embedding", "dense")

        def dense(pool: DataFrame) -> DataFrame:
            asked = encode.encode(questions, "qid", "question", encoder[0]).withColumnRenamed("embedding", "qvec")
            got = fusion.dense_scores(pool, vectors, asked)
            return pool.join(got, ["qid", "chunk_idx"], "left").fillna(0.0, ["dense"])
    ix = stored_index(p, lambda: chunks, params)
    scores = p.stage("scores", lambda: index.top_bm25(ix, questions, max(params.pool, params.doc_pool), params).drop("rank"))
    if dense is None:
        pool = index.top_chunks(scores, params.doc_pool)
        return p.stage("ranked", lambda: aggregate.rank_docs(pool, "max", params.topk, "bm25", ix.doc_sizes()))
    pool = p.stage("pool", lambda: dense(index.top_chunks(scores, params.pool).drop("rank")))
    return p.stage("ranked", lambda: aggregate.rank_docs(fusion.fuse(pool, params.fusion, params.alpha), params.agg, params.topk, "fused", ix.doc_sizes()))


def search(chunks: DataFrame, questions: DataFrame, k: int = 10, mode: str = "doc", agg: str = "max", params: Params = Params(), size: int = 260, ix: index.Index | None = None) -> DataFrame:
    """The k (1 to 100) best documents or chunks of every question, with title and a snippet of `size` characters of the best
    chunk; `ix` is the stored index of the chunks, without which one is built for this search."""
    k = max(1, min(100, k))
    ix = ix or index.Index.of(chunks, params)
    if mode == "chunk":
        top = index.top_bm25(ix, questions, k, params).select("qid", "rank", "doc_id", F.col("bm25").alias("score"), "chunk_idx")
    elif mode == "doc":
        top = index.top_docs(ix, questions, params.doc_pool, agg, k, params).withColumnRenamed("best_chunk", "chunk_idx")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    d = late_fetch(top, chunks, ["text", "path"])
    return d.select("qid", "rank", "doc_id", "score", "chunk_idx", header_title(F.col("text")).alias("title"), "path", snippet(F.col("text"), size).alias("snippet"))


def submit(ranked: DataFrame, train: DataFrame, questions: DataFrame, params: Params = Params()) -> DataFrame:
    """(qid, answer): candidates reweighed by the prior of all labels and padded to topk."""
    final = prior.apply_prior(ranked, prior.prior_weights(train), params.lam, params.topk)
    return prior.answers(prior.pad(final, questions, prior.fallback(train), params.topk))


def submission_report(ranked: DataFrame, train: DataFrame, questions: DataFrame, params: Params = Params()) -> DataFrame:
    """One row on what `submit` makes of the candidates: the numbers of prior.output_stats, and `moved`, the questions whose
    best documents the prior has changed."""
    final = prior.apply_prior(ranked, prior.prior_weights(train), params.lam, params.topk)
    stats = prior.output_stats(prior.pad(final, questions, prior.fallback(train), params.topk))
    moved = prior.changed(ranked.filter(F.col("rank") <= params.topk), final).agg(F.count(F.lit(1)).alias("moved"))
    return stats.crossJoin(moved)  # one row each
