"""Pools of chunks scored by BM25 and by vectors, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotusrank.functions.text import bind

RRF_K = 60


def scored_pool(chunks: DataFrame, pool: int = 2000) -> DataFrame:
    """(qid, chunk_idx, doc_id, bm25, dense): the `pool` best chunks of positive BM25 of every question; a missing dense
    score counts as 0."""
    num = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))
    d = chunks.filter("qid is not null").select("qid", "chunk_idx", "doc_id", num("bm25").alias("bm25"), F.coalesce(num("dense"), F.lit(0.0)).alias("dense"))
    d = d.filter("bm25 > 0").dropDuplicates(["qid", "chunk_idx"])
    w = Window.partitionBy("qid").orderBy(F.col("bm25").desc(), F.col("chunk_idx"))
    return d.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= pool).drop("__r")


def minmax(c: Column, by: list[str], eps: float = 1e-9) -> Column:
    """Scaled to [0, 1] within a pool; 0 throughout where its span is below eps."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi - lo < eps, F.lit(0.0)).otherwise((c - lo) / (hi - lo))


def fuse(pool: DataFrame, fusion: str = "linear", alpha: float = 0.7) -> DataFrame:
    """Adds `fused`: linear (min-max scaled), rrf (ranks), or one of the scores as it is."""
    if fusion == "linear":
        v = alpha * minmax(F.col("dense"), ["qid"]) + (1 - alpha) * minmax(F.col("bm25"), ["qid"])
    elif fusion == "rrf":
        rank = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.col(c).desc(), F.col("chunk_idx")))
        v = 1 / (RRF_K + rank("bm25")) + 1 / (RRF_K + rank("dense"))
    elif fusion in ("dense", "bm25"):
        v = F.col(fusion)
    else:
        raise ValueError(f"unknown fusion {fusion!r}")
    return pool.withColumn("fused", F.round(v, 9))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def truncate(a: Column, dims: int) -> Column:
    """The first dims parts, of unit length again; null for null and zero vectors."""
    cut = F.slice(a, 1, dims)
    return bind(norm(cut), lambda n: F.when(n > 0, F.transform(cut, lambda x: x.cast("double") / n)))


def dense_scores(pool: DataFrame, vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(qid, chunk_idx, dense): inner products of the question's vector with those of its pool's chunks only."""
    return (pool.select("qid", "chunk_idx").join(vectors, "chunk_idx").join(query_vectors, "qid")
            .select("qid", "chunk_idx", dot(F.col("dense"), F.col("qvec")).alias("dense")))


def products(pool: DataFrame, vectors: DataFrame, query_vectors: DataFrame, columns: dict[str, tuple[str, str]], digits: int, cosine: bool = False) -> DataFrame:
    """Adds to the pool, for each of `columns` (name: (part of vectors, part of query_vectors)), the rounded inner product of the question's
    vector with the chunk's, or their cosine; 0 where a vector is missing, or of length 0. vectors (chunk_idx, ...), query_vectors
    (qid, ...). The questions' vectors must be few enough to be held everywhere; products are taken in double precision, in Arrow batches."""
    spark = pool.sparkSession
    q = query_vectors.toArrow()
    sent = spark.sparkContext.broadcast((q["qid"].combine_chunks(), {b: _matrix(q[b].combine_chunks()) for _, b in columns.values()}))
    keep, parts = pool.columns, list(dict.fromkeys(a for a, _ in columns.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked = sent.value
        for b in batches:
            at = pc.index_in(b.column("qid"), value_set=qids).fill_null(-1).to_numpy(zero_copy_only=False)
            out = [b.column(c) for c in keep]
            for a, to in columns.values():
                v, m = b.column(a), asked[to]
                has = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False) & (at >= 0))
                x = np.zeros(b.num_rows)
                if len(has):
                    x[has] = _products(_matrix(v.take(pa.array(has))), m[at[has]], cosine)
                out.append(pa.array(np.copysign(np.floor(np.abs(x) * 10 ** digits + 0.5) / 10 ** digits, x) + 0.0))
            yield pa.RecordBatch.from_arrays(out, [*keep, *columns])
    d = pool.join(vectors.select("chunk_idx", *parts), "chunk_idx", "left").select(*keep, *parts)
    kinds = dict(pool.dtypes)
    return d.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + "".join(f", `{c}` double" for c in columns))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows; an array of lists of several lengths keeps them as they are."""
    n = np.asarray(lists.value_lengths())
    if len(n) == 0 or (n == n[0]).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(n), n[0] if len(n) else 0)
    out = np.empty(len(n), dtype=object)
    out[:] = [np.asarray(x.values, dtype=np.float64) for x in lists]
    return out


def _products(v: np.ndarray, q: np.ndarray, cosine: bool) -> np.ndarray:
    """Row by row; 0 where the lengths differ, and for cosines where one is 0."""
    if v.dtype == object or q.dtype == object or v.shape[1] != q.shape[1]:
        return np.array([_products(np.asarray(a)[None], np.asarray(b)[None], cosine)[0] if len(a) == len(b) else 0.0 for a, b in zip(v, q)])
    v, q = v.astype(np.float64), q.astype(np.float64)
    x = np.einsum("ij,ij->i", v, q)
    if not cosine:
        return x
    lengths = np.sqrt(np.einsum("ij,ij->i", v, v)), np.sqrt(np.einsum("ij,ij->i", q, q))
    ok = (lengths[0] != 0) & (lengths[1] != 0)
    return np.divide(np.divide(x, lengths[0], out=np.zeros_like(x), where=ok), lengths[1], out=np.zeros_like(x), where=ok)
