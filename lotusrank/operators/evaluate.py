"""Relevance metrics, intervals, selection and parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotusrank.functions.scale import cut
from lotusrank.operators.aggregate import rank_docs, value_of
from lotusrank.operators.fusion import RRF_K, minmax
from lotusrank.operators.index import Index, best, sums
from lotusrank.operators.prior import apply_prior
from lotusrank.operators.rerank import blend
from lotusrank.params import Params, parse_agg


def per_question(ranked: DataFrame, gold: DataFrame, k: int = 5, deep: int = 20) -> DataFrame:
    """(qid, recall, precision, hit, rr) of every labelled question; those without a ranking score 0."""
    n_gold = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    j = ranked.join(gold.withColumn("g", F.lit(1)), ["qid", "doc_id"], "left")
    got = j.groupBy("qid").agg(F.sum(F.when((F.col("rank") <= k) & (F.col("g") == 1), 1).otherwise(0)).alias("inter"),
                               F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("n_pred"),
                               F.min(F.when((F.col("g") == 1) & (F.col("rank") <= max(k, deep)), F.col("rank"))).alias("first"))
    d = n_gold.join(got, "qid", "left").fillna(0, ["inter", "n_pred"])
    return d.select("qid", (F.col("inter") / F.col("n_gold")).alias("recall"),
                    F.when(F.col("n_pred") > 0, F.col("inter") / F.col("n_pred")).otherwise(F.lit(0.0)).alias("precision"),
                    (F.col("inter") > 0).cast("int").alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), "first")


def metrics(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    return per_question(ranked, gold, k).agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("recall", "recall"), ("precision", "precision"), ("hit", "hit_rate"), ("rr", "mrr"))], F.count(F.lit(1)).alias("questions"))


def rank_histogram(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    f = F.col("first")
    bucket = F.when(f.isNull(), "miss").when(f == 1, "1").when(f <= 3, "2-3").when(f <= 5, "4-5").when(f <= 10, "6-10").otherwise("11-20")
    return per_question(ranked, gold).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("questions"))


def ceiling(cands: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the mean share of labels that any candidate list could still return."""
    d = gold.join(cands.select("qid", "doc_id").distinct().withColumn("c", F.lit(1)), ["qid", "doc_id"], "left")
    q = d.groupBy("qid").agg((F.sum(F.coalesce("c", F.lit(0))) / F.count(F.lit(1))).alias("r"))
    return q.agg(F.round(F.avg("r"), 6).alias("ceiling"), F.count(F.lit(1)).alias("questions"))


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: the exact probability that a positive outscores a negative, ties one half. Equal scores are counted
    first; what remains to be ordered is one row per distinct score."""
    from lotusrank.functions.scale import with_group_offsets
    v = scored.groupBy(F.lit(0).alias("__g"), F.col(score).alias("__s")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    below = with_group_offsets(v, ["__g"], [F.col("__s")], "n", "below")
    return below.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc")).select(F.round("auc", 9).alias("auc"))


def bootstrap(deltas: DataFrame, samples: int = 4000, seed: int = 0) -> DataFrame:
    """One row: the mean of `delta`, its 2.5 and 97.5 percentiles over resamples, and the share of resamples above 0."""
    return bootstrap_by(deltas.withColumn("config", F.lit(0)), samples, seed).drop("config")


def bootstrap_by(deltas: DataFrame, samples: int = 4000, seed: int = 0) -> DataFrame:
    """(config, mean, lo, hi, win) over deltas (config, qid, delta); all configs see the same resamples.

    Poisson bootstrap: each question's number of draws in each resample comes from a digest of (qid, resample, seed), so
    every question is resampled where it lies and only sums per resample meet; partitioning can't change the result.
    """
    each = deltas.groupBy("qid").agg(F.collect_list(F.struct("config", "delta")).alias("x"))  # one digest for all configs
    drawn = each.select("qid", "x", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", "qid", F.col("b").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    term, cum, n = 0.36787944117144233, 0.0, F.lit(0)
    for k in range(9):
        cum += term
        n = n + (u > cum).cast("int")
        term /= k + 1
    drawn = drawn.select("b", n.alias("n"), "x").select("b", "n", F.explode("x").alias("x")).select("b", "n", "x.config", "x.delta")
    means = drawn.groupBy("config", "b").agg((F.sum(F.col("n") * F.col("delta")) / F.sum("n")).alias("m"))
    ci = means.groupBy("config").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.avg((F.col("m") > 0).cast("double")).alias("win"))
    mean = deltas.groupBy("config").agg(F.avg("delta").cast("double").alias("mean"))
    return mean.join(ci, "config").select("config", "mean", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"), "win")


def half_split(results: DataFrame, halves: DataFrame) -> DataFrame:
    """(config, first, second, chosen): mean of `value` by config on both halves, `chosen` for the best on the first.

    results: qid, config, value; halves: qid, half (1 or 2). Ties go to the smaller config.
    """
    d = results.join(halves, "qid").groupBy("config").agg(F.round(F.avg(F.when(F.col("half") == 1, F.col("value"))), 6).alias("first"), F.round(F.avg(F.when(F.col("half") == 2, F.col("value"))), 6).alias("second"))
    top = d.orderBy(F.col("first").desc(), "config").first()
    return d.withColumn("chosen", F.col("config") == F.lit(top["config"]) if top else F.lit(False))


def sample(questions: DataFrame, n: int, seed: int = 0, skip: int = 0) -> DataFrame:
    """n questions in hash order after the first `skip`: the same for every partitioning."""
    return questions.orderBy(F.md5(F.concat(F.col("qid"), F.lit(f":{seed}"))), "qid").offset(skip).limit(n)


def sweep_bm25(chunks: DataFrame | Index, questions: DataFrame, gold: DataFrame, k1s: list[float], bs: list[float], p: Params = Params(), agg: str = "max") -> DataFrame:
    """(k1, b, recall, mrr) of every pair: postings are matched once, and all pairs weighed in one pass over them."""
    grid = [(float(k), float(b)) for k in k1s for b in bs]
    ix = Index.of(chunks, p)
    keys, cfgs = {"k1": "double", "b": "double"}, [f"{k}|{b}" for k, b in grid]
    if agg == "max":  # the best chunks decide, and these are found where the chunks lie
        d = best(ix, questions, grid, 20, docs=True)
        cfg = F.element_at(F.array(*[F.lit(c) for c in cfgs]), F.col("cno") + 1)
        return measured(d.select(F.concat_ws("#", "qid", cfg).alias("qid"), "doc_id", "rank"), gold, keys, cfgs)
    wide, names = sums(ix, questions, {f"s{i}": kb for i, kb in enumerate(grid)}, p)
    wide = wide.join(names, "qno").join(ix.lengths.select("chunk_idx", "doc_id"), "chunk_idx")
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("cfg"), F.col(f"s{i}").alias("score")) for i, c in enumerate(cfgs)]))
    s = wide.select("qid", "chunk_idx", "doc_id", long.alias("c")).select("qid", "chunk_idx", "doc_id", "c.cfg", "c.score")
    return by_config(s, gold, agg, keys, cfgs)


def by_config(scores: DataFrame, gold: DataFrame, agg: str, keys: dict[str, str], cfgs: list[str]) -> DataFrame:
    """Recall@5 and MRR by config, for scores with a column cfg: question and config together key one ranking."""
    return measured(rank_docs(scores.withColumn("qid", F.concat_ws("#", "qid", "cfg")), agg, 20), gold, keys, cfgs)


def measured(ranked: DataFrame, gold: DataFrame, keys: dict[str, str], cfgs: list[str]) -> DataFrame:
    """Recall@5 and MRR by config, for rankings whose qid is question and config together."""
    g = gold.withColumn("cfg", F.explode(F.array(*[F.lit(c) for c in cfgs]))).withColumn("qid", F.concat_ws("#", "qid", "cfg"))
    q = per_question(ranked, g.select("qid", "doc_id"))
    q = q.withColumn("cfg", F.element_at(F.split("qid", "#"), -1))
    d = q.groupBy("cfg").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))
    parts = F.split("cfg", r"\|")
    return d.select(*[parts[i].cast(t).alias(k) for i, (k, t) in enumerate(keys.items())], "recall", "mrr")


def _ranked_by_all(scores: DataFrame, aggs: list[str], topk: int = 20) -> DataFrame:
    """(qid, rank, doc_id) with the aggregate added to qid after a |: all aggregates of one grouping, ranked in one window.
    The ties are those of rank_docs."""
    w = Window.partitionBy("qid", "doc_id").orderBy(F.col("score").desc(), F.col("chunk_idx"))
    d = scores.withColumn("__rn", F.row_number().over(w))
    values = [value_of(a, F.col("score"), F.col("__rn")).alias(f"v{i}") for i, a in enumerate(aggs)]
    d = d.groupBy("qid", "doc_id").agg(*values, F.max("score").alias("best"), F.min(F.when(F.col("__rn") == 1, F.col("chunk_idx"))).alias("chunk"))
    long = F.explode(F.array(*[F.struct(F.lit(a).alias("agg"), F.round(f"v{i}", 6).alias("score")) for i, a in enumerate(aggs)]))
    d = d.select("qid", "doc_id", "best", "chunk", long.alias("x")).select(F.concat_ws("|", "qid", "x.agg").alias("qid"), "doc_id", "best", "chunk", "x.score")
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.round("best", 6).desc(), "chunk", "doc_id")
    return d.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= topk).select("qid", "rank", "doc_id")


def _alphas(pool: DataFrame, alphas: list[float], key: Column) -> DataFrame:
    """(qid, chunk_idx, doc_id, score), one row per alpha: scores are scaled once within `qid`, alphas exploded beside them;
    qid becomes question and config, `key` with the alpha after it."""
    d = pool.select("qid", "chunk_idx", "doc_id", key.alias("__key"), minmax(F.col("dense"), ["qid"]).alias("d"), minmax(F.col("bm25"), ["qid"]).alias("b"))
    each = F.explode(F.array(*[F.struct(F.lit(f"{a:g}").alias("cfg"), F.round(a * F.col("d") + (1 - a) * F.col("b"), 9).alias("score")) for a in alphas]))
    d = d.select("qid", "chunk_idx", "doc_id", "__key", each.alias("x"))
    return d.select(F.concat("__key", "x.cfg").alias("qid"), "chunk_idx", "doc_id", "x.score")


def sweep_fusion(pool: DataFrame, gold: DataFrame, alphas: list[float], aggs: list[str]) -> DataFrame:
    """(alpha, agg, recall, mrr): one pool, scaled once; every alpha is a row beside each chunk, every aggregate a column of
    one grouping, and all rankings come from one window keyed by question and config."""
    ranked = _ranked_by_all(_alphas(pool, alphas, F.concat("qid", F.lit("#"))), aggs)
    return measured(ranked, gold, {"alpha": "double", "agg": "string"}, [f"{a:g}|{g}" for a in alphas for g in aggs])


def sweep_pool(pool: DataFrame, gold: DataFrame, pools: list[int], alphas: list[float], aggs: list[str]) -> DataFrame:
    """(pool, alpha, agg, recall, mrr): chunks are scored once for the largest pool; a smaller one is made of the ranks by BM25
    it holds, and is scaled by itself."""
    w = Window.partitionBy("qid").orderBy(F.col("bm25").desc(), F.col("chunk_idx"))
    ranked = pool.withColumn("__r", F.row_number().over(w))
    sizes = F.explode(F.filter(F.array(*[F.lit(n) for n in pools]), lambda n: n >= F.col("__r")))
    each = ranked.select("chunk_idx", "doc_id", "bm25", "dense", "qid", sizes.alias("n")).withColumn("qid", F.concat_ws("#", "qid", F.col("n").cast("string")))
    ranked = _ranked_by_all(_alphas(each, alphas, F.concat("qid", F.lit("|"))), aggs)
    return measured(ranked, gold, {"pool": "int", "alpha": "double", "agg": "string"}, [f"{n}|{a:g}|{g}" for n in pools for a in alphas for g in aggs])


@dataclass(frozen=True)
class Ranking:
    """One way to rank a question's pool; `cfg` is put after the question's id."""
    cfg: str
    fusion: str
    alpha: float
    agg: str


def _at(x: np.ndarray, digits: int) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 10 ** digits + 0.5) / 10 ** digits, x)


def _down(x: np.ndarray) -> np.ndarray:
    """Keys of the falling order, in which NaN comes first as in SQL."""
    return -np.where(np.isnan(x), np.inf, x)


class _Pool:
    """One question's pool in memory: at most as many rows as a pool has."""

    def __init__(self, t: pa.Table):
        self.chunk, self.bm25, self.dense = (t[c].to_numpy() for c in ("chunk_idx", "bm25", "dense"))
        self.ids = t["doc_id"].combine_chunks().dictionary_encode()
        self.ids = self.ids.chunk(0) if isinstance(self.ids, pa.ChunkedArray) else self.ids
        names = self.ids.dictionary
        place = np.empty(len(names), dtype=np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        code = self.ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.doc = np.where(code < 0, -1, place[code]) if len(names) else np.full(len(code), -1)  # in order of the ids, null first
        self.doc_ids = t["doc_id"].combine_chunks()

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        lo, hi = np.fmin.reduce(x), x.max()
        return np.zeros(len(x)) if hi - lo < 1e-9 else (x - lo) / (hi - lo)

    def _ranks(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), dtype=np.int64)
        out[np.lexsort((self.chunk, _down(x)))] = np.arange(1, len(x) + 1)
        return out

    def fused(self, fusion: str, alpha: float) -> np.ndarray:
        """As fusion.fuse."""
        if fusion == "linear":
            v = alpha * self._scaled(self.dense) + (1 - alpha) * self._scaled(self.bm25)
        elif fusion == "rrf":
            v = 1 / (RRF_K + self._ranks(self.bm25)) + 1 / (RRF_K + self._ranks(self.dense))
        else:
            v = {"dense": self.dense, "bm25": self.bm25}[fusion]
        return _at(v, 9)

    def best(self, s: np.ndarray, agg: str, topk: int) -> np.ndarray:
        """The rows of the best chunks of the topk best documents, as aggregate.rank_docs ranks them."""
        order = np.lexsort((self.chunk, _down(s), self.doc))
        doc, s = self.doc[order], s[order]
        first = np.flatnonzero(np.diff(doc, prepend=-2))
        n = np.diff(first, append=len(doc))
        nth = np.arange(len(doc)) - np.repeat(first, n)
        kind, x = parse_agg(agg)
        if kind == "max":
            v = s[first]
        elif kind == "avg":
            v = np.add.reduceat(s, first) / n
        elif kind == "max+":
            v = np.add.reduceat(np.where(nth == 0, s, np.where(nth == 1, s * x, 0.0)), first)
        elif kind == "top":
            v = np.add.reduceat(np.where(nth < int(x), s, 0.0), first) / np.minimum(n, int(x))
        else:
            raise ValueError(f"{agg!r} needs the documents' sizes")
        top = np.lexsort((doc[first], self.chunk[order][first], _down(_at(s[first], 6)), _down(_at(v, 6))))[:topk]
        return order[first[top]]

    def candidates(self, s: np.ndarray, n_docs: int, m_chunks: int) -> np.ndarray:
        """The rows that rerank.candidate_cut keeps."""
        order = np.lexsort((self.chunk, _down(s)))
        _, first, of = np.unique(self.doc[order], return_index=True, return_inverse=True)
        met = np.sort(first)
        order, of = order[:met[n_docs]] if len(met) > n_docs else order, of[:met[n_docs]] if len(met) > n_docs else of
        by = np.argsort(of, kind="stable")
        start = np.flatnonzero(np.diff(of[by], prepend=-1))
        nth = np.empty(len(by), dtype=np.int64)
        nth[by] = np.arange(len(by)) - np.repeat(start, np.diff(start, append=len(by)))
        return order[nth < m_chunks]


def _by_question(pool: DataFrame, columns: str, each) -> DataFrame:
    """`each` of a question's id and _Pool gives Arrow tables; the pool moves once, by question."""
    schema = f"qid string, {columns}"

    def run(t: pa.Table) -> pa.Table:
        return pa.concat_tables(each(t["qid"][0].as_py(), _Pool(t)))
    return pool.select("qid", F.col("chunk_idx").cast("long").alias("chunk_idx"), "doc_id", F.col("bm25").cast("double").alias("bm25"), F.col("dense").cast("double").alias("dense")).groupBy("qid").applyInArrow(run, schema)


def best_docs(pool: DataFrame, rankings: list[Ranking], topk: int = 20) -> DataFrame:
    """(qid, rank, doc_id) of every ranking of every question's pool; qid is the question's with the ranking's cfg after it."""
    def each(qid: str, p: _Pool) -> list[pa.Table]:
        out, fused = [], {}
        for r in rankings:
            key = (r.fusion, r.alpha)
            if key not in fused:
                fused[key] = p.fused(*key)
            rows = p.best(fused[key], r.agg, topk)
            out.append(pa.table({"qid": pa.array([qid + r.cfg] * len(rows), pa.string()), "rank": pa.array(np.arange(1, len(rows) + 1), pa.int32()), "doc_id": p.doc_ids.take(pa.array(rows)).cast(pa.string())}))
        return out
    return _by_question(pool, "rank int, doc_id string", each)


def candidates_each(pool: DataFrame, alphas: list[float], n_docs: int, m_chunks: int) -> DataFrame:
    """(qid, doc_id, chunk_idx, fused, cfg): the candidates under every alpha."""
    def each(qid: str, p: _Pool) -> list[pa.Table]:
        out = []
        for a in alphas:
            s = p.fused("linear", a)
            rows = p.candidates(s, n_docs, m_chunks)
            out.append(pa.table({"qid": pa.array([qid] * len(rows), pa.string()), "doc_id": p.doc_ids.take(pa.array(rows)).cast(pa.string()), "chunk_idx": pa.array(p.chunk[rows], pa.int64()), "fused": pa.array(s[rows], pa.float64()), "cfg": pa.array([f"{a:g}"] * len(rows), pa.string())}))
        return out
    return _by_question(pool, "doc_id string, chunk_idx bigint, fused double, cfg string", each)


def compare_fusions(pool: DataFrame, gold: DataFrame, fusions: tuple[str, ...], alpha: float, agg: str) -> DataFrame:
    """(config, recall, mrr) of every way to fuse the pool's two scores."""
    return measured(best_docs(pool, [Ranking(f"#{f}", f, alpha, agg) for f in fusions]), gold, {"config": "string"}, list(fusions))


def compare_vectors(pools: dict[str, DataFrame], gold: DataFrame, alphas: list[float], agg: str = "top2") -> DataFrame:
    """(vectors, alpha, recall, mrr): pools that differ in their dense scores only, such as those of a tuned encoder and of its
    base, over the same alphas."""
    each = reduce(DataFrame.unionByName, [p.select("qid", "chunk_idx", "doc_id", "bm25", "dense").withColumn("qid", F.concat("qid", F.lit(f"#{name}"))) for name, p in pools.items()])
    ranked = best_docs(each, [Ranking(f"|{a:g}|{agg}", "linear", a, agg) for a in alphas])
    d = measured(ranked, gold, {"vectors": "string", "alpha": "double", "agg": "string"}, [f"{n}|{a:g}|{agg}" for n in pools for a in alphas])
    return d.drop("agg")


def compare_scorers(pairs: DataFrame, scores: DataFrame, gold: DataFrame, betas: list[float], agg: str = "top2") -> DataFrame:
    """(model, beta, recall, delta, first, second, lo, hi, win): models that have scored the same pairs (qid, doc_id, chunk_idx,
    fused), blended by every beta; scores (model, qid, chunk_idx, ce). delta, its halves by digest of the question and the
    interval are against the fused order; a pair that a model has not scored counts as 0."""
    base = per_question(rank_docs(pairs.withColumn("score", F.round("fused", 9)), agg, 5), gold).select("qid", F.col("recall").alias("base"))
    models = scores.select("model").distinct()
    d = pairs.crossJoin(F.broadcast(models)).join(scores, ["model", "qid", "chunk_idx"], "left").fillna(0.0, ["ce"])  # models are a handful
    d = d.withColumn("qid", F.concat_ws("#", "qid", "model"))
    mixed = reduce(DataFrame.unionByName, [blend(d, b).select(F.concat("qid", F.lit(f"|{b:g}")).alias("qid"), "doc_id", "chunk_idx", F.round("score", 9).alias("score")) for b in betas])
    keys = models.select(F.explode(F.array(*[F.concat("model", F.lit(f"|{b:g}")) for b in betas])).alias("config"))
    g = gold.crossJoin(F.broadcast(keys)).select(F.concat_ws("#", "qid", "config").alias("qid"), "doc_id")
    q = per_question(rank_docs(mixed, agg, 5), g).select(F.split("qid", "#")[0].alias("qid"), F.element_at(F.split("qid", "#"), -1).alias("config"), "recall")
    q = cut(q.join(base, "qid").select("config", "qid", "recall", (F.col("recall") - F.col("base")).alias("delta")))
    half = F.ascii(F.substring(F.md5("qid"), 1, 1)) % 2
    r6 = lambda c, name: F.round(F.avg(c), 6).alias(name)
    d = q.groupBy("config").agg(r6("recall", "recall"), r6("delta", "delta"), r6(F.when(half == 0, F.col("delta")), "first"), r6(F.when(half == 1, F.col("delta")), "second"))
    d = d.join(bootstrap_by(q), "config")
    parts = F.split("config", r"\|")
    return d.select(parts[0].alias("model"), parts[1].cast("double").alias("beta"), "recall", "delta", "first", "second", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "win")])


def sweep_prior(cands: DataFrame, weights: DataFrame, gold: DataFrame, lams: list[float], halves: DataFrame) -> DataFrame:
    """(lam, recall, delta, first, second, lo, hi, win, chosen): the prior at every strength against none, on all questions and
    on both halves (qid, half), with a bootstrap interval; `chosen` is the best on the first half, to be confirmed by the second."""
    one = [apply_prior(cands, weights, lam, 5).withColumn("qid", F.concat("qid", F.lit(f"#{lam:g}"))) for lam in lams]
    g = gold.withColumn("qid", F.explode(F.array(*[F.concat("qid", F.lit(f"#{lam:g}")) for lam in lams])))
    q = per_question(reduce(DataFrame.unionByName, one), g).select(F.split("qid", "#")[0].alias("qid"), F.element_at(F.split("qid", "#"), -1).cast("double").alias("config"), "recall")
    q = cut(q)
    base = q.filter(F.col("config") == lams[0]).select("qid", F.col("recall").alias("base"))
    q = q.join(base, "qid").withColumn("delta", F.col("recall") - F.col("base")).join(halves, "qid")
    r6 = lambda c, name: F.round(F.avg(c), 6).alias(name)
    d = q.groupBy("config").agg(r6("recall", "recall"), r6("delta", "delta"), r6(F.when(F.col("half") == 1, F.col("delta")), "first"), r6(F.when(F.col("half") == 2, F.col("delta")), "second"))
    d = cut(d.join(bootstrap_by(q.select("config", "qid", "delta")).drop("mean"), "config"))
    top = d.orderBy(F.col("first").desc(), "config").first()
    return d.select(F.col("config").alias("lam"), "recall", "delta", "first", "second", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "win")], (F.col("config") == F.lit(top["config"]) if top else F.lit(False)).alias("chosen"))


def sweep_rerank(pool: DataFrame, gold: DataFrame, weights: DataFrame, score: Callable[[DataFrame], DataFrame], alphas: list[float], betas: list[float], lams: list[float], p: Params = Params(), agg: str = "top2") -> DataFrame:
    """(alpha, beta, lam, recall, mrr): the model scores each candidate of any alpha once; `score` takes the distinct
    (qid, chunk_idx) and adds `ce`. Candidates without a score count as 0."""
    cands = cut(candidates_each(pool, alphas, p.n_docs, p.m_chunks))
    ce = score(cands.select("qid", "chunk_idx").distinct()).select("qid", "chunk_idx", "ce")
    d = cut(cands.join(ce, ["qid", "chunk_idx"], "left").fillna(0.0, ["ce"]).withColumn("qid", F.concat_ws("#", "qid", "cfg")))
    mixed = [blend(d, b).select(F.concat("qid", F.lit(f"|{b:g}")).alias("qid"), "doc_id", "chunk_idx", F.round("score", 9).alias("score")) for b in betas]
    docs = cut(rank_docs(reduce(DataFrame.unionByName, mixed), agg, p.n_docs))
    final = reduce(DataFrame.unionByName, [apply_prior(docs, weights, lam, 5).withColumn("qid", F.concat("qid", F.lit(f"|{lam:g}"))) for lam in lams])
    return measured(final, gold, {"alpha": "double", "beta": "double", "lam": "double"}, [f"{a:g}|{b:g}|{lam:g}" for a in alphas for b in betas for lam in lams])
