import random

import pytest
from pyspark.sql import functions as F

from lotusrank.operators import aggregate, evaluate, fusion, prior, rerank
from lotusrank.params import Params


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(4)
    rows = [(f"q{q}", i, f"d{rnd.randint(0, 14)}", rnd.random() * 9 + 0.1, rnd.random()) for q in range(3) for i in range(40)]
    pool = spark.createDataFrame(rows, "qid string, chunk_idx long, doc_id string, bm25 double, dense double")
    return pool, spark.createDataFrame([(f"q{q}", f"d{d}") for q in range(3) for d in (q, q + 5)], "qid string, doc_id string")


def test_pool_grid_equals_each_pool_by_itself(spark, data):
    pool, gold = data
    got = {(r.pool, r.alpha): (r.recall, r.mrr) for r in evaluate.sweep_pool(pool, gold, [10, 40], [0.0, 0.5], ["top2"]).collect()}
    assert len(got) == 4
    small = fusion.scored_pool(pool, 10)
    r = evaluate.metrics(aggregate.rank_docs(fusion.fuse(small, "linear", 0.5), "top2", 20, "fused"), gold).first()
    assert got[10, 0.5] == (r.recall, r.mrr)


def test_rerank_grid_scores_the_union_once(spark, data):
    pool, gold = data
    weights, p, seen = spark.createDataFrame([("d1", 1.0), ("d6", 0.5)], "doc_id string, w double"), Params(n_docs=6, m_chunks=2), []

    def score(c):
        seen.append(c.count())
        return c.withColumn("ce", (F.col("chunk_idx") * 7 % 11).cast("double"))
    got = {(r.alpha, r.beta, r.lam): (r.recall, r.mrr) for r in evaluate.sweep_rerank(pool, gold, weights, score, [0.2, 0.8], [0.5, 1.0], [0.0, 0.4], p).collect()}
    cut = {a: rerank.candidate_cut(fusion.fuse(pool, "linear", a), 6, 2) for a in (0.2, 0.8)}
    assert len(got) == 8 and seen == [cut[0.2].select("qid", "chunk_idx").union(cut[0.8].select("qid", "chunk_idx")).distinct().count()]
    for a, b, lam in got:
        docs = rerank.rerank_docs(cut[a].withColumn("ce", (F.col("chunk_idx") * 7 % 11).cast("double")), b, "top2", 6)
        r = evaluate.metrics(prior.apply_prior(docs, weights, lam, 5), gold).first()
        assert got[a, b, lam] == (r.recall, r.mrr)
