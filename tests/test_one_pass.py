"""Every ranking of a pool comes from one move of its rows, and is that of the plans that move them once a ranking."""

import random

import pytest
from pyspark.sql import functions as F

from lotusrank.operators import evaluate, fusion, rerank
from lotusrank.operators.aggregate import rank_docs


@pytest.fixture(scope="module")
def pool(spark):
    """Scores with many ties, a missing document and cosines below 0."""
    r = random.Random(5)
    rows = [(f"q{q}", c, None if c % 17 == 0 else f"d{r.randrange(12)}", float(r.randrange(1, 9)), r.randrange(-4, 5) / 4) for q in range(6) for c in r.sample(range(300), 90)]
    return spark.createDataFrame(rows, "qid string, chunk_idx long, doc_id string, bm25 double, dense double").repartition(5).cache()


def rows(d):
    return sorted((tuple(r) for r in d.collect()), key=repr)


def shuffles(d) -> int:
    d.collect()
    return d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


@pytest.mark.parametrize("how, alpha, agg", [("linear", 0.7, "top3"), ("rrf", 0.7, "top2"), ("dense", 0.7, "max+0.4"), ("bm25", 0.7, "avg"), ("linear", 0.0, "max")])
def test_a_ranking_is_that_of_its_own_plan(pool, how, alpha, agg):
    got = evaluate.best_docs(pool, [evaluate.Ranking("", how, alpha, agg)], 7)
    assert rows(got) == rows(rank_docs(fusion.fuse(pool, how, alpha), agg, 7, "fused").select("qid", "rank", "doc_id"))


def test_fusions_move_the_pool_once(spark, pool):
    gold = spark.createDataFrame([(f"q{q}", f"d{q}") for q in range(6)], "qid string, doc_id string")
    got = {r.config: (r.recall, r.mrr) for r in evaluate.compare_fusions(pool, gold, ("linear", "rrf"), 0.7, "top3").collect()}
    for f, x in got.items():
        own = evaluate.metrics(rank_docs(fusion.fuse(pool, f, 0.7), "top3", 20, "fused"), gold).first()
        assert x == (own.recall, own.mrr)
    assert shuffles(evaluate.best_docs(pool, [evaluate.Ranking(f, f, 0.7, "top3") for f in ("linear", "rrf", "dense", "bm25")])) == 1


def test_vectors_are_compared_without_a_move_per_alpha(spark, pool):
    gold = spark.createDataFrame([(f"q{q}", f"d{q}") for q in range(6)], "qid string, doc_id string")
    other = pool.withColumn("dense", -F.col("dense"))
    got = {(r.vectors, r.alpha): (r.recall, r.mrr) for r in evaluate.compare_vectors({"a": pool, "b": other}, gold, [0.0, 0.5, 1.0]).collect()}
    for (name, a), x in got.items():
        own = evaluate.metrics(rank_docs(fusion.fuse(pool if name == "a" else other, "linear", a), "top2", 20, "fused"), gold).first()
        assert x == (own.recall, own.mrr)
    assert len(got) == 6


def test_candidates_of_all_alphas_move_the_pool_once(pool):
    got = evaluate.candidates_each(pool, [0.2, 0.8], 4, 2)
    for a in (0.2, 0.8):
        want = rerank.candidate_cut(fusion.fuse(pool, "linear", a), 4, 2).select("qid", "doc_id", "chunk_idx", "fused")
        assert rows(got.filter(F.col("cfg") == f"{a:g}").drop("cfg")) == rows(want)
    assert shuffles(got) == 1


def test_products_are_cosines_of_the_vectors_there_are(spark):
    p = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)], "qid string, chunk_idx long, bm25 double")
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "chunk_idx long, v array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-4.0, 3.0])], "qid string, q array<float>")
    got = {(r.qid, r.chunk_idx): r.x for r in fusion.products(p, v, q, {"x": ("v", "q")}, 5, cosine=True).collect()}
    assert got == {("a", 1): 0.6, ("a", 2): 0.0, ("a", 3): 0.0, ("b", 1): 0.0, ("c", 1): 0.0}
    assert {r.x for r in fusion.products(p, v, q, {"x": ("v", "q")}, 5).filter("qid = 'a' and chunk_idx = 1").collect()} == {3.0}
