"""The best chunks of every question, found where the chunks lie."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotusrank.operators import aggregate, evaluate, index

SHAPE = "chunk_idx long, doc_id string, chunk_id string, tier int, path string, n_words int, text string"


def plain(scores, k):
    w = Window.partitionBy("qid").orderBy(F.col("bm25").desc(), F.col("chunk_idx"))
    return sorted(map(tuple, scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "chunk_idx", "doc_id", "bm25").collect()))


def rows(d):
    return sorted(map(tuple, d.select("qid", "rank", "chunk_idx", "doc_id", "bm25").collect()))


@pytest.fixture(scope="module")
def searched(spark):
    """One word stands often in few chunks of the sample, and once in many others."""
    inside = {r.id for r in spark.range(400).filter("pmod(xxhash64(id), 8) = 0").collect()}
    high = set(sorted(inside)[:25])
    text = lambda i: "thuế " * (9 if i in high else i % 3) + f"đất khác w{i % 7} x{i % 90}"
    df = spark.createDataFrame([(i, f"d{i % 40}", str(i), 1, "", 5, text(i)) for i in range(400)], SHAPE)
    q = spark.createDataFrame([("1", "thuế w3"), ("2", "w3 thuế"), ("3", "thuế"), ("4", "x5 lạ"), ("5", "lạ")], "qid string, question string")
    return index.Index.of(df), q


def test_rows_below_a_sampled_score_stay_where_they_are(spark, searched, monkeypatch):
    ix, q = searched
    want = {k: plain(index.bm25_scores(ix, q), k) for k in (3, 60)}
    assert {r[0] for r in want[60]} == {"1", "2", "3", "4"}
    monkeypatch.setattr(index, "SAMPLE", 50)
    for k in (3, 60):  # at 60 the sample expects too much of question 3, which is searched again
        assert rows(index.top_bm25(ix, q, k)) == want[k]


def test_questions_of_the_same_terms_are_scored_once(searched):
    ix, q = searched
    (asked, names), = index._numbered(ix, q)
    assert asked.n == 3 and names.select("qid").distinct().count() == 4


def test_many_questions_are_searched_in_groups(searched, monkeypatch):
    ix, q = searched
    want = plain(index.bm25_scores(ix, q), 20)
    monkeypatch.setattr(index, "ASKED_EVERYWHERE", 2)
    assert len(list(index._numbered(ix, q))) > 1 and rows(index.top_bm25(ix, q, 20)) == want


def test_an_index_is_a_row_per_chunk(spark, searched, tmp_path):
    df = spark.createDataFrame([(1, "a", "1", 1, "", 2, "thuế đất thuế"), (2, "a", "2", 1, "", 1, None), (3, "b", "3", 1, "", 1, "đất")], SHAPE)
    index.write_index(df, str(tmp_path / "i"))
    got = {r.chunk_idx: dict(zip(r.terms, r.tfs)) for r in spark.read.parquet(str(tmp_path / "i/forward")).collect()}
    assert got == {1: {"thuế": 2, "đất": 1}, 2: {}, 3: {"đất": 1}}


def test_the_grid_ranks_documents_where_their_chunks_lie(spark, searched):
    ix, q = searched
    grid = [(0.6, 0.4), (2.0, 0.9)]
    got = index.best(ix, q, grid, 20, docs=True)
    for c, (k1, b) in enumerate(grid):
        d, names = index.sums(ix, q, {"s": (k1, b)})
        d = d.join(names, "qno").join(ix.lengths, "chunk_idx").groupBy("qid", "doc_id").agg(F.max(F.struct("s", -F.col("chunk_idx"))).alias("m"))
        d = d.select("qid", (-F.col("m.col2")).alias("chunk_idx"), "doc_id", F.col("m.s").alias("bm25"))
        assert rows(got.filter(F.col("cno") == c).withColumnRenamed("score", "bm25")) == plain(d, 20)
    gold = spark.createDataFrame([("1", "d3")], "qid string, doc_id string")
    assert evaluate.sweep_bm25(ix, q, gold, [0.6], [0.4]).count() == 1


def test_documents_are_ranked_where_the_pool_has_met(spark, searched, monkeypatch):
    ix, q = searched
    shape = ["qid", "rank", "doc_id", "score", "best_chunk", "n_chunks"]
    got = lambda agg, k: sorted(map(tuple, index.top_docs(ix, q, k, agg, 4).select(*shape).collect()))
    want = {(a, k): sorted(map(tuple, aggregate.rank_docs(index.top_chunks(index.bm25_scores(ix, q), k), a, 4, "bm25", ix.doc_sizes()).select(*shape).collect()))
            for a in ("avg", "top3", "max+0.4", "top3_log") for k in (3, 60)}
    plan = index.top_docs(ix, q, 60, "avg", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the chunks move once
    assert all(got(*x) == want[x] for x in want)
    monkeypatch.setattr(index, "SAMPLE", 50)  # some questions are searched again
    assert all(got(*x) == want[x] for x in want)


def test_only_repeated_chunks_are_moved(spark):
    row = lambda i, text: (i, "d", str(i), 1, "", 1, text)
    moved = lambda d: d._jdf.queryExecution().executedPlan().toString().count("REPARTITION")
    once = index.distinct_chunks(spark.createDataFrame([row(i, f"t{i}") for i in range(40)], SHAPE))
    assert once.count() == 40 and not moved(once)
    some = index.distinct_chunks(spark.createDataFrame([row(i % 38, f"t{i % 38}") for i in range(40)] + [row(None, "n")] * 2, SHAPE))
    assert sorted((r.chunk_idx is not None, r.chunk_idx, r.text) for r in some.collect() if r.chunk_idx is not None) == sorted((True, i, f"t{i}") for i in range(38))
    assert some.count() == 39 and "left_anti" in some._jdf.queryExecution().executedPlan().toString().lower().replace("leftanti", "left_anti")


def test_a_sample_gives_few_scores_and_rows_are_sorted_once(spark, searched, monkeypatch):
    ix, q = searched
    (asked, names), = index._numbered(ix, q)
    sent = spark.sparkContext.broadcast(asked)
    own = {r.bno: r.qid for r in names.collect()}
    want = {}
    for r in index.bm25_scores(ix, q).collect():
        want.setdefault(r.qid, []).append(r.bm25)
    p = index.Params()
    for nth in (1, 80):
        each = index._of_a_task(nth)
        tops = index.cut(ix.forward.repartition(index.SAMPLE_TASKS).mapInArrow(index._tops(sent, p.k1, p.b, (ix.n, ix.avgdl), each), "bno int, top array<double>"))
        assert tops.filter(F.size("top") > each).count() == 0 and each <= nth
        got = {own[r.bno]: r.score for r in index._edges(tops, nth).collect()}
        assert all(s <= sorted(want[k])[-nth] + 1e-6 for k, s in got.items())  # never above
        if nth == 1:
            assert got == {k: max(v) for k, v in want.items() if k in got}
    monkeypatch.setattr(index, "SAMPLE", 50)
    plans, cut = [], index.cut
    monkeypatch.setattr(index, "cut", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    index.top_bm25(ix, q, 3)
    assert len(plans) == 1 and "Sort" in plans[0] and "Sort" not in plans[0].split("Exchange hashpartitioning")[1]
