"""What is moved between tasks: rankings and the chunks they keep, not whole pools and texts once more."""

import pytest
from pyspark.sql import functions as F

from lotusrank.functions.text import tokens
from lotusrank.operators import encode, index, mining, rerank
from lotusrank.plans import queries as Q


def plan(d) -> str:
    d.collect()
    return d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def unsized(spark):
    """Joins as with large tables: only what is named small goes everywhere."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, old)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 chunks of 20 documents, one of them twice; three labelled questions, one without words."""
    d = str(tmp_path_factory.mktemp("moved"))
    text = F.concat(F.lit("Thuế đất "), F.expr("repeat('x ', cast(id % 7 as int))"), F.when(F.col("id") % 3 == 0, "nhà ở").otherwise("rừng"))
    c = spark.range(60).select(F.col("id").alias("chunk_idx"), F.concat(F.lit("d"), F.col("id") % 20).alias("doc_id"), F.col("id").cast("string").alias("chunk_id"), F.lit("doc").alias("tier"), F.lit("").alias("path"), F.lit(5).alias("n_words"), text.alias("text"))
    c.unionByName(c.limit(1)).write.parquet(f"{d}/chunks.parquet")
    spark.createDataFrame([("100", "thuế nhà ở thuế", ["d0"]), ("200", "Rừng x", ["d1", "d2"]), ("300", "?", ["d3"])], "qid string, question string, answer array<string>").write.parquet(f"{d}/train.parquet")
    spark.createDataFrame([("1", "x")], "qid string, question string").write.parquet(f"{d}/public_official.parquet")
    spark.createDataFrame([(i, [1.0, i / 100]) for i in range(60)], "chunk_idx long, dense array<float>").write.parquet(f"{d}/emb.parquet")
    return d


def test_rows_of_a_grid_meet_once(spark, folder):
    ix = index.Index.of(Q.chunks(spark, folder))
    assert plan(index.best(ix, Q.asked(spark, folder), [(1.2, 0.75), (2.0, 0.9)], 3, docs=True)).count("Exchange hashpartitioning") == 1


def test_scores_come_from_the_words_of_the_index(spark, folder):
    p, _, _ = Q.evaluated(spark, folder)
    got = Q.asked_scored(spark, folder, p)
    texts = Q.chunks(spark, folder).select("chunk_idx", "text").join(got, "chunk_idx").join(Q.asked(spark, folder), "qid")
    for r in texts.withColumn("want", rerank.overlap_score()).withColumn("n", F.size(F.array_distinct(tokens(F.col("text"))))).collect():
        assert (r.ce, r.words) == (r.want, r.n)
    assert texts.count() == got.count() > 0 and "text#" not in plan(got)


def test_only_chosen_texts_move(unsized):
    ch = unsized.createDataFrame([(i, f"t{i}") for i in range(6)] + [(0, "t0"), (3, "t3")], "chunk_idx long, text string")
    pos = unsized.createDataFrame([("q", 0), ("z", 5)], "qid string, chunk_idx long")
    neg = unsized.createDataFrame([("q", 2, 4), ("q", 1, 3), ("n", 1, 1)], "qid string, neg_no int, chunk_idx long")
    got = mining.pairs(unsized.createDataFrame([(x, "hỏi") for x in "qzn"], "qid string, question string"), pos, neg, ch)
    assert [tuple(r) for r in got.collect()] == [("q", "hỏi", "t0", ["t3", "t4"])]
    assert plan(got).count("SortMergeJoin") == 1  # the questions


def test_labels_go_to_the_pool(unsized, folder):
    for name in ("mined_positives", "mined_negatives"):
        assert "LeftSemi" not in "".join(x for x in plan(Q.QUERIES[name](unsized, folder)).splitlines() if "SortMergeJoin" in x)
        assert "LeftAnti" not in "".join(x for x in plan(Q.QUERIES[name](unsized, folder)).splitlines() if "SortMergeJoin" in x)


def test_encoders_are_screened_by_columns(spark, folder):
    c = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.1), ("q", "c", 3, None)], "qid string, doc_id string, chunk_idx long, m double")
    g = spark.createDataFrame([("q", "a")], "qid string, doc_id string")
    assert [tuple(r) for r in encode.screen(c, g, {"m": None}).collect()] == [("m", 1.0, 1.0)]
    assert {r.encoder for r in Q.QUERIES["encoder_screen"](spark, folder).collect()} == {"hashed32", "hashed256"}
