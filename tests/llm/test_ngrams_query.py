from lotusrank.llm import queries


def test_a_query_counts_up_to_three_terms(spark, tmp_path):
    spark.createDataFrame([("k1", "a b a b"), ("k2", "a b c")], "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["term"]: (r["n"], r["occurrences"], r["records"]) for r in queries.QUERIES["p5_ngrams"](spark, str(tmp_path)).collect()}
    assert got == {"a": (1, 3, 2), "b": (1, 3, 2), "c": (1, 1, 1), "a b": (2, 3, 2), "b a": (2, 1, 1), "b c": (2, 1, 1), "a b a": (3, 1, 1), "b a b": (3, 1, 1), "a b c": (3, 1, 1)}
