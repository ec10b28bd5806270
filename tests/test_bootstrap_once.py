"""All configs see the same resamples, and a resample's digest is made once for them."""

from pyspark.sql import functions as F

from lotusrank.operators import evaluate


def test_one_digest_serves_all_configs(spark):
    d = spark.createDataFrame([(c, f"q{i}", (i - 5) * c / 10) for c in (1.0, 2.0) for i in range(12)], "config double, qid string, delta double")
    got = evaluate.bootstrap_by(d, 200)
    each = {c: evaluate.bootstrap_by(d.filter(F.col("config") == c), 200).first() for c in (1.0, 2.0)}
    assert {r.config: tuple(r) for r in got.collect()} == {c: tuple(r) for c, r in each.items()}
    # questions are put together before they are resampled
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()
