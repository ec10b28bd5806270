import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lotusrank.llm import fuse, termfreq, topn


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_top_n_matches_brute_force_with_ties_nulls_and_repeats(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([f"i{k}" for k in range(40)] + [None, "", "  "]), rnd.choice([1.0, 2.0, 3.0, float("nan"), None]), k % 3) for k in range(900)]
    df = spark.createDataFrame(data + data[:50], "g string, item string, s double, __salt int")
    got = rows(topn.top_n(df, "g", "item", "s", 4, salts=5))
    best = defaultdict(dict)
    for g, i, s, _ in data:
        if g is not None and i and i.strip() and s is not None and not math.isnan(s):
            best[g][i] = max(s, best[g].get(i, -9))
    want = sorted((g, i, s, r + 1) for g, m in best.items() for r, (i, s) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:4]))
    assert got == want


def test_top_n_of_an_empty_table_and_of_a_submission(spark):
    assert rows(topn.top_n(spark.createDataFrame([], "g string, item string, s double"), "g", "item", "s", 3)) == []
    sub = spark.createDataFrame([("q", ["x", "y", "x", None, " "], [1.0, 2.0, 5.0, 9.0, 9.0]), ("q", None, None), ("r", [], []), ("q", ["z"], [5.0])], "qid string, answer array<string>, score array<double>")
    assert rows(topn.best_answers(sub)) == [("q", "x", 5.0, 1), ("q", "y", 2.0, 3), ("q", "z", 5.0, 2)]


def test_found_breaks_ties_by_chunk_ordinal(spark):
    ch = spark.createDataFrame([("d", f"d#{i}", i, 1.0) for i in (9, 3, 7, 5)] + [("d", "d#3", 3, 1.0), ("d", "d#1", 1, float("nan")), ("e", "e#0", 0, None)], "doc_id string, chunk_id string, chunk_idx long, bm25 double")
    sub = spark.createDataFrame([], "qid string, answer array<string>, score array<double>")
    assert rows(topn.found(sub, ch)) == [("document", "d", "d#3"), ("document", "d", "d#5"), ("document", "d", "d#7")]


def test_fusion_is_blind_to_scale_and_fills_gaps(spark):
    data = [("q", i, float(i), i * 1000.0) for i in range(6)] + [("q", 6, None, float("nan")), ("c", 1, 5.0, 1.0), ("c", 2, 5.0, 1.0), (None, 3, 1.0, 1.0), ("q", 0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "qid string, chunk_idx long, a double, b double")
    got = {(r.qid, r.chunk_idx): r.position for r in fuse.fuse(df, "qid", "chunk_idx", {"a": 1, "b": 1}).collect()}
    assert [got["q", i] for i in range(6)] == [7, 6, 5, 3, 2, 1] and got["q", 6] == 4
    assert (got["c", 1], got["c", 2]) == (1, 2) and len(got) == 9


def test_fusion_matches_numpy(spark):
    rnd = random.Random(3)
    data = [(f"q{k % 4}", k, round(rnd.gauss(0, 1), 1), rnd.choice([None, round(rnd.gauss(0, 99), 0)])) for k in range(300)]
    df = spark.createDataFrame(data, "qid string, chunk_idx long, a double, b double").repartition(7)
    got = {(r.qid, r.chunk_idx): (r.projection, r.position) for r in fuse.fuse(df, "qid", "chunk_idx", {"a": 1, "b": -1}).collect()}
    ranks = {}
    for q in {d[0] for d in data}:
        for c in (2, 3):
            v = sorted(d[c] for d in data if d[0] == q and d[c] is not None)
            for d in data:
                if d[0] == q:
                    ranks[q, d[1], c] = 0.5 if d[c] is None else (v.index(d[c]) + (v.count(d[c]) + 1) / 2) / (len(v) + 1)
    z = {}
    for c in (2, 3):
        x = np.array([ranks[d[0], d[1], c] for d in data])
        z[c] = (x - x.mean()) / x.std()
    proj = (z[2] - z[3]) / math.sqrt(2)
    for d, p in zip(data, proj):
        assert got[d[0], d[1]][0] == pytest.approx(p, abs=1e-8)
    for q in {d[0] for d in data}:
        order = sorted(((-round(p, 9), d[1]) for d, p in zip(data, proj) if d[0] == q))
        assert [i for _, i in order] == [i for i, _ in sorted(((k[1], v[1]) for k, v in got.items() if k[0] == q), key=lambda x: x[1])]


def test_three_scores_of_which_one_disagrees(spark):
    """The projection is the first principal component of the rank-transformed scores, turned to the side of most weight."""
    rnd = random.Random(7)
    data = []
    for k in range(200):
        x = rnd.gauss(0, 1)
        data.append(("q", k, x + rnd.gauss(0, 0.3), 1000 * x + rnd.gauss(0, 500), -x + rnd.gauss(0, 0.8)))
    got = {r.chunk_idx: r.projection for r in fuse.fuse(spark.createDataFrame(data, "qid string, chunk_idx long, a double, b double, c double"), "qid", "chunk_idx", {"a": 1, "b": 1, "c": 1}).collect()}
    ranks = np.column_stack([np.argsort(np.argsort([d[c] for d in data])) for c in (2, 3, 4)]) + 1.0
    z = (ranks - ranks.mean(axis=0)) / ranks.std(axis=0)
    load = np.linalg.eigh(np.corrcoef(z.T))[1][:, -1]
    load *= np.sign(load.sum())
    assert load[2] < 0 < load[0] and np.allclose([got[d[1]] for d in data], z @ load, atol=1e-6)


def test_components_take_declared_signs():
    assert fuse.first_component(np.array([[1, 0.8, -0.5], [0.8, 1, -0.5], [-0.5, -0.5, 1]]), [1, 1, -1]) == pytest.approx([0.6108, 0.6108, -0.5038], abs=1e-4)
    assert fuse.first_component(np.array([[1, -0.8], [-0.8, 1]]), [1, 1]) == pytest.approx([math.sqrt(0.5)] * 2)
    assert fuse.first_component(np.eye(2), [1, -1]) == pytest.approx([math.sqrt(0.5), -math.sqrt(0.5)])
    assert fuse.first_component(np.array([[1, np.nan], [np.nan, np.nan]]), [1, 1]) == pytest.approx([1, 0])


def brute(texts, sigma):
    cf, df = Counter(), Counter()
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        grams = [" ".join(w[i:i + n]) for n in range(1, sigma + 1) for i in range(len(w) - n + 1)]
        cf.update(grams)
        df.update(set(grams))
    return sorted((g, len(g.split()), cf[g], df[g]) for g in cf)


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_ngram_counts_match_brute_force(spark, sigma):
    rnd = random.Random(sigma)
    texts = [" ".join(rnd.choice(["a", "B", "c_1", "đất", "của", "x-y"]) for _ in range(rnd.randint(0, 30))) for _ in range(200)] + [None, "", "!!"]
    df = spark.createDataFrame([(f"k{i}", t, i) for i, t in enumerate(texts)] + [("k0", texts[0], 5), (None, "zzz", 1)], "chunk_id string, text string, term int").repartition(5)
    assert rows(termfreq.ngram_counts(df, "chunk_id", "text", sigma)) == brute(texts, sigma)


def test_marks(spark):
    df = spark.createDataFrame([(f"k{i}", "chung " + ("b" if i < 3 else "") + (" riêng" if i == 9 else "")) for i in range(10)] + [("n", None)], "chunk_id string, text string")
    assert rows(termfreq.found(df)) == [("chung", "common"), ("riêng", "rare")]
    assert rows(termfreq.found(spark.createDataFrame([], "chunk_id string, text string"))) == []
