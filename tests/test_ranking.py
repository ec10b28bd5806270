import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lotusrank.operators import aggregate, encode, evaluate, fusion, index, mining, prior, rerank
from lotusrank.params import Params, parse_agg


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    words = ["đất", "thuế", "phép", "lao", "động", "hợp", "đồng", "của", "xã", "ủy"]
    rows = [(i, f"d{i % 7}", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8))) + (" hiếm" if i == 3 else "")) for i in range(60)]
    return spark.createDataFrame(rows, "chunk_idx long, doc_id string, text string"), rows


def test_bm25_equals_a_plain_loop(spark, corpus):
    df, rows = corpus
    q = spark.createDataFrame([("q1", "thuế đất thuế hiếm lạ"), ("q2", ""), ("q3", None)], "qid string, question string")
    p = Params(k1=1.5, b=0.75)
    toks = {i: re.findall(r"\w+", t.lower()) for i, _, t in rows}
    n, avg = len(rows), sum(map(len, toks.values())) / len(rows)
    dfreq = Counter(w for t in toks.values() for w in set(t))
    want = {}
    for i, t in toks.items():
        s = 0.0
        for w in "thuế đất thuế hiếm lạ".split():
            if 2 <= dfreq[w] <= int(n * 0.7) and w in t:
                tf = t.count(w)
                s += math.log(1 + (n - dfreq[w] + 0.5) / (dfreq[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want[i] = round(s, 6)
    got = {r.chunk_idx: r.bm25 for r in index.bm25_scores(df, q, p).collect()}
    assert got == pytest.approx(want, abs=2e-6) and want
    assert "hiếm" not in {r.term for r in index.vocabulary(df).collect()}


@pytest.mark.parametrize("agg", ["max", "avg", "top2", "top3", "max+0.4", "top3_log"])
def test_aggregates(spark, agg):
    rnd = random.Random(3)
    rows = [("q", i, f"d{rnd.randint(0, 4)}", rnd.choice([0.5, 1.0, 2.0])) for i in range(30)]
    df = spark.createDataFrame(rows, "qid string, chunk_idx long, doc_id string, score double")
    sizes = aggregate.doc_sizes(df)
    by = defaultdict(list)
    for _, i, d, s in rows:
        by[d].append((-s, i))
    kind, x = parse_agg(agg)
    def value(v):
        v = [-s for s, _ in sorted(v)]
        return {"max": v[0], "avg": sum(v) / len(v), "max+": v[0] + x * (v[1] if len(v) > 1 else 0)}.get(kind) if kind in ("max", "avg", "max+") else sum(v[:int(x)]) / len(v[:int(x)]) / (math.log1p(len(v)) if kind == "top3_log" else 1)
    want = sorted(((-round(value(v), 6), sorted(v)[0], d) for d, v in by.items()))[:3]
    got = [(r.doc_id, r.best_chunk, r.n_chunks) for r in sorted(aggregate.rank_docs(df, agg, 3, "score", sizes).collect(), key=lambda r: r.rank)]
    assert got == [(d, b[1], len(by[d])) for _, b, d in want]


@pytest.mark.parametrize("bad", ["median", "top0", "max-1", ""])
def test_unknown_aggregates_raise(bad):
    with pytest.raises(ValueError):
        parse_agg(bad)
    with pytest.raises(ValueError):
        Params(agg=bad)


def pool(spark, rows):
    return spark.createDataFrame(rows, "qid string, chunk_idx long, doc_id string, bm25 double, dense double")


def test_fusion_limits_and_order(spark):
    rnd = random.Random(5)
    p = pool(spark, [("q", i, f"d{i % 5}", rnd.random() * 50, rnd.random()) for i in range(25)] + [("c", i, "d", 3.0, 3.0) for i in range(3)])
    for alpha, col in ((1.0, "dense"), (0.0, "bm25")):
        f = [r for r in fusion.fuse(p, "linear", alpha).collect() if r.qid == "q"]
        assert sorted(f, key=lambda r: -r.fused) == sorted(f, key=lambda r: -r[col]) and all(0 <= r.fused <= 1 for r in f)
    assert all(r.fused == 0 for r in fusion.fuse(p).collect() if r.qid == "c")
    rrf = {r.chunk_idx: r.fused for r in fusion.fuse(p, "rrf").collect() if r.qid == "c"}
    assert rrf == pytest.approx({i: 2 / (61 + i) for i in range(3)}, abs=1e-8)
    with pytest.raises(ValueError):
        fusion.fuse(p, "sum")


def walk(rows, n_docs, m):
    seen, out = Counter(), []
    for s, i, d in sorted((-s, i, d) for _, i, d, s in rows):
        if d not in seen and len(seen) == n_docs:
            break
        seen[d] += 1
        if seen[d] <= m:
            out.append(i)
    return out


def test_candidate_cut_equals_the_walk(spark):
    rnd = random.Random(7)
    for n_docs, m in ((1, 1), (3, 2), (50, 1)):
        rows = [("q", i, f"d{rnd.randint(0, 6)}", rnd.choice([1.0, 2.0, 3.0, 4.0])) for i in range(30)]
        df = spark.createDataFrame(rows, "qid string, chunk_idx long, doc_id string, fused double")
        got = [r.chunk_idx for r in sorted(rerank.candidate_cut(df, n_docs, m).collect(), key=lambda r: r.rn)]
        assert got == walk(rows, n_docs, m)


def test_blend_ensemble_and_model_plug_in(spark):
    df = spark.createDataFrame([("q", 1, "a", 1.0, "đất đai", "đất"), ("q", 2, "b", 0.0, "đất đai", "đất đai nhà")], "qid string, chunk_idx long, doc_id string, fused double, question string, text string")
    d = df.withColumn("ce", rerank.overlap_score())
    assert [r.ce for r in d.orderBy("chunk_idx").collect()] == [0.5, 1.0]
    assert {r.chunk_idx: r.score for r in rerank.blend(d, 0.5).collect()} == {1: 0.5, 2: 0.5}
    assert [r.doc_id for r in rerank.rerank_docs(d, 1.0, "max").orderBy("rank").collect()] == ["b", "a"]
    def lengths(q, t):
        return (t.str.len() - q.str.len()).astype(float)
    assert {r.chunk_idx: r.m for r in rerank.score_pairs(df, lengths, out="m").collect()} == {1: -4.0, 2: 4.0}
    e = d.select("qid", "chunk_idx", F.lit("a").alias("model"), F.col("ce").alias("score"))
    assert {r.chunk_idx: r.ce for r in rerank.ensemble(e.union(e.withColumn("score", F.lit(0.0)))).collect()} == {1: 0.25, 2: 0.5}


def test_prior_and_padding(spark):
    train = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "a"]), ("3", None), ("9", ["z"]), ("1", ["a", "b"])], "qid string, answer array<string>")
    ex = spark.createDataFrame([("9",)], "qid string")
    w = {r.doc_id: (r.freq, r.w) for r in prior.prior_weights(train, ex).collect()}
    assert w["a"] == (3, 1.0) and w["b"] == (1, pytest.approx(math.log(2) / math.log(4))) and "z" not in w
    c = spark.createDataFrame([("q", "b", 1.0), ("q", "c", 2.0), ("k", "x", 3.0)], "qid string, doc_id string, score double")
    got = {(r.qid, r.rank): (r.doc_id, r.score) for r in prior.apply_prior(c, prior.prior_weights(train, ex), 4.0, 1).collect()}
    assert got == {("q", 1): ("b", 2.0), ("k", 1): ("x", 0.0)}
    r = prior.apply_prior(c, prior.prior_weights(train), 0.0)
    q = spark.createDataFrame([("q",), ("n",)], "qid string")
    p = prior.pad(r.filter("qid = 'q'"), q, prior.fallback(train), 3).collect()
    assert sorted((x.qid, x.rank, x.doc_id, x.padded) for x in p) == [("n", 1, "a", True), ("n", 2, "b", True), ("n", 3, "z", True), ("q", 1, "c", False), ("q", 2, "b", False), ("q", 3, "a", True)]
    assert {x.qid: x.answer for x in prior.answers(spark.createDataFrame(p)).collect()}["q"] == ["c", "b", "a"]
    assert [x.qid for x in prior.changed(r.filter("rank = 1"), r).collect()] == ["q"]


def test_metrics(spark):
    ranked = spark.createDataFrame([("1", r, f"d{r}") for r in range(1, 9)] + [("2", 1, "x")], "qid string, rank int, doc_id string")
    gold = spark.createDataFrame([("1", "d2"), ("1", "d7"), ("2", "y"), ("3", "z")], "qid string, doc_id string")
    m = {r.qid: (r.recall, r.precision, r.hit, r.rr) for r in evaluate.per_question(ranked, gold).collect()}
    assert m == {"1": (0.5, 0.2, 1, 0.5), "2": (0.0, 0.0, 0, 0.0), "3": (0.0, 0.0, 0, 0.0)}
    assert {r.bucket: r.questions for r in evaluate.rank_histogram(ranked, gold).collect()} == {"2-3": 1, "miss": 2}
    assert evaluate.ceiling(ranked, gold).first().ceiling == pytest.approx(1 / 3, abs=1e-6)


def test_auc_is_exact(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 1), rnd.choice([0.1, 0.2, 0.3, 0.4])) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auc(spark.createDataFrame(rows, "label int, score double")).first().auc == pytest.approx(want, abs=1e-8)


def test_bootstrap_is_stable_and_covers_the_mean(spark):
    rnd = random.Random(2)
    d = spark.createDataFrame([(str(i), rnd.gauss(0.1, 1)) for i in range(300)], "qid string, delta double")
    a, b = evaluate.bootstrap(d, 1000).first(), evaluate.bootstrap(d.repartition(7), 1000).first()
    assert a == pytest.approx(b) and a.lo < a["mean"] < a.hi and a.hi - a.lo == pytest.approx(4 / math.sqrt(300), rel=0.15)


def test_half_split(spark):
    r = spark.createDataFrame([(str(i), c, float(i % 2 == c)) for i in range(8) for c in (0, 1)], "qid string, config int, value double")
    h = spark.createDataFrame([(str(i), 1 if i % 2 else 2) for i in range(8)], "qid string, half int")
    assert {x.config: (x.first, x.second, x.chosen) for x in evaluate.half_split(r, h).collect()} == {0: (0.0, 1.0, False), 1: (1.0, 0.0, True)}


def test_mining(spark):
    f = spark.createDataFrame([("q", i, f"d{i // 2}", 10.0 - i) for i in range(12)] + [("z", 50, "d0", 1.0)], "qid string, chunk_idx long, doc_id string, fused double")
    g = spark.createDataFrame([("q", "d2"), ("z", "d9"), ("n", "d404")], "qid string, doc_id string")
    ch = spark.createDataFrame([(i, f"d{i // 2}", f"t{i}") for i in range(20)], "chunk_idx long, doc_id string, text string")
    pos, neg = mining.positives(f, g, ch), mining.negatives(f, g, 2, 10, 2)
    assert {r.qid: r.chunk_idx for r in pos.collect()} == {"q": 4, "z": 18}
    assert sorted((r.qid, r.neg_no, r.chunk_idx) for r in neg.collect()) == [("q", 1, 2), ("q", 2, 6)]
    p = mining.pairs(spark.createDataFrame([("q", "hỏi"), ("z", "hỏi")], "qid string, question string"), pos, neg, ch)
    assert [tuple(r) for r in p.collect()] == [("q", "hỏi", "t4", ["t2", "t6"])]
    assert mining.biencoder_rows(p, 2).first().negative_2 == "t6" and mining.biencoder_rows(p, 3).count() == 0
    assert sorted((r.text, r.label) for r in mining.crossencoder_rows(p, 1).collect()) == [("t2", 0), ("t4", 1)]
    ce = spark.createDataFrame([("q", 5, 0.9), ("q", 4, 0.1)], "qid string, chunk_idx long, ce double")
    assert [tuple(r) for r in mining.positives_by_model(f, g, ce).collect()] == [("q", 5)]
    s = mining.split(f.select("qid").union(g.select("qid")), 1)
    assert sorted(r.fold for r in s.collect()) == ["train", "train", "val"]


def test_encoder_plug_in(spark, tmp_path):
    df = spark.createDataFrame([(1, "một hai"), (2, None), (3, "hai một")], "chunk_idx long, text string")
    e = {r.chunk_idx: r.embedding for r in encode.encode(df, "chunk_idx", "text", encode.hashed(16), dims=8).collect()}
    assert e[1] == e[3] and len(e[1]) == 8 and sum(e[2]) == 0
    assert encode.pooling_of({}) == ("mean", None) and encode.pooling_of({"pooling_mode": "mean", "pooling_mode_cls_token": True}) == ("mean", None)
    assert encode.EncoderMeta.of_model(str(tmp_path)) == encode.EncoderMeta(tmp_path.name, 0, "mean")
    (tmp_path / "1_Pooling").mkdir()
    (tmp_path / "1_Pooling/config.json").write_text('{"pooling_mode_cls_token": true, "word_embedding_dimension": 8}')
    assert encode.EncoderMeta.of_model(str(tmp_path)) == encode.EncoderMeta(tmp_path.name, 8, "cls")
    with pytest.raises(ValueError):
        encode.EncoderMeta("a", 8).check(encode.EncoderMeta("b", 8))
    x = df.filter("chunk_idx = 1").select(encode.yes_no_prompt("pair", F.lit("q"), F.col("text"), 1).alias("p"), encode.yes_probability(F.lit(0.0), F.lit(0.0)).alias("y")).first()
    assert x.p.startswith("A: q\nB: một\nGiven") and x.y == pytest.approx(-math.log(2))
    c = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, doc_id string, chunk_idx long")
    g = spark.createDataFrame([("q", "a")], "qid string, doc_id string")
    s = spark.createDataFrame([("q", 1, 0.9)], "qid string, chunk_idx long, score double")
    assert [tuple(r) for r in encode.screen(c, g, {"m": s, "w": s.withColumn("score", -F.col("score"))}).collect()] == [("m", 1.0, 1.0), ("w", 0.0, 1.0)]


def test_a_stored_index_scores_like_one_built_at_once(spark, corpus, tmp_path):
    df, _ = corpus
    df = df.unionByName(spark.createDataFrame([(99, "d9", None)], df.schema))
    q = spark.createDataFrame([("q1", "thuế đất lạ"), ("q2", "hợp đồng lao động")], "qid string, question string")
    index.write_index(df, str(tmp_path / "i"))
    ix = index.Index.read(spark, str(tmp_path / "i"))
    assert ix.n == 61 and ix.lengths.filter("chunk_idx = 99").first().doclen == 0 and not (tmp_path / "i/counts").exists()
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(index.bm25_scores(ix, q)) == rows(index.bm25_scores(df, q)) and rows(ix.doc_sizes()) == rows(aggregate.doc_sizes(df))
    # few asked terms are part of the scan
    plan = index.matched(ix, q)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan
    assert rows(index.hit_terms(ix, q)) == [("q1", "thuế"), ("q1", "đất"), ("q2", "hợp"), ("q2", "lao"), ("q2", "đồng"), ("q2", "động")]
    assert index.bm25_scores(df.limit(0), q).count() == 0


def test_texts_are_cut_to_the_tokens_a_model_takes(spark):
    tok, dec = (lambda t: [ord(c) for c in t]), (lambda ids: "".join(map(chr, ids)))
    assert encode.fit_to(tok, dec, 3)("abcd") == "abc" and encode.fit_to(tok, dec, 4)("abcd") == "abcd"
    seen = []

    def logits(prompts):
        seen.extend(prompts)
        import numpy as np
        return np.array([[0.0, float(len(p))] for p in prompts])
    import pandas as pd
    frame = sum(map(len, encode.YES_NO["pair"])) + 1
    got = encode.yes_no_scorer("pair", logits, tok, dec, max_len=frame + 5, least=2)(pd.Series(["q", "q"]), pd.Series(["x" * 50, None]))
    assert [len(p) for p in seen] == [frame + 5, frame] and list(got) == [frame + 5, frame]
    chat = encode.yes_no_scorer("chat", lambda p: __import__("numpy").zeros((len(p), 2)), tok, dec)(pd.Series(["q"]), pd.Series(["x"]))
    assert chat[0] == pytest.approx(math.log(0.5))
    df = spark.createDataFrame([(1, "a b", None)], "k int, q string, t string")
    assert rerank.score_pairs(df, lambda q, t: q.str.len() * 10.0 + t.str.len(), "q", "t", segment=lambda s: s.replace(" ", "__")).first().ce == 40.0


def test_vectors_are_encoded_in_groups_and_kept_with_their_maker(spark, tmp_path):
    df = spark.createDataFrame([(i, "w" * (i % 7 + 1)) for i in range(50)], "chunk_idx long, text string").repartition(1)
    a = {r.chunk_idx: r.embedding for r in encode.encode(df, "chunk_idx", "text", encode.hashed(8), group=16, batch=5).collect()}
    b = {r.chunk_idx: r.embedding for r in encode.encode(df, "chunk_idx", "text", encode.hashed(8)).collect()}
    assert a == b and len(a) == 50
    meta = encode.EncoderMeta("m", 8)
    encode.write_vectors(encode.encode(df, "chunk_idx", "text", encode.hashed(8)), str(tmp_path / "v"), meta)
    v, made = encode.read_vectors(spark, str(tmp_path / "v"), meta)
    assert made == meta and v.count() == 50
    with pytest.raises(ValueError):
        encode.read_vectors(spark, str(tmp_path / "v"), encode.EncoderMeta("other", 8))


def test_prediction_by_tier(spark):
    from lotusrank.plans import pipeline
    rows = [("q", i, f"d{i // 2}", 10.0 - i, i / 10) for i in range(8)]
    pool = spark.createDataFrame(rows, "qid string, chunk_idx long, doc_id string, bm25 double, dense double")
    first = lambda tier, score=None: [r.doc_id for r in pipeline.predict(tier, pool, Params(topk=2, agg="max"), score).orderBy("rank").collect()]
    assert first("bm25") == ["d0", "d1"] and first("hybrid") == ["d3", "d2"]
    assert first("rerank", lambda c: c.withColumn("ce", F.when(F.col("doc_id") == "d1", 9.0).otherwise(0.0)))[0] == "d1"
    for bad in (("rerank",), ("all", None)):
        with pytest.raises(ValueError):
            first(*bad)


def test_listwise_rows_need_all_negatives(spark):
    p = spark.createDataFrame([("1", "q", "p", ["a", "b"]), ("2", "r", "s", ["c"])], "qid string, query string, positive string, negatives array<string>")
    assert [tuple(r) for r in mining.listwise_rows(p, 2).collect()] == [("q", "p", "a", "b")]


def test_slices_of_a_sample_are_disjoint(spark):
    q = spark.createDataFrame([(str(i),) for i in range(30)], "qid string")
    a, b = ({r.qid for r in evaluate.sample(q, 10, skip=k).collect()} for k in (0, 10))
    assert len(a) == len(b) == 10 and not a & b


def test_mean_pool_looks_at_what_the_mask_keeps():
    import numpy as np
    states = np.array([[[1.0, 2.0], [3.0, 4.0], [100.0, 100.0]], [[5.0, 5.0], [0.0, 0.0], [0.0, 0.0]]])
    assert encode.mean_pool(states, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[2.0, 3.0], [0.0, 0.0]]
