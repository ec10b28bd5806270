"""Empty tables, clashing extra columns and very long texts, for every operator."""

import time

import pytest
from pyspark.sql import functions as F

from lotusrank.llm import fuse, mixing, neighbours, overlap, pii, scripts, splitting, termfreq, tokens, topn

TABLES = {
    "context": "doc_id string, name string, link string, passage string",
    "chunks": "chunk_idx long, doc_id string, chunk_id string, path string, text string, qid string, bm25 double, dense double",
    "emb": "chunk_idx long, dense array<float>",
    "train": "qid string, question string, answer array<string>, source string, fold string",
    "submission": "qid string, answer array<string>, score array<double>",
    "documents": "doc_id long, text string, source string",
    "mix_targets": "source string, weight double, max_repeats int",
}
CLASHING = ["key", "rec_id", "text_", "item", "score_", "grp", "kind", "lo", "found", "sig", "canon", "rank", "position", "block", "slot", "ids", "n_tokens", "piece_no", "term", "count", "id", "unit", "v"]


def table(spark, name, rows=()):
    d = spark.createDataFrame(list(rows), TABLES[name])
    for c in CLASHING:
        if c not in d.columns:
            d = d.withColumn(c, F.lit("x"))
    return d


ALL = {
    "p1": lambda t: topn.found(t("submission"), t("chunks")),
    "p2": lambda t: scripts.found(t("context"), t("train")),
    "p3": lambda t: overlap.found(t("train"), t("train")),
    "p3c": lambda t: overlap.counts(t("train"), t("train")),
    "p4": lambda t: fuse.fuse(t("chunks"), "qid", "chunk_idx", {"bm25": 1, "dense": 1}),
    "p5": lambda t: termfreq.found(t("chunks")),
    "p6": lambda t: neighbours.found(t("emb")),
    "p7": lambda t: splitting.split_all(t("context"), t("chunks")),
    "p8": lambda t: tokens.encode(t("documents")),
    "p9": lambda t: mixing.mixture(mixing.sized(t("documents")), t("mix_targets"))[0],
    "p10": lambda t: pii.found(t("documents")),
    "p10r": lambda t: pii.redact(t("documents")),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_tables_give_no_rows(spark, name):
    assert ALL[name](lambda n: table(spark, n)).count() == 0


NULLS = {n: [(None,) * len(s.split(", "))] * 3 for n, s in TABLES.items()}


@pytest.mark.parametrize("name", ALL)
def test_rows_of_nulls_do_no_harm(spark, name):
    got = ALL[name](lambda n: table(spark, n, NULLS[n])).collect()
    if name in ("p8", "p10r"):  # rows are kept: nothing to encode, nothing to replace
        assert len(got) == 3 and all(not r[1] for r in got)
    else:
        assert got == []


def test_very_long_texts(spark):
    long = "Điều 1. " + "từ ngữ dài, " * 150_000
    solid = "x" * 300_000
    ctx = table(spark, "context", [("1", "n", None, long), ("2", None, None, solid), ("3", None, None, "а" + long)])
    began = time.time()
    got = splitting.split_all(ctx, table(spark, "chunks")).groupBy("rec_id").agg(F.max("n_words"), F.max("end_word")).collect()
    assert sorted(tuple(r) for r in got) == [("1", 350, 450_002), ("3", 350, 450_002)]
    assert [r.rec_id for r in scripts.found(ctx, table(spark, "train")).collect()] == ["3"]
    docs = table(spark, "documents", [(1, long, "s"), (2, solid, "s")])
    ids = {r.doc_id: r.ids for r in tokens.encode(docs).collect()}
    enc = tokens.encoder(tokens.vocabulary())
    assert all(b"".join(enc.bytes_of[i] for i in ids[k]).decode() == t for k, t in ((1, long), (2, solid)))
    ch = table(spark, "chunks", [(1, "d", "c", "p", long, None, None, None)])
    assert {(r.term, r.occurrences) for r in termfreq.terms(ch).collect()} >= {("từ", 150_000), ("1", 1)}
    assert time.time() - began < 120
