import io as bytesio
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lotusrank.operators import validate
from lotusrank.plans import pipeline
from lotusrank.sources import io
from lotusrank.streaming import ingest


def zipped(entries):
    b = bytesio.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return b.getvalue()


def codes(spark, value, name="s.zip", entries=None, ref=("1", "2")):
    data = zipped(entries or {"submission.json": value if isinstance(value, (str, bytes)) else json.dumps(value)}) if name.endswith(".zip") else value
    r = spark.createDataFrame([(q,) for q in ref], "qid string") if ref else None
    corpus = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    return sorted((x.code, x.qid) for x in validate.validate_file(spark, name, data, r, corpus).collect())


OK = {"1": {"answer": ["a"]}, "2": {"answer": ["b", "a"]}}


@pytest.mark.parametrize("value, want", [
    (OK, []), ({"1": {"answer": ["a"]}}, [("E005", "2")]), ({**OK, "3": {"answer": ["a"]}}, [("E006", "3")]), ({**OK, "2": []}, [("E007", "2")]), ({**OK, "2": {}}, [("E008", "2")]), ({**OK, "2": {"answer": None}}, [("E009", "2")]),
    ({**OK, "2": {"answer": [1, 1, "a"]}}, [("E010", "2")] * 2), ({**OK, "2": {"answer": [" "]}}, [("E011", "2")]), ({**OK, "2": {"answer": ["a", "a"]}}, [("E012", "2")]), ({**OK, "2": {"answer": ["zz"]}}, [("E014", "2")]),
    ({**OK, "2": {"answer": []}}, [("W001", "2")]), ({**OK, "2": {"answer": ["a", "b"] * 3}}, [("E012", "2")] * 2 + [("W002", "2")]), ([], [("E004", None)]), ({}, [("E004", None)]), ("{bad", [("E003", None)]), (b"\xff\xfe{", [("E003", None)]),
    ('﻿{"1": {"answer": ["a"]}, "2": {"answer": ["a"]}, "2": {"answer": ["b"]}}'.encode(), [("E013", "2")]),
])
def test_submission_rules(spark, value, want):
    assert codes(spark, value) == want


def test_container_rules(spark):
    assert [c for c, _ in sorted((c, d) for _, c, d in validate.read_file("x.zip", b"no zip")[1])] == ["E001"]
    assert [c for _, c, _ in validate.read_file("x.zip", zipped({"a/submission.json": "{}"}))[1]] == ["E001"]
    assert codes(spark, None, entries={"submission.json": json.dumps(OK), "more.txt": "", "__MACOSX/x": ""}) == [("E002", None), ("W003", None)]
    assert codes(spark, json.dumps(OK).encode(), name="x.json", ref=None) == [("W004", None), ("W005", None)]


def test_readers_and_submission(spark, tmp_path):
    d = tmp_path / "data" / "deep"
    d.mkdir(parents=True)
    (d / "context_12.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"id": 12, "link": "l", "passage": "Điều 1"}).encode())
    (d / "context_9.json").write_text(json.dumps({"id": 9, "name": "n", "passage": None}))
    (d / "other.json").write_text("{}")
    got = {r.doc_id: (r.id, r.name, r.passage) for r in io.read_contexts(spark, str(tmp_path / "data")).collect()}
    assert got == {"12": (12, None, "Điều 1"), "9": (9, "n", None)}
    assert sorted(r.doc_id for r in io.corpus_ids(spark, str(tmp_path / "data")).collect()) == ["12", "9"]
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"1": {"question": "hỏi", "answer": [5, "6"]}, "2": {"question": "x", "answer": None}}))
    assert {r.qid: r.answer for r in io.read_questions(spark, str(q)).collect()} == {"1": ["5", "6"], "2": None}
    z = io.to_submission(spark.createDataFrame([("1", ["a"]), ("2", ["b"])], "qid string, answer array<string>"))
    assert json.loads(zipfile.ZipFile(bytesio.BytesIO(z)).read("submission.json")) == {"1": {"answer": ["a"]}, "2": {"answer": ["b"]}}


DOCS = [("1", "Luật A", None, "Điều 1. thuế đất đai " + "đất " * 40 + "\nĐiều 2. lao động " + "việc " * 40), ("2", "Luật B", None, "thuế " * 300), ("3", "Chỉ tên", None, None)]


def test_pipeline_skips_complete_stages(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, name string, link string, passage string")
    qs = spark.createDataFrame([("q", "việc lao động")], "qid string, question string")
    p = pipeline.Pipeline(spark, str(tmp_path))
    first = [tuple(r) for r in pipeline.retrieve(p, docs, qs, pipeline.Params(min_df=1, max_df_ratio=1.0)).collect()]
    assert p.ran == ["chunks", "index", "scores", "ranked"] and first[0][2] == "1"
    p2 = pipeline.Pipeline(spark, str(tmp_path))
    (tmp_path / "ranked/_SUCCESS").unlink()  # half-written
    assert [tuple(r) for r in pipeline.retrieve(p2, docs, qs, pipeline.Params(min_df=1, max_df_ratio=1.0)).collect()] == first and p2.ran == ["ranked"]


def test_search_facade(spark):
    ch = spark.createDataFrame([(0, "1", "Điều 1", "A > Điều 1\nthuế đất"), (1, "1", "Điều 2", "A > Điều 2\nlao động"), (2, "2", "Phần 1", "B > Phần 1\nthuế thuế")], "chunk_idx long, doc_id string, path string, text string")
    q = spark.createDataFrame([("q", "thuế")], "qid string, question string")
    p = pipeline.Params(min_df=1, max_df_ratio=1.0)
    assert [(r.doc_id, r.title, r.snippet) for r in pipeline.search(ch, q, 5, "doc", params=p).orderBy("rank").collect()] == [("2", "B", "thuế thuế"), ("1", "A", "thuế đất")]
    assert pipeline.search(ch, q, 0, "chunk", params=p).count() == 1
    with pytest.raises(ValueError):
        pipeline.search(ch, q, 5, "page")


def test_stream_of_documents(spark, tmp_path):
    src, out, st = (str(tmp_path / x) for x in ("in", "out", "state"))
    docs = spark.createDataFrame(DOCS, "doc_id string, name string, link string, passage string").withColumn("crawled_at", F.lit("2030-01-01").cast("timestamp_ntz"))
    docs.write.parquet(src)
    ingest.run(spark, src, out, st).awaitTermination()
    docs.limit(1).write.mode("append").parquet(src)
    ingest.run(spark, src, out, st).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.doc_id, r.tier) for r in got.collect()) == [("1", 1), ("1", 1), ("2", 3), ("2", 3), ("3", 0)]


def test_files_that_hand_results_on(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.corpus_ids(spark, str(tmp_path))
    c = spark.createDataFrame([("1", "1#0", 1, "Điều 1", 2, "a\nb")], "doc_id string, chunk_id string, tier int, path string, n_words int, text string")
    io.write_lines(c, str(tmp_path / "chunks"))
    assert [tuple(r) for r in io.read_chunks(spark, str(tmp_path / "chunks")).collect()] == [tuple(c.first())]
    folds = spark.createDataFrame([("2", "train"), ("1", "val"), ("3", "train")], "qid string, fold string")
    assert json.loads(io.split_json(folds, 42)) == {"train": ["2", "3"], "val": ["1"], "seed": 42}
    io.write_dump(folds, str(tmp_path / "dump"), {"pool": 2000, "alpha": 0.7}, ["qid"])
    assert io.read_dump(spark, str(tmp_path / "dump"), {"pool": 2000})[0].count() == 3
    with pytest.raises(ValueError):
        io.read_dump(spark, str(tmp_path / "dump"), {"pool": 20})
    for i in (3, 1, 2):
        (tmp_path / f"context_{i}.json").write_text(json.dumps({"id": i, "passage": "x"}))
    assert sorted(r.doc_id for r in io.read_contexts(spark, str(tmp_path), first=2).collect()) == ["1", "2"]


def test_stages_of_a_session_follow_the_files(spark, tmp_path):
    d = str(tmp_path / "t")
    spark.range(3).write.parquet(f"{d}/a.parquet")
    p = pipeline.session_stages(spark, d)
    p.stage("x", lambda: spark.range(1))
    again = pipeline.session_stages(spark, d)
    again.stage("x", lambda: spark.range(1))
    assert p.ran == ["x"] and again.ran == [] and again.root == p.root
    spark.range(3).write.parquet(f"{d}/b.parquet")
    assert pipeline.session_stages(spark, d).root != p.root


def test_pipeline_with_an_encoder(spark, tmp_path):
    from lotusrank.operators import encode
    docs = spark.createDataFrame(DOCS, "doc_id string, name string, link string, passage string")
    qs = spark.createDataFrame([("q", "việc lao động")], "qid string, question string")
    params, meta = pipeline.Params(min_df=1, max_df_ratio=1.0), encode.EncoderMeta("hashed", 16)
    p = pipeline.Pipeline(spark, str(tmp_path))
    got = pipeline.retrieve(p, docs, qs, params, encoder=(encode.hashed(16), meta))
    assert p.ran == ["chunks", "vectors", "index", "scores", "pool", "ranked"] and got.first().doc_id == "1"
    with pytest.raises(ValueError):
        pipeline.retrieve(pipeline.Pipeline(spark, str(tmp_path)), docs, qs, params, encoder=(encode.hashed(16), encode.EncoderMeta("other", 16)))
    train = spark.createDataFrame([("x", ["2"]), ("y", ["2"])], "qid string, answer array<string>")
    asked = spark.createDataFrame([("q",), ("r",)], "qid string")
    r = pipeline.submission_report(spark.createDataFrame([("q", 1, "1", 1.0), ("q", 2, "2", 0.99)], "qid string, rank int, doc_id string, score double"), train, asked, pipeline.Params(lam=3.0, topk=1)).first()
    assert (r.questions, r.answers, r.padded, r.moved) == (2, 2, 1, 1)
