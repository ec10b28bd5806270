"""Readers and writers of the project's file forms."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

CONTEXT = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("link", StringType()), StructField("passage", StringType())])
QUESTIONS = "map<string,struct<question:string,answer:array<string>>>"
BOM = "﻿"


def read_contexts(spark: SparkSession, folder: str, first: int | None = None) -> DataFrame:
    """context_<id>.json files at any depth: (doc_id, id, name, link, passage); doc_id comes from the file's name. `first` takes
    that many files in the order of their names."""
    d = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "context_*.json").option("wholetext", "true").text(folder)
         .select(F.regexp_extract(F.input_file_name(), r"context_([^/]+)\.json$", 1).alias("doc_id"), F.from_json(F.ltrim(F.regexp_replace("value", f"^{BOM}", "")), CONTEXT).alias("j")))
    d = d.select("doc_id", "j.*")
    return d.orderBy("doc_id").limit(first) if first else d


def corpus_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id) of all context files, from their names alone: no file is opened; raises if there is none."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "context_*.json").load(folder).select("path")
    if d.isEmpty():
        raise FileNotFoundError(f"no context_*.json under {folder}")
    return d.select(F.regexp_extract("path", r"context_([^/]+)\.json$", 1).alias("doc_id"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object qid -> {question, answer} as (qid, question, answer); ids become strings, answer may be null."""
    d = spark.read.option("wholetext", "true").text(path).select(F.from_json(F.regexp_replace("value", f"^{BOM}", ""), QUESTIONS).alias("m"))
    return d.select(F.explode("m").alias("qid", "v")).select("qid", "v.question", "v.answer")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as JSON lines."""
    return spark.read.schema("doc_id string, chunk_id string, tier int, path string, n_words int, text string").json(path)


def lookup(docs: DataFrame, doc_id: str) -> DataFrame:
    """One document; the filter reaches the scan."""
    return docs.filter(F.col("doc_id") == doc_id)


def late_fetch(top: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Joins wide columns to the few chunks that a ranking kept."""
    return top.join(chunks.select("chunk_idx", *columns).dropDuplicates(["chunk_idx"]), "chunk_idx")


def to_submission(answers: DataFrame) -> bytes:
    """A zip with submission.json at its root; one row per question reaches the driver, as the file form demands."""
    body = {r["qid"]: {"answer": list(r["answer"])} for r in answers.orderBy("qid").toLocalIterator()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("submission.json", json.dumps(body, ensure_ascii=False))
    return out.getvalue()


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, ordered by `by` inside range partitions, so that readers prune by it."""
    if by:
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    df.write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, such as chunks and training pairs; null fields are left out."""
    df.write.mode("overwrite").json(path)


def split_json(folds: DataFrame, seed: int) -> str:
    """(qid, fold) as the JSON object {train: [...], val: [...], seed}; one id per question reaches the driver, as the file form demands."""
    got: dict = {"train": [], "val": []}
    for r in folds.orderBy("qid").toLocalIterator():
        got[r["fold"]].append(r["qid"])
    return json.dumps({**got, "seed": seed}, ensure_ascii=False)


def write_dump(df: DataFrame, path: str, settings: dict, by: list[str] | None = None) -> None:
    """An intermediate result (candidates, pairs, a pool, scores) with the settings that made it."""
    write_table(df, f"{path}/rows", by)
    df.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")


def read_dump(spark: SparkSession, path: str, expect: dict | None = None) -> tuple[DataFrame, dict]:
    """A dump and its settings; raises if any of `expect` is another."""
    settings = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    other = {k: settings.get(k) for k, v in (expect or {}).items() if settings.get(k) != v}
    if other:
        raise ValueError(f"{path} was made with {other}")
    return spark.read.parquet(f"{path}/rows"), settings
