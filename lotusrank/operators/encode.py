"""Encoders and scorers as plug-ins: the engine batches, pools, truncates and normalises; the model is the caller's."""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusrank.operators.evaluate import Ranking, auc, best_docs, per_question
from lotusrank.sources.io import write_table

Encode = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class EncoderMeta:
    """What must agree between the vectors of a corpus and those of its questions."""
    model: str
    dim: int
    pooling: str = "mean"
    max_len: int = 512

    def check(self, other: "EncoderMeta") -> None:
        if (self.model, self.dim, self.pooling) != (other.model, other.dim, other.pooling):
            raise ValueError(f"vectors of {other} can't be searched with {self}")

    @staticmethod
    def of_model(folder: str, max_len: int = 512) -> "EncoderMeta":
        """What a model folder says about itself in 1_Pooling/config.json."""
        path = os.path.join(folder, "1_Pooling", "config.json")
        config = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
        mode, dim = pooling_of(config)
        return EncoderMeta(os.path.basename(folder.rstrip("/")), dim or 0, mode, max_len)


def write_vectors(vectors: DataFrame, path: str, meta: EncoderMeta) -> None:
    """Vectors (chunk_idx, embedding) ordered by chunk, and beside them one row that says which encoder made them."""
    write_table(vectors, f"{path}/vectors", ["chunk_idx"])
    vectors.sparkSession.createDataFrame([(meta.model, meta.dim, meta.pooling, meta.max_len)], "model string, dim int, pooling string, max_len int").write.mode("overwrite").parquet(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str, encoder: EncoderMeta | None = None) -> tuple[DataFrame, EncoderMeta]:
    """The vectors and what made them; raises if `encoder`, which is to encode the questions, is another."""
    meta = EncoderMeta(**spark.read.parquet(f"{path}/meta").first().asDict())
    if encoder is not None:
        encoder.check(meta)
    return spark.read.parquet(f"{path}/vectors"), meta


# What the fields of public pooling configurations say, the earlier before the later.
POOLING = {"pooling_mode": {"mean": "mean", "cls": "cls"}, "pooling_mode_cls_token": {True: "cls"}, "pooling_mode_mean_tokens": {True: "mean"}}
DIMENSION = ("word_embedding_dimension", "embedding_dimension")


def pooling_of(config: Mapping) -> tuple[str, int | None]:
    """(`mean` or `cls`, dimension or None) from a pooling configuration; mean where it says nothing."""
    said = [modes[config[field]] for field, modes in POOLING.items() if config.get(field) in modes]
    return [*said, "mean"][0], next((config[f] for f in DIMENSION if config.get(f)), None)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(n, tokens, dim) and (n, tokens) to the mean over the tokens that count."""
    m = mask[..., None].astype(states.dtype)
    return (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def hashed(dim: int = 64) -> Encode:
    """Stand-in encoder: signed feature hashing of words. It tests plumbing, not quality."""
    def run(texts: list[str]) -> np.ndarray:
        hashes = [[_hash(w) for w in t.lower().split()] for t in texts]
        h = np.array([x for own in hashes for x in own], dtype=np.uint64)
        at = np.repeat(np.arange(len(texts)), [len(own) for own in hashes]) * dim + (h % np.uint64(dim)).astype(np.int64)
        return np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * dim).reshape(len(texts), dim)
    return run


@functools.lru_cache(1 << 17)
def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def encode(df: DataFrame, key: str, text: str, model: Encode, *, dims: int | None = None, batch: int = 64, group: int = 4096, fit: Callable[[str], str] | None = None) -> DataFrame:
    """(key, embedding array<float>): unit vectors; null text counts as empty, a zero vector stays zero.

    Texts are taken in groups of `group`, each sorted by length, longest first, so that model batches hold texts alike in
    size; `fit` cuts a text to what the model takes (see fit_to); `dims` keeps the first parts of each vector, of unit
    length again.
    """
    kind = dict(df.dtypes)[key]

    def one(keys: list, texts: list[str]) -> pd.DataFrame:
        texts = [fit(t) for t in texts] if fit else texts
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        rows: list = [None] * len(texts)
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            v = np.asarray(model([texts[i] for i in part]), dtype=np.float64)[:, :dims]
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            for i, x in zip(part, v):
                rows[i] = x.astype(np.float32)
        return pd.DataFrame({"k": pd.Series(keys, dtype=object), "e": rows})

    def run(frames):
        keys, texts = [], []
        for pdf in frames:
            keys += pdf["k"].tolist()
            texts += pdf["t"].fillna("").tolist()
            while len(texts) >= group:
                yield one(keys[:group], texts[:group])
                keys, texts = keys[group:], texts[group:]
        if texts:
            yield one(keys, texts)
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, e array<float>").select(F.col("k").alias(key), F.col("e").alias("embedding"))


def fit_to(tokenize: Callable[[str], list[int]], decode: Callable[[list[int]], str], budget: int) -> Callable[[str], str]:
    """A function that cuts a text to `budget` tokens of a tokenizer, and leaves shorter texts as they are."""
    def fit(text: str) -> str:
        ids = tokenize(text)
        return text if len(ids) <= budget else decode(ids[:budget])
    return fit


# The public prompt forms of two families of yes/no rerankers.
YES_NO = {
    "chat": ('<|im_start|>system\nJudge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".<|im_end|>\n<|im_start|>user\n'
             "<Instruct>: Given a legal question in Vietnamese, retrieve the legal document passage that answers the question\n<Query>: ", "\n<Document>: ", "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"),
    "pair": ("A: ", "\nB: ", "\nGiven a query A and a passage B, determine whether the passage contains an answer to the query by providing a prediction of either 'Yes' or 'No'."),
}


def yes_no_prompt(kind: str, question: Column, text: Column, words: int) -> Column:
    """The prompt of a pair; the passage is cut to `words` words before it is put in, so that the end of the prompt, where
    the answer is expected, always survives."""
    head, middle, tail = YES_NO[kind]
    cut = F.regexp_extract(text, rf"^(?:\S+\s*){{0,{words}}}", 0)
    return F.concat(F.lit(head), question, F.lit(middle), F.rtrim(cut), F.lit(tail))


def yes_no_scorer(kind: str, logits: Callable[[list[str]], np.ndarray], tokenize: Callable[[str], list[int]], decode: Callable[[list[int]], str], *, max_len: int = 512, least: int = 64, batch: int = 16):
    """A scorer for rerank.score_pairs from a generative model, `logits` giving (n, 2) for the answers no and yes: the logarithm of
    yes' share of both for `chat`, the logit of yes alone for `pair`. Of each prompt's `max_len` tokens the passage gets what
    its frame leaves, `least` at least, and is cut before it is put in."""
    head, middle, tail = YES_NO[kind]

    def run(question: pd.Series, text: pd.Series) -> pd.Series:
        prompts = []
        for q, t in zip(question.fillna(""), text.fillna("")):
            frame = f"{head}{q}{middle}"
            prompts.append(frame + fit_to(tokenize, decode, max(least, max_len - len(tokenize(frame + tail))))(t) + tail)
        out = np.empty(len(prompts))
        for lo in range(0, len(prompts), batch):
            no, yes = np.asarray(logits(prompts[lo:lo + batch]), dtype=np.float64).T
            out[lo:lo + batch] = yes if kind == "pair" else -np.logaddexp(0, no - yes)
        return pd.Series(out)
    return run


def yes_probability(no: Column, yes: Column) -> Column:
    """log P(yes) over {yes, no} from two logits, without overflow."""
    return -F.log1p(F.exp(-F.abs(yes - no))) - F.greatest(no - yes, F.lit(0.0))


def screen(cands: DataFrame, gold: DataFrame, scores: dict[str, DataFrame | None], agg: str = "top2") -> DataFrame:
    """(encoder, auc, recall): several encoders on the same candidates (qid, doc_id, chunk_idx), each with its scores
    (qid, chunk_idx, score), or None where the candidates have them in a column of the encoder's name; a missing score is 0.
    All encoders are measured in one plan each."""
    out = None
    for name, s in sorted(scores.items()):
        d = cands.withColumn("score", F.col(name)) if s is None else cands.join(s, ["qid", "chunk_idx"], "left")
        d = d.withColumn("score", F.coalesce("score", F.lit(0.0)))
        labelled = d.join(gold.withColumn("label", F.lit(1)), ["qid", "doc_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
        recall = per_question(best_docs(d.select("qid", "doc_id", "chunk_idx", F.lit(0.0).alias("bm25"), F.col("score").alias("dense")), [Ranking("", "dense", 1.0, agg)], 5), gold).agg(F.round(F.avg("recall"), 6).alias("recall"))
        row = auc(labelled).crossJoin(recall).select(F.lit(name).alias("encoder"), "auc", "recall")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
