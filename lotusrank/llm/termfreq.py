"""Occurrences and record counts of every term (n-gram) by suffix-sorted counting."""

from __future__ import annotations

import re
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = "\x01"
TERM = re.compile(r"\w+")
#: Distinct suffixes (or tokens of one block) after which a map task hands over what it has counted.
FLUSH = 400_000
MAP_OUT = "first string, second string, suffix string, cf long, ddf array<long>"


def count_block(texts: list[str], sigma: int) -> pd.DataFrame:
    """The truncated suffixes of a block of records, combined.

    One row per distinct suffix: its occurrences cf, and ddf, whose l-th entry is the number of records in which this
    suffix is the first (in reverse-lexicographic order) to bring its prefix of l terms. Summing ddf over all suffixes
    below a prefix gives the size of the union of their record sets, so blocks of different records simply add up.
    """
    vocab: dict[str, int] = {}
    ids: list[int] = []
    lens: list[int] = []
    put = vocab.setdefault
    for t in texts:
        toks = TERM.findall(t.lower())
        ids += [put(x, len(vocab)) for x in toks]
        lens.append(len(toks))
    if not ids:
        return pd.DataFrame({"first": [], "second": [], "suffix": [], "cf": [], "ddf": []})
    words = np.array(list(vocab), dtype=object)
    order = np.argsort(words, kind="stable")
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    tok = rank[np.fromiter(ids, dtype=np.int64, count=len(ids))]
    words = words[order]
    rec = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
    n, nrec = len(tok), len(lens)
    cols = [tok]
    for step in range(1, sigma):
        c = np.full(n, -1, dtype=np.int64)
        same = rec[step:] == rec[:-step] if n > step else np.empty(0, dtype=bool)
        c[: n - step][same] = tok[step:][same]
        cols.append(c)
    srt = np.lexsort([-c for c in reversed(cols)]) if sigma > 1 else np.argsort(-tok, kind="stable")
    cols, rec = [c[srt] for c in cols], rec[srt]
    new = np.zeros(n, dtype=bool)
    new[0] = True
    group_of = []
    for c in cols:
        new = new.copy()
        new[1:] |= c[1:] != c[:-1]
        group_of.append(np.cumsum(new) - 1)
    leaf = group_of[-1]
    heads = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    cf = np.bincount(leaf)
    ddf = np.zeros((len(heads), sigma), dtype=np.int64)
    for level in range(sigma):
        live = cols[level] >= 0
        _, at = np.unique(group_of[level][live] * nrec + rec[live], return_index=True)
        ddf[:, level] = np.bincount(leaf[live][at], minlength=len(heads))
    terms = [c[heads] for c in cols]
    names = [np.where(t >= 0, words[t], None) for t in terms]
    if sigma == 1:
        suffix, depth = names[0], np.ones(len(heads), dtype=np.int64)
    else:
        depth = sum((t >= 0).astype(np.int64) for t in terms)
        suffix = [SEP.join(x for x in row if x is not None) for row in zip(*names)]
    second = names[1] if sigma > 1 else np.full(len(heads), None)
    return pd.DataFrame({"first": names[0], "second": second, "suffix": suffix, "cf": cf, "ddf": [list(row[:k]) for row, k in zip(ddf.tolist(), depth)]})


def _mapper(sigma: int):
    def run(batches):
        hold: list[str] = []
        size = 0
        for pdf in batches:
            for t in pdf["text"]:
                hold.append(t)
                size += len(t)
                if size > FLUSH * 12:
                    yield count_block(hold, sigma)
                    hold, size = [], 0
        if hold:
            yield count_block(hold, sigma)
    return run


def stack_counts(rows):
    """From (suffix, cf, ddf) in reverse-lexicographic order, (prefix, cf, df) of every prefix, with one stack."""
    path: list[str] = []
    cfs: list[int] = []
    dfs: list[int] = []
    for suffix, cf, ddf in rows:
        terms = suffix.split(SEP)
        keep = 0
        while keep < len(path) and keep < len(terms) and path[keep] == terms[keep]:
            keep += 1
        while len(path) > keep:
            yield SEP.join(path), cfs[-1], dfs[-1]
            done = cfs.pop()
            path.pop()
            dfs.pop()
            if cfs:
                cfs[-1] += done
        for t in terms[keep:]:
            path.append(t)
            cfs.append(0)
            dfs.append(0)
        cfs[-1] += cf
        for i, x in enumerate(ddf):
            dfs[i] += x
    while path:
        yield SEP.join(path), cfs[-1], dfs[-1]
        done = cfs.pop()
        path.pop()
        dfs.pop()
        if cfs:
            cfs[-1] += done


def _reducer(batches):
    def rows():
        for pdf in batches:
            yield from zip(pdf["suffix"], pdf["cf"], pdf["ddf"])
    out: list[tuple] = []
    for x in stack_counts(rows()):
        out.append(x)
        if len(out) >= 50_000:
            yield pd.DataFrame(out, columns=["term", "occurrences", "records"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["term", "occurrences", "records"])


def ngram_counts(df: DataFrame, key: str, text: str, sigma: int = 1) -> DataFrame:
    """(term, n, occurrences, records) of every n-gram of up to sigma terms; terms of an n-gram are joined by a space.

    Map tasks combine the truncated suffixes of their own records; the combined suffixes are routed by first term
    (split further by the second, so that no first term is one task's burden), sorted reverse-lexicographically and
    folded with a stack; the partial counts of split first terms are added at the end. A term is a longest run of
    letters, digits and underscores, in lower case. Repeated keys count once; null and empty texts hold no term;
    null keys are no record.
    """
    recs = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("text")).dropDuplicates(["__key"])
    combined = recs.filter(F.col("text").isNotNull()).select("text").mapInPandas(_mapper(sigma), MAP_OUT)
    routed = combined.repartition(F.col("first"), F.pmod(F.xxhash64("second"), F.lit(16))).sortWithinPartitions(F.col("suffix").desc())
    counted = routed.select("suffix", "cf", "ddf").mapInPandas(_reducer, "term string, occurrences long, records long")
    out = counted.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return out.select(F.translate("term", SEP, " ").alias("term"), F.size(F.split("term", SEP)).alias("n"), "occurrences", "records")


def terms(df: DataFrame, key: str = "chunk_id", text: str = "text", *, rare: int = 1, common: float = 0.7, sigma: int = 1) -> DataFrame:
    """ngram_counts with mark: `rare` in at most `rare` records, `common` in more than floor(common * N), else null.

    N is the number of distinct keys, those with null text included.
    """
    n = df.agg(F.countDistinct(key)).first()[0]
    most = int(Decimal(str(common)) * n)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > most, "common")
    return ngram_counts(df, key, text, sigma).withColumn("mark", mark)


def found(chunks: DataFrame) -> DataFrame:
    return terms(chunks).filter("mark is not null").select("term", "mark")
