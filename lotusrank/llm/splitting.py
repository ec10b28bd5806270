"""Cutting oversized texts into overlapping pieces at natural boundaries, by pointer doubling over successor tables."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

WIDTHLESS = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_WIDTHLESS = re.compile(f"[{WIDTHLESS}]")
_ARTICLE = re.compile(r"(?m)^[^\S\n]*(Điều\s+\d+[a-zđ]?)(?!\w)")
_SPACE = np.zeros(0x3002, dtype=bool)
for _c in range(0x3002):
    _SPACE[_c] = chr(_c).isspace()
_LINE_END = np.array([ord(c) for c in "\n\r\x0b\x0c\x85\u2028\u2029"], dtype=np.uint32)
_SENTENCE = np.array([ord(c) for c in ".?!;…:"], dtype=np.uint32)
_CLOSE = np.array([ord(c) for c in "\"'”’»)]"], dtype=np.uint32)
OUT = "fld string, rec_id string, piece_no int, n_pieces int, path string, n_words int, start_word int, end_word int, text string"


def count_words(text: str) -> int:
    """Words are separated by white space of any kind; characters of no width separate nothing and are no word."""
    return len((_WIDTHLESS.sub("", text) if _WIDTHLESS.search(text) else text).split())


@F.pandas_udf(IntegerType())
def _words(s: pd.Series) -> pd.Series:
    return s.map(lambda t: count_words(t) if t is not None else 0).astype("int32")


def word_count(col: Column) -> Column:
    return _words(col)


def scan(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, natural): character offsets of all words; natural[k] tells whether a break follows word k."""
    ch = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = np.zeros(len(ch), dtype=bool)
    low = ch < len(_SPACE)
    space[low] = _SPACE[ch[low]]
    thin = np.isin(ch, np.array([ord(c) for c in WIDTHLESS], dtype=np.uint32))
    solid = ~space & ~thin
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts) and thin.any():
        full = np.add.reduceat(solid.astype(np.int64), starts) > 0
        starts, ends = starts[full], ends[full]
    n = len(starts)
    if not n:
        return starts, ends, np.zeros(0, dtype=bool)
    last = ch[ends - 1]
    before = np.where(ends - starts > 1, ch[np.maximum(ends - 2, 0)], 0)
    mark = np.where(np.isin(last, _CLOSE), before, last)
    stop = np.isin(mark, _SENTENCE)
    digit = (before >= 48) & (before <= 57)
    number = stop & digit & (ends - starts <= 4)  # "1." or "12." opens a clause, it ends none
    breaks = np.r_[0, np.cumsum(np.isin(ch, _LINE_END))]
    nxt = np.r_[starts[1:], len(ch)]
    line = breaks[nxt] > breaks[ends]
    natural = (stop & ~number) | line
    natural[-1] = True
    return starts, ends, natural


def successors(natural: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every cut c (a number of words from the start): where the piece after it starts, and the next cut.

    The next piece starts at the first natural break within `overlap` words before c, else exactly `overlap` words
    before it, and ends at the farthest natural break its limit allows, else at the limit. The end is its own successor.
    """
    n = len(natural)
    breaks = np.flatnonzero(natural) + 1
    cut = np.arange(n + 1)
    first = np.searchsorted(breaks, cut - overlap, side="left")
    near = breaks[np.minimum(first, len(breaks) - 1)]
    start = np.where((near < cut) & (near >= cut - overlap), near, np.maximum(cut - overlap, 0))
    far = breaks[np.maximum(np.searchsorted(breaks, start + limit, side="right") - 1, 0)]
    nxt = np.where((far > cut) & (far <= start + limit), far, np.minimum(start + limit, n))
    nxt[n] = n
    return start, nxt


def greedy_cuts(nxt: np.ndarray, n: np.ndarray, base: np.ndarray) -> np.ndarray:
    """All cuts reached from the first states `base` of many texts at once: the table is squared until nothing new is
    reached, and each squaring doubles the known part of every text's chain."""
    seen = np.unique(base)
    table = nxt
    while True:
        more = np.union1d(seen, table[seen])
        if len(more) == len(seen):
            return seen
        seen = more
        table = table[table]


def split_batch(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    """Word ranges [start, end) of the pieces of every text; texts within the limit are one piece."""
    scans = [scan(t) for t in texts]
    return [p for p in _ranges([s[2] for s in scans], limit, overlap)]


def _ranges(naturals: list[np.ndarray], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    starts, nexts, base, offs, at = [], [], [], [], 0
    for nat in naturals:
        offs.append(at)
        n = len(nat)
        if n == 0:
            starts.append(np.zeros(1, dtype=np.int64))
            nexts.append(np.array([at]))
            base.append(at)
            at += 1
            continue
        s, nx = successors(nat, limit, overlap)
        starts.append(s)
        nexts.append(nx + at)
        # the first piece starts at word 0 whatever the overlap
        breaks = np.flatnonzero(nat) + 1
        far = breaks[max(np.searchsorted(breaks, limit, side="right") - 1, 0)]
        base.append(at + int(far if far <= limit else min(limit, n)))
        at += n + 1
    start, nxt = np.concatenate(starts), np.concatenate(nexts)
    cuts = greedy_cuts(nxt, np.array([len(x) for x in naturals]), np.array(base))
    out = []
    for k, nat in enumerate(naturals):
        lo = offs[k]
        mine = cuts[(np.searchsorted(cuts, lo)):np.searchsorted(cuts, lo + len(nat), side="right")] - lo
        mine = mine.tolist() if len(nat) else []
        out.append([(0 if i == 0 else int(start[lo + mine[i - 1]]), c) for i, c in enumerate(mine)])
    return out


def _pieces(limit: int, overlap: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # few texts at a time as Python objects
                yield _emit(batch.slice(lo, 64).to_pydict(), limit, overlap)
    return run


def _emit(pdf: dict, limit: int, overlap: int) -> pa.RecordBatch:
    texts = pdf["text"]
    scans = [scan(t) for t in texts]
    out: dict[str, list] = {c.split()[0]: [] for c in OUT.split(", ")}
    for i, (text, (starts, ends, _), ranges) in enumerate(zip(texts, scans, _ranges([s[2] for s in scans], limit, overlap))):
        heads = [(m.start(1), " ".join(m.group(1).split())) for m in _ARTICLE.finditer(text)]
        at = np.array([h[0] for h in heads])
        base = pdf["path"][i]
        for k, (a, b) in enumerate(ranges):
            lo, hi = int(starts[a]), int(ends[b - 1])
            h = int(np.searchsorted(at, lo, side="right")) - 1 if heads else -1
            label = heads[h][1] if h >= 0 else ""
            trail = [x for x in (base, label if label and not (base or "").endswith(label) else "", f"Phần {k + 1}/{len(ranges)}") if x]
            for c, v in (("fld", pdf["fld"][i]), ("rec_id", pdf["rec_id"][i]), ("piece_no", k + 1), ("n_pieces", len(ranges)), ("path", " > ".join(trail)), ("n_words", b - a), ("start_word", a), ("end_word", b), ("text", text[lo:hi])):
                out[c].append(v)
    return pa.RecordBatch.from_pydict(out, schema=_SCHEMA)


_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int32()) for c in OUT.split(", ")])


def pieces(df: DataFrame, fld: str, key: str, text: str, path: Column, limit: int = 350, overlap: int = 50) -> DataFrame:
    """The pieces of every text of more than `limit` words, in the columns of OUT; shorter texts give no row.

    Pieces are slices of the text, of at most `limit` words, that end after a sentence, a clause closed by ; or :, or a
    line, if the text has such a break there, and repeat up to `overlap` words of the piece before, from a natural
    break on if there is one. path: the record's own path, the article in which the piece starts, and the number of the
    piece. Null and empty texts and null keys give no row; repeated keys count once; text without any break is cut at
    words. A word is never cut, however long.
    """
    # n words need n - 1 separators and n letters at least
    long = df.filter(F.col(key).isNotNull() & (F.length(text) > 2 * limit)).select(F.lit(fld).alias("fld"), F.col(key).alias("rec_id"), path.alias("path"), F.col(text).alias("text"))
    over = long.filter(word_count(F.col("text")) > limit).dropDuplicates(["rec_id"])
    return over.mapInArrow(_pieces(limit, overlap), OUT)


def title(name: Column, link: Column) -> Column:
    """A document's title: its name, else the readable part of its link."""
    slug = F.regexp_extract(link, r"/([^/]+?)-\d+\.aspx", 1)
    return F.trim(F.translate(F.coalesce(F.when(F.trim(name) != "", name), slug, F.lit("")), "-", " "))


def split_all(context: DataFrame, chunks: DataFrame, limit: int = 350, overlap: int = 50) -> DataFrame:
    a = pieces(context, "context.passage", "doc_id", "passage", title(F.col("name"), F.col("link")), limit, overlap)
    b = pieces(chunks, "chunks.text", "chunk_id", "text", F.col("path"), limit, overlap)
    return a.unionByName(b)


def found(context: DataFrame, chunks: DataFrame) -> DataFrame:
    return split_all(context, chunks).filter("piece_no = 1").select("fld", "rec_id")
