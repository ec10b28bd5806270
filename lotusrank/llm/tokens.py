"""Exact byte-pair encoding of whole corpora by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files are; a parameter of every function here.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same in the classes of the standard library, for texts without the characters on which the two differ.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_FULL = regex.compile(PATTERN)


@lru_cache(maxsize=1)
def _odd():
    """Characters that the two patterns class differently: numbers that are no decimal digits, separators \\x1c-\\x1f,
    and letters that one library knows and the other doesn't yet."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    classes = [(r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")]
    odd = sorted({ord(c) for full, fast in classes for c in set(regex.findall(full, every)) ^ set(re.findall(fast, every))})
    runs: list[list[int]] = []
    for c in odd:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]")


def pretokens(text: str) -> list[str]:
    return (_FULL if _odd().search(text) else _FAST).findall(text)


class Encoder:
    """Byte-pair encoding without running merges over the text.

    For every prefix of a word there is one token that can end its encoding. It is found by walking an automaton of the
    vocabulary that yields all tokens which are suffixes of what has been read (a trie of the tokens with failure links;
    states for parts of tokens that begin none would never end a match, so it has none) and testing whether the token
    is compatible with the last token of the prefix before it: two tokens may stand beside each other if and only if
    encoding their joined bytes gives just these two. Back-pointers from the end give the ids.
    """

    def __init__(self, ranks: dict[bytes, int], cache: int = 500_000):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.room = cache
        self.pairs: dict[tuple[int, int], bool] = {}
        self._build()

    def _build(self) -> None:
        """Automaton over bytes whose states are prefixes of tokens; out[s] lists the tokens that are suffixes of s."""
        go: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for tok, rank in self.ranks.items():
            s = 0
            for b in tok:
                nxt = go[s].get(b)
                if nxt is None:
                    nxt = len(go)
                    go[s][b] = nxt
                    go.append({})
                    own.append(-1)
                s = nxt
            own[s] = rank
        fail = [0] * len(go)
        link = [-1] * len(go)  # nearest state on the suffix chain that is a token
        queue = list(go[0].values())
        for s in queue:
            for b, t in go[s].items():
                f = fail[s]
                while f and b not in go[f]:
                    f = fail[f]
                fail[t] = go[f][b] if b in go[f] and go[f][b] != t else 0
                queue.append(t)
            f = fail[s]
            link[s] = f if own[f] >= 0 else link[f]
        self.go, self.own, self.fail, self.link = go, own, fail, link
        self.size = {r: len(t) for t, r in self.ranks.items()}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by lowest rank; only for joined pairs of tokens, and for tests."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            pair = (parts[at], parts[at + 1])
            new, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    new.append(pair[0] + pair[1])
                    i += 2
                else:
                    new.append(parts[i])
                    i += 1
            parts = new
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) > self.room:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def word(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        go, own, fail, link, size = self.go, self.own, self.fail, self.link, self.size
        n = len(data)
        last = [-1] * (n + 1)
        s = 0
        for i in range(n):
            b = data[i]
            while s and b not in go[s]:
                s = fail[s]
            s = go[s].get(b, 0)
            t = s if own[s] >= 0 else link[s]
            while t > 0:  # from the longest token that ends here to the shortest
                tok = own[t]
                before = i + 1 - size[tok]
                if before == 0 or last[before] >= 0 and self.compatible(last[before], tok):
                    last[i + 1] = tok
                    break
                t = link[t]
        if last[n] < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        out = []
        while n:
            out.append(last[n])
            n -= size[last[n]]
        return out[::-1]

    def packed(self, text: str) -> list[bytes]:
        """The ids of every pretoken, as little-endian 32-bit integers."""
        cache = self.cache
        words = pretokens(text)
        try:
            return [cache[w] for w in words]
        except KeyError:
            out = []
            for w in words:
                got = cache.get(w)
                if got is None:
                    got = array("i", self.word(w.encode("utf-8", "surrogatepass"))).tobytes()
                    if len(w) <= 64:
                        if len(cache) >= self.room:
                            cache.clear()
                        cache[w] = got
                out.append(got)
            return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.packed(text)), dtype="<i4").tolist()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(load_ranks(path))


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _encode(path: str, key_type: pa.DataType, counts: bool):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                parts = [b"".join(enc.packed(t)) if t else b"" for t in batch.column(1).slice(lo, 1000).to_pylist()]
                sizes = np.fromiter((len(p) // 4 for p in parts), dtype=np.int64, count=len(parts))
                keys = batch.column(0).slice(lo, len(parts))
                if counts:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(sizes)], names=["key", "n_tokens"])
                    continue
                offs = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offs, flat)], names=["key", "ids"])
    return run


def _keyed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")), kind


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", *, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>): the ids of every text, without special tokens; strings of special tokens are plain text.

    Null and empty texts give an empty list. Null keys are kept, and rows stay as they come (the key of a corpus
    is unique). Texts are encoded whole, in linear time, without any shuffle.
    """
    d, kind = _keyed(df, key, text)
    return d.mapInArrow(_encode(vocabulary(name, folder), None, False), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", *, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens): as encode, but only the number of ids leaves the workers."""
    d, kind = _keyed(df, key, text)
    return d.mapInArrow(_encode(vocabulary(name, folder), None, True), f"key {kind}, n_tokens long").withColumnRenamed("key", key)
