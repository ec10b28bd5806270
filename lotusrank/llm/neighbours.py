"""Most similar vectors for every vector: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotusrank.functions.scale import cut, shuffle_parts

SIGNED = "id long, same binary, regions array<long>"
BLOCK = "key long, role int, tab int, ids binary, vecs binary, dim int"
PACK = 64  # vectors in one shipped row
HOLD = 16_384  # vectors that a map task packs at a time
BLOCK_ROWS = 131_072  # vectors that are compared with a region at a time
COL = 1 << 22  # more than a block has columns


def functions_for(n: int, bucket: int = 4000) -> int:
    """Hash functions per table, so that a bucket of n random vectors holds about `bucket` of them: each function of
    width 2 on unit vectors keeps 0.55 of unrelated vectors together."""
    return max(1, round(math.log(max(n, 2) / bucket) / 0.6)) if n > bucket else 1


def probe_sets(m: int, t: int) -> list[tuple[int, ...]]:
    """The t most promising perturbations as sets of ranks 0..2m-1 of the boundary distances, by expected score.

    Rank j and rank 2m-1-j belong to the two sides of one function, so never both are taken. Expected squared
    distances of the j-th nearest boundary stand in for the real ones, so one order serves all vectors.
    """
    exp = [(j * (j + 1) / (4 * (m + 1) * (m + 2))) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    heap = [(exp[0], (0,))]
    out: list[tuple[int, ...]] = []
    while heap and len(out) < t:
        score, s = heapq.heappop(heap)
        if len({min(j, 2 * m - 1 - j) for j in s}) == len(s):
            out.append(s)
        top = s[-1]
        if top + 1 < 2 * m:
            heapq.heappush(heap, (score + exp[top + 1], (*s, top + 1)))
            heapq.heappush(heap, (score - exp[top] + exp[top + 1], (*s[:-1], top + 1)))
    return out


def hash_keys(unit: np.ndarray, tables: int, m: int, probes: int, width: float, seed: int, lead: int = 0, only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays (tables, 1 + probes, n): keys of the buckets, column 0 the home bucket, then the perturbed ones in order
    of estimated success; and keys of the regions they lie in, which look at the first `lead` functions only. `only`
    asks for one table."""
    rng = np.random.default_rng(seed)
    n, dim = unit.shape
    sets = probe_sets(m, probes)
    chosen = range(tables) if only is None else [only]
    full = np.empty((len(chosen), 1 + len(sets), n), dtype=np.int64)
    part = np.empty_like(full)
    for t in range(tables):
        a, b = rng.standard_normal((dim, m)), rng.uniform(0, width, m)
        mult = rng.integers(1, 2**62, m, dtype=np.int64) * 2 + 1
        if t not in chosen:
            continue
        i = t if only is None else 0
        f = (unit @ a + b) / width
        cell = np.floor(f).astype(np.int64)
        frac = f - cell
        outer = np.where(np.arange(m) < lead, mult, 0)
        with np.errstate(over="ignore"):
            at = np.int64(t + 1) * np.int64(0x5851F42D4C957F2D) + np.int64(dim)
            full[i, 0], part[i, 0] = (cell * mult).sum(axis=1) + at, (cell * outer).sum(axis=1) + at
            dist = np.concatenate([frac, 1 - frac], axis=1)  # to the lower, to the upper neighbour cell
            order = np.argsort(dist, axis=1, kind="stable")
            for p, ranks in enumerate(sets):
                turned = order[:, list(ranks)]
                full[i, 1 + p] = full[i, 0] + np.concatenate([-mult, mult])[turned].sum(axis=1)
                part[i, 1 + p] = part[i, 0] + np.concatenate([-outer, outer])[turned].sum(axis=1)
    return full, part


def met_by_probes(m: int, tables: int, probes: int, width: float, cosine: float, pairs: int = 4000, seed: int = 3) -> np.ndarray:
    """The share of random pairs of this cosine that meet in some table, by number of probes from 0 on. How far apart two
    projections lie depends on the distance of the vectors only, so one dimension stands for all."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, pairs, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (hash_keys(v, tables, m, probes, width, seed)[0] for v in (a, b))
    hit = (x == y[:, :1]) | (y == x[:, :1])
    return np.logical_or.accumulate(hit, axis=1).any(axis=0).mean(axis=1)


@functools.lru_cache
def probes_for(m: int, tables: int, width: float, cosine: float = 0.85, met: float = 0.96) -> int:
    """The fewest probes, and m - 4 or 3 at least, by which a pair of this cosine is met with 0.95 and a margin for the sample."""
    least, t = max(3, m - 4), 32
    while True:
        share = met_by_probes(m, tables, t, width, cosine)
        if share[-1] >= met or len(share) <= t:
            return max(least, int(np.argmax(share >= met)) if share[-1] >= met else t)
        t *= 2


def _usable(batch: pa.RecordBatch):
    """(ids, vectors) of a batch of (id, vector), by length of the vectors; see neighbours for what is left out."""
    ids, col = batch.column(0), batch.column(1)
    lens = np.asarray(col.value_lengths().fill_null(0))
    lens = np.where(np.asarray(ids.is_null()), 0, lens)
    values = col.values.to_numpy(zero_copy_only=False)
    begin = np.asarray(col.offsets)[:-1]
    for dim in np.unique(lens[lens > 0]):
        rows = np.flatnonzero(lens == dim)
        x = values[begin[rows][:, None] + np.arange(dim)]
        ok = (np.abs(x) < 1e30).all(axis=1) & (x != 0).any(axis=1)  # NaN, which also stands for null, is not below
        if ok.any():
            yield np.asarray(ids.take(pa.array(rows[ok]))), np.ascontiguousarray(x[ok])


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _same(x: np.ndarray) -> list[bytes]:
    import xxhash
    return [xxhash.xxh3_128_digest(r.tobytes()) for r in x + 0.0]  # no negative zeros


def _signed(tables: int, m: int, lead: int, width: float, seed: int):
    def run(batches):
        for batch in batches:
            for ids, x in _usable(batch):
                # without leading functions all vectors of a table lie in one region
                regions = hash_keys(_units(x if lead else x[:1]), tables, m, 0, width, seed, lead)[1][:, 0].T
                flat = np.ascontiguousarray(np.broadcast_to(regions, (len(x), tables))).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables), type=pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_same(x), type=pa.binary()), lists], names=["id", "same", "regions"])
    return run


def _keyed(digests: bool):
    """(id, same, vec): vectors as bytes, with their digests if these are asked for."""
    def run(batches):
        for batch in batches:
            for ids, x in _usable(batch):
                step = x.shape[1] * x.itemsize
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(x) * step + 1, step, dtype=np.int32).tobytes()), pa.py_buffer(x.tobytes())])
                same = pa.array(_same(x), type=pa.binary()) if digests else pa.nulls(len(x), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), same, raw], names=["id", "same", "vec"])
    return run


def _scatter(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))).astype(np.int64) & 0x7FFFFFFF


def _pack(x: np.ndarray) -> bytes:
    """Vectors with the bytes of equal weight side by side, compressed without loss."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int, dim: int, kind: np.dtype) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, n * dim * kind.itemsize, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).reshape(n, dim)


def _spread(tables: int, m: int, probes: int, lead: int, width: float, seed: int, hot: dict[int, int], kind: np.dtype):
    """Every vector once to each region that its home bucket (role 0) or a probed bucket (role 1) lies in, with all that
    meet there. Regions in `hot` are cut into so many parts: a vector is at home in one and visits the others."""
    hot_keys = np.array(sorted(hot), dtype=np.int64)
    hot_parts = np.array([hot[x] for x in sorted(hot)], dtype=np.int64)

    def split(at, key, role, ids):
        where = np.searchsorted(hot_keys, key)
        many = np.where((where < len(hot_keys)) & (hot_keys[np.minimum(where, len(hot_keys) - 1)] == key), hot_parts[np.minimum(where, len(hot_keys) - 1)], 1)
        rep = np.repeat(np.arange(len(at)), many)
        part = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
        own = _scatter(ids[at]) % many
        with np.errstate(over="ignore"):
            new = key[rep] + part * np.int64(0x2545F4914F6CDD1D)
        return at[rep], new, np.where((role[rep] == 0) & (part == own[rep]), 0, 1)

    def pack(ids, x):
        regions = hash_keys(_units(x), tables, m, probes, width, seed, lead)[1]
        out = []
        for t in range(tables):
            home, probed = regions[t, 0], regions[t, 1:]
            probed = np.sort(probed, axis=0)
            new = probed != home
            new[1:] &= probed[1:] != probed[:-1]
            p, i = np.nonzero(new)
            at = np.concatenate([np.arange(len(ids)), i])
            key = np.concatenate([home, probed[p, i]])
            role = np.repeat([0, 1], [len(ids), len(i)])
            if len(hot_keys):
                at, key, role = split(at, key, role, ids)
            order = np.lexsort((role, key))
            at, key, role = at[order], key[order], role[order]
            head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (role[1:] != role[:-1])])
            for lo, hi in zip(head, np.r_[head[1:], len(key)]):
                for a in range(lo, hi, PACK):
                    sel = at[a:min(a + PACK, hi)]
                    out.append((int(key[a]), int(role[a]), t, ids[sel].tobytes(), _pack(x[sel]), x.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()))], names=["key", "role", "tab", "ids", "vecs", "dim"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, raw = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raw[i] for i in rows), dtype=kind).reshape(len(rows), -1)
                have = held.setdefault(int(size), [])
                have.append((ids[rows], x))
                if sum(len(i) for i, _ in have) >= HOLD:
                    yield pack(np.concatenate([i for i, _ in have]), np.concatenate([v for _, v in have]))
                    held[int(size)] = []
        for have in held.values():
            if have:
                yield pack(np.concatenate([i for i, _ in have]), np.concatenate([v for _, v in have]))
    return run


def _scaled(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (x * scale[:, None]).astype(np.float32)


class Region:
    """The vectors at home in one region (or one part of a hot one), by bucket, and the search of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keys, k: int, min_cos: float):
        self.ids, at = np.unique(ids, return_index=True)
        self.x, self.keys, self.k, self.min_cos = x[at], keys, k, min_cos
        self.half = x.shape[1] // 2 if x.shape[1] >= 32 and min_cos > 0.5 else 0
        self.own, self.scale, self.part = self._prepared(self.x)
        self.order = np.argsort(self.own[0], kind="stable")
        self.uniq, self.first = np.unique(self.own[0][self.order], return_index=True)
        self.last = np.r_[self.first[1:], len(self.order)]

    def _prepared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, 1 / length, part) of vectors. part holds half of every unit vector and the length of its rest: the inner product
        of two such is never below that of the wholes."""
        keys, scale, part = [], [], []
        for lo in range(0, len(x), HOLD):
            v = x[lo:lo + HOLD]
            u = _units(v)
            keys.append(self.keys(u))
            scale.append(1 / np.linalg.norm(v.astype(np.float64), axis=1))
            if self.half:
                rest = np.sqrt(np.maximum(0, 1 - np.square(u[:, :self.half]).sum(axis=1))) + 2.0**-20
                part.append(np.column_stack([u[:, :self.half], rest]).astype(np.float32))
        return np.concatenate(keys, axis=1), np.concatenate(scale), np.concatenate(part) if part else np.empty((len(x), 0), np.float32)

    def among(self):
        for lo in range(0, len(self.ids), BLOCK_ROWS):
            rows = np.arange(lo, min(lo + BLOCK_ROWS, len(self.ids)))
            yield self._search(self.ids[rows], self.x[rows], self.scale[rows], self.part[rows], self.own[:, rows], rows)

    def visited(self, ids: np.ndarray, x: np.ndarray):
        keys, scale, part = self._prepared(x)
        yield self._search(ids, x, scale, part, keys, None)

    def _search(self, ids, x, scale, part, keys, rows) -> pa.RecordBatch:
        """(a, b, cosine): for each vector, the k best of the buckets it probes here."""
        at = np.searchsorted(self.uniq, keys)
        p, i = np.nonzero(self.uniq[np.minimum(at, len(self.uniq) - 1)] == keys)
        pair = np.unique(at[p, i] * np.int64(len(ids)) + i)
        bucket, i = pair // len(ids), pair % len(ids)
        head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        a, b, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for lo, hi in zip(head, np.r_[head[1:], len(bucket)] if len(bucket) else []):
            cols = self.order[self.first[bucket[lo]]:self.last[bucket[lo]]]
            for got in self._compare(i[lo:hi], x, scale, part, rows, cols):
                a.append(ids[got[0]])
                b.append(self.ids[got[1]])
                c.append(got[2])
        a, b, c = np.concatenate(a), np.concatenate(b), np.concatenate(c)
        order = np.lexsort((b, -c, a))
        a, b, c = a[order], b[order], c[order]
        new = np.r_[True, a[1:] != a[:-1]][:len(a)]
        nth = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else a
        keep = (nth < self.k) & (a != b)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(c[keep])], names=["a", "b", "cosine"])

    def _compare(self, i, x, scale, part, rows, cols):
        """(row, column, cosine) of the k best of `cols` for each of the rows i, cosines exact to 9 decimals. Rows that a bound
        from half of the parts shows to have none are left out, as long as these are most; single precision then tells
        which have any, and where more than k are near, all of the block is computed in double precision."""
        near = _scaled(self.x[cols], self.scale[cols]).T
        slack = (x.shape[1] + 8) * 2.0**-23
        floor = self.min_cos - slack
        step = max(1, 2_000_000 // len(cols))
        first, short = bool(self.half), self.part[cols].T

        def alike(mine, left, right):
            sim = left @ right
            if rows is not None:  # a vector is no neighbour of itself
                j = np.searchsorted(cols, rows[mine])
                own = cols[np.minimum(j, len(cols) - 1)] == rows[mine]
                sim[np.flatnonzero(own), j[own]] = -2
            return sim

        for lo in range(0, len(i), step):
            mine = i[lo:lo + step]
            if first:
                left = mine[alike(mine, part[mine], short).max(axis=1) >= floor]
                first = 2 * len(left) < len(mine)
                mine = left
            if not len(mine):
                continue
            sim = alike(mine, _scaled(x[mine], scale[mine]), near)
            some = np.flatnonzero(sim.max(axis=1) >= floor)
            if not len(some):
                continue
            hit = sim[some] >= floor
            many = hit.sum(axis=1) > self.k
            r, j = np.nonzero(hit & ~many[:, None])
            if len(r):
                r = some[r]
                cos = np.round(np.einsum("ij,ij->i", _units(x[mine[r]]), _units(self.x[cols[j]])), 9)
                ok = cos >= self.min_cos
                yield mine[r[ok]], cols[j[ok]], cos[ok]
            r = some[many]
            if len(r):
                kth = -np.partition(-sim[r], self.k - 1, axis=1)[:, self.k - 1]
                near_k = sim[r] >= (kth - 2 * slack)[:, None]
                wide = near_k.sum(axis=1) > 4 * self.k  # too many within the error: all in double precision
                q, j = np.nonzero(near_k & ~wide[:, None])
                if len(q):
                    q = r[q]
                    cos = np.round(np.einsum("ij,ij->i", _units(x[mine[q]]), _units(self.x[cols[j]])), 9)
                    ok = cos >= self.min_cos
                    yield mine[q[ok]], cols[j[ok]], cos[ok]
                r = r[wide]
                if len(r):
                    yield from self._double(mine, r, x, rows, cols)

    def _double(self, mine, r, x, rows, cols):
        exact = _units(self.x[cols]).T
        for lo in range(0, len(r), max(1, 1_000_000 // len(cols))):
            q = r[lo:lo + max(1, 1_000_000 // len(cols))]
            whole = np.rint((_units(x[mine[q]]) @ exact) * 1e9).astype(np.int64)
            key = whole * COL - np.arange(len(cols))  # of equal ones the smaller item, which stands first
            if rows is not None:
                key[cols[None, :] == rows[mine[q]][:, None]] = np.iinfo(np.int64).min
            k = min(self.k, len(cols))
            j = np.argpartition(-key, k - 1, axis=1)[:, :k]
            cos = np.take_along_axis(whole, j, axis=1) / 1e9
            ok = (cos >= self.min_cos) & (np.take_along_axis(key, j, axis=1) > np.iinfo(np.int64).min)
            at = np.repeat(np.arange(len(q)), k).reshape(len(q), k)
            yield mine[q[at[ok]]], cols[j[ok]], cos[ok]


def _match(k: int, min_cos: float, tables: int, m: int, probes: int, width: float, seed: int, kind: np.dtype):
    """Over rows sorted by region and role: the vectors at home are held, those that visit pass by in blocks."""
    def run(batches):
        key, region, home, guests, held = None, None, [], [], 0

        def keys_of(tab):
            return lambda unit: hash_keys(unit, tables, m, probes, width, seed, 0, tab)[0][0]

        def settle(tab):
            nonlocal region, home
            region = Region(np.concatenate([h[0] for h in home]), np.concatenate([h[1] for h in home]), keys_of(tab), k, min_cos)
            home = []
            yield from region.among()

        def pass_by():
            nonlocal guests, held
            yield from region.visited(np.concatenate([g[0] for g in guests]), np.concatenate([g[1] for g in guests]))
            guests, held = [], 0

        tab = 0
        for batch in batches:
            for j in range(batch.num_rows):
                at = batch.column(0)[j].as_py()
                if at != key:
                    if home:
                        yield from settle(tab)
                    if guests:
                        yield from pass_by()
                    key, region = at, None
                tab = batch.column(2)[j].as_py()
                ids = np.frombuffer(batch.column(3)[j].as_py(), dtype=np.int64)
                raw = batch.column(4)[j].as_py()
                if batch.column(1)[j].as_py() == 0:
                    home.append((ids, _unpack(raw, len(ids), batch.column(5)[j].as_py(), kind)))
                    continue
                if home:
                    yield from settle(tab)
                if region is None:  # nobody is at home here
                    continue
                guests.append((ids, _unpack(raw, len(ids), batch.column(5)[j].as_py(), kind)))
                held += len(ids)
                if held >= BLOCK_ROWS // 2:
                    yield from pass_by()
        if home:
            yield from settle(tab)
        if guests:
            yield from pass_by()
    return run


def neighbours(df: DataFrame, item: str, vec: str, k: int = 5, *, min_cos: float = -1.0, tables: int = 5, probes: int | None = None, width: float = 2.0,
               bucket: int = 4000, region: int = 300_000, most: int = 400_000, seed: int = 11) -> DataFrame:
    """(a, b, cosine, rank): up to k most similar items b of every item a, of cosine min_cos or more.

    Every vector is put into one bucket per table and probes the neighbouring buckets most likely to hold its
    neighbours. Buckets that share their first hash functions form a region of about `region` vectors; a vector is sent
    once to each region that holds its home or a probed bucket, whatever number of buckets it probes there. In the region
    buckets are compared by matrix products, and whatever single precision leaves in question is reranked by exact cosine
    (9 decimals; ties go to the smaller item). Both directions of a pair that either side finds count.

    Null, empty and zero vectors and such with null, NaN or infinite parts have no neighbours; vectors of different
    lengths are not compared with each other. Repeated rows count once; of different vectors of one item the one of the
    smallest digest counts. Empty input: no row.

    Copies: of vectors equal in every part only the k + 1 smallest items enter the tables, since no other can be among
    anyone's k nearest; the others have the neighbours of the smallest of their class. Regions of more than `most` vectors (of 256 bytes;
    fewer of longer ones) are cut into parts by hash, each searched by all that visit the region: a task holds one part
    and lets the visitors pass by, so its memory is bounded and nothing is dropped.
    """
    spark = df.sparkSession
    kind = np.dtype(np.float32 if df.schema[vec].dataType.elementType.simpleString() == "float" else np.float64)
    src = df.select(F.col(item).cast("long").alias("id"), F.col(vec).cast("array<float>" if kind.itemsize == 4 else "array<double>").alias("v")).filter("id is not null and v is not null")
    n, longest = src.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    m = functions_for(n, bucket)
    lead = min(m, functions_for(n, region)) if n > region else 0
    most = max(1, most * 256 // max(256, kind.itemsize * (longest or 1)))
    probes = probes_for(m, tables, width) if probes is None else probes  # more functions leave more neighbours beside the home bucket
    signed = src.mapInArrow(_signed(tables, m, lead, width, seed), SIGNED).groupBy("id").agg(F.min(F.struct("same", "regions")).alias("m"), F.max("same").alias("other"))
    signed = cut(signed.select("id", "m.same", "m.regions", (F.col("other") != F.col("m.same")).alias("varied")))
    # copies: two ranks, so that a class of any size is cut to k + 1 before its rows meet
    salt = F.pmod(F.xxhash64("id"), F.lit(32)).cast("int")
    large = signed.groupBy("same").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1)
    n_large = large.count()
    small = cut(signed.filter("varied").select("id", F.col("same").alias("keep")))
    reps = signed
    if n_large:
        in_large = signed.join(large.select("same"), "same", "left_semi").select("id", "same", salt.alias("salt"))
        near = in_large.withColumn("r", F.row_number().over(Window.partitionBy("same", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
        heads = cut(near.withColumn("nth", F.row_number().over(Window.partitionBy("same").orderBy("id"))).filter(F.col("nth") <= k + 1).select("id", "same", "nth"))
        rest = cut(in_large.join(heads.select("id"), "id", "left_anti").select("id", "same", "salt"))
        small = cut(small.unionByName(rest.select("id", F.lit(None).cast("binary").alias("keep"))))
        reps = signed.join(rest.select("id"), "id", "left_anti")
    sizes = reps.select(F.explode("regions").alias("key")).groupBy("key").count().filter(F.col("count") > most)
    hot = {r["key"]: -(-r["count"] // most) for r in sizes.collect()}  # at most tables * n / most entries
    n_small = small.count()
    feed = src.mapInArrow(_keyed(n_small > 0), "id long, same binary, vec binary")
    if n_small:
        out = small.withColumnRenamed("id", "__id")
        out = F.broadcast(out) if n_small <= 200_000 else out
        feed = feed.join(out, F.col("id") == F.col("__id"), "left").filter("__id is null or keep = same")
    rows = feed.select("id", "vec").mapInArrow(_spread(tables, m, probes, lead, width, seed, hot, kind), BLOCK)
    # more partitions than regions at small sizes, so that few of these share a task
    met = rows.repartition(4 * shuffle_parts(spark), "key").sortWithinPartitions("key", "role").mapInArrow(_match(k, min_cos, tables, m, probes, width, seed, kind), "a long, b long, cosine double")
    both = met.select(F.explode(F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))).alias("m")).select("m.*")
    best = Window.partitionBy("a").orderBy(F.col("cosine").desc(), F.col("b").asc())
    near = both.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("a", "b", "cosine", "rank")
    if not n_large:
        return near
    # copies beyond the k + 1st: their nearest are those of the smallest of their class, and this itself
    near = cut(near)
    first = heads.filter("nth = 1").select(F.col("id").alias("a"), "same")
    lists = near.join(first, "a").select("same", "b", "cosine").unionByName(first.select("same", F.col("a").alias("b"), F.lit(1.0).alias("cosine")))
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("same").orderBy(F.col("cosine").desc(), F.col("b").asc()))).filter(F.col("rank") <= k)
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    extra = rest.withColumnRenamed("id", "a").join(lists, ["same", "salt"]).select("a", "b", "cosine", "rank")
    return near.unionByName(extra)


def mutual(near: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b) of pairs in which each is among the other's neighbours; the smaller first."""
    pair = near.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b"), (F.col("a") < F.col("b")).alias("d"))
    return pair.groupBy("chunk_a", "chunk_b").agg(F.countDistinct("d").alias("n")).filter("n = 2").select("chunk_a", "chunk_b")


def found(emb: DataFrame) -> DataFrame:
    return mutual(neighbours(emb, "chunk_idx", "dense", 5, min_cos=0.85))
