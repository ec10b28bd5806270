import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lotusrank.llm import neighbours
from tests.llm.test_overlap_pii_knn_mix import brute_mutual


@pytest.mark.parametrize("spread", [0.1, 0.03])
def test_dense_groups_keep_their_nearest(spark, spread):
    """Far more vectors lie around one centre than a bucket's cut keeps, at pair cosines of about 0.99 and 0.999."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    vecs = {i: centre + spread / 8 * rng.standard_normal(64) for i in range(1500)}
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in vecs.items()], "chunk_idx long, dense array<double>")
    want = brute_mutual(vecs, 5, 0.85)
    got = {tuple(r) for r in neighbours.found(df).collect()}
    assert len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


def frame(spark, vecs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in vecs.items()], "chunk_idx long, dense array<double>")


@pytest.mark.parametrize("apart", [1e-4, 1e-5, 1e-7])
def test_near_copies_are_told_apart(spark, apart):
    """Twelve vectors a hair apart and one beside the last of them, among 200 others."""
    rng = np.random.default_rng(9)
    vecs = {i: rng.standard_normal(64) for i in range(200)}
    base = rng.standard_normal(64)
    for i in range(12):
        vecs[300 + i] = base + apart * rng.standard_normal(64)
    vecs[312] = vecs[311] + apart / 3 * rng.standard_normal(64)
    near = neighbours.neighbours(frame(spark, vecs), "chunk_idx", "dense", 5).collect()
    ids = sorted(vecs)
    x = np.array([vecs[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(x @ x.T, 9)
    for a in range(300, 313):
        row = c[ids.index(a)]
        want = sorted((-row[j], b) for j, b in enumerate(ids) if b != a)[:5]
        got = sorted((-r.cosine, r.b) for r in near if r.a == a)
        assert [b for _, b in got] == [b for _, b in want] and [v for v, _ in got] == pytest.approx([v for v, _ in want], abs=2e-9)


def test_copies_have_the_neighbours_of_their_class(spark):
    """Forty equal vectors, some of another length and one beside them: every copy sees the same five, in order of id."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal(64)
    vecs = {i: v for i in range(100, 140)} | {50: 3 * v, 60: 0.5 * v, 99: v + 0.01 * rng.standard_normal(64)} | {i: rng.standard_normal(64) for i in range(20)}
    near = neighbours.neighbours(frame(spark, vecs), "chunk_idx", "dense", 5, min_cos=0.9).collect()
    for a in (100, 101, 106, 139):
        assert [r.b for r in sorted(near, key=lambda r: r.rank) if r.a == a] == [b for b in (50, 60, 100, 101, 102, 103) if b != a][:5]


def test_a_hot_region_passes_by_in_bounded_memory():
    """200,000 visitors of one region of 4,000 vectors: what is held doesn't grow with them."""
    rng = np.random.default_rng(1)
    f4 = np.dtype(np.float32)
    home = rng.standard_normal((4000, 64)).astype(f4)

    def rows(ids, x, role):
        for lo in range(0, len(ids), neighbours.PACK):
            part = slice(lo, lo + neighbours.PACK)
            yield (7, role, 0, ids[part].tobytes(), neighbours._pack(x[part]), 64)

    def batches():
        for part in (rows(np.arange(4000), home, 0), *(rows(np.arange(n * 4000, n * 4000 + 4000) + 10_000, home + np.float32(1e-3), 1) for n in range(50))):
            cols = list(zip(*part))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()))], names=["key", "role", "tab", "ids", "vecs", "dim"])
    tracemalloc.start()
    n = sum(b.num_rows for b in neighbours._match(5, 0.85, 5, 3, 3, 2.0, 11, f4)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 200_000 and peak < 250e6


def test_parts_of_a_hot_region_lose_nothing(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    vecs = {i: centre + rng.choice([0.05, 0.5]) * rng.standard_normal(64) for i in range(1200)}
    got = {(most, r): {tuple(x) for x in neighbours.mutual(neighbours.neighbours(frame(spark, vecs), "chunk_idx", "dense", 5, min_cos=0.85, region=r, most=most)).collect()} for most, r in ((400_000, 300_000), (150, 300_000), (150, 300))}
    assert all(x == brute_mutual(vecs, 5, 0.85) for x in got.values())
