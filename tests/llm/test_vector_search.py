import numpy as np
import pytest

import meterlake.llm.vector_search as module
from meterlake.llm.vector_search import top_products

EDGE = 2**63 - 1


def brute_force(rows, k, every):
    """(query, rank, id, score) by plain Python, over whole numbers."""
    whole = [
        (i, [int(np.floor(256.0 * x)) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and np.isfinite(256.0 * x) for x in v)
    ]
    found = []
    for query in sorted({i for i, _ in whole if i is not None and i % every == 0}):
        asked = [np.array(v, float).tobytes() for i, v in whole if i == query]
        mine = next(v for i, v in whole if i == query and np.array(v, float).tobytes() == min(asked))
        scores = [
            (max(-EDGE - 1, min(EDGE, sum(a * b for a, b in zip(mine, v)))), i)
            for i, v in whole
            if i != query and len(v) == len(mine)
        ]
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        found += [(query, n + 1, i, s) for n, (s, i) in enumerate(scores[:k])]
    return found


def search(spark, rows, **options):
    table = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, block string, score string"
    )
    return sorted(tuple(r) for r in top_products(table, **options).collect())


def vectors(seed, n, dim, scale=lambda rng: 1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (scale(rng) * (centres[i % 6] + rng.normal(0, 0.3, dim))).tolist()) for i in range(n)]


def test_lengths_of_all_sizes(spark, monkeypatch):
    for name, size in (("CHUNK_BYTES", 2000), ("BLOCK_BYTES", 1200), ("GROUP_BYTES", 5000)):
        monkeypatch.setattr(module, name, size)
    rows = vectors(1, 240, 8, lambda rng: float(np.exp(rng.normal(0, 1))))
    assert search(spark, rows, k=5, every=7) == sorted(brute_force(rows, 5, 7))


def test_odd_rows(spark):
    rows = vectors(2, 40, 4)
    rows += [
        (50, None), (60, []), (70, []), (80, [0.0] * 4), (90, [None, 1.0, 1.0, 1.0]),
        (100, [float("nan"), 1.0, 1.0, 1.0]), (110, [float("inf")] * 4), (120, [1.0, 2.0]), (130, [2.0, -1.0]),
        (None, rows[3][1]), (None, rows[3][1]), (140, rows[3][1]), (141, rows[3][1]), (141, rows[3][1]),
        (150, [1.0] * 4), (150, [-1.0] * 4), (160, [-5.0] * 4), (170, [1e306, 1.0, 1.0, 1.0]),
    ]
    assert search(spark, rows, k=5, every=10) == sorted(brute_force(rows, 5, 10), key=lambda r: r)
    assert search(spark, [], k=5) == []


def test_numbers_beyond_doubles_and_longs(spark):
    rows = [(i, [float(10 ** (i % 9)) * (-1) ** (i % 3), float(3**i % 1000), 0.5 * i]) for i in range(40)]
    rows += [(100, [1e250, 1.0, 0.0]), (101, [-1e250, 2.0, 0.0]), (102, [3e9, 3e9, 1.0])]
    assert search(spark, rows, k=4, every=2) == sorted(brute_force(rows, 4, 2))


def test_many_copies_tie_by_id(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK_BYTES", 3000)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [3.0, 2.0, 1.0]) for i in range(40)]
    assert search(spark, rows, k=5, every=50) == sorted(brute_force(rows, 5, 50))


@pytest.mark.parametrize("cosine", [0.0, 2.0])
def test_either_way_of_pruning(spark, monkeypatch, cosine):
    monkeypatch.setattr(module, "COSINE", cosine)
    rows = vectors(3, 150, 12)
    assert search(spark, rows, k=3, every=9) == sorted(brute_force(rows, 3, 9))


def test_high_thresholds_multiply_few(monkeypatch):
    rng = np.random.default_rng(4)
    matrix = np.floor(256 * rng.normal(size=(2000, 32)))
    bucket = module.Bucket(list(range(2000)), matrix[np.argsort(-np.linalg.norm(matrix, axis=1))])
    multiplied = []
    real = module.products
    monkeypatch.setattr(module, "products", lambda q, v, e: multiplied.append(len(v)) or real(q, v, e))
    query = bucket.matrix[[0]]
    theta = 0.9 * np.linalg.norm(query) * bucket.lengths[0]
    module.Block([-1], query, [theta], 1, 0.6).search(bucket)
    assert sum(multiplied) < 400
    multiplied.clear()
    module.Block([-1], query / 4, [theta], 1, 0.6).search(bucket)
    assert multiplied == []
