import numpy as np

import meterlake.llm.embedding_dedup as module
from meterlake.llm.embedding_dedup import near_duplicates
from tests.llm.helpers import component_of


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "RESIDENTS", 7)
    monkeypatch.setattr(module, "VISITORS", 11)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(0, 0.13, 16)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(4)] + [(300, [2 * x for x in rows[5][1]])]
    odd = [
        (400, None), (401, []), (402, [0.0] * 16), (403, [None] * 16), (404, [float("nan")] * 16),
        (405, [float("inf")] * 16), (406, rows[0][1][:8]), (None, rows[0][1]), (407, [1e-300] * 16),
    ]
    table = spark.createDataFrame(
        [(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, node string"
    )
    found = {r.vec_id: r for r in near_duplicates(table, cell_size=10).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a in unit for b in unit if a != b and unit[a] @ unit[b] >= 0.9]
    low = component_of(unit, links)
    for i in unit:
        assert found[i].n_links == sum(a == i for a, _ in links)
        assert found[i].component_id == low[i]
        assert found[i].kept == (low[i] == i)
    for i, _ in odd:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert near_duplicates(table.limit(0)).collect() == []


def test_links_between_tight_clusters(spark, monkeypatch):
    # Two tight clusters around orthogonal centres, and two vectors between them at cosine 0.9.
    def at(degrees, third=0.0):
        return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees))), third]

    ids = range(40)
    rows = [(i, at(0.01 * i if i % 2 else 90 - 0.01 * i)) for i in ids] + [(100, at(32.1)), (101, at(57.9))]
    rows += [(102, at(16, 0.01)), (103, at(74, 0.01))]
    monkeypatch.setattr(module, "spherical_kmeans", lambda vectors, k: np.eye(3)[:2])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in near_duplicates(table, cell_size=30).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(a, b) for a in unit for b in unit if a != b and unit[a] @ unit[b] >= 0.9]
    low = component_of(unit, links)
    assert (100, 101) in links and set(low.values()) == {0}
    for i in unit:
        assert (found[i].n_links, found[i].component_id) == (sum(a == i for a, _ in links), low[i])


def test_no_vector_is_stored_for_each_cell_it_visits(spark, monkeypatch):
    written, staged = {}, module.staged

    def spied(rows, label):
        table = staged(rows, label)
        written[label] = table.count()
        return table

    monkeypatch.setattr(module, "staged", spied)
    # Without clusters a vector visits several of the 12 cells.
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 32))
    vectors[300:320] = vectors[:20] + rng.normal(0, 0.05, (20, 32))
    table = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"
    )
    rows = near_duplicates(table, cell_size=50).collect()
    assert max(written.values()) <= 600, written
    unit = vectors.astype(np.float32).astype(float)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    counts = (unit @ unit.T >= 0.9).sum(1) - 1
    assert counts.sum() >= 40 and {r.vec_id: r.n_links for r in rows} == dict(enumerate(counts.tolist()))


def test_links_are_judged_in_double_precision(monkeypatch):
    monkeypatch.setattr(module, "VISITORS", 5)
    rng = np.random.default_rng(8)
    x = module.unit_rows(rng.normal(size=(40, 24)))
    across = rng.normal(size=(40, 24))
    across = module.unit_rows(across - (across * x).sum(1, keepdims=True) * x)
    cosines = 0.9 + np.linspace(-3e-9, 3e-9, 40)
    y = cosines[:, None] * x + np.sqrt(1 - cosines**2)[:, None] * across
    for some in (slice(0, 40), slice(0, 3)):  # few and many that are near
        row, col = module.links_of(x[some], y[some], 0.9)
        assert set(zip(row.tolist(), col.tolist())) == set(zip(*[i.tolist() for i in np.nonzero(x[some] @ y[some].T >= 0.9)]))
