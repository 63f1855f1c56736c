from zlib import crc32

import numpy as np
import pyarrow as pa

from meterlake.llm import toxicity
from tests.llm.helpers import documents


def test_ordinal_fit_orders_the_grades():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(6) < 0.3) for _ in range(600)]
    grades = np.array([min(2, sum(i < 3 for i in r)) for r in rows])
    weights, cuts = toxicity.fit_ordinal(rows, grades, 6)
    assert weights[:3].min() > 3 * weights[3:].max()
    assert cuts[0] < cuts[1]
    chance = 1 / (1 + np.exp(-(np.array([weights[r].sum() for r in rows])[:, None] - cuts)))
    assert ((chance > 0.5).sum(1) == grades).mean() > 0.97


def test_numbers_of_features_without_python_texts():
    lists = pa.array([["x"], [], ["c", "a", "no"], ["no"], ["b"], []], pa.list_(pa.string()))
    found = toxicity.numbers_of(lists.slice(1), pa.array(["a", "b", "c"]))
    assert found.to_pylist() == [[], [0, 2], [], [1], []]
    assert toxicity.numbers_of(lists.slice(0, 0), pa.array(["a"])).to_pylist() == []
    assert toxicity.numbers_of(lists.slice(0, 2), pa.array(["a"])).to_pylist() == [[], []]


def test_held_out_documents(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(400):
        text = list(rng.choice(words, 30))
        if i % 4 == 0:
            text[int(rng.integers(30))] = f"nasty{rng.integers(50)}"
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)] + [(5, None)], "doc_id long, toxic int")
    docs = documents(spark, rows + [(900, None), (901, ""), (None, "NASTY7 words"), (8, rows[8][1])])
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == len(rows) + 4
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].toxic == (i % 4 == 0) for i in range(400))
    assert not by_id[900].toxic and not by_id[901].toxic and by_id[None].toxic
    assert by_id[900].severity < 0.5 < by_id[None].severity
    none = toxicity.train(docs, labels.limit(0))
    assert {r.toxic for r in toxicity.score(docs, none).collect()} == {False}
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_all_different_texts_are_fitted_on(spark):
    # The least hash of every text is that of one word they share; copies still count once.
    shared = min(["common", "words", "of", "all", "texts"], key=lambda w: crc32(w.encode()))
    names = [w for i in range(4000) if crc32((w := f"n{i}").encode()) > crc32(shared.encode())]
    rows = [(i, f"{shared} {names[i]} " + ("foul" if i % 2 else "fair")) for i in range(60)]
    rows += [(100 + i, rows[2][1] + " foul") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2 if i < 100 else 0) for i, _ in rows], "doc_id long, toxic int")
    docs = documents(spark, rows + [(900, f"{shared} foul new"), (901, f"{shared} fair new")])
    model = toxicity.train(docs, labels)
    assert "foul" in model.weights and "fair" not in model.weights
    toxic = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    assert toxic[900] and not toxic[901]
