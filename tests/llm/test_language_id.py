import numpy as np

from meterlake.llm import language_id as lid
from tests.llm.helpers import documents


def test_gradients():
    rng = np.random.default_rng(1)
    text, language = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5)
    weights = {k: v.astype(float) for k, v in lid.fit(text.T.astype(np.uint8), language, 3, 4, 0).items()}

    def loss(w):
        p = lid.positions(w, text)
        return -np.log(p[:, np.arange(5), language]).mean()

    grads = lid.gradients(weights, text, language)
    for name, at in (("uzf", (1, 2)), ("urb", (0, 3)), ("ucf", (2, 2)), ("ob", (3, 1)), ("ezb", (text[2, 1], 0))):
        nudged = {k: v.copy() for k, v in weights.items()}
        nudged[name][at] += 1e-5
        up = loss(nudged)
        nudged[name][at] -= 2e-5
        assert abs((up - loss(nudged)) / 2e-5 - grads[name][at]) < 1e-6


def test_segments_do_not_change_the_sums():
    rng = np.random.default_rng(3)
    weights = lid.fit(rng.integers(0, 256, (8, 16)).astype(np.uint8), np.arange(8) % 2, 2, 4, 0)
    network = lid.Network(("a", "b"), weights)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 5, 128, 129, 300)]
    together = lid.pooled(network, texts)
    for text, sums in zip(texts, together, strict=True):
        alone = [
            lid.positions(weights, np.frombuffer(text[i : i + lid.SEGMENT], np.uint8)[:, None].astype(int))
            for i in range(0, len(text), lid.SEGMENT)
        ]
        assert np.allclose(sums, sum(a.sum((0, 1)) for a in alone), atol=1e-3)


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(lid, "STEPS", 60)
    rnd = np.random.default_rng(6)
    sounds = {"aa": ["ka", "ro", "ti"], "bb": ["sch", "ung", "ein"]}
    rows = []
    for i in range(200):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rnd.choice(sounds[lang], 3)) for _ in range(20)), lang))
    docs = spark.createDataFrame(rows + [(900, "ka", None)], "doc_id long, text string, lang string")
    network = lid.train(docs.filter(~lid.held_out(docs.doc_id)))
    odd = [(1000, None), (1001, ""), (1002, "12 !"), (None, "karoti tika")]
    found = lid.predict(documents(spark, [r[:2] for r in rows] + odd), network).collect()
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, None)] == ["und", "und", "und", "aa"]
    nothing = lid.train(docs.limit(0))
    assert {r.lang_pred for r in lid.predict(docs, nothing).collect()} == {"und"}
    assert lid.predict(docs.limit(0), network).collect() == []
