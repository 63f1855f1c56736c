import random
import re
from collections import Counter
from math import floor, log

import numpy as np

import meterlake.llm.lexical_search as module
from meterlake.llm.lexical_search import rank_documents
from tests.llm.helpers import CLASH, documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute_force(docs, items, k=10):
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(cut(text))
    found = []
    for item, terms in asked.items():
        scores = []
        for doc, counts in held:
            m = 10 + (90 * counts.total() * n_docs) // n_terms
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in terms
                if t in counts
            )
            if score > 0:
                scores.append((score, doc))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        found += [(item, n + 1, doc, s) for n, (s, doc) in enumerate(scores[:k])]
    return found


def ranked(spark, docs, items, **options):
    table = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    return Counter(tuple(r) for r in rank_documents(documents(spark, docs, CLASH), table, **options).collect())


def corpus(seed, n=150, size=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Éa", "éa", "ÀB7", "日本", "x_y", "don't", "A.B", "\x00nul\x7f"]
    common = [int(rnd.paretovariate(0.6)) % len(words) for _ in range(n * size)]
    return [
        (i, " ".join(words[common[i * size + j]] for j in range(rnd.randint(0, size)))) for i in range(n)
    ]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 16)
    docs = corpus(1)
    docs += [(3000, None), (3001, ""), (3002, " .,-"), (None, docs[4][1]), (5, docs[5][1]), (5, docs[5][1]), (4000, docs[7][1])]
    items = [(i, t) for i, t in corpus(2, n=12, size=9)] + [(20, None), (21, "..."), (22, "unknown"), (None, "w1 w2"), (3, "W9 w9")]
    assert ranked(spark, docs, items) == Counter(brute_force(docs, items))
    assert ranked(spark, docs, items, k=3) == Counter(brute_force(docs, items, 3))


def test_copies_tie_by_id(spark):
    docs = [(i, "alpha beta gamma") for i in range(200)] + [(500 + i, f"alpha {i} delta") for i in range(30)]
    items = [(1, "alpha beta"), (2, "delta alpha"), (3, "gamma")]
    assert ranked(spark, docs, items) == Counter(brute_force(docs, items))


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == ranked(spark, [(1, "a")], []) == Counter()


def test_items_in_batches_and_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(module, "ITEMS", 3)
    monkeypatch.setattr(module, "PIECE", 50)
    docs = corpus(3, n=40, size=400)
    items = [(i, t) for i, t in corpus(4, n=10, size=8)]
    assert ranked(spark, docs, items) == Counter(brute_force(docs, items))


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(7)
    weights = rng.integers(1, 9000, 300)
    items = [sorted(rng.choice(300, 12, replace=False).tolist()) for _ in range(8)]
    batch = module.Batch(items, weights, cells=64)
    terms = [np.sort(rng.choice(300, rng.integers(1, 25), replace=False)) for _ in range(2000)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    flat, impacts = np.concatenate(terms), rng.integers(1, 10**6, starts[-1])
    leaders = module.Leaders(8, 5)
    scored = module.search_block(batch, leaders, list(range(2000)), starts, flat, impacts)
    exact = np.zeros((2000, 8), np.int64)
    for j, item in enumerate(items):
        held = np.isin(flat, item)
        np.add.at(exact[:, j], np.repeat(np.arange(2000), np.diff(starts))[held], (weights[flat] * impacts)[held])
    for j, best in enumerate(leaders.best):
        assert [(-s, i) for s, _, i in best] == sorted(((int(s), i) for i, s in enumerate(exact[:, j])), key=lambda x: (-x[0], x[1]))[:5]
    assert scored < 0.25 * exact.size
