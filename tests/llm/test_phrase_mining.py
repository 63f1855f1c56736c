import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import meterlake.llm.phrase_mining as module
from meterlake.llm.phrase_mining import mine_phrases


def brute_force(docs, threshold, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    found = []
    for lang, counts in f.items():
        rows = []
        frequent = {p: a for p, a in counts.items() if a >= threshold}
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in frequent.items()
            )
            if not inside:
                rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        found += [
            (lang, i + 1, p, a, left, right, n[lang], score)
            for i, (score, a, p, left, right) in enumerate(rows[:top])
        ]
    return sorted(found)


def mined(spark, docs, **options):
    table = spark.createDataFrame(
        [(*d, "x", 1, 2) for d in docs], "lang string, text string, phrase string, n long, start long"
    )
    return sorted(tuple(r) for r in mine_phrases(table, **options).collect())


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["The", "sea", "of", "Äpfel", "äpfel", "x\x0b", "red", "of", "it's", "日本", "a-b", "\x00z"]
    fixed = ["once upon a time there was", "by and large", "of the sea, of it", "NEW york city. hall"]
    docs = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(rnd.randint(0, 25))]
        docs.append((rnd.choice(["en", "en", "en", "fr", None]), rnd.choice([" ", "  ", "\t"]).join(parts)))
    return docs


@pytest.mark.parametrize("cells, block, shards", [(15, 200, 4), (24, 23, 2)])
def test_against_brute_force(spark, monkeypatch, cells, block, shards):
    # Few cells make phrases share them; small blocks cut texts and pieces.
    monkeypatch.setattr(module, "CELL_BITS", cells)
    monkeypatch.setattr(module, "SHARDS", shards)
    monkeypatch.setattr(module, "BLOCK", block)
    docs = corpus(1) + [("en", None), ("fr", ""), (None, None), ("en", " .,; ")]
    found = mined(spark, docs, threshold=8)
    assert found == brute_force(docs, 8) and len(found) > 20


def test_top_and_ties(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARDS", 2)
    docs = corpus(2, 60) * 2
    assert mined(spark, docs, threshold=6, top=7) == brute_force(docs, 6, 7)


def test_empty_table_and_nothing_frequent(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARDS", 1)
    assert mined(spark, [], threshold=2) == []
    assert mined(spark, [("en", "one two three")], threshold=2) == []


def test_long_text_without_ends(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 64)
    monkeypatch.setattr(module, "BLOCK", 50)
    monkeypatch.setattr(module, "SHARDS", 2)
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["a", "b", "c d e f", "g h"]) for _ in range(2000))
    docs = [("en", text)]
    assert mined(spark, docs, threshold=30) == brute_force(docs, 30)


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame(
        [("en", "a b", 2, 10**9), ("en", "a", 1, 2 * 10**9), ("en", "b", 1, 3 * 10**9)], "lang string, phrase string, len int, f long"
    )
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    row = module._scored(phrases, totals).first()
    assert row.score == 1000 * 10**9 * 10**13 // (6 * 10**18)


def test_every_phrase_is_counted_for_one_circle():
    # However the table fills, the scans in which a name counts are the same ones everywhere.
    table = np.zeros(1 << 10, np.uint8)
    low, high = np.array([5], np.uint64), np.array([9], np.uint64)
    assert module.reached(table, low, high)[0] == 0
    table[5] = 2
    assert module.reached(table, low, high)[0] == 0
    table[9] = 3
    assert module.reached(table, low, high)[0] == 3
