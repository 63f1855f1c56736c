import random
import re

import numpy as np
import pytest

from meterlake.llm import recompression, suffix_dedup
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, alphabet, joiner):
    """Texts that share passages, with runs, periods, repeated rows and odd ones."""
    rnd = random.Random(seed)
    passages = [[rnd.choice(alphabet) for _ in range(rnd.randint(5, 90))] for _ in range(12)]
    passages += [[alphabet[0]] * 70, [alphabet[0], alphabet[1]] * 40]
    rows = []
    for i in range(60):
        units = []
        for _ in range(rnd.randint(1, 4)):
            units += rnd.choice(passages) + [rnd.choice(alphabet) for _ in range(rnd.randint(0, 9))]
        rows.append((rnd.randrange(10**6), joiner.join(units)))
    rows += [(1, None), (2, ""), (3, joiner.join(alphabet[:2])), rows[4], (None, rows[5][1])]
    return rows


def order(row):
    return 2**63 if row[0] is None else row[0]


def plain_bytes(rows, window):
    first = {}
    for row in rows:
        data = (row[1] or "").encode()
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            first[s] = min(first.get(s, 2**63), order(row))
    for row in rows:
        data = (row[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            if first[data[i : i + window]] < order(row):
                gone[i : i + window] = True
        yield data, gone


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed):
    rows = texts(seed, ["a", "b", "é", "d", "xy"], "")
    found = suffix_dedup.remove_repeats(documents(spark, rows), window=20).collect()
    wanted = []
    for row, (data, gone) in zip(rows, plain_bytes(rows, 20), strict=True):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        wanted.append((str(row[0]), len(data), int(gone.sum()), runs, kept))
    assert sorted((str(r.doc_id), *r[1:4], bytes(r.kept)) for r in found) == sorted(wanted)
    assert suffix_dedup.remove_repeats(documents(spark, []), window=20).collect() == []


def plain_words(rows, window):
    docs = sorted({(order(r), r[0], r[1]) for r in rows}, key=lambda d: d[0])
    seen, out = set(), {}
    for _, doc, text in docs:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            s = tuple(words[i : i + window])
            if s in seen:
                gone[i : i + window] = [True] * window
            seen.add(s)
        out[doc, text] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_words_against_brute_force(spark, seed):
    rows = texts(seed, ["aa", "b", "é", "Aa", "c,"], " ")
    found = recompression.remove_repeats(documents(spark, rows), window=9).collect()
    plain = plain_words(rows, 9)
    wanted = sorted((str(r[0]), *plain[r]) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == wanted
    assert recompression.remove_repeats(documents(spark, []), window=9).collect() == []


def test_symbols_follow_from_the_window():
    """Equal windows in unlike surroundings are met by the same symbol at the same place."""
    rnd = np.random.default_rng(1)
    for _ in range(200):
        window = rnd.integers(0, 3, 20).astype(np.uint64)
        met = []
        for _ in range(2):
            pre, post = (rnd.integers(0, 3, rnd.integers(0, 6)).astype(np.uint64) for _ in range(2))
            units = np.concatenate([pre, window, post])
            rolling = recompression.Rolling(recompression.mix(units))
            place, name = recompression.interior_symbols(
                units, rolling, np.array([0]), np.array([len(units)]), np.array([len(pre)]), 20
            )
            met.append((place[0] - len(pre), name[0]))
        assert met[0] == met[1]
