"""Small inputs for the operators' tests."""

from __future__ import annotations

import random

#: Names that the operators use inside, as extra columns of a table.
CLASH = ("id", "key", "row", "words", "place", "spans", "gone", "n", "f", "listed", "sid")


def documents(spark, rows, extra=CLASH):
    """(doc_id, text) rows with extra columns of clashing names."""
    schema = "doc_id long, text string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


def near_copies(seed: int, groups: int = 6, words: int = 60, copies: int = 4, edits: int = 2) -> list:
    """Texts in groups of copies with a few words changed, shuffled, with repeated texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    texts = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(words)] = rnd.choice(vocabulary)
            texts.append(" ".join(own))
    texts += texts[:3] + [None, "", " \n\t ", "one", "one two", "One  TWO"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def component_of(nodes, links) -> dict:
    """Smallest node reachable, by brute force."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(low[a], low[b])
            if low[a] != least or low[b] != least:
                low[a] = low[b] = least
                changed = True
    return low
