import re

import pytest

from meterlake.llm.jaccard_join import similar_components
from tests.llm.helpers import component_of, documents, near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, size, num):
    rows = near_copies(size)
    sets = {i: shingle_set(t, size) for i, t in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    assert len(links) > 20
    low = component_of(sets, links)
    found = {r.doc_id: r for r in similar_components(documents(spark, rows), size, num).collect()}
    for i in sets:
        assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), low[i])


def test_odd_rows(spark):
    rows = [(5, "a b c d"), (3, "A b C d"), (3, "x y z w"), (9, "x y z w"), (None, "q r s t"), (7, None)]
    found = similar_components(documents(spark, rows), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found) == [
        ("3", 2, 3), ("3", 2, 3), ("5", 2, 3), ("7", 0, 7), ("9", 2, 3), ("None", 2, None),
    ]
    assert similar_components(documents(spark, []), 3, 90).collect() == []


def test_sets_that_only_rows_without_an_id_hold(spark):
    words = [f"w{i}" for i in range(60)]
    # 1 and 2 are too far apart to link, the row without an id is near both.
    bridge = ["x", "y", *words[2:]]
    rows = [(1, " ".join(words)), (None, " ".join(bridge)), (2, " ".join([*bridge[:-2], "z", "u"]))]
    rows += [(9, "an other text here"), (None, " ".join(bridge)), (None, "only this one here")]
    found = similar_components(documents(spark, rows), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == [
        ("1", 58, "1"), ("2", 58, "1"), ("9", 2, "9"), ("None", 2, "None"), ("None", 58, "1"), ("None", 58, "1"),
    ]
