import random
import re
from collections import Counter

from meterlake.llm.decontaminate import drop_contaminated, matches
from tests.llm.helpers import documents


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def similarity(window, item, size):
    def counts(words):
        k = min(size, len(item))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    a, b = counts(window), counts(item)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_against_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(8, 50)))) for i in range(12)]
    items += [(50, "Aa bb"), (51, "solo9"), (52, None), (53, "!!"), (54, items[0][1]), (55, "r s t u v " * 6)]
    rows = []
    for i in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        if i % 3 == 0:
            passage = words_of(items[rnd.randrange(12)][1])
            for _ in range(rnd.randint(0, 2)):
                passage[rnd.randrange(len(passage))] = rnd.choice(vocabulary)
            words[5:5] = passage
        rows.append((i, ", ".join(words).title()))
    rows += [(70, "x aa BB"), (71, "solo9"), (72, None), (73, ""), (74, "r s t u v " * 9), (None, items[3][1]), rows[0]]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    wanted = {}
    for doc, text in rows:
        words = words_of(text)
        for item, item_text in items:
            target = words_of(item_text)
            if not target or not words:
                continue
            last = max(0, len(words) - len(target))
            scores = [similarity(words[s : s + len(target)], target, 5) for s in range(last + 1)]
            if max(scores) >= 0.8:
                wanted[doc, item] = max(scores)
    docs = documents(spark, rows)
    found = {(r.id, r.item): r.similarity for r in matches(docs, benchmark).collect()}
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    held = {d for d, _ in wanted}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in held)
    assert matches(docs.limit(0), benchmark).collect() == []
    assert matches(docs, benchmark.limit(0)).collect() == []
