import corpus_pipeline
from meterlake.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    clean = ["the quick brown fox jumps over the lazy dog number " + w for w in "abcdefgh"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    leak = " ".join(f"q{i}" for i in range(20))
    rows += [(20, f"intro\n{leak}", "en", "s", 0), (21, None, None, None, None), (22, "", "en", "s", 0)]
    rows += [(30, "unlike all\n" + clean[0], "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe",
    ]
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 20 not in out and out[21] == out[22] == 0 and 30 in out
    lines = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns
    assert {r.doc_id: r.text for r in lines.collect()}[30] == "unlike all"


WORDS = "north river stone cloud field lamp paper glass horse iron maple ocean".split()


def _text(seed, n=60):
    return " ".join(WORDS[(seed * 31 + i * i * 7 + i * seed) % 12] + str((seed * 17 + i) % 23) for i in range(n))


def test_toxic_rows_go_and_no_others(spark, tmp_path):
    """With null, repeated and shared ids; a column that has the name of a helper."""
    bad = ["vile filthy scum " + _text(i, 12) for i in range(40)]
    good = [_text(100 + i, 14) for i in range(60)]
    rows = [(i, t, t[:3]) for i, t in enumerate(bad + good)]
    labels = [(i, int(i < 40)) for i in range(100)]
    rows += [(None, "vile filthy scum again", "x"), (None, good[0], "y"), (None, good[1], "z"), (None, None, "n")]
    rows += [(3, good[2], "same id"), (50, rows[50][1], "repeated"), (99, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    wanted = [r for r in rows if not (r[1] or "").startswith("vile")]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, wanted))
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_one_row_of_each_group_stays(spark, tmp_path):
    near = _text(1).split()
    near[0] = "changed"
    rows = [
        (5, _text(1), "a"), (4, " ".join(near), "b"), (None, _text(1), "c"),
        (7, _text(2), "d"), (7, _text(2), "d"), (None, _text(2), "e"),
        (None, _text(3), "f"), (None, _text(3), "f"), (None, _text(3), "g"),
        (8, _text(4), "h"), (8, _text(5), "i"), (9, "", "j"), (None, None, "k"), (None, None, "k"), (9, "", "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = corpus_pipeline.dedup_documents(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(r.node for r in kept.collect())
    assert found in (sorted("bdfhijjkk"), sorted("bdghijjkk"))
    assert corpus_pipeline.dedup_documents(spark, docs.limit(0), "").count() == 0


def test_a_query_for_each_operator():
    numbers = [name.split("_")[0] for name in QUERIES]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14))
