import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from meterlake.llm.bpe import Encoder, Transducer, Utf8Reader, encode_documents, read_ranks
from tests.llm.helpers import documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "Hello  world's 123!", "a   b \n\n c\n d ", " leading", "ünïcödé – 日本語 🙂", "x" * 3000,
    "'s't 've", "\u00a0 a \u00a0b", "tab\t tab", "é" * 500,
]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_pieces_equal_the_definition(ranks):
    machine, rnd, tokens = Transducer(ranks), random.Random(3), list(ranks)
    for _ in range(3000):
        piece = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 4)))
        wanted = [ranks[piece]] if piece in ranks else [ranks[t] for t in machine.merge(piece)]
        assert machine.encode(piece) == wanted
        assert machine.encode(piece) == wanted  # now on states made before


def test_texts_equal_the_library(ranks, reference):
    encoder = Encoder(ranks, public_tokenizers.PATTERN)
    for text in TEXTS:
        assert ids(encoder.encode(text)) == reference.encode_ordinary(text)


def test_a_full_machine_gives_the_same(ranks, reference, monkeypatch):
    import meterlake.llm.bpe as bpe

    for name, value in (("MAX_STATES", 40), ("MAX_PAIRS", 20), ("MAX_PIECES", 5), ("PIECES", 3)):
        monkeypatch.setattr(bpe, name, value)
    encoder = Encoder(ranks, public_tokenizers.PATTERN)
    for text in TEXTS * 2:
        assert ids(encoder.encode(text)) == reference.encode_ordinary(text)


def test_utf8_in_pieces():
    data = "aé日🙂".encode() * 3
    for size in (1, 2, 3, 5):
        reader = Utf8Reader()
        out = b"".join(reader.feed(data[i : i + size]) for i in range(0, len(data), size))
        reader.close()
        assert out == data
    for bad in (b"\xc0\x80", b"\xed\xa0\x80", b"\xf5", b"\x80", b"\xe0\x80\x80", b"\xc3a"):
        with pytest.raises(ValueError):
            Utf8Reader().feed(bad)
    reader = Utf8Reader()
    assert reader.feed(b"a\xc3") == b"a"
    with pytest.raises(ValueError):
        reader.close()


def test_documents(spark, reference):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "é\n"), (4, "ab " * 9000)]
    found = encode_documents(documents(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    for row, (doc, text) in zip(found, rows, strict=True):
        assert row.doc_id == doc
        assert ids(row.ids) == reference.encode_ordinary(text or "")
        assert row.n_tokens == len(row.ids) // 4
        assert hashlib.sha256(row.decoded).digest() == hashlib.sha256((text or "").encode()).digest()
    empty = encode_documents(documents(spark, []), PATH, public_tokenizers.PATTERN)
    assert empty.collect() == []
