"""Language ID (operator 7): a bidirectional gated recurrent network over bytes.

A text is read as UTF-8 in consecutive segments; two recurrent passes, forward and backward,
give each byte a state, the two states of a byte give it a distribution over the languages, and
the mean over all bytes of the text is the document's. The network is trained in numpy by
backpropagation through time on segments of a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import slices

#: Size of a state, bytes per segment when reading and when training, segments read at once.
HIDDEN, SEGMENT, TRAIN_SEGMENT, LANES = 16, 128, 64, 2048
#: Labelled texts per language, segments taken from each, steps and segments per step.
SAMPLE, PER_TEXT, STEPS, BATCH, RATE = 400, 8, 250, 256, 0.02
#: Groups in which the draws of a language first meet.
DEALS = 256
#: The language of texts without a letter.
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class Network(NamedTuple):
    """Languages and the weights by name; names end in f (forward) or b (backward)."""

    languages: tuple[str, ...]
    weights: dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def run(weights: dict[str, np.ndarray], way: str, text: np.ndarray, real: np.ndarray | None) -> np.ndarray:
    """States of one direction, (time, lane, hidden). ``real`` marks bytes that are not padding.

    Both gates of a step are one product, and every step works in the same buffers.
    """
    uc, ec = weights["uc" + way], weights["ec" + way]
    hidden = uc.shape[0]
    # The half that the logistic function takes of its argument is in the weights already.
    u = np.concatenate([weights["uz" + way], weights["ur" + way]], 1) * uc.dtype.type(0.5)
    e = np.concatenate([weights["ez" + way], weights["er" + way]], 1) * uc.dtype.type(0.5)
    steps, lanes = text.shape
    out = np.empty((steps, lanes, hidden), uc.dtype)
    gates, told = np.empty((2, lanes, 2 * hidden), uc.dtype)
    c, heard = np.empty((2, lanes, hidden), uc.dtype)
    state = np.zeros((lanes, hidden), uc.dtype)
    z, r = gates[:, :hidden], gates[:, hidden:]
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        byte = text[t]
        np.matmul(state, u, out=gates)
        gates += np.take(e, byte, 0, out=told, mode="clip")
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        r *= state
        np.matmul(r, uc, out=c)
        c += np.take(ec, byte, 0, out=heard, mode="clip")
        np.tanh(c, out=c)
        c -= state
        c *= z
        state = np.add(state, c, out=out[t])
        if real is not None:
            state *= real[t][:, None]
    return out


def positions(weights: dict[str, np.ndarray], text: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
    """Distribution over the languages at every byte, (time, lane, language)."""
    steps, lanes = text.shape
    # Language by language: sums over a few languages beside each other would be slow.
    scores = np.repeat(weights["bias"][:, None], steps * lanes, 1)
    for way in "fb":
        states = run(weights, way, text, real)
        scores += weights["o" + way].T @ states.reshape(steps * lanes, -1).T
    scores -= scores.max(0)
    np.exp(scores, out=scores)
    scores /= scores.sum(0)
    return scores.reshape(-1, steps, lanes).transpose(1, 2, 0)


def gradients(weights: dict[str, np.ndarray], text: np.ndarray, language: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over all bytes, by backpropagation through time."""
    states = {way: run(weights, way, text, None) for way in "fb"}
    p = states["f"] @ weights["of"] + states["b"] @ weights["ob"] + weights["bias"]
    p = np.exp(p - p.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    p[:, np.arange(text.shape[1]), language] -= 1
    p /= text.size
    grads = {"bias": p.sum((0, 1))}
    for way in "fb":
        hidden = weights["uz" + way].shape[0]
        own = states[way]
        grads["o" + way] = own.reshape(-1, hidden).T @ p.reshape(-1, p.shape[-1])
        push = p @ weights["o" + way].T
        # States before each step, in reading order.
        before = np.zeros_like(own)
        if way == "f":
            before[1:] = own[:-1]
        else:
            before[:-1] = own[1:]
        uz, ur, uc = (weights[n + way] for n in ("uz", "ur", "uc"))
        z = sigmoid(before @ uz + weights["ez" + way][text])
        r = sigmoid(before @ ur + weights["er" + way][text])
        rh = r * before
        c = np.tanh(rh @ uc + weights["ec" + way][text])
        dz, dr, dc = np.empty_like(z), np.empty_like(z), np.empty_like(z)
        carry = np.zeros_like(own[0])
        for t in range(len(text) - 1, -1, -1) if way == "f" else range(len(text)):
            d = carry + push[t]
            dz[t] = d * (c[t] - before[t]) * z[t] * (1 - z[t])
            dc[t] = d * z[t] * (1 - c[t] * c[t])
            back = dc[t] @ uc.T
            dr[t] = back * before[t] * r[t] * (1 - r[t])
            carry = d * (1 - z[t]) + back * r[t] + dz[t] @ uz.T + dr[t] @ ur.T
        flat = text.reshape(-1)
        for name, d, source in (("z", dz, before), ("r", dr, before), ("c", dc, rh)):
            grads["u" + name + way] = source.reshape(-1, hidden).T @ d.reshape(-1, hidden)
            table = np.zeros_like(weights["e" + name + way])
            np.add.at(table, flat, d.reshape(-1, hidden))
            grads["e" + name + way] = table
    return grads


def fit(segments: np.ndarray, language: np.ndarray, n_languages: int, hidden: int = HIDDEN, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights after ``steps`` Adam steps; (segment, time) bytes and a language per segment."""
    rng = np.random.default_rng(7)
    weights = {"bias": np.zeros(n_languages)}
    for way in "fb":
        weights["o" + way] = rng.normal(0, 0.3, (hidden, n_languages))
        for name in "zrc":
            weights["e" + name + way] = rng.normal(0, 0.3, (256, hidden))
            weights["u" + name + way] = rng.normal(0, 0.7 / np.sqrt(hidden), (hidden, hidden))
    weights = {n: w.astype(np.float32) for n, w in weights.items()}
    m = {n: np.zeros_like(w) for n, w in weights.items()}
    v = {n: np.zeros_like(w) for n, w in weights.items()}
    shares = 1 / np.maximum(np.bincount(language, minlength=n_languages), 1)
    chance = shares[language] / shares[language].sum()  # every language alike
    for i in range(1, steps + 1):
        rows = rng.choice(len(segments), BATCH, p=chance)
        rate = RATE * (1 - 0.9 * i / steps)
        for n, g in gradients(weights, segments[rows].T.astype(np.intp), language[rows]).items():
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.99 * v[n] + 0.01 * g * g
            step = rate * (m[n] / (1 - 0.9**i)) / (np.sqrt(v[n] / (1 - 0.99**i)) + 1e-7)
            weights[n] = (weights[n] - step).astype(np.float32)
    return weights


def train(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network:
    """Fit on at most ``sample`` texts of each language in the rows given, drawn by a hash.

    From each text come segments that begin anywhere in it. Rows with a null language or a text
    without a letter are not used; without any the network knows no language.
    """
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(id_col), F.length(text_col)).alias("draw"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def least(of: DataFrame, *keys) -> DataFrame:
        by_draw = Window.partitionBy(*keys).orderBy("draw", "id")
        return of.withColumn("n", F.row_number().over(by_draw)).filter(F.col("n") <= sample).drop("n")

    # Of a frequent language every task sends its least draws. They first meet in DEALS groups, so
    # that no task takes those of all others.
    dealt = least(rows.select("lang", "draw", "id"), "lang", F.pmod("draw", F.lit(DEALS)))
    drawn = least(dealt, "lang").distinct()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = text.encode()
                rng = np.random.default_rng(crc32(data))
                for at in rng.integers(0, max(1, len(data) - TRAIN_SEGMENT), PER_TEXT):
                    langs.append(lang)
                    found.append(data[at : at + TRAIN_SEGMENT].ljust(TRAIN_SEGMENT))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "segment"]
            )

    # At most ``sample`` texts of a few hundred bytes per language reach the driver.
    got = (
        rows.join(F.broadcast(drawn), ["lang", "draw", "id"])
        .select("lang", "text")
        .mapInArrow(cut, "lang string, segment binary")
        .orderBy("lang", "segment")
        .collect()
    )
    if not got:
        return Network((), {})
    languages = tuple(sorted({r.lang for r in got}))
    segments = np.frombuffer(b"".join(bytes(r.segment) for r in got), np.uint8).reshape(len(got), -1)
    return Network(languages, fit(segments, np.array([languages.index(r.lang) for r in got]), len(languages)))


def pooled(network: Network, texts: Sequence[bytes]) -> np.ndarray:
    """Sum of the distributions at all bytes of each text."""
    sums = np.zeros((len(texts), len(network.languages)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begins[owner] + number * SEGMENT
    length = np.minimum(SEGMENT, begins[owner] + sizes[owner] - start)
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), LANES):
        lane = order[i : i + LANES]
        longest = int(length[lane[0]])
        at = np.arange(longest)[:, None]
        real = at < length[lane]
        text = data[np.minimum(start[lane] + at, len(data) - 1)].astype(np.intp)
        whole = bool(real.all())
        found = positions(network.weights, text, None if whole else real.astype(np.float32))
        if not whole:
            found *= real[:, :, None]
        np.add.at(sums, owner[lane], found.sum(0, dtype=np.float64))
    return sums


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training; rows without an id are."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(True))


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang_pred, score) per document.

    ``score`` is the mean chance of ``lang_pred`` over all bytes of the text. A null text, one
    without a letter, and any text if the network knows no language, give ``und`` and 0. Ids may
    be null or repeated: every input row gives a row. Other columns are not read. An empty table
    gives an empty result. The network has a fixed size and is sent to all tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    id_type = dict(docs.dtypes)[id_col]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            lettered = [i for i, t in enumerate(texts) if t and known.languages and _LETTER.search(t)]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if lettered:
                sums = pooled(known, [texts[i].encode() for i in lettered])
                best = sums.argmax(1)
                share = sums[np.arange(len(best)), best] / sums.sum(1)
                for i, b, s in zip(lettered, best, share, strict=True):
                    langs[i], scores[i] = known.languages[b], float(min(1.0, s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[id_col, "lang_pred", "score"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        judge, f"`{id_col}` {id_type}, lang_pred string, score double"
    )
