"""Toxicity (operator 3): cumulative-link ordinal regression on sparse text features.

The chance of grade k or worse is ``logistic(w . x - t_k)``: one weight vector for all grades,
ordered thresholds t_1 < t_2 < ... The expected severity is the sum of these chances. Features
are the words of a whole text and their beginnings, present or not; those that mark
toxic documents are chosen by their counts over the labelled sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import slices, staged

#: Labelled rows fitted on, features kept, documents a feature must occur in.
SAMPLE, FEATURES, LEAST_DOCS = 20_000, 1024, 5
#: Deviations of the bound on a feature's share of toxic documents, and the least share.
SURE, LEAST_SHARE = 3.0, 0.4
#: Length of the word beginnings that count as features, and the mark before them.
STEM, MARK = 4, "^"
ROUNDS, RATE, RIDGE = 1500, 0.3, 1e-6
#: Text whose words a task holds at once.
WORD_BYTES = 1 << 20
_WORDS = re.compile(r"\w+")


class Model(NamedTuple):
    """Weights by feature and ordered thresholds; without thresholds every grade is 0."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def at_least(self, features: Iterable[str]) -> np.ndarray:
        """Chances of grade 1 or worse, 2 or worse, ..."""
        get = self.weights.get
        score = sum(sorted(get(f, 0.0) for f in features if f in self.weights))
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -30, 30)))


def features_of(text: str | None) -> set[str]:
    """Distinct words of a text, lower-cased, and their beginnings."""
    words = set(_WORDS.findall((text or "").lower()))
    return words | {MARK + w[:STEM] for w in words if len(w) > STEM}


def numbers_of(lists: pa.Array, names: pa.Array) -> pa.Array:
    """Of each list of texts the places in ``names`` of those that are there, ascending. No text
    becomes a Python object, so this holds little more than the lists themselves."""
    found = pc.index_in(lists.flatten(), value_set=names.cast(lists.type.value_type))
    known = found.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[known]
    number = found.drop_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((number, row))
    ends = np.cumsum(np.bincount(row, minlength=len(lists)))
    return pa.ListArray.from_arrays(
        pa.array(np.append(0, ends), pa.int32()), pa.array(number[order], pa.int32())
    )


def fit_ordinal(indices: list[np.ndarray], grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the ordinal likelihood.

    ``indices`` are the features present in each row, ``grades`` 0, 1, ... up to their maximum.
    """
    levels = int(grades.max(initial=0))
    if not levels:
        return np.zeros(n_features), np.zeros(0)
    rows = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
    cols = np.concatenate([*indices, np.zeros(0, np.int64)]).astype(np.int64)
    share = np.array([(grades >= k).mean() for k in range(1, levels + 1)])
    base = np.log((1 - share + 1e-6) / (share + 1e-6))
    steps = np.log(np.maximum(np.diff(base), 1e-3))
    params = np.concatenate([np.zeros(n_features), base[:1], steps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    reached = grades[:, None] >= np.arange(1, levels + 1)
    reached_next = grades[:, None] >= np.arange(2, levels + 2)
    for i in range(1, ROUNDS + 1):
        w, gaps = params[:n_features], np.exp(params[n_features + 1 :])
        cuts = params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        scores = np.bincount(rows, w[cols], len(indices))
        p = 1 / (1 + np.exp(-np.clip(scores[:, None] - cuts, -30, 30)))
        q = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
        own = np.maximum(q[np.arange(len(p)), grades] - q[np.arange(len(p)), grades + 1], 1e-12)
        # d(-log own)/d(score - cut_k): the chance's upper bound counts up, the lower down.
        slope = p * (1 - p) / own[:, None]
        is_upper = reached & ~reached_next
        is_lower = (grades[:, None] + 1) == np.arange(1, levels + 1)
        push = slope * (is_lower.astype(float) - is_upper.astype(float)) / len(p)
        g_cuts = -push.sum(0)
        tail = np.cumsum(g_cuts[::-1])[::-1]
        grad = np.concatenate(
            [np.bincount(cols, push.sum(1)[rows], n_features) + RIDGE * w, tail[:1], tail[1:] * gaps]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params -= RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        # The features mark higher grades, so none may speak against them.
        np.maximum(params[:n_features], 0, out=params[:n_features])
    return params[:n_features], params[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_features + 1 :]))])


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    n_features: int = FEATURES,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on at most ``sample`` labelled documents, drawn by a hash of their id.

    Labels are toxic or not; toxic documents are graded 1 or 2 by how many such
    features they hold (2: above the median). Rows with a null
    label or id are not used; of repeated labels of a document the worst counts. Documents with
    the same label and the same features count once, so that words of a much copied text do
    not pass for typical; all that differ are fitted on. Without labels of both kinds every
    grade is 0.
    """
    spark = docs.sparkSession
    drawn = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg((F.max(F.col(label_col).cast("int")) > 0).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", WORD_BYTES):
            found = [sorted(features_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array([sha256("\n".join(x).encode()).digest() for x in found], pa.binary()),
                    pa.array(found, pa.list_(pa.string())),
                ],
                names=["toxic", "digest", "features"],
            )

    rows = staged(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(drawn), "id")
        .select("toxic", "text")
        .mapInArrow(features, "toxic boolean, digest binary, features array<string>")
        .groupBy("toxic", "digest")
        .agg(F.first("features").alias("features")),
        "toxicity-sample",
    )
    n, n_toxic = rows.agg(F.count("*"), F.count_if("toxic")).first()
    if not n_toxic or n_toxic == n:
        return Model({}, np.zeros(0))
    counts = (
        rows.select("toxic", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("docs"), F.count_if("toxic").alias("toxic"))
        .filter(F.col("docs") >= LEAST_DOCS)
    )
    # Lower bound (Wilson) of the share of toxic documents among those with the feature: few
    # documents do not suffice to call a word telling.
    share, z = F.col("toxic") / F.col("docs"), SURE * SURE / F.col("docs")
    low = (share + z / 2 - F.sqrt(z) * F.sqrt(share * (1 - share) + z / 4)) / (1 + z)
    chosen = (
        counts.select("feature", low.alias("low"))
        .filter(F.col("low") > LEAST_SHARE)
        .orderBy(F.desc("low"), "feature")
        .limit(n_features)
        .collect()
    )
    number = {r.feature: i for i, r in enumerate(chosen)}
    if not number:
        return Model({}, np.zeros(0))
    shared = spark.sparkContext.broadcast(list(number))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        for batch in slices(batches, "features", WORD_BYTES):
            present = numbers_of(batch.column("features"), names)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), present], names=["toxic", "present"])

    fitted = rows.mapInArrow(pick, "toxic boolean, present array<int>").collect()
    # Sorted here: a sort by Spark would first work everything out once more for its ranges.
    fitted.sort(key=lambda r: (r.toxic, r.present))
    toxic = np.array([r.toxic for r in fitted])
    hits = np.array([len(r.present) for r in fitted])
    grades = np.where(toxic, 1 + (hits > np.median(hits[toxic])), 0)
    weights, thresholds = fit_ordinal([np.array(r.present, np.int64) for r in fitted], grades, len(number))
    return Model({f: float(weights[i]) for f, i in number.items()}, thresholds)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, grade, severity, toxic) per document.

    ``severity`` is the expected grade, ``grade`` the likeliest one, ``toxic`` whether grade 1
    or worse is likelier than not. A null or empty text has no features. Ids may be null or
    repeated: every input row gives a row. Other columns are not read. An empty table gives an
    empty result. The model holds a bounded number of features and is sent to all tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = dict(docs.dtypes)[id_col]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", WORD_BYTES):
            chances = [shared.value.at_least(features_of(t)) for t in batch.column("text").to_pylist()]
            steps = [-np.diff(np.concatenate([[1.0], c, [0.0]])) for c in chances]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([int(s.argmax()) for s in steps], pa.int32()),
                    pa.array([float(c.sum()) for c in chances], pa.float64()),
                    pa.array([bool(len(c) and c[0] >= 0.5) for c in chances], pa.bool_()),
                ],
                names=[id_col, "grade", "severity", "toxic"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        judge, f"`{id_col}` {id_type}, grade int, severity double, toxic boolean"
    )
