"""Quality classifier: naive Bayes log-count ratios as feature scales of a linear hinge-loss model.

Features are indicators of byte 3-grams, hashed to 2^16. Over a bounded sample of labelled documents the log ratio
of each feature's share in good and in poor documents is taken; indicators times these ratios, divided by the root
of their number, feed an L1-loss support vector machine fitted by dual coordinate descent in one task. A logistic
curve fitted on a fifth of the sample that the machine has not seen turns margins into probabilities. Every
document is then scored whole in one pass, without a shuffle; the model is one row of fixed size.

Defined cases: a null, empty or very short text has no features and takes the intercept's score; where labels are
missing or of one class only, every score is that class's smoothed share; repeated rows are scored alike; rows with
a null doc_id are scored and not held out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import table, text_batches
from harborlight.llm.labelled import held_out, labelled_sample, platt, sigmoid
from harborlight.llm.textscan import blocks

#: Labelled documents that the classifier is fitted on, at most.
FIT_ROWS = 15_000
BITS = 16


def gram_codes(buf: np.ndarray) -> np.ndarray:
    """Hashed byte 3-grams at every position."""
    x = buf.astype(np.uint32)
    return (((x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


def documents_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Codes of each document's 3-grams, with repeats."""
    none = np.zeros(0, np.int32)
    for lo, hi, buf, off in blocks(column):
        codes = gram_codes(buf) if len(buf) > 2 else none
        ends = off.tolist()
        for i in range(hi - lo):
            yield codes[ends[i] : max(ends[i], ends[i + 1] - 2)]


def fit_nbsvm(features: list[np.ndarray], label: np.ndarray, size: int = 1 << BITS, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float, float, float]:
    """Feature weights, bias, and the slope and intercept of the probability curve."""
    rng = np.random.default_rng(seed)
    share = (label.sum() + 1) / (len(label) + 2)
    if len(label) == 0 or label.min() == label.max():
        return np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share)))
    order = rng.permutation(len(label))
    fold = order[: len(order) // 5]
    fit = order[len(order) // 5 :]
    if label[fit].min() == label[fit].max() or len(fold) == 0:
        fold = fit = order
    counts = np.ones((2, size))
    for i in fit:
        counts[int(label[i]), features[i]] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scale = [1 / np.sqrt(max(1, len(f))) for f in features]
    rows = {i: r[features[i]] * scale[i] for i in fit}
    y = np.where(label == 1, 1.0, -1.0)
    n1 = (label[fit] == 1).mean()
    most = {1.0: cost * 0.5 / n1, -1.0: cost * 0.5 / (1 - n1)}
    w, bias = np.zeros(size), 0.0
    q = {i: float(v @ v) + 1.0 for i, v in rows.items()}
    alpha = dict.fromkeys(rows, 0.0)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(fit):
            v, f, s = rows[i], features[i], y[i]
            g = s * (w[f] @ v + bias) - 1
            was = alpha[i]
            now = min(max(was - g / q[i], 0.0), most[s])
            if now != was:
                alpha[i] = now
                w[f] += (now - was) * s * v
                bias += (now - was) * s
                worst = max(worst, abs(now - was))
        if worst < 1e-3:
            break
    w = w * r
    margin = np.array([w[features[i]].sum() * scale[i] + bias for i in fold])
    return w, bias, *platt(margin, label[fold])


def fit(sample: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Fits in one task on (text, label), whose number is bounded; the model comes back as one row."""

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(c) for c in documents_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "features"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, label, ids = [], [], []
        for b in batches:
            column = b.column("features")
            found += np.split(np.asarray(column.flatten()), np.cumsum(np.asarray(pa.compute.list_value_length(column)))[:-1]) if b.num_rows else []
            label += b.column("label").to_pylist()
            ids += b.column("doc_id").to_pylist()
        order = np.argsort(np.array(ids, np.int64))
        w, *rest = fit_nbsvm([found[i] for i in order], np.array(label, np.int64)[order])
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([rest], pa.list_(pa.float64()))], names=["w", "rest"])

    made = sample.mapInArrow(features, "doc_id long, label int, features array<int>").repartition(1)
    row = made.mapInArrow(learn, "w array<double>, rest array<double>").first()
    return np.array(row.w), *row.rest


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float]) -> DataFrame:
    """Adds score (0 to 1) to the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, a, b_ = shared.value
        seen = np.zeros(len(w), bool)
        for b in batches:
            margin = np.empty(b.num_rows)
            for i, codes in enumerate(documents_of(b.column("text"))):
                seen[codes] = True
                here = np.flatnonzero(seen)
                margin[i] = w[here].sum() / np.sqrt(max(1, len(here))) + bias
                seen[here] = False
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sigmoid(a * margin + b_))], names=[*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Adds score to documents (doc_id, text), by labels (doc_id, quality)."""
    text_batches(docs.sparkSession)
    return score(docs, fit(labelled_sample(docs, labels, "quality", fit_rows)))


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality_scores(docs, table(spark, sf_dir, "labels"))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below one half go."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("score >= 0.5").select(*docs.columns)


QUERIES = {"op10_quality_nbsvm": op10_quality_nbsvm}
ORACLES: dict[str, str] = {}
