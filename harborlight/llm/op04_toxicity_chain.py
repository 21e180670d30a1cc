"""Toxicity categories by a chain of linear models.

Features are all runs of 4 and of 6 bytes of the whole lower-cased text, any white space counting as a space, so that
inflections of a word share some and scripts without spaces are read alike; the most telling of them over the labelled
sample (chi-square against toxicity) are kept, a fixed number whatever their score.
The labels table marks toxicity alone. Two finer categories, called themes as the data give them no names, are read off
the labelled sample: the features that tell of toxicity are split in two groups by the documents they occur in, and a
toxic document is of a theme if it has a feature of its group. No word of any language is written down here.
The categories come in a fixed order, toxicity last. Each is a ridge-penalised logistic model of the features and of the earlier
categories' log odds; in training these come from models fitted without the row's own fold. Scoring runs the whole
chain on each document in one pass; the model is of bounded size.

Defined cases: a null or empty text takes the intercepts' probabilities; a category whose labels are missing or of
one class gets the smoothed share of its class; a null label of a category leaves the row out of that category's
model alone; repeated rows are scored alike; an empty table gives no rows; extra columns are ignored. A toxic
document with no telling feature says nothing of either theme. Where no feature is telling, both themes are of one
class, and where the telling ones all stand in the same documents, the second is; toxicity is learnt all the same. A
text of under 4 bytes has no feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import materialize, table, text_batches
from harborlight.llm.labelled import held_out, labelled_sample, sigmoid
from harborlight.llm.textscan import LOWER, SPACE, blocks

#: Labelled documents to fit on, features to keep at most, folds of the out-of-fold predictions.
FIT_ROWS, FEATURES, FOLDS = 30_000, 4096, 5
#: Bytes in a feature, seven at most.
SIZES = (4, 6)
#: The penalty on squared weights.
RIDGE = 1.0
#: The chi-square from which a feature that leans to toxicity shapes a theme, rounds of splitting the features.
THEME_CHI, SPLITS = 20.0, 15
CHAIN = ["theme_1", "theme_2", "toxic"]


def byte_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, keys, rows) of blocks, repeats and all; a key packs its bytes and their number."""
    for lo, hi, buf, off in blocks(column):
        buf = np.where(SPACE[buf], np.uint8(32), LOWER[buf])
        row = np.repeat(np.arange(hi - lo), np.diff(off))
        left = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))  # bytes from here to the end of the text
        wide = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.int64)
        packed = np.zeros(len(buf), np.int64)
        keys, rows = [], []
        for j in range(max(SIZES)):
            packed |= wide[j : j + len(buf)] << (8 * j)
            if j + 1 in SIZES:
                fits = left > j
                keys.append(packed[fits] | (j + 1) << 56)
                rows.append(row[fits])
        yield lo, hi, np.concatenate(keys), np.concatenate(rows)


def distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, key) once, in order of rows."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], rows[new]


def _slot(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class Chosen:
    """The features kept, and which of them a row has: most keys are turned away by one look at a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.may = keys, np.zeros(1 << 20, bool)
        self.may[_slot(keys)] = True

    def hits(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places of features, each pair once."""
        on = self.may[_slot(keys)] if len(self.keys) else np.zeros(len(keys), bool)
        keys, rows = distinct(keys[on], rows[on])
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        real = self.keys[at] == keys
        return rows[real], at[real]


class Rows:
    """Sparse indicator rows; matrix products by counting."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.shape = rows, cols, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.shape[1])

    def take(self, keep: np.ndarray) -> Rows:
        place = np.full(self.shape[0], -1)
        place[keep] = np.arange(len(keep))
        on = place[self.rows] >= 0
        return Rows(place[self.rows[on]], self.cols[on], (len(keep), self.shape[1]))


def logistic(x: Rows, dense: np.ndarray, y: np.ndarray, ridge: float | None = None, rounds: int = 25) -> np.ndarray:
    """Weights of the sparse, then the dense columns, then the intercept: Newton steps by scaled conjugate gradients."""
    n, d = x.shape[1], dense.shape[1]
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return np.concatenate([np.zeros(n + d), [np.log(share / (1 - share))]])
    push = np.full(n + d + 1, RIDGE if ridge is None else ridge)
    push[n:] = 1e-3
    dot = lambda w: x.dot(w[:n]) + dense @ w[n : n + d] + w[-1]
    back = lambda g: np.concatenate([x.back(g), dense.T @ g, [g.sum()]])
    loss = lambda z, w: np.logaddexp(0, z).sum() - z @ y + (push * w * w).sum() / 2
    w = np.zeros(n + d + 1)
    z = dot(w)
    for _ in range(rounds):
        p = sigmoid(z)
        grad = back(p - y) + push * w
        if np.abs(grad).max() < 1e-4 * len(y):
            break
        h = p * (1 - p)
        scale = np.concatenate([x.back(h), (dense * dense).T @ h, [h.sum()]]) + push
        step, r = np.zeros_like(w), -grad
        v = r / scale
        least, rr = 1e-4 * (r @ v), r @ v
        for _ in range(60):
            hv = back(h * dot(v)) + push * v
            a = rr / (v @ hv)
            step += a * v
            r -= a * hv
            new = r @ (r / scale)
            if new < least:
                break
            v, rr = r / scale + new / rr * v, new
        t, now = 1.0, loss(z, w)
        while t > 1e-4 and loss(dot(w + t * step), w + t * step) > now:
            t /= 2
        w = w + t * step
        z = dot(w)
    return w


def log_odds(x: Rows, dense: np.ndarray, w: np.ndarray) -> np.ndarray:
    n, d = x.shape[1], dense.shape[1]
    return np.clip(x.dot(w[:n]) + dense @ w[n : n + d] + w[-1], -12, 12)


def fit_one(x: Rows, dense: np.ndarray, y: np.ndarray, folds: np.ndarray, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A category's weights learned without one fold (-1: from all rows), the rows of that fold and their log odds; y is
    nan where unknown."""
    rest, own = np.flatnonzero(~np.isnan(y) & (folds != fold)), np.flatnonzero(folds == fold)
    w = logistic(x.take(rest), dense[rest], y[rest])
    return w, own, log_odds(x.take(own), dense[own], w)


def split_features(x: Rows) -> np.ndarray:
    """True for the features of the second of two groups: spherical 2-means of columns, none of them empty."""
    size = np.sqrt(x.back(np.ones(x.shape[0])))
    group = np.zeros(x.shape[1], bool)
    if not len(group):
        return group
    near = lambda w: (lambda c: x.back(c / np.linalg.norm(c)) / size)(x.dot(w / size))
    far = size * (1 - near(np.arange(len(size)) == size.argmax()))
    if far.max() < 1e-6:
        return group
    centres = [np.arange(len(size)) == size.argmax(), np.arange(len(size)) == far.argmax()]
    for _ in range(SPLITS):
        now = near(centres[1]) > near(centres[0]) + 1e-9
        if now.all() or not now.any() or (now == group).all():
            break
        group, centres = now, [~now, now]
    return group


def themes(x: Rows, toxic: np.ndarray) -> np.ndarray:
    """Labels of the two themes, a column each: nan for a toxic row without a telling feature."""
    n, p, a, k = x.shape[0], toxic.sum(), x.back(toxic), x.back(np.ones(x.shape[0]))
    odd = k * (n - k) * p * (n - p)
    telling = (a * n > k * p) & ((a * n - k * p) ** 2 * n >= THEME_CHI * odd) & (odd > 0)
    place = np.cumsum(telling) - 1
    on = telling[x.cols]
    told = Rows(x.rows[on], place[x.cols[on]], (n, int(telling.sum())))
    second = split_features(told.take(np.flatnonzero(toxic == 1)))
    has = np.column_stack([told.dot(w.astype(float)) > 0 for w in (~second, second)])
    return np.where(toxic[:, None] == 0, 0.0, np.where(has.any(axis=1)[:, None], has, np.nan))


def telling_features(sample: DataFrame, categories: list[str], features: int) -> np.ndarray:
    """The keys of the highest chi-square against any category, counted over the whole sample."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in categories])
            for lo, _, keys, rows in byte_runs(b.column("text")):
                keys, rows = distinct(keys, rows)
                kinds, at = np.unique(keys, return_inverse=True)
                total = [np.bincount(at, ~np.isnan(y[lo + rows, j]), len(kinds)).astype(np.int64) for j in range(len(categories))]
                pos = [np.bincount(at, np.nan_to_num(y[lo + rows, j]), len(kinds)).astype(np.int64) for j in range(len(categories))]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, total), *map(pa.array, pos)], names=["key", *(f"n_{c}" for c in categories), *(f"p_{c}" for c in categories)])

    sums = [f"{k}_{c}" for k in "np" for c in categories]
    counted = sample.mapInArrow(count, "key long, " + ", ".join(f"{s} long" for s in sums)).groupBy("key").agg(*(F.sum(s).alias(s) for s in sums))
    whole = sample.agg(*(F.count(c).alias(f"n_{c}") for c in categories), *(F.sum(c).alias(f"p_{c}") for c in categories)).first()

    def chi(c: str) -> F.Column:
        n, p = float(whole[f"n_{c}"] or 0), float(whole[f"p_{c}"] or 0)
        k, a = F.col(f"n_{c}"), F.col(f"p_{c}")
        odd = k * (n - k) * p * (n - p)
        return F.when(odd > 0, n * (a * n - k * p) * (a * n - k * p) / odd).otherwise(0.0)

    best = counted.select("key", F.greatest(*map(chi, categories), F.lit(0.0)).alias("chi"))
    return np.sort(np.array([r.key for r in best.where("chi > 0").orderBy(F.desc("chi"), "key").limit(features).collect()], np.int64))


def fit(sample: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chosen features and the chain's models, from (doc_id, text, toxic)."""
    chosen = telling_features(sample, ["toxic"], features)

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Chosen(chosen)
        for b in batches:
            out: list[np.ndarray] = []
            for lo, hi, keys, rows in byte_runs(b.column("text")):
                rows, cols = kept.hits(keys, rows)
                out += np.split(cols.astype(np.int32), np.cumsum(np.bincount(rows, minlength=hi - lo))[:-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])

    def learn(place: int) -> Callable[[pa.Table], pa.Table]:
        def one(t: pa.Table) -> pa.Table:
            fold = t["without"][0].as_py()
            t = t.sort_by("doc_id").combine_chunks()
            column = t["features"].combine_chunks()
            count = np.asarray(pa.compute.list_value_length(column))
            x = Rows(np.repeat(np.arange(len(count)), count), np.asarray(column.flatten()).astype(np.int64), (len(count), len(chosen)))
            toxic = t["toxic"].to_numpy()
            dense = np.array(t["odds"].to_pylist(), float).reshape(len(count), place)
            y = np.column_stack([themes(x, toxic), toxic])[:, place]
            w, own, odds = fit_one(x, dense, y, t["fold"].to_numpy(), fold)
            if fold < 0:
                return pa.table({"doc_id": pa.nulls(1, pa.int64()), "own": pa.nulls(1, pa.float64()), "w": pa.array([w.tolist()], pa.list_(pa.float64()))})
            return pa.table({"doc_id": t["doc_id"].take(pa.array(own)), "own": pa.array(odds), "w": pa.nulls(len(own), pa.list_(pa.float64()))})

        return one

    # A task a model: one of all rows and one without each fold, category by category.
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = sample.mapInArrow(rows_of, "doc_id long, toxic double, features array<int>").select("*", fold, F.array().cast("array<double>").alias("odds"))
    rows, models = materialize(rows, "toxic-rows"), []
    for place in range(len(CHAIN)):
        last = place + 1 == len(CHAIN)
        without = F.array(*(F.lit(f) for f in ([-1] if last else range(-1, FOLDS))))
        spread = rows.withColumn("without", F.explode(without)).repartition(4 * FOLDS, "without")
        made = materialize(spread.groupBy("without").applyInArrow(learn(place), "doc_id long, own double, w array<double>"), "toxic-model")
        whole = made.where("w is not null").select("w").first()
        models.append(np.array(whole.w) if whole else np.zeros(len(chosen) + place + 1))
        if not last:
            own = F.broadcast(made.where("w is null").select("doc_id", "own"))  # a number a row of the bounded sample
            rows = materialize(rows.join(own, "doc_id").withColumn("odds", F.concat("odds", F.array("own"))).drop("own"), "toxic-rows")
    return chosen, models


def score(docs: DataFrame, model: tuple[np.ndarray, list[np.ndarray]], categories: list[str]) -> DataFrame:
    """Adds a probability p_<category> each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{c}" for c in categories]
    keep = [c for c in docs.columns if c not in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, models = shared.value
        kept = Chosen(chosen)
        for b in batches:
            parts = [np.zeros((0, len(models)))]
            for lo, hi, keys, rows in byte_runs(b.column("text")):
                x = Rows(*kept.hits(keys, rows), (hi - lo, len(chosen)))
                dense = np.zeros((hi - lo, 0))
                for w in models:
                    dense = np.column_stack([dense, log_odds(x, dense, w)])
                parts.append(dense)
            p = sigmoid(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(p[:, j]) for j in range(len(names)))], names=[*keep, *names])

    schema = docs.select(*keep).schema
    for c in names:
        schema = schema.add(c, "double")
    return docs.select(*keep).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Adds p_theme_1, p_theme_2 and p_toxic to documents (doc_id, text), by labels (doc_id, toxic)."""
    text_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", fit_rows).select("doc_id", "text", F.col("label").cast("double").alias("toxic"))
    return score(docs, fit(materialize(sample, "toxic-sample")), CHAIN)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = toxicity(docs, table(spark, sf_dir, "labels"))
    return done.select("doc_id", held_out().alias("held_out"), *(f"p_{c}" for c in CHAIN), (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose probability of toxicity is one half or more go."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where("p_toxic < 0.5").select(*docs.columns)


QUERIES = {"op4_toxicity_chain": op4_toxicity_chain}
ORACLES: dict[str, str] = {}
