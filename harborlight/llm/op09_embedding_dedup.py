"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label are one point with a weight. Points of one label and length are compared. For each length of
which a label has more than a cell's points, a codebook of unit centroids, fitted by spherical k-means on
a bounded sample, gives every point a home cell: its nearest centroid, apart for each label; the points of other
lengths have one cell each label. A point also visits
each cell whose border it may have a partner behind: if x lives in cell c and y in cell d, then x lies on c's side
of the plane between the two centroids, so y's distance to that plane, (y.d - y.c) / |d - c|, is at most the sine
of the threshold angle. Hence every pair at or above the threshold meets in a cell where one of them lives, and
nothing is lost. Homes are cut to blocks of bounded size, and every block is compared, in double precision, with
the homes and visitors of its cell, one chunk at a time. Each comparison yields link counts and a spanning forest
of its links, not the links themselves; connected components then give the representative of each group.

Defined cases: vectors that are null, empty, zero, or with null or non-finite components, and rows with a null label, link with nothing and keep themselves; rows with a null vec_id
are left out; repeated rows of a vec_id count once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import connected_components, materialize, table

#: Vectors that the codebook is fitted on, at most; points of a cell and label, about; centroids, at most.
SAMPLE, CELL, CENTROIDS = 4096, 1024, 1024
#: Home points of a block.
BLOCK = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; x: unit rows. Starts from points far from those chosen; empty cells take the worst fitted point."""
    k = max(1, min(k, len(x)))
    chosen, best = [0], x @ x[0]
    for _ in range(1, k):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        sims = x @ c.T
        cell = sims.argmax(1)
        new = np.zeros_like(c)
        np.add.at(new, cell, x)
        size = np.linalg.norm(new, axis=1)
        for j in np.flatnonzero(size < 1e-12):
            new[j], size[j] = x[int(np.argmin(sims.max(1)))], 1.0
        c = new / size[:, None]
    return c


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b, as links of every point to the least point of its tree."""
    points, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(points))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], m)
        np.minimum.at(new, low[y], m)
        new = new[new]
        new = np.minimum(new, new[low])
        if (new == low).all():
            break
        low = new
    tied = low != np.arange(len(points))
    return points[tied], points[low[tied]]


def codebook(points: DataFrame, k: int) -> np.ndarray:
    """Fitted in one task on a bounded sample, the points of least hash."""

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_matrix(b.column("v")) for b in batches if b.num_rows]
        if rows:
            c = spherical_kmeans(unit(np.concatenate(rows)), k)
            yield pa.RecordBatch.from_arrays([pa.array(c.tolist(), pa.list_(pa.float64()))], names=["c"])

    sample = points.select("v", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(SAMPLE).select("v")
    return np.array([r.c for r in sample.coalesce(1).mapInArrow(fit, "c array<double>").collect()])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label")).where("id is not null").dropDuplicates(["id"])
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sane = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    good = base.where(sane)
    grouped = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    points = materialize(grouped.select("label", "rep", "weight", F.col("v").cast("array<double>").alias("v")), "points")
    stats = points.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    large = stats.where(F.col("n") > CELL).groupBy("dim").agg(F.max("n").alias("n")).collect()
    alone = base.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    # A length has a codebook only if some label has more points of it than a cell; these lengths are few.
    centres = {r.dim: codebook(points.where(F.size("v") == r.dim), min(CENTROIDS, -(-r.n // CELL))) for r in large}
    reach = float(np.sqrt(1 - threshold * threshold)) + 1e-9
    gaps = {dim: np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18)) for dim, c in centres.items()}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = np.asarray(pa.compute.list_value_length(b.column("v")))
            for dim in np.unique(length):
                own = b.take(pa.array(np.flatnonzero(length == dim)))
                if dim in centres:
                    s = unit(_matrix(own.column("v"))) @ centres[dim].T
                    home = s.argmax(1)
                    margin = (s[np.arange(len(s)), home][:, None] - s) / gaps[dim][home]
                    margin[np.arange(len(s)), home] = 0
                    row, cell = np.nonzero(margin <= reach)
                else:
                    row, cell = np.arange(own.num_rows), np.zeros(own.num_rows, np.int64)
                    home = cell
                out = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([out.column(c) for c in ("label", "rep", "weight", "v")] + [pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell)], names=["label", "rep", "weight", "v", "dim", "cell", "lives"])

    kind = points.schema["label"].dataType.simpleString()
    dealt = materialize(points.mapInArrow(deal, f"label {kind}, rep long, weight long, v array<double>, dim int, cell int, lives boolean"), "cells")
    # Homes are cut to blocks, homes and visitors to chunks; each block meets each chunk of its cell in one small group.
    cells = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if("lives") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    placed = dealt.join(cells.where("blocks > 0"), ["label", "dim", "cell"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    homes = placed.where("lives").withColumn("block", own("blocks")).withColumn("chunk", spread("chunks")).withColumn("home", F.lit(True))
    others = placed.withColumn("chunk", own("chunks")).withColumn("block", spread("blocks")).withColumn("home", F.lit(False))
    columns = ["label", "dim", "cell", "block", "chunk", "home", "rep", "weight", "v"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Every home's number of linked vectors in this chunk, and a spanning forest of the links.

        A linked pair of different cells meets in both, so that each point's own home block counts all its links.
        """
        home = group["home"].to_numpy()
        ids, weight, x = group["rep"].to_numpy(), group["weight"].to_numpy(), unit(np.array(group["v"].tolist()))
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        i, j = np.nonzero(x[a] @ x[b].T >= threshold)
        i, j = a[i], b[j]
        apart = ids[i] != ids[j]
        i, j = i[apart], j[apart]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, i, weight[j])
        seen = np.flatnonzero(count)
        u, v = forest(ids[i], ids[j]) if len(i) else (ids[:0], ids[:0])
        return pd.DataFrame({"node": np.concatenate([ids[seen], u]), "other": np.concatenate([ids[seen], v]), "n": np.concatenate([count[seen], np.zeros(len(u), np.int64)])})

    met = homes.select(*columns).union(others.select(*columns)).groupBy("label", "dim", "cell", "block", "chunk").applyInPandas(compare, "node long, other long, n long")
    met = materialize(met, "links")
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    component = connected_components(met.select(F.col("node").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "cnode")
    point = points.select("rep", "weight")
    point = point.join(counts, point.rep == counts.node, "left").join(component, F.col("rep") == F.col("cnode"), "left")
    point = point.select("rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # Back to the rows: copies of a point share its figures; the rest stand alone.
    rows = good.select("id", "label", "v").join(grouped.select("label", "v", "rep"), ["label", "v"]).select("id", "rep").join(point, "rep")
    rows = rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return rows.union(alone.join(rows.select("vec_id"), "vec_id", "left_anti"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


_ORACLE = r"""
WITH RECURSIVE g AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.98
), n AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
), reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.node, p.b FROM reach JOIN p ON reach.other = p.a
), c AS (
  SELECT node, min(other) AS c FROM reach GROUP BY node
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""

QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
ORACLES = {"op9_embedding_dedup": _ORACLE}
