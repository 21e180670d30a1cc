"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search over it, both as Spark joins.

Equal vectors are one point; its copies come back at the end. The graph starts from the exact neighbours inside small
cells of a few random sign splits (a cell is cut to blocks of bounded size). Each round of NN-descent then joins every
point, as a pivot, with a sample of the points it is linked with in either direction, new links apart from old ones, and their vectors;
each list of at most 2 x SAMPLE vectors is compared in one small product, and pairs nearer than one side's farthest neighbour become
links: neighbours of neighbours. A link is new in one round; rounds end when few links are new.

Queries walk the graph, all at once: a query's beam holds the BEAM nearest points seen so far; each round its WIDTH nearest ones not yet
opened are joined with their neighbour lists (both directions of every link, in blocks of points), those with their vectors,
and the distances, in double precision, go back to the beam, until everything in the beam is open. A query starts at its own
point and at some points of the table. Every point is in the graph; nothing is collected but the entry points and figures of each
vector length. Recall against brute force is measured in the tests.

Defined cases: vectors that are null, empty, zero, or with null or non-finite components, and rows with a null vec_id, take no part;
vectors of different lengths aren't compared; repeated rows of a vec_id count once, and one with several vectors
has the least; queries with fewer than ten candidates return all that the walk reaches, which for so few points is all; an empty table
gives no rows; extra columns are ignored. Memory of a task: one block of points and the queries that ask for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.llm.common import materialize, table, text_batches

#: Results of a query; links of a point; random splits, and points of a cell, that the graph starts from.
NEAREST, LINKS, SPLITS, CELL = 10, 16, 4, 1024
#: Members of a pivot's list that are new, and as many old ones; the share of new links at which rounds end; rounds, at most.
SAMPLE, SETTLED, ROUNDS = 16, 0.05, 10
#: Points of a query's beam; points opened in a round; entry points; numbers in a block of vectors.
BEAM, WIDTH, ENTRIES, BLOCK = 1000, 256, 16, 1 << 18


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _floats(column: pa.Array | pa.ChunkedArray, kind: type, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def points_of(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row that takes part, rep being the least id of its copies, and (rep, dim, v) of the different vectors."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null")
    base = base.where(F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))
    base = materialize(base, "vectors")
    points = materialize(base.groupBy("v").agg(F.min("id").alias("rep")).select("rep", F.size("v").alias("dim"), "v"), "points")
    rows = materialize(base.join(points.select("v", "rep"), "v").select("id", "rep"), "copies")
    return rows, points


def shapes(points: DataFrame) -> dict[int, tuple[int, np.ndarray, float]]:
    """Number of points, mean and scale (a power of two) of each vector length."""
    sums = points.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max(F.abs("x")).alias("most")).collect()
    out = {}
    for dim in {r.dim for r in sums}:
        own = sorted((r for r in sums if r.dim == dim), key=lambda r: r.pos)
        out[dim] = (own[0].n, np.nan_to_num(np.array([r.mean for r in own])), 2.0 ** min(1000, math.frexp(max(r.most for r in own))[1]))
    return out


def best(links: DataFrame) -> DataFrame:
    """The LINKS nearest of each point, one row a pair; a pair that stood there before isn't new. One shuffle serves both steps."""
    pairs = links.repartition("u").groupBy("u", "w").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "w"))).where(F.col("rank") <= LINKS).drop("rank")


def first_links(points: DataFrame, shape: dict) -> DataFrame:
    """Exact neighbours inside the blocks of random cells; points: (rep, dim, c)."""
    planes = {dim: [np.random.default_rng([split, dim]).standard_normal((dim, max(0, math.ceil(math.log2(n / CELL))))) for split in range(SPLITS)] for dim, (n, _, _) in shape.items()}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                x = _floats(own.column("c"), np.float32, own.num_rows)
                for split in range(SPLITS if planes[dim][0].shape[1] else 1):
                    p = planes[dim][split]
                    cell = (x @ p > 0) @ (1 << np.arange(p.shape[1])) if p.shape[1] else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), split, np.int32)), pa.array(cell.astype(np.int64)), *(own.column(c) for c in ("rep", "dim", "c"))], names=["split", "cell", "rep", "dim", "c"])

    key = ["split", "dim", "cell"]
    dealt = materialize(points.mapInArrow(deal, "split int, cell long, rep long, dim int, c binary"), "cells")
    sizes = dealt.groupBy(*key).agg(F.ceil(F.count("*") / CELL).alias("blocks"))
    placed = dealt.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep", "split"), "blocks"))

    def near(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("rep"))
        x = _floats(group.column("c"), np.float32, len(ids))
        sq = (x * x).sum(1)
        k = min(LINKS, len(ids) - 1)
        if not k:
            return pa.table({"u": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "d": pa.array([], pa.float32())})
        u, w, d = [], [], []
        for lo in range(0, len(ids), CELL):
            far = np.maximum(sq[lo : lo + CELL, None] + sq[None] - 2 * (x[lo : lo + CELL] @ x.T), 0)
            far[np.arange(len(far)), np.arange(lo, lo + len(far))] = np.inf
            at = np.argpartition(far, k - 1, 1)[:, :k]
            u.append(np.repeat(ids[lo : lo + CELL], k))
            w.append(ids[at].ravel())
            d.append(np.take_along_axis(far, at, 1).ravel())
        return pa.table({"u": np.concatenate(u), "w": np.concatenate(w), "d": np.concatenate(d)})

    links = placed.groupBy(*key, "block").applyInArrow(near, "u long, w long, d float")
    return materialize(best(links.withColumn("new", F.lit(True))), "graph")


def _local_joins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a pivot's members, one of them new, that are nearer than one side's farthest neighbour."""
    for b in batches:
        lists = b.column("members")
        flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(lists)))])
        ids, limit, new = (np.asarray(flat.field(c)) for c in ("member", "limit", "new"))
        vectors = flat.field("c").to_pylist()
        us, ws, ds = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            x = np.frombuffer(b"".join(vectors[lo:hi]), np.float32).reshape(hi - lo, -1)
            i, far, fresh = ids[lo:hi], limit[lo:hi], new[lo:hi]
            a = np.flatnonzero(fresh)
            sq = (x * x).sum(1)
            d = np.maximum(sq[a, None] + sq[None] - 2 * (x[a] @ x.T), 0)
            apart = i[a, None] != i[None]
            r, c = np.nonzero(apart & (d < far[a, None]))
            r2, c2 = np.nonzero(apart & (d < far[None]) & ~fresh[None])
            us += [i[a[r]], i[c2]]
            ws += [i[c], i[a[r2]]]
            ds += [d[r, c], d[r2, c2]]
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(ws)), pa.array(np.concatenate(ds))], names=["u", "w", "d"])


def descend(graph: DataFrame, points: DataFrame) -> DataFrame:
    """Rounds of NN-descent over (u, w, d, new); points: (rep, c)."""
    for turn in range(ROUNDS):
        limit = graph.groupBy("u").agg(F.count("*").alias("k"), F.max("d").alias("far")).select(F.col("u").alias("member"), F.when(F.col("k") < LINKS, float("inf")).otherwise(F.col("far")).cast("float").alias("limit"))
        both = graph.select(F.col("u").alias("pivot"), F.col("w").alias("member"), "new").union(graph.select(F.col("w").alias("pivot"), F.col("u").alias("member"), "new"))
        drawn = both.withColumn("rank", F.row_number().over(Window.partitionBy("pivot", "new").orderBy(F.xxhash64("member", "pivot", F.lit(turn)), "member"))).where(F.col("rank") <= SAMPLE)
        drawn = drawn.withColumn("live", F.max("new").over(Window.partitionBy("pivot"))).where("live").select("pivot", "member", "new")
        known = points.select(F.col("rep").alias("member"), "c").join(limit, "member")
        lists = drawn.join(known, "member").groupBy("pivot").agg(F.collect_list(F.struct("member", "limit", "new", "c")).alias("members"))
        found = lists.select("members").mapInArrow(_local_joins, "u long, w long, d float").withColumn("new", F.lit(True))
        graph = materialize(best(graph.withColumn("new", F.lit(False)).union(found.select("u", "w", "d", "new"))), "graph")
        share = graph.agg(F.avg(F.col("new").cast("int"))).first()[0]
        if not share or share <= SETTLED:
            break
    return graph


def _parts(ids: np.ndarray, dim: int, parts: int) -> np.ndarray:
    return (dim << 32) + ids % parts


def blocks(graph: DataFrame, points: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(part, nodes, offsets, others): neighbour lists by both directions; (part, nodes, vectors): vectors in double precision."""
    part = (F.col("dim").cast("long") * F.lit(1 << 32) + F.pmod("rep", F.lit(parts))).alias("part")

    def listed(group: pa.Table) -> pa.Table:
        v, w = np.asarray(group.column("v")), np.asarray(group.column("w"))
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        once = np.ones(len(v), bool)
        once[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        v, w = v[once], w[once]
        nodes, start = np.unique(v, return_index=True)
        return pa.table({"part": group.column("part").slice(0, 1), "nodes": [_bytes(nodes)], "offsets": [_bytes(np.append(start, len(v)))], "others": [_bytes(w)]})

    def stacked(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("rep"))
        order = np.argsort(ids)
        return pa.table({"part": group.column("part").slice(0, 1), "nodes": [_bytes(ids[order])], "vectors": [_bytes(_floats(group.column("v"), np.float64, len(ids))[order])]})

    own = points.select("rep", "dim", part)
    both = graph.select(F.col("u").alias("v"), "w").union(graph.select(F.col("w").alias("v"), F.col("u").alias("w")))
    lists = both.join(own, both.v == own.rep).select("part", "v", "w").groupBy("part").applyInArrow(listed, "part long, nodes binary, offsets binary, others binary")
    vectors = points.select("rep", "v", part).groupBy("part").applyInArrow(stacked, "part long, nodes binary, vectors binary")
    return materialize(lists, "lists"), materialize(vectors, "blocks")


_STATE = "q long, dim int, v binary, ids binary, far binary, done binary, open int"
_ASK = "part long, q long, dim int, v binary, worst double, ids binary"


def _ask(rows: Iterable[tuple], parts: int) -> dict[str, list]:
    """Rows of (q, dim, v, worst, ids) cut by the part that holds the ids."""
    out: dict[str, list] = {c: [] for c in ("part", "q", "dim", "v", "worst", "ids")}
    for q, dim, v, worst, ids in rows:
        part = _parts(ids, dim, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(ids) else []
        for piece in np.split(order, cuts[1:]) if len(ids) else []:
            for c, x in zip(out, (int(part[piece[0]]), q, dim, v, worst, _bytes(ids[piece]))):
                out[c].append(x)
    return out


def _asked(rows: Iterable[tuple], parts: int) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.binary())
    return pa.table({c: pa.array(x, k) for (c, x), k in zip(_ask(rows, parts).items(), kinds)})


def _worst(far: np.ndarray) -> float:
    return float(far[-1]) if len(far) >= BEAM else float("inf")


def search(queries: DataFrame, lists: DataFrame, vectors: DataFrame, entries: dict[int, np.ndarray], parts: int) -> DataFrame:
    """(q, ids, far): the beams, nearest first, of queries (q, dim, v)."""

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("dim"), b.column("v"), pa.array([_bytes(np.array([x], np.int64)) for x in q]), pa.array([_bytes(np.zeros(1))] * len(q), pa.binary()), pa.array([b"\0"] * len(q), pa.binary()), pa.array([1] * len(q), pa.int32())], names=["q", "dim", "v", "ids", "far", "done", "open"])

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _asked(((q, dim, v, float("inf"), entries[dim]) for q, dim, v in zip(*(b.column(c).to_pylist() for c in ("q", "dim", "v")))), parts).to_batches()

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q, dim, v, ids, far, done in zip(*(b.column(c).to_pylist() for c in ("q", "dim", "v", "ids", "far", "done"))):
                at = np.flatnonzero(np.frombuffer(done, np.uint8) == 0)[:WIDTH]
                rows.append((q, dim, v, _worst(np.frombuffer(far)), np.frombuffer(ids, np.int64)[at]))
            yield from _asked(rows, parts).to_batches()

    def opened(asks: pa.Table, block: pa.Table) -> pa.Table:
        if not (block.num_rows and asks.num_rows):
            return _asked((), parts)
        nodes, offsets, others = (np.frombuffer(block.column(c)[0].as_py(), np.int64) for c in ("nodes", "offsets", "others"))

        def rows() -> Iterator[tuple]:
            for q, dim, v, worst, ids in zip(*(asks.column(c).to_pylist() for c in ("q", "dim", "v", "worst", "ids"))):
                own = np.frombuffer(ids, np.int64)
                at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
                at = at[nodes[at] == own]
                if len(at):
                    yield q, dim, v, worst, np.unique(np.concatenate([others[offsets[i] : offsets[i + 1]] for i in at]))

        return _asked(rows(), parts)

    def measured(asks: pa.Table, block: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if block.num_rows and asks.num_rows:
            nodes = np.frombuffer(block.column("nodes")[0].as_py(), np.int64)
            x = np.frombuffer(block.column("vectors")[0].as_py()).reshape(len(nodes), -1)
            for q, v, worst, ids in zip(*(asks.column(c).to_pylist() for c in ("q", "v", "worst", "ids"))):
                own = np.frombuffer(ids, np.int64)
                gap = x[np.searchsorted(nodes, own)] - np.frombuffer(v)
                far = np.einsum("ij,ij->i", gap, gap)
                held = far <= worst
                if held.any():
                    for c, value in zip(out, (q, _bytes(own[held]), _bytes(far[held]))):
                        c.append(value)
        return pa.table({"q": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.binary()), "far": pa.array(out[2], pa.binary())})

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for ids, far, done, seen in zip(*(b.column(c).to_pylist() for c in ("ids", "far", "done", "seen"))):
                done = np.frombuffer(done, np.uint8).copy()
                done[np.flatnonzero(done == 0)[:WIDTH]] = 1
                seen = seen or []
                i = np.concatenate([np.frombuffer(ids, np.int64), *(np.frombuffer(s["ids"], np.int64) for s in seen)])
                d = np.concatenate([np.frombuffer(far), *(np.frombuffer(s["far"]) for s in seen)])
                o = np.concatenate([done, np.zeros(len(i) - len(done), np.uint8)])
                once = np.unique(i, return_index=True)[1]
                once = once[np.lexsort((i[once], d[once]))][:BEAM]
                for c, value in zip(out, (_bytes(i[once]), _bytes(d[once]), _bytes(o[once]), int((o[once] == 0).sum()))):
                    c.append(value)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("dim"), b.column("v"), *(pa.array(c, pa.binary()) for c in out[:3]), pa.array(out[3], pa.int32())], names=["q", "dim", "v", "ids", "far", "done", "open"])

    state = materialize(queries.mapInArrow(start, _STATE), "beams")
    wanted = queries.mapInArrow(enter, _ASK)
    while state.where("open > 0").limit(1).count():
        asks = state.where("open > 0").mapInArrow(pick, _ASK)
        found = asks.groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(opened, _ASK)
        wanted = found if wanted is None else found.union(wanted)
        seen = wanted.groupBy("part").cogroup(vectors.groupBy("part")).applyInArrow(measured, "q long, ids binary, far binary")
        seen = seen.groupBy("q").agg(F.collect_list(F.struct("ids", "far")).alias("seen"))
        state = materialize(state.join(seen, "q", "left").mapInArrow(merge, _STATE), "beams")
        wanted = None
    return state.select("q", "ids", "far")


def nearest(vectors: DataFrame, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by every, against all others."""
    spark = vectors.sparkSession
    text_batches(spark)
    rows, points = points_of(vectors, id_col, vec_col)
    shape = shapes(points)

    def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors less the mean, scaled, in single precision for the graph; scaled, in double precision for the search."""
        for b in batches:
            both: tuple[list, list] = ([], [])
            for dim, v in zip(b.column("dim").to_pylist(), b.column("v")):
                x = np.asarray(v.values) / shape[dim][2]
                both[0].append(_bytes((x - shape[dim][1] / shape[dim][2]).astype(np.float32)))
                both[1].append(_bytes(x))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("dim"), *(pa.array(x, pa.binary()) for x in both)], names=["rep", "dim", "c", "v"])

    held = materialize(points.mapInArrow(small, "rep long, dim int, c binary, v binary"), "held")
    graph = descend(first_links(held.select("rep", "dim", "c"), shape), held.select("rep", "c"))
    parts = max(1, math.ceil(sum(n * dim for dim, (n, _, _) in shape.items()) / BLOCK)) | 1
    lists, packed = blocks(graph, held.select("rep", "dim", "v"), parts)
    order = Window.partitionBy("dim").orderBy(F.xxhash64("rep"), "rep")
    chosen = held.select("dim", "rep").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ENTRIES).collect()
    entries = {dim: np.array(sorted(r.rep for r in chosen if r.dim == dim), np.int64) for dim in shape}
    asking = rows.where(F.col("id") % every == 0)
    q = held.join(asking.select("rep").distinct(), "rep").select(F.col("rep").alias("q"), "dim", "v")
    beams = search(materialize(q, "queries"), lists, packed, entries, parts)

    def top(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first points of each beam, and those at the last one's distance."""
        for b in batches:
            us, ws = [], []
            for q, ids, far in zip(*(b.column(c).to_pylist() for c in ("q", "ids", "far"))):
                i, d = np.frombuffer(ids, np.int64), np.frombuffer(far)
                i = i[d <= d[min(len(d) - 1, NEAREST)] * (1 + 1e-12)]
                us.append(np.full(len(i), q))
                ws.append(i)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(ws))], names=["q", "w"])

    pairs = beams.mapInArrow(top, "q long, w long")
    side = lambda k, v: points.select(F.col("rep").alias(k), F.col("v").alias(v))
    gap = F.zip_with("a", "b", lambda a, b: (a - b) * (a - b))
    scored = pairs.join(side("w", "b"), "w").join(side("q", "a"), "q").select("q", "w", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    # Of a point's copies no query can need more than the least eleven, its own row among them.
    copies = rows.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("rank") <= NEAREST + 1).select(F.col("rep").alias("w"), F.col("id").alias("vec_id"))
    ranked = scored.join(copies, "w").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("rank") <= NEAREST + 1)
    answers = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("list"))
    own = asking.join(answers, F.col("rep") == F.col("q"))
    own = own.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("id")), 1, NEAREST)).alias("pos", "x"))
    return own.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


_ORACLE = r"""
WITH g AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(range(len(q.v)), lambda i: (q.v[i + 1] - c.v[i + 1]) * (q.v[i + 1] - c.v[i + 1]))), lambda x, y: x + y)) AS score
  FROM g q JOIN g c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op11_nn_descent": op11_nn_descent}
ORACLES = {"op11_nn_descent": _ORACLE}
