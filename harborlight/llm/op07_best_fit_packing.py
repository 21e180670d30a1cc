"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A document's length is its number of UTF-8 bytes. Documents longer than a bin give full pieces of their own bins;
what is left of each document is packed. Pieces are dealt to shards by the hash of their row, each shard of a size
that one task packs, so the number of shards grows with the table and a hot source or a hot text is spread over all. In a shard pieces come longest
first. Open bins are ordered by residual and carry a bitmap of the sources and one of the duplicate clusters that
they hold; from the first bin that is large enough the successors are searched until one has neither the piece's
source nor its cluster, which is the tightest compatible bin. If there is none, a bin is opened.

Defined cases: a null or empty text has length 0 and is placed in a bin like any other; null sources are one
source; a null doc_id keeps its row; repeated rows are one duplicate cluster and never share a bin; ties go by
doc_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import materialize, table

#: Bytes of a bin; pieces of a shard, about.
CAPACITY, SHARD = 8192, 20_000


class Bins:
    """Open bins in the order of their residual, in blocks; each bin has the bitmap of what it holds, and each block the
    bits that all its bins have, so that blocks of conflicting bins are passed over in one step."""

    BLOCK = 64

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        #: By block: residuals, bin numbers, bitmaps. The last two lists run over the blocks: largest residual, common bits.
        self.blocks: list[tuple[list[int], list[int], list[int]]] = []
        self.top: list[int] = []
        self.common: list[int] = []

    def _settle(self, k: int) -> None:
        residual, _, held = self.blocks[k]
        if not residual:
            for x in (self.blocks, self.top, self.common):
                del x[k]
            return
        bits = held[0]
        for h in held:
            bits &= h
            if not bits:
                break
        self.top[k], self.common[k] = residual[-1], bits

    def _add(self, left: int, number: int, held: int) -> None:
        k = bisect_left(self.top, left)
        if k == len(self.blocks):
            if k and len(self.blocks[-1][0]) < self.BLOCK:
                k -= 1
            else:
                self.blocks.append(([], [], []))
                self.top.append(left)
                self.common.append(held)
        block = self.blocks[k]
        at = bisect_left(block[0], left)
        for x, v in zip(block, (left, number, held), strict=True):
            x.insert(at, v)
        if len(block[0]) > 2 * self.BLOCK:
            self.blocks[k : k + 1] = [tuple(x[: self.BLOCK] for x in block), tuple(x[self.BLOCK :] for x in block)]
            self.top.insert(k, 0)
            self.common.insert(k, 0)
            self._settle(k)
            self._settle(k + 1)
        else:
            self.top[k], self.common[k] = block[0][-1], self.common[k] & held

    def place(self, length: int, bits: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece with these conflict bits."""
        for k in range(bisect_left(self.top, length), len(self.blocks)):
            if self.common[k] & bits:
                continue
            residual, numbers, held = self.blocks[k]
            for i in range(bisect_left(residual, length), len(residual)):
                if not held[i] & bits:
                    left, number, had = residual.pop(i), numbers.pop(i), held.pop(i)
                    self._settle(k)
                    self._add(left - length, number, had | bits)
                    return number, self.capacity - left
        self.made += 1
        self._add(self.capacity - length, self.made - 1, bits)
        return self.made - 1, 0


def pack(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece. Only clusters of several pieces can conflict and get a bit, behind the sources'."""
    kinds, bit = np.unique(source, return_inverse=True)
    _, which, count = np.unique(cluster, return_inverse=True, return_counts=True)
    many = np.cumsum(count > 1) - 1 + len(kinds)
    out, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    bins = Bins(capacity)
    for i in order.tolist():
        w = which[i]
        out[i], at[i] = bins.place(int(length[i]), 1 << int(bit[i]) | (1 << int(many[w]) if count[w] > 1 else 0))
    return out, at


def packed(docs: DataFrame, length: Column, cluster: Column, capacity: int = CAPACITY, shard_pieces: int = SHARD) -> DataFrame:
    """(doc_id, source, piece, start, length, bin, bin_offset) of every piece of every document."""
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), length.cast("long").alias("n"), cluster.cast("long").alias("cluster"), F.monotonically_increasing_id().alias("row"))
    base = materialize(base, "lengths")
    full = F.floor(F.col("n") / capacity)
    rest = base.withColumn("piece", full).withColumn("start", full * capacity).withColumn("n", F.col("n") - full * capacity).where("n > 0 or piece = 0")
    shards = max(1, -(-base.count() // shard_pieces))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        shard = t["shard"].to_numpy()
        for s in np.unique(shard):
            rows = t.filter(pa.array(shard == s))
            n, key = rows["n"].to_numpy(), rows["doc_id"].fill_null(-(1 << 62)).to_numpy()
            source = np.array(rows["source"].to_pylist(), object).astype(str)
            order = np.lexsort((rows["row"].to_numpy(), rows["cluster"].to_numpy(), key, -n))
            number, at = pack(n, source, rows["cluster"].to_numpy(), order, capacity)
            names = [pa.array([f"p{s}-{b}" for b in number.tolist()])]
            yield pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in ("doc_id", "source", "piece", "start", "n")), *names, pa.array(at)], names=["doc_id", "source", "piece", "start", "length", "bin", "bin_offset"])

    schema = "doc_id long, source string, piece long, start long, length long, bin string, bin_offset long"
    shared = dealt.select("doc_id", "source", "piece", "start", "n", "cluster", "row", "shard").repartition(shards, "shard").mapInArrow(run, schema)
    # Pieces as long as a bin fill it: no search, no conflict.
    whole = base.where(F.col("n") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)))
    name = F.format_string("w%d-%d", "row", "piece")
    alone = whole.select("doc_id", "source", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), name.alias("bin"), F.lit(0).cast("long").alias("bin_offset"))
    return shared.union(alone)


def text_length() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0))


def text_cluster() -> Column:
    """Equal texts, whatever the case of A-Z, are one cluster."""
    return F.xxhash64(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), text_length(), text_cluster())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents in their bins."""
    return packed(docs, text_length(), text_cluster())


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
