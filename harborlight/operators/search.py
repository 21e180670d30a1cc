"""Text search by postings: an index by token, ranked answers from the asked tokens' postings alone, and merged result lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight.operators.scratch import place

#: Folders that tokens are dealt to by hash; tokens of all queries that are looked up by name, at most: beyond, the join alone picks them.
FOLDERS, NAMED = 64, 2000

#: Pairs of query and token that a task holds as a matrix and that matrix's cells, at most: more are met by a join. Documents that are scored at once.
PAIRS, CELLS, BLOCK = 20_000, 4_000_000, 500


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


class TextIndex:
    """Postings (token, id, tf) and document frequencies in a folder of the shared store, each in folders by the token's hash."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @staticmethod
    def build(docs: DataFrame, id_col: str, text_col: str) -> TextIndex:
        """Rows of one id are one document; a document without tokens counts, but is never found."""
        index = TextIndex(docs.sparkSession, place(docs.sparkSession, "postings"))
        words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(text_col)).alias("token"))
        counted = words.groupBy("token", "id").agg(F.count("*").alias("tf")).withColumn("folder", F.pmod(F.xxhash64("token"), F.lit(FOLDERS)).cast("int"))
        counted.repartition("folder").write.partitionBy("folder").parquet(f"{index.folder}/postings")
        postings = index.spark.read.parquet(f"{index.folder}/postings")
        postings.groupBy("folder", "token").agg(F.count("*").alias("df")).write.partitionBy("folder").parquet(f"{index.folder}/tokens")
        docs.agg(F.countDistinct(id_col).alias("n")).write.parquet(f"{index.folder}/size")
        return index

    def _of(self, name: str, asked: list[str] | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        if asked is None:
            return rows
        folders = self.spark.createDataFrame([(t,) for t in asked], "token string").select(F.pmod(F.xxhash64("token"), F.lit(FOLDERS)).cast("int").alias("f")).distinct()
        return rows.where(F.col("folder").isin([r.f for r in folders.collect()]) & F.col("token").isin(asked))

    def search(self, queries: DataFrame, query_id: str, text_col: str, k: int) -> DataFrame:
        """(query_id, rank, id, score): of each query the k documents of highest sum of (1 + ln tf) ln((n + 1) / df) over its different tokens, ties to the
        smaller id. Scores are rounded to six digits before they are ranked. Blank queries and queries without a known token have no answer."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(text_col))).alias("token")).distinct()
        few = asked.select("token").distinct().limit(NAMED + 1).collect()
        names = [r.token for r in few] if len(few) <= NAMED else None
        n = self.spark.read.parquet(f"{self.folder}/size").first().n
        weight = F.log((F.lit(n) + 1) / F.col("df"))
        known = self._of("tokens", names).select("token", weight.alias("idf"))
        pairs = asked.limit(PAIRS + 1).collect()
        if len(pairs) <= PAIRS and len({r.query_id for r in pairs}) * len({r.token for r in pairs}) <= CELLS:
            scored = self._best(pairs, asked, self._of("postings", names), known, k)
        else:
            hits = asked.join(known, "token").join(self._of("postings", names).select("token", "id", "tf"), "token")
            scored = hits.groupBy("query_id", "id").agg(F.sum((1 + F.log("tf")) * F.col("idf")).alias("score"))
        scored = scored.withColumn("score", F.round("score", 6))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


    def _best(self, pairs: list, asked: DataFrame, postings: DataFrame, known: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score) of each block of documents: for each query all that may be among its k best, by products of documents with the queries' tokens.

        A posting is read once, not once for each query that asks its token. All within the rounding of a block's k-th score stay, so that ties are the ranking's.
        """
        ids, words = list(dict.fromkeys(r.query_id for r in pairs)), list(dict.fromkeys(r.token for r in pairs))
        row, column = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
        asks = np.array([(row[r.token], column[r.query_id]) for r in pairs], np.int64).reshape(-1, 2)
        numbers = self.spark.createDataFrame(list(row.items()), "token string, t int")
        part = F.struct("t", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
        told = postings.select("token", "id", "tf").join(F.broadcast(numbers.join(known, "token")), "token")
        docs = told.groupBy("id").agg(F.collect_list(part).alias("parts"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = np.zeros((len(words), len(ids)))
            queries[asks[:, 0], asks[:, 1]] = 1
            for b in (b.slice(lo, BLOCK) for b in batches for lo in range(0, b.num_rows, BLOCK)):
                flat, size = b.column("parts").flatten(), b.column("parts").value_lengths().to_numpy()
                held = np.zeros((b.num_rows, len(words)))
                held[np.repeat(np.arange(b.num_rows), size), flat.field("t").to_numpy()] = flat.field("w").to_numpy()
                score = held @ queries
                least = np.partition(score, -k, axis=0)[-k] - 2e-6 if k < b.num_rows else np.zeros(len(ids))
                doc, query = np.nonzero((score > 0) & (score >= least))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), pa.array(query, pa.int32()), pa.array(score[doc, query])], names=["id", "q", "score"])

        kind = docs.schema["id"].dataType.simpleString()
        best = docs.mapInArrow(run, f"id {kind}, q int, score double")
        names = self.spark.createDataFrame([(q, i) for i, q in enumerate(ids)], T.StructType([asked.schema["query_id"], T.StructField("q", T.IntegerType())]))
        return best.join(F.broadcast(names), "q").select("query_id", "id", "score")


def merged_lists(lists: DataFrame, query_id: str, list_no: str, rank: str, item: str) -> DataFrame:
    """(query_id, position, item): the lists of a query behind each other in order of list_no, each item at its first place only."""
    first = lists.groupBy(query_id, item).agg(F.min(F.struct(list_no, rank)).alias("place"))
    return first.select(query_id, F.row_number().over(Window.partitionBy(query_id).orderBy("place", item)).alias("position"), item)
