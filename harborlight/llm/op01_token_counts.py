"""Token counts kept as delta-maintained rollups.

A batch of changes holds signed rows: an insert counts +1 document and its tokens, a delete -1 and minus its tokens,
a revision both (the old count out, the new one in). Every batch is summed to one signed row for each source,
language and tokenizer version before it is written, so a hot source is pre-aggregated in the map tasks, and lands
in a folder of the batch's own name. A batch is committed by its writer's success marker alone; one that is already
committed is skipped, one that was cut off is written anew, and readers only see committed batches: applying a
batch again, in any order of arrival, changes nothing. Totals are sums over batches; compaction folds the committed
ones into one folder, with a ledger of their names beside it: a table of its own, so that it outlives totals that come
to nothing, and the fold counts only once its ledger is committed. What a compaction has folded is deleted by the next
one, so that readers of the totals from before can finish.

Defined cases: null source or language is a group of its own; a null or empty text has 0 tokens and still counts as
a document; repeated rows count each; groups that fall to no documents and no tokens vanish from the totals; an
empty batch commits and changes nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import delete_path, fresh_path, path_exists, table, text_batches
from harborlight.llm.op02_byte_bpe import WordTable, slices, word_table
from harborlight.llm.op03_token_files import library_table

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    """Totals by source, language and tokenizer version under one folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _done(self) -> tuple[list[str], int]:
        """The folders that their writers have finished, and the number of the last fold whose ledger is (0: none)."""
        fs, root = self._fs()
        if not fs.exists(root):
            return [], 0
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        done = sorted(n for n in names if path_exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))
        return done, max((int(n[7:]) for n in done if n.startswith("ledger-")), default=0)

    def ledger(self, number: int) -> DataFrame:
        """The names of the batches that a fold holds."""
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/ledger-{number:09d}")

    def _folded(self, number: int, batches: list[str]) -> set[str]:
        """Those of a few batches that are in a fold."""
        return {r.batch for r in self.ledger(number).where(F.col("batch").isin(batches)).collect()} if number and batches else set()

    def committed(self) -> list[str]:
        """The folders whose sums make up the totals: the last fold and the batches committed since."""
        done, fold = self._done()
        batches = [n[6:] for n in done if n.startswith("batch-")]
        covered = self._folded(fold, batches)
        return [f"fold-{fold:09d}"] * bool(fold) + [f"batch-{b}" for b in batches if b not in covered]

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits signed changes (source, lang, tokenizer, sign, n_tokens); False if the batch was committed before."""
        return self.apply_sums(batch, changes.select(*KEYS, F.col("sign").cast("long").alias("n_docs"), (F.col("sign") * F.col("n_tokens")).alias("n_tokens")))

    def apply_sums(self, batch: str, sums: DataFrame) -> bool:
        """The same for changes that say by themselves how many documents and tokens they add (source, lang, tokenizer, n_docs, n_tokens)."""
        done, fold = self._done()
        if f"batch-{batch}" in done or self._folded(fold, [batch]):
            return False
        sums = sums.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        parts = [f"{self.folder}/{n}" for n in self.committed()]
        rows = self.spark.read.schema(_SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds the committed parts into one; the parts stay for readers until the next compaction."""
        done, fold = self._done()
        parts = self.committed()
        fresh = [n[6:] for n in parts if n.startswith("batch-")]
        if not fresh:
            return
        rows = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.folder}/{n}" for n in parts))
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/fold-{fold + 1:09d}")
        names = self.spark.createDataFrame([(b,) for b in fresh], "batch string")
        names = self.ledger(fold).union(names) if fold else names
        names.write.mode("overwrite").parquet(f"{self.folder}/ledger-{fold + 1:09d}")
        for n in done:
            if n not in parts and not n.endswith(f"-{fold:09d}"):
                delete_path(self.spark, f"{self.folder}/{n}")


def insert(rows: DataFrame) -> DataFrame:
    """Rows (source, lang, tokenizer, n_tokens) in, once each, or as often as a column copies says."""
    return rows.withColumn("sign", F.col("copies") if "copies" in rows.columns else F.lit(1))


def delete(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sign", -F.col("copies") if "copies" in rows.columns else F.lit(-1))


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts out and the new ones in: two additive rows, no lookup of a stored row."""
    return delete(old).union(insert(new))


def words_v1(text: Column) -> Column:
    """Version 1: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def words_v2(text: Column) -> Column:
    """Version 2: letters-and-digits runs of ASCII, other runs of non-space characters, apart."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four deliveries: all documents in; repeats of an earlier text out; the counts of the documents that stay revised
    from version 1 to version 2; and the second batch once more, as after a lost acknowledgement, which is skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    counted = docs.select("doc_id", "source", "lang", key.alias("key"), words_v1(F.col("text")).alias("v1"), words_v2(F.col("text")).alias("v2"))
    return deduplicated_totals(counted)


def deduplicated_totals(counted: DataFrame) -> DataFrame:
    """The deliveries of op1_token_counts over rows (doc_id, source, lang, key, v1, v2): one row a text stays, that of the least doc_id
    (null ids last), of equal ids the least source and language, and of equal rows one.

    A text's copies are summed by source and language in the map tasks, so that a text that holds a third of all rows meets as a few.
    """
    spark = counted.sparkSession
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")).alias("lead")
    alike = counted.groupBy("key", "source", "lang").agg(F.count("*").alias("n"), lead, F.min("v1").alias("v1"), F.min("v2").alias("v2"))
    path = fresh_path(spark, "counted")
    alike.write.parquet(path)
    alike = spark.read.schema(alike.schema).parquet(path)
    place = F.struct("lead", "source", "lang")
    first = alike.groupBy("key").agg(F.min(place).alias("first"))
    marked = alike.join(first, "key").withColumn("stays", place.eqNullSafe(F.col("first")).cast("long"))
    version = lambda v, copies: marked.select("source", "lang", F.lit(v).alias("tokenizer"), F.col(v).alias("n_tokens"), copies.alias("copies")).where("copies > 0")
    rollup = TokenRollup(spark, fresh_path(spark, "rollup"))
    staying = F.col("stays")
    gone = version("v1", F.col("n") - staying)
    rollup.apply("1-load", insert(version("v1", F.col("n"))))
    rollup.apply("2-repeats", delete(gone))
    rollup.apply("3-version", revise(version("v1", staying), version("v2", staying)))
    rollup.apply("2-repeats", delete(gone))
    rollup.compact()
    return rollup.totals()


def token_counts_by_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under two published byte-level vocabularies, kept side by side: each is a delivery of its own; then the documents
    without a language are revised to the language "und" under both, and that delivery comes twice."""
    import public_tokenizers

    multi, plain, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents")
    rollup = TokenRollup(spark, fresh_path(spark, "rollup"))
    loads = {"byte_bpe_multi_50k": lambda: word_table(multi, pattern), "byte_bpe_50k": lambda: library_table(plain)}
    for name, encoder in loads.items():
        rollup.apply_sums(f"load-{name}", token_totals(docs, encoder).withColumn("tokenizer", F.lit(name)))
    bare = rollup.totals().where("lang is null")
    move = bare.select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")).unionByName(bare.withColumn("lang", F.lit("und")))
    rollup.apply_sums("languages", move)
    rollup.apply_sums("languages", move)
    return rollup.totals()


def token_totals(docs: DataFrame, encoder: Callable[[], WordTable]) -> DataFrame:
    """(source, lang, n_docs, n_tokens) by an encoder that each task makes for itself: whole texts are encoded, counts summed in the map tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder()
        for b in batches:
            texts = b.column("text").fill_null("")
            for lo, hi in slices(texts):
                count = words.encode(texts.slice(lo, hi - lo))[1]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("source", "lang")), pa.array(count)], names=["source", "lang", "n"])

    text_batches(docs.sparkSession)
    rows = docs.select("source", "lang", "text").mapInArrow(run, "source string, lang string, n long")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


_ORACLE = r"""
WITH d AS (
  SELECT source, lang, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS r,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+')) AS n
  FROM documents
)
SELECT source, lang, 'v2' AS tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM d WHERE r = 1 GROUP BY source, lang
"""

QUERIES = {"op1_token_counts": op1_token_counts, "token_counts_by_tokenizer": token_counts_by_tokenizer}
ORACLES = {"op1_token_counts": _ORACLE}


def merged(rollups: list[DataFrame]) -> DataFrame:
    """Totals of several rollups, such as those of separate clusters: sums are additive."""
    union = reduce(DataFrame.unionByName, rollups)
    return union.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
