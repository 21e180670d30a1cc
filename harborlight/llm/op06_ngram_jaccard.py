"""Exact Jaccard self-join of documents on word shingles through a token-group matrix.

Steps, each a Spark job over all documents:

1. Shingle every text to a set of 64-bit hashes. Documents with equal sets are one class; only the class
   representative goes on, and its copies share its component.
2. Of every set keep its leading tokens under the order of the hashes: p(n) = n - ceil(3n/4) + L(n) of them with
   L(n) = 1 + n // 5. Two sets with Jaccard >= t share at least L(min(n1, n2)) leading tokens (general t alike).
   Tokens of a single representative are dropped from the sorted token stream, and so are documents left with
   fewer tokens than any partner would need.
3. The whole sets of the documents left: a document has s tokens that others hold too. A partner shares ceil(t * n)
   of them, so one of the s - ceil(t * n) + 1 in the fewest documents (its lead) is in the partner's lead as well.
   Tokens that lead the same documents (a passage that many share) count as one. The first leading token that two
   documents share has all others that they share behind it, on both sides.
4. Partition into groups of similar documents. In each round the leader of a token's list, at first the document with
   the largest share of common tokens, is compared with the others by whole sets; the components of the links found
   are cut by size and number into groups of about 32 documents. A group's row of the matrix is the union of its
   members' tokens, so a thousand near copies are thirty rows.
5. Bound: documents a and b link only if they share ceil(t * (na + nb) / (1 + t)) tokens, so a document of one component
   links into a group of another only if a token of its lead is in a lead there, with so many shared tokens from it
   on, by the least size in the group, and as many of its tokens are in the group's union. Lists inside one component
   are passed over.
6. Open: the document is compared by whole sets with the members of the groups that qualify, and of those only with
   members of which either side has tokens enough. Links inside a component add nothing, so component ids are exact
   though not all links are listed.

Defined cases: a null or empty text or one of white space has no set and links with nothing; a text under k words
has its whole sequence as its one shingle; repeated rows of a doc_id count as copies, and of different texts of one
doc_id the least is compared; rows with a null doc_id are left out; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import BROADCAST_IDS, connected_components, materialize, table, with_ids
from harborlight.llm.textscan import LOWER, blocks, mix, shingle_hashes, span_hashes, words

#: Rounds of comparing a token's documents with one of them.
LEADERS = 3
#: Documents that a group of the matrix holds, as a mean; their sizes differ by a tenth at most.
GROUP = 32
GROUP_KEY = ["comp", "band", "part"]


def document_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes, ends by row) of blocks of texts."""
    for lo, hi, buf, off in blocks(column):
        buf = LOWER[buf]
        start, end, row = words(buf, off)
        h, at = shingle_hashes(span_hashes(buf, start, end) if len(start) else np.zeros(0, np.uint64), row, hi - lo, k)
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        h, at = h[new], at[new]
        yield lo, hi, h, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=hi - lo))]).astype(np.int64)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, t: int, k: int) -> DataFrame:
    """(doc_id, n, sig1, sig2, lead): set size, a 128-bit identity of the set, and its leading tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, ends in document_sets(b.column("text"), k):
                n = np.diff(ends)
                with np.errstate(over="ignore"):
                    total = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x)])[ends]).view(np.int64)
                    sig1, sig2 = total(mix(h + np.uint64(1))), total(mix(h ^ np.uint64(0x5851F42D4C957F2D)))
                p = np.where(n > 0, n - (-(-n * t // 100)) + 1 + n // 5, 0)
                p = np.minimum(p, n)
                close = np.cumsum(p)
                take = np.repeat(ends[:-1] - close + p, p) + np.arange(int(close[-1]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(sig1), pa.array(sig2), _lists(h[take], np.concatenate([[0], close]))],
                    names=["doc_id", "n", "sig1", "sig2", "lead"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, sig1 long, sig2 long, lead array<long>")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tokens, n): the whole sets, ascending."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, ends in document_sets(b.column("text"), k):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), _lists(h, ends), pa.array(np.diff(ends))], names=["doc_id", "tokens", "n"])

    return docs.mapInArrow(run, "doc_id long, tokens array<long>, n long")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """(token, doc_id, n) without the tokens that only one document has: a pass over the sorted stream of each partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, with whether its token has shown before
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            whole = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if held is not None else b
            t = whole.column("token").to_numpy()
            same = t[1:] == t[:-1]
            first = before is not None and t[0] == before
            keep = np.concatenate([[first], same]) | np.concatenate([same, [False]])
            done = whole.slice(0, len(t) - 1).filter(pa.array(keep[:-1]))
            if done.num_rows:
                yield done
            held = whole.slice(len(t) - 1, 1)
            before = t[-1] if len(t) > 1 and same[-1] or len(t) == 1 and first else None
        if held is not None and before is not None:
            yield held

    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, doc_id long, n long")


def _least(n: Column, t: int) -> Column:
    """Leading tokens that a document shares with any partner: L(ceil(t * n))."""
    return F.lit(1) + F.floor(F.ceil(n * t / 100) / 5).cast("long")


def _fits(na: Column, sa: Column, nb: Column, sb: Column, t: int) -> Column:
    """Whether sets of na and nb tokens, of which sa and sb at most are shared, can reach the threshold."""
    return F.least(sa, sb) * (100 + t) >= (na + nb) * t


def _rows_once(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, text) of the members, one row each: of the texts of a repeated doc_id the least."""
    rows = with_ids(docs, members, "doc_id")
    again = materialize(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return rows
    return rows.join(again, "doc_id", "left_anti").union(rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def leading(docs: DataFrame, members: DataFrame, t: int, k: int) -> DataFrame:
    """(doc_id, n, s, lead, shared): set size, number of tokens that other members hold, those of them in the fewest
    documents of which any partner leads with one, and all of them. Members that can have no partner are left out."""
    tokens = whole_sets(_rows_once(docs, members), k).select(F.explode("tokens").alias("token"), "doc_id", "n").repartition("token")
    held = tokens.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    each = tokens.join(held, "token").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("docs", "token"))).alias("shared"))
    need = F.ceil(F.col("n") * t / 100).cast("int")
    each = each.withColumn("s", F.size("shared")).where(F.col("s") >= need)
    lead = F.slice("shared", F.lit(1), F.col("s") - need + 1).alias("lead")
    return each.select("doc_id", "n", "s", lead, F.col("shared.token").alias("shared"))


def lists_once(leads: DataFrame) -> DataFrame:
    """(token, doc_id, n, s, rest) by leading token, rest counting the shared tokens from it on; of tokens that lead the
    same documents the first stands for all."""
    each = leads.select("doc_id", "n", "s", F.posexplode("lead").alias("at", "t")).select("t.token", "t.docs", "doc_id", "n", "s", (F.col("s") - F.col("at")).alias("rest"))
    same = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"x{i}") for i in range(2)]
    lists = each.groupBy("token", "docs").agg(F.count("*").alias("leads"), *same).where("leads > 1")
    first = lists.groupBy("leads", "x0", "x1").agg(F.min(F.struct("docs", "token")).alias("t")).select("t.token")
    return each.join(first, "token", "left_semi").drop("docs")


def _beside(df: DataFrame, placed: DataFrame) -> DataFrame:
    """df with the columns of placed by doc_id; placed is broadcast up to a checked number of rows."""
    return df.join(F.broadcast(placed) if placed.count() <= BROADCAST_IDS else placed, "doc_id")


def verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold; sets has the tokens that may be shared, and sizes."""
    pairs = materialize(pairs.distinct(), "pairs")
    few = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
    first = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("ta")).join(few, "a")
    second = with_ids(sets, pairs.select(F.col("b").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("tb"))
    met = first.join(second, "b").withColumn("o", F.size(F.array_intersect("ta", "tb")))
    return met.where(F.col("o") * (100 + t) >= (F.col("na") + F.col("nb")) * t).select("a", "b")


def opened_pairs(matrix: DataFrame, kept: DataFrame, placed: DataFrame, t: int) -> DataFrame:
    """(a, b): documents of different components of which a's tokens meet the bound for the group of b."""
    sizes = placed.groupBy("comp").agg(F.count("*").alias("docs"))
    grouped = kept.select("doc_id", "n", "s").join(placed, "doc_id").join(sizes, "comp")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1))).alias("band")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("docs") / GROUP)).alias("part")
    grouped = materialize(grouped.select("doc_id", "n", "s", "comp", "docs", band, part), "groups")

    rows = _beside(matrix.select("token", "doc_id", "rest"), grouped)
    across = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    rows = materialize(rows.join(across, "token", "left_semi"), "across")
    union = rows.groupBy("token", "docs", *GROUP_KEY).agg(F.min("n").alias("least"), F.max("rest").alias("most"))
    query = rows.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("rest").alias("sa"), F.col("comp").alias("ca"), F.col("docs").alias("da"))
    met = query.join(union, "token").where((F.struct("da", "ca") < F.struct("docs", "comp")) & _fits(F.col("na"), F.col("sa"), F.col("least"), F.col("most"), t))
    asked = materialize(met.groupBy("a", "na", *GROUP_KEY).agg(F.min("least").alias("least")), "asked")

    wanted = grouped.join(asked.select(*GROUP_KEY).distinct(), GROUP_KEY, "left_semi").select("doc_id", *GROUP_KEY)
    unions = _beside(kept.select("doc_id", "shared"), wanted).groupBy(*GROUP_KEY).agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("union"))
    own = with_ids(kept.select("doc_id", "shared"), asked.select(F.col("a").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("a"), "shared")
    overlap = F.size(F.array_intersect("shared", "union"))
    enough = F.greatest(F.col("least"), F.ceil(F.col("na") * t / 100)) + F.col("na")
    opened = asked.join(own, "a").join(unions, GROUP_KEY).withColumn("o", overlap).where(F.col("o") * (100 + t) >= enough * t).select("a", "na", "o", *GROUP_KEY)
    member = grouped.select(*GROUP_KEY, F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return opened.join(member, GROUP_KEY).where(_fits(F.col("na"), F.col("o"), F.col("nb"), F.col("sb"), t)).select("a", "b")


def similar_classes(docs: DataFrame, t: int = 75, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (doc_id, text); t in per cent."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sketch = materialize(sketches(docs, t, k), "sketch")
    reps = materialize(sketch.where("n > 0").groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("rep")), "reps")
    leads = with_ids(sketch.where("n > 0"), reps.select(F.col("rep").alias("doc_id")), "doc_id")
    left = shared_tokens(leads.select(F.explode("lead").alias("token"), "doc_id", "n"))
    # A document with fewer surviving tokens than any partner needs goes.
    members = materialize(left.groupBy("doc_id", "n").count().where(F.col("count") >= _least(F.col("n"), t)).select("doc_id").distinct(), "members")
    kept = materialize(leading(docs, members, t, k), "kept")
    matrix = materialize(lists_once(kept), "matrix")

    placed, links = kept.select("doc_id", F.col("doc_id").alias("comp")), None
    for turn in range(LEADERS):
        rows = _beside(matrix, placed)
        draw = F.struct((F.col("s") * 7 - F.col("n") * 6 if turn == 0 else F.xxhash64("doc_id", F.lit(turn))).alias("by"), "doc_id")
        head = F.max_by(F.struct(F.col("doc_id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("s").alias("sa")), draw).alias("head")
        heads = rows.groupBy("token").agg(head, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "head.*")
        pairs = rows.join(heads, "token").where((F.col("comp") != F.col("ca")) & _fits(F.col("na"), F.col("sa"), F.col("n"), F.col("s"), t))
        found = materialize(verified(pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")), kept, t), "links")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        comp = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        placed = materialize(kept.select("doc_id").join(comp, F.col("doc_id") == comp.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp")), "placed")

    last = materialize(verified(opened_pairs(matrix, kept, placed, t), kept, t), "links")
    links = last if links is None else links.union(last)
    comp = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = reps.select("sig1", "sig2", "n", "rep")
    classes = classes.join(comp, classes.rep == comp.node, "left").select("sig1", "sig2", "n", F.coalesce("component", "rep").alias("component_id"))
    full = sketch.where("n > 0").select("doc_id", "n", "sig1", "sig2").join(classes, ["sig1", "sig2", "n"])
    empty = sketch.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


def _second_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, other) of the texts of a doc_id beyond its first, and a number of 63 bits for each."""
    texts = docs.where("doc_id is not null").select("doc_id", "_key").groupBy("doc_id").agg(F.sort_array(F.collect_set("_key")).alias("keys"))
    more = texts.where(F.size("keys") > 1).select("doc_id", F.explode(F.slice("keys", 2, F.size("keys") - 1)).alias("_key"))
    low = (1 << 62) - 1
    return materialize(more.withColumn("_other", F.xxhash64("doc_id", "_key").bitwiseAND(F.lit(low)).bitwiseOR(F.lit(low + 1))), "second-texts")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the smallest doc_id of every component stays, in one row; rows without a doc_id stay.

    Different texts of one doc_id are documents of their own: the first in order of hashes goes by the doc_id, the
    others by a number above all usual ids. Of rows of one doc_id with equal words the one of least hash stays.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), upper, lower), r"[\x20\x09-\x0D]+", " ")
    keyed = docs.withColumn("_key", F.sha2(F.trim(plain).cast("binary"), 256))
    second = _second_texts(keyed)
    named = docs.withColumn("_id", F.col("doc_id").cast("long"))
    if not second.isEmpty():
        named = keyed.join(second, ["doc_id", "_key"], "left").withColumn("_id", F.coalesce("_other", F.col("doc_id").cast("long")))
    first = similar_classes(named.select(F.col("_id").alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    kept = named.join(first, "_id", "left_semi").groupBy("_id").agg(row)
    return kept.select("row.*").union(docs.where("doc_id is null").select(*docs.columns))


_ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), classes AS (
  SELECT list_sort(sh) AS sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY 1
), tok AS (
  SELECT rep, len(sh) AS n, unnest(sh) AS t FROM classes
), pairs AS (
  SELECT x.rep AS a, y.rep AS b FROM tok x JOIN tok y ON x.t = y.t AND x.rep < y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach(node, other) AS (
  SELECT rep, rep FROM classes UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), comp AS (
  SELECT node, min(other) AS c FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id
FROM s LEFT JOIN classes ON list_sort(s.sh) = classes.sh LEFT JOIN comp ON node = rep
"""

QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLES = {"op6_ngram_jaccard": _ORACLE}
