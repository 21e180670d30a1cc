"""Byte-level BPE encoding and decoding by merge replay.

Every task replays the merge list over its block of the corpus: the block's distinct words are laid out in one
symbol array, an inverted index leads from a merge's rank to the positions where its pair stands, and the ranks
are applied in order, each touching only the neighbours of the positions it merges. Words are independent, so a
block needs no shuffle and a lost executor costs one block. The ids of words seen before stay in the worker's
table, whose size is bounded; words beyond the bound are replayed again with their block.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; extra
columns are carried unless they bear the name of an output; texts may be of any length (memory grows with the
longest text and the block).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight.llm.common import table, text_batches
from harborlight.llm.textscan import blocks, span_hashes

#: Words whose ids a worker keeps between batches.
KEPT_WORDS = 300_000
_NONE = np.int64(1) << 40


class MergeReplay:
    """Ids of distinct words under a table of byte-string ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        self.risky = set()
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    made.append(r)
                    self.risky.update(x for x in (a, b) if x > r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62), np.append(np.array(made, np.int64)[order], _NONE)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        i = np.searchsorted(self.keys, key)
        return np.where((a >= 0) & (b >= 0) & (self.keys[i] == key), self.made[i], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids (little-endian, 32 bits), as the lowest-ranked pair of a word is merged first, leftmost first among equals."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        close = np.cumsum(size + 1) - 1
        sym = self.byte_id[raw]
        sym[close] = -1
        word = np.repeat(np.arange(len(words), dtype=np.int32), size + 1)
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[-1], prv[0] = n - 1, n - 1  # both lead to the last separator
        pair = np.full(n, _NONE)
        pair[:-1] = self.rank_of(sym[:-1], sym[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray) -> None:
            rank = pair[at]
            live = rank < _NONE
            at, rank = at[live], rank[live]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                r = int(rank[lo])
                if r in waiting:
                    waiting[r].append(at[lo:hi])
                else:
                    waiting[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)

        index(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            found = waiting.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[pair[at] == r]
            if not len(at):
                continue
            at.sort()
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if r in self.risky:  # a merge may uncover a lower rank: one merge in each word, then look again
                first = np.unique(word[at], return_index=True)[1]
                rest = np.delete(at, first)
                if len(rest):
                    waiting[r] = [rest]
                    heapq.heappush(heap, r)
                at = at[first]
            elif len(at) > 1:
                touch = nxt[at[:-1]] == at[1:]
                if touch.any():  # overlapping pairs, such as in "aaa": the leftmost wins
                    keep = np.ones(len(at), bool)
                    for i in np.flatnonzero(touch):
                        keep[i + 1] = not keep[i]
                    at = at[keep]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = r
            sym[gone] = -2
            pair[gone] = _NONE
            nxt[at] = after
            prv[after] = at
            left = prv[at]
            pair[at] = self.rank_of(sym[at], sym[after])
            pair[left] = self.rank_of(sym[left], sym[nxt[left]])
            pair[n - 1] = _NONE
            index(np.concatenate([left, at]))
        live = sym >= 0
        ids = sym[live].astype("<i4")
        ends = np.cumsum(np.bincount(word[live], minlength=len(words)))
        raw, at = ids.tobytes(), (ends * 4).tolist()
        return [raw[i:j] for i, j in zip([0, *at], at, strict=False)]


class WordTable:
    """Ids of texts, word by word; words are cut before spaces and the known ones come from a table.

    No match of the pattern reaches over a single space between two other characters, so a text's ids are those of
    its words, each with the space before it. A text with other white space beside a space is cut as a whole.
    `learn` gives the ids of a list of strings, each by itself; `words` the same of words that stand alone.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], whole: str = "\0\0", words: Callable[[list[str]], list[bytes]] | None = None):
        self.learn, self.words, self.whole = learn, words or learn, whole.encode()
        self.known: dict[bytes, bytes | None] = {}

    def stands_alone(self, word: str, raw: bytes) -> bool:
        body = word[1:] if word[0] == " " else word
        return bool(body) and not body[0].isspace() and not body[-1].isspace() and self.whole not in raw

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in a row, and each text's number of ids."""
        starts, ends, hashes, rows, raws = [], [], [], [], []
        base, total = 0, len(column)
        for lo, _, buf, off in blocks(column):
            first = buf == 32
            inner = off[:-1]
            first[inner[inner < len(buf)]] = True
            start = np.flatnonzero(first)
            end = np.append(start[1:], len(buf))
            starts.append(start + base)
            ends.append(end + base)
            hashes.append(span_hashes(buf, start, end) if len(start) else np.zeros(0, np.uint64))
            rows.append(np.searchsorted(off, start, "right") - 1 + lo)
            raws.append(buf)
            base += len(buf)
        if not base:
            return np.zeros(0, "<i4"), np.zeros(total, np.int64)
        raw = np.concatenate(raws).tobytes()
        start, end, row, h = (np.concatenate(x) for x in (starts, ends, rows, hashes))
        order = np.argsort(h)
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        word = np.empty(len(h), np.int32)
        word[order] = np.cumsum(new) - 1
        at = order[new]
        distinct = [raw[i:j] for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        fresh = [w for w in distinct if w not in self.known]
        text = [w.decode() for w in fresh]
        alone = [i for i, w in enumerate(fresh) if self.stands_alone(text[i], w)]
        self.known.update(dict.fromkeys(fresh))
        self.known.update(zip((fresh[i] for i in alone), self.words([text[i] for i in alone]), strict=True))
        ids = [self.known[w] for w in distinct]
        if len(self.known) > KEPT_WORDS:
            for w in fresh:
                del self.known[w]
        odd = np.fromiter((x is None for x in ids), bool, len(ids))
        cut = np.unique(row[odd[word]]) if odd.any() else np.zeros(0, np.int64)
        if len(cut):  # these texts are cut as a whole: their first word stands for all of it
            keep = np.ones(len(word), bool)
            at_first = np.searchsorted(row, cut)
            keep[np.isin(row, cut)] = False
            keep[at_first] = True
            word[at_first] = len(ids) + np.arange(len(cut))
            ids += self.learn([column[int(r)].as_py() for r in cut])
            word, row = word[keep], row[keep]
        size = np.fromiter((len(x) >> 2 if x else 0 for x in ids), np.int64, len(ids))
        flat, place = np.frombuffer(b"".join(x or b"" for x in ids), "<i4"), np.concatenate([[0], np.cumsum(size)[:-1]])
        each = size[word]
        close = np.cumsum(each)
        take = np.repeat((place[word] - close + each).astype(np.int32), each)
        take += np.arange(len(take), dtype=np.int32)
        count = np.zeros(total, np.int64)
        np.add.at(count, row, each)
        return flat[take], count


def replayed(pattern: str, replay: MergeReplay) -> Callable[[list[str]], list[bytes]]:
    """Ids of strings: each match of the pattern is a word of the replay."""
    cut = regex.compile(pattern)

    def learn(texts: list[str]) -> list[bytes]:
        cuts = [cut.findall(t) for t in texts]
        distinct = list({p for c in cuts for p in c})
        ids = dict(zip(distinct, replay.encode([p.encode() for p in distinct]), strict=True))
        return [b"".join(map(ids.__getitem__, c)) for c in cuts]

    return learn


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_TABLES: dict[tuple[str, str], WordTable] = {}


def word_table(path: str, pattern: str) -> WordTable:
    if (path, pattern) not in _TABLES:
        _TABLES[path, pattern] = WordTable(replayed(pattern, MergeReplay(load_ranks(path))))
    return _TABLES[path, pattern]


def slices(column: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes of text."""
    for lo, hi, _, _ in blocks(column, size):
        yield lo, hi


def list_column(flat: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Replaces the text column by its ids (array of int)."""
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(vocabulary, pattern)
        for b in batches:
            texts = b.column(text).fill_null("")
            for lo, hi in slices(texts):
                cols = [b.column(c).slice(lo, hi - lo) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, list_column(*words.encode(texts.slice(lo, hi - lo)))], names=[*keep, out])

    text_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for (binary); null ids give no bytes."""
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in load_ranks(vocabulary).items()}
        length, spelt = np.zeros(max(tokens) + 1, np.int64), np.full(max(tokens) + 1, b"", object)
        for i, t in tokens.items():
            length[i], spelt[i] = len(t), t
        for b in batches:
            column = b.column(ids)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < len(sizes):  # about a million ids at a time
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), "right")) - 1)
                flat = np.asarray(column.slice(lo, hi - lo).flatten())
                size = np.concatenate([[0], np.cumsum(length[flat])])[ends[lo : hi + 1] - ends[lo]]
                made = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(b"".join(spelt[flat].tolist()))])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keep), made], names=[*keep, out])
                lo = hi

    return df.select(*keep).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())]))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
