"""Token-id files with keyed access: raw id payloads in shards and a minimal perfect hash from key to place.

Layout under one folder: `ids-<shard>-<attempt>.bin` hold nothing but little-endian ids (of 16 bits, or of 32 where
the caller asks for them; an id that does not fit ends the job), shards and documents in ascending key order; `index-<bucket>-<attempt>.mph` map the
keys whose hash falls in a bucket to shard and offset. A bucket's index is a cascade of bit levels: a key lies at
the first level where no other key shares its bit, and the number of set bits before it is its slot. Each slot
stores a 32-bit fingerprint of its key, so that foreign keys are turned away. Files are written by the tasks
through the file system that the folder's address names; a retried task writes another attempt's files, and only
those in the manifest that Spark keeps are ever read.

Defined cases: a null or empty text has the end id alone; of a repeated key all texts are written, and the key leads
to the first of them; a text with a null key is written but can't be fetched; an empty table gives no files; extra
columns are ignored; a text may be of any length that fits a task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harborlight.llm.common import fresh_path, materialize, table, text_batches
from harborlight.llm.op02_byte_bpe import WordTable, slices
from harborlight.llm.textscan import mix

#: Keys of one index file and documents of one payload shard, about.
BUCKET_KEYS, SHARD_ROWS = 100_000, 200_000
_MAGIC = b"HLMPH1\0\0"


# ---- minimal perfect hash ------------------------------------------------------------------------------------


def _seeded(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_seeded(keys, 997) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys; about 3 bits a key before the fingerprints."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = [np.frombuffer(np.packbits(x, bitorder="little").tobytes(), "<u8") for x in levels]
        self.words = np.concatenate(words) if words else np.zeros(0, "<u8")
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        left = keys.astype(np.uint64)
        while len(left):
            if len(levels) > 60:
                raise ValueError("keys repeat")
            m = max(64, -(-2 * len(left) // 64) * 64)
            at = (_seeded(left, len(levels)) % np.uint64(m)).astype(np.int64)
            hits = np.bincount(at, minlength=m)
            levels.append(hits == 1)
            left = left[hits[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 if it certainly has none."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_seeded(keys[open_], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            place = at[hit] + self.base[i]
            below = self.words[place >> 6] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            out[open_[hit]] = self.rank[place >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + struct.pack(f"<{len(self.levels)}I", *map(len, self.levels)) + self.words.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        (n,) = struct.unpack_from("<I", raw)
        sizes = struct.unpack_from(f"<{n}I", raw, 4)
        at, levels = 4 + 4 * n, []
        for m in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, m // 8, at), bitorder="little").astype(bool))
            at += m // 8
        return cls(levels), at


def index_bytes(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, count: np.ndarray) -> bytes:
    """An index file: hash, then fingerprint, shard, offset and number of ids of each slot."""
    tree = PerfectHash.build(keys)
    slot = tree.slots(keys)
    order = np.argsort(slot)
    head = tree.to_bytes()
    cols = (fingerprints(keys)[order], shard[order].astype("<u4"), offset[order].astype("<u8"), count[order].astype("<u8"))
    return _MAGIC + struct.pack("<QQ", len(keys), len(head)) + head + b"".join(c.tobytes() for c in cols)


class Index:
    """A read index file; lookup touches one slot for a key."""

    def __init__(self, raw: bytes):
        if raw[:8] != _MAGIC:
            raise ValueError("not an index file")
        n, size = struct.unpack_from("<QQ", raw, 8)
        self.tree, _ = PerfectHash.from_bytes(raw[24 : 24 + size])
        at = 24 + size
        self.columns = []
        for kind in ("<u4", "<u4", "<u8", "<u8"):
            self.columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Found or not, shard, offset in ids and number of ids of every key."""
        slot = self.tree.slots(keys)
        safe = np.maximum(slot, 0)
        mark, shard, offset, count = (c[safe] if len(c) else np.zeros(len(keys), np.int64) for c in self.columns)
        return (slot >= 0) & (mark == fingerprints(keys)), shard, offset, count


# ---- writing and reading ---------------------------------------------------------------------------------------


def _store(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (pafs.LocalFileSystem(), address)


_ENCODERS: dict[str, WordTable] = {}

#: Words that are handed to the library as one text.
_JOINED = 500


def joined(words: list[str], learn: Callable[[list[str]], list[bytes]], spelt: np.ndarray) -> list[bytes]:
    """Ids of words that stand alone, of which those with a space before them are encoded many to a text and cut apart by the bytes that ids stand for (spelt)."""
    spaced = [i for i, w in enumerate(words) if w[0] == " "]
    out = dict(zip(rest := [i for i, w in enumerate(words) if w[0] != " "], learn([words[i] for i in rest]), strict=True))
    runs = [spaced[lo : lo + _JOINED] for lo in range(0, len(spaced), _JOINED)]
    for run, raw in zip(runs, learn(["".join(map(words.__getitem__, run)) for run in runs]), strict=True):
        read = np.cumsum(spelt[np.frombuffer(raw, "<i4")])
        want = np.cumsum([len(words[i].encode()) for i in run])
        close = np.searchsorted(read, want) + 1
        if not np.array_equal(read[np.minimum(close, len(read)) - 1], want):  # an id that reaches over two words
            out.update(zip(run, learn([words[i] for i in run]), strict=True))
            continue
        ends = (close * 4).tolist()
        out.update(zip(run, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
    return [out[i] for i in range(len(words))]


def library_table(vocabulary: str) -> WordTable:
    """The tokenizers library's ids, word by word; texts with a special token's opening are handed over whole."""
    if vocabulary not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)

        def learn(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<i4").tobytes() for lo in range(0, len(texts), 20_000) for e in tokenizer.encode_batch_fast(texts[lo : lo + 20_000], add_special_tokens=False)]

        names = tokenizer.get_vocab(with_added_tokens=True)
        spelt = np.zeros(max(names.values()) + 1, np.int64)
        spelt[list(names.values())] = [len(t) for t in names]  # a character of a byte-level token is a byte
        _ENCODERS[vocabulary] = WordTable(learn, whole="<|", words=lambda texts: joined(texts, learn, spelt))
    return _ENCODERS[vocabulary]


def write_files(docs: DataFrame, folder: str, encoder: Callable[[], WordTable], key: str = "doc_id", text: str = "text", end_id: int = 0, width: int = 2, shards: int | None = None) -> DataFrame:
    """Encodes and writes the payload shards; returns the manifest (key, shard, path, offset, n_ids), kept by Spark."""
    spark = docs.sparkSession
    folder_made = f"{folder}/payload"
    text_batches(spark)
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_ROWS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = encoder(), TaskContext.get()
        fs, root = _store(folder_made)
        fs.create_dir(root, recursive=True)
        name = f"{root}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        out, at = None, 0
        for b in batches:
            texts = b.column(text).fill_null("")
            for lo, hi in slices(texts):
                flat, count = words.encode(texts.slice(lo, hi - lo))
                close = np.cumsum(count)
                ids = np.insert(flat, close, end_id)
                if int(ids.max()) >> 8 * width:
                    raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
                count = count + 1
                out = out or fs.open_output_stream(name)
                out.write(ids.astype("<u2" if width == 2 else "<u4").tobytes())
                starts = at + np.cumsum(count) - count
                at += int(count.sum())
                m = hi - lo
                yield pa.RecordBatch.from_arrays([b.column(key).slice(lo, m), pa.array(np.full(m, task.partitionId()), pa.int32()), pa.array([name] * m, pa.string()), pa.array(starts, pa.int64()), pa.array(count, pa.int64())], names=["key", "shard", "path", "offset", "n_ids"])
        if out:
            out.close()

    ordered = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(n, key).sortWithinPartitions(key)
    made = ordered.mapInArrow(run, "key long, shard int, path string, offset long, n_ids long")
    return materialize(made, "manifest")


def write_index(manifest: DataFrame, folder: str) -> DataFrame:
    """Builds one index file for each bucket of keys; returns (bucket, index_path, n_keys, buckets), the last being the
    number of buckets that keys were dealt to, of which some may be empty."""
    buckets = max(1, -(-manifest.count() // BUCKET_KEYS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        fs, root = _store(f"{folder}/index")
        fs.create_dir(root, recursive=True)
        bucket = held["bucket"].to_numpy()
        for k in np.unique(bucket):
            rows = held.filter(pa.array(bucket == k)).sort_by([("key", "ascending"), ("shard", "ascending"), ("offset", "ascending")])
            ids = rows["key"].to_numpy()
            rows = rows.filter(pa.array(np.concatenate([[True], ids[1:] != ids[:-1]])))
            name = f"{root}/index-{k:06d}-{task.taskAttemptId()}.mph"
            with fs.open_output_stream(name) as out:
                out.write(index_bytes(rows["key"].to_numpy(), rows["shard"].to_numpy(), rows["offset"].to_numpy(), rows["n_ids"].to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name]), pa.array([rows.num_rows], pa.int64()), pa.array([buckets], pa.int32())], names=["bucket", "index_path", "n_keys", "buckets"])

    keyed = manifest.where("key is not null").select("key", "shard", "offset", "n_ids", bucket_of("key", buckets).alias("bucket"))
    return materialize(keyed.repartition(buckets, "bucket").mapInArrow(run, "bucket int, index_path string, n_keys long, buckets int"), "index")


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_keys(keys: DataFrame, manifest: DataFrame, index: DataFrame, folder: str, width: int = 2, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """Fetches documents by key through the index: (key, found, shard, offset, ids as bytes of the payload). With
    strict, a key that isn't found ends the job."""
    buckets = index.agg(F.max("buckets")).first()[0] or 1
    paths = manifest.groupBy("shard").agg(F.min("path").alias("path"))
    wanted = keys.select(F.col(key).cast("long").alias("key")).where("key is not null")
    wanted = wanted.withColumn("bucket", bucket_of("key", buckets)).join(index, "bucket", "left")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Index] = {}
        fs, _ = _store(f"{folder}/index")
        for b in batches:
            ask, names = b.column("key").to_numpy(zero_copy_only=False), np.array(b.column("index_path").to_pylist(), object)
            found, shard, offset, count = np.zeros(len(ask), bool), *(np.zeros(len(ask), np.int64) for _ in range(3))
            for name in {x for x in names if x}:
                if name not in opened:
                    opened.clear()
                    opened[name] = Index(fs.open_input_file(name).readall())
                here = names == name
                found[here], shard[here], offset[here], count[here] = opened[name].lookup(ask[here])
            if strict and not found.all():
                raise KeyError(int(ask[~found][0]))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found), pa.array(shard.astype(np.int32)), pa.array(offset), pa.array(count)], names=["key", "found", "shard", "offset", "n_ids"])

    placed = wanted.sortWithinPartitions("bucket").mapInArrow(find, "key long, found boolean, shard int, offset long, n_ids long")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(f"{folder}/payload")
        name, f = None, None
        for b in batches:
            got = []
            for path, at, n in zip(b.column("path").to_pylist(), b.column("offset").to_pylist(), b.column("n_ids").to_pylist(), strict=True):
                if path is None:
                    got.append(None)
                    continue
                if path != name:
                    name, f = path, fs.open_input_file(path)
                got.append(f.read_at(n * width, at * width))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("found"), b.column("shard"), b.column("offset"), pa.array(got, pa.binary())], names=["key", "found", "shard", "offset", "ids"])

    where = placed.join(paths, "shard", "left").repartition("shard", F.floor(F.col("offset") / 4_000_000)).sortWithinPartitions("shard", "offset")
    return where.mapInArrow(fetch, "key long, found boolean, shard int, offset long, ids binary")


def digests(read: DataFrame, width: int = 2) -> DataFrame:
    """n_tokens and the crc32 of the ids as 32-bit integers, of fetched documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("ids").to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("shard"), b.column("offset"), pa.array([len(x) // width for x in raw], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "shard", "offset", "n_tokens", "ids_crc32"])

    return read.where("found").mapInArrow(run, "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = fresh_path(spark, "token-files")
    manifest = write_files(docs, folder, lambda: library_table(vocabulary))
    index = write_index(manifest, folder)
    read = digests(read_keys(docs.select("doc_id"), manifest, index, folder, strict=True))
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # One row for each shard file: the running sum is over files, not documents.
    base = shards.select("shard", (F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).alias("base"))
    return read.join(base, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op3_token_files": op3_token_files}
ORACLES: dict[str, str] = {}
