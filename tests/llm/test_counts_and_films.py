"""Token totals against plain counts, and films that must not end a job."""

from __future__ import annotations

import re
import struct
from collections import Counter

import numpy as np
import pytest

from harborlight.llm import op01_token_counts as op1
from harborlight.llm import op08_avi_mjpeg as op8

DOCS = "doc_id long, text string, lang string, source string, n_tokens int, sign int, copies int"
ROWS = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, "a b", None, "t"), (None, "zz", "en", None), (None, "zz", "en", None), (3, "", "de", "s"), (4, None, "de", "t"), (5, "x-y 12", None, "s"), (6, "x-y 12", None, "s")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(*r, 9, 9, 9) for r in ROWS], DOCS).write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], DOCS).write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def totals(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_repeats_leave_one_row_a_text(spark, odd, none):
    first = {}
    for i, text, lang, source in ROWS:
        place = (i is None, i or 0, source is not None, source or "", lang is not None, lang or "")
        first.setdefault(text or "", []).append((place, (source, lang)))
    first = {t: min(x, key=lambda y: y[0]) for t, x in first.items()}
    want = Counter()
    tokens = Counter()
    for text, (_, (source, lang)) in first.items():
        want[source, lang, "v2"] += 1
        tokens[source, lang, "v2"] += len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+", text))
    assert totals(op1.op1_token_counts(spark, odd)) == {k: (n, tokens[k]) for k, n in want.items()}
    assert op1.op1_token_counts(spark, none).count() == 0


def test_totals_by_tokenizer_are_those_of_the_libraries(spark, odd, none):

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from harborlight.llm.op02_byte_bpe import load_ranks

    multi = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = {"byte_bpe_multi_50k": lambda t: len(multi.encode_ordinary(t)), "byte_bpe_50k": lambda t: len(plain.encode(t, add_special_tokens=False).ids)}
    for folder, rows in ((odd, ROWS), ("/root/testdata/sf0.001", [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()])):
        want: dict = {}
        for name, f in count.items():
            for _, text, lang, source in rows:
                n, t = want.get((source, lang or "und", name), (0, 0))
                want[source, lang or "und", name] = n + 1, t + f(text or "")
        assert totals(op1.token_counts_by_tokenizer(spark, folder)) == want
    assert op1.token_counts_by_tokenizer(spark, none).count() == 0


def test_no_film_ends_the_job(spark):
    frame = op8.encode_frame(np.arange(1024, dtype=np.uint8))
    film = op8.write_avi([frame] * 3, 512, 128)
    at = film.index(b"avih")
    short = film[: at + 4] + struct.pack("<I", 8) + film[at + 8 : at + 16] + film[at + 8 + struct.unpack_from("<I", film, at + 4)[0] :]
    sof = frame.index(b"\xff\xc0")
    huge = op8.write_avi([frame[: sof + 5] + b"\xff\xff\xff\xff" + frame[sof + 9 :], frame], 512, 128)
    index = film.index(b"idx1")
    cut = film[: index + 4] + struct.pack("<I", 24) + film[index + 8 : index + 32]
    wild = bytearray(film)
    struct.pack_into("<I", wild, index + 8 + 16 + 8, 0xFFFFFFF0)
    films = {"short": short, "huge": huge, "cut": cut, "wild": bytes(wild), "tiny": b"RIFF\0\0\0\0AVI ", "list": b"RIFF\0\0\0\0AVI LIST\x04\0\0\0movi", "tail": film[:-5], "empty": b"", "none": None}
    films |= {f"end{n}": film[:n] for n in range(0, len(film), 37)}
    rng = np.random.default_rng(11)
    for n in range(150):
        raw = np.frombuffer(film, np.uint8).copy()
        raw[rng.integers(0, min(len(raw), 700) if n % 2 else len(raw), 6)] = rng.integers(0, 256, 6)
        films[f"noise{n}"] = raw.tobytes()
    rows = op8.film_clips(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in films.items()], "doc_id string, film binary")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sum(r.frames for r in by["huge"]) == 2 and by["huge"][0].bad_frames == 1
    assert sum(r.frames for r in by["wild"]) == 2 and sum(r.frames for r in by["cut"]) == 1
    assert not {"tiny", "list", "empty", "none"} & set(by)
    with pytest.raises(ValueError, match="larger than its scan"):
        op8.decode_frame(frame[: sof + 5] + b"\xff\xff\xff\xff" + frame[sof + 9 :])


def test_flat_frames_read_as_the_decoder_reads_them():
    """The query's own way to its frames gives what the general decoder gives."""
    rng = np.random.default_rng(12)
    for rows in (1, 2, 16):
        levels = rng.integers(0, 256, 64 * rows).astype(np.uint8)
        raw = op8.encode_frame(levels)
        grey = op8.decode_frame(raw)
        assert (op8.flat_samples(raw) == levels).all() and (grey[::8, ::8].ravel() == levels).all() and (grey == np.kron(levels.reshape(rows, 64), np.ones((8, 8), np.uint8))).all()
