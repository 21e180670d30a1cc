"""AVI motion-JPEG columns: write, parse, decode and cut to timed shots.

A payload is kept as 8-bit grey samples of a film: each sample is the flat level of one 8x8 block, which baseline
JPEG holds exactly in the block's DC term (quantiser 8, no AC terms). A row of 64 blocks is 64 payload bytes. The
frame's Huffman table gives a difference of s bits a code of 9 - s bits, so that every block takes ten bits with
its end-of-block code, and whole frames pack and unpack as arrays. Films have a RIFF header, a `movi` list and an
`idx1` index. The reader finds frames by the index, or by walking `movi` where there is none; it takes any baseline
grey or YCbCr frame with restart markers, custom or no Huffman tables or 4:2:0 sampling, by a window of bits, and frames
of its own form, whose blocks all have ten bits, by array.

Shots: a cut stands where the histogram difference of two frames exceeds a fixed floor and the local level of
motion: the lower median of the differences around it, itself left out, plus three of their deviations. Cuts up to
every other frame thus don't raise the threshold. Of films of two or three frames the floor alone decides; frames that
share next to no grey level are always cut. Where more than half of the differences nearby are alike and smaller than
that, they count as motion.

Defined cases: a null or empty text is one row of zero bytes; equal texts give equal films; repeated rows are
treated alike; a file that is no AVI film has no clips; a dropped or damaged frame shows the one before it and is counted; an empty table gives no rows; extra columns are carried;
very long texts are films of many frames (one film is in memory at a time).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from harborlight.llm.common import table, text_batches

#: Payload bytes of a block row, block rows of a frame at most, frames a second.
UNIT, MOST_ROWS, RATE = 64, 16, 25
#: Differences on either side that tell the local level of motion; a difference that is a cut whatever stands around.
REACH, SURE = 12, 0.95

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


# ---- writing ---------------------------------------------------------------------------------------------------


def _words() -> np.ndarray:
    """The ten bits of each DC difference -255..255."""
    d = np.arange(-255, 256)
    s = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64)
    code = (1 << (9 - s)) - 2  # ones, then a zero
    extra = np.where(d > 0, d, d + (1 << s) - 1)
    return ((code << s | extra) << 1).astype(np.uint64)


_WORDS = _words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(64)
def _frame_head(rows: int) -> bytes:
    dqt = _segment(0xDB, bytes([0, 8] + [1] * 63))
    sof = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + bytes([1, 0x11, 0]))
    dc = _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + [8, 7, 6, 5, 4, 3, 2, 1, 0]))
    ac = _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
    return b"\xff\xd8" + dqt + sof + dc + ac + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_frame(samples: np.ndarray) -> bytes:
    """One frame of 64 samples a row."""
    x = samples.astype(np.int64) - 128
    w = _WORDS[np.diff(x, prepend=0) + 255].reshape(-1, 4)
    five = w[:, 0] << np.uint64(30) | w[:, 1] << np.uint64(20) | w[:, 2] << np.uint64(10) | w[:, 3]
    data = np.ascontiguousarray(five.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
    return _frame_head(len(samples) // UNIT) + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, note: bytes = b"", rate: int = RATE) -> bytes:
    """A film of equal-sized frames; the note goes to the INFO list."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, min(width, 65535), min(height, 65535))
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note)) if note else b""
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + head + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def payload_of(text: bytes) -> bytes:
    """The bytes, with zero bytes up to a positive multiple of 64."""
    return text + b"\0" * ((-len(text)) % UNIT or (UNIT if not text else 0))


def store(payload: bytes) -> bytes:
    """A film of the payload: as few frames as may be, of equal height; rows beyond the payload are black."""
    rows = len(payload) // UNIT
    count = -(-rows // MOST_ROWS)
    high = -(-rows // count)
    x = np.zeros(count * high * UNIT, np.uint8)
    x[: len(payload)] = np.frombuffer(payload, np.uint8)
    return write_avi([encode_frame(f) for f in x.reshape(count, -1)], UNIT * 8, high * 8, str(len(payload)).encode())


# ---- reading ---------------------------------------------------------------------------------------------------


def chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, first byte, end) of the chunks of a list; a cut chunk ends the walk."""
    while at + 8 <= end:
        tag, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if at + 8 + size > end:
            return
        yield tag, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def read_avi(raw: bytes) -> dict | None:
    """width, height, seconds a frame, note, and the (first byte, end) of each video frame; None if it is no film. A header that is cut off
    leaves size and rate as they stand without one; index entries that are cut off or point outside the file are left out."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        return None
    out: dict = {"width": 0, "height": 0, "period": 1 / RATE, "note": b"", "frames": []}
    movi, index = None, None
    for tag, lo, hi in chunks(raw, 12, len(raw)):
        kind = raw[lo : lo + 4] if tag == b"LIST" else b""
        if kind == b"hdrl":
            for t, a, end in chunks(raw, lo + 4, hi):
                if t == b"avih" and a + 40 <= end:
                    v = struct.unpack_from("<10I", raw, a)
                    out |= {"period": v[0] / 1e6 or 1 / RATE, "width": v[8], "height": v[9]}
        elif kind == b"INFO":
            out["note"] = next((raw[a:b] for t, a, b in chunks(raw, lo + 4, hi) if t == b"ICMT"), b"")
        elif kind == b"movi":
            movi = (lo, hi)
        elif tag == b"idx1":
            index = (lo, hi)
    if movi is None:
        return out
    if index:
        entries = np.frombuffer(raw, np.dtype([("tag", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), (index[1] - index[0]) // 16, index[0])
        base = movi[0]
        if len(entries) and raw[base + int(entries["at"][0]) : base + int(entries["at"][0]) + 4] != entries["tag"][0]:
            base = 0  # offsets from the start of the file
        spans = [(base + a + 8, base + a + 8 + n) for t, a, n in zip(entries["tag"].tolist(), entries["at"].tolist(), entries["size"].tolist(), strict=True) if t[2:] in (b"dc", b"db")]
        out["frames"] = [(a, b) for a, b in spans if b <= len(raw)]
    else:
        out["frames"] = [(a, b) for t, a, b in chunks(raw, movi[0] + 4, movi[1]) if t[2:] in (b"dc", b"db")]
    return out


class _Bits:
    """Bits of a scan by a window of eight bytes; behind the end stand zero bits."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, len(data) * 8

    def peek(self, n: int) -> int:
        lo = self.at >> 3
        return (int.from_bytes(self.data[lo : lo + 8], "big") >> (64 - n - (self.at & 7))) & ((1 << n) - 1)

    def symbol(self, table: tuple[bytes, bytes]) -> int:
        code = self.peek(16)
        size = table[0][code]
        self.at += size
        if not size or self.at > self.end:
            raise ValueError("no such code" if not size else "the scan ends early")
        return table[1][code]

    def signed(self, s: int) -> int:
        if not s:
            return 0
        v = self.peek(s)
        self.at += s
        if self.at > self.end:
            raise ValueError("the scan ends early")
        return v if v >> (s - 1) else v - (1 << s) + 1


@lru_cache(64)
def _huffman(sizes: bytes, symbols: bytes) -> tuple[bytes, bytes]:
    """Code length and symbol of every 16 bits that may come next; length 0 where no code fits."""
    length, value, code, at = bytearray(1 << 16), bytearray(1 << 16), 0, 0
    for n, count in enumerate(sizes, 1):
        span = 1 << (16 - n)
        for _ in range(count):
            if code + span > 1 << 16 or at >= len(symbols):
                raise ValueError("no such Huffman table")
            length[code : code + span] = bytes([n]) * span
            value[code : code + span] = symbols[at : at + 1] * span
            code, at = code + span, at + 1
    return bytes(length), bytes(value)


# The JPEG standard's example tables, which a motion-JPEG frame without tables takes. Number of codes of
# 1 to 16 bits, then the symbols; of the AC tables all symbols not listed follow in ascending order.
_DC_LUMA = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_DC_CHROMA = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)
_AC_LUMA = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
_AC_LUMA_SYMBOLS = "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"
_AC_CHROMA = (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)
_AC_CHROMA_SYMBOLS = "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"


def standard_tables() -> dict[int, tuple[bytes, bytes]]:
    """Sizes and symbols by class and number, as a DHT segment names them."""
    rest = lambda first: first + bytes(r << 4 | n for r in range(16) for n in range(1, 11) if r << 4 | n not in first)
    luma, chroma = rest(bytes.fromhex(_AC_LUMA_SYMBOLS)), rest(bytes.fromhex(_AC_CHROMA_SYMBOLS))
    return {0x00: (bytes(_DC_LUMA), bytes(range(12))), 0x01: (bytes(_DC_CHROMA), bytes(range(12))), 0x10: (bytes(_AC_LUMA), luma), 0x11: (bytes(_AC_CHROMA), chroma)}


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.mgrid[0:8, 0:8]
    return np.where(k == 0, np.sqrt(1 / 8), 1 / 2) * np.cos((2 * x + 1) * k * np.pi / 16)


def decode_frame(raw: bytes) -> np.ndarray:
    """Grey levels (height, width) of a baseline frame: the only or the luma component."""
    at, quant, huff, comps, restart = 2, {}, {k: _huffman(*x) for k, x in standard_tables().items()}, [], 0
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no frame")
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("a segment is cut off")
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            _, high, wide, n = struct.unpack_from(">BHHB", body)
            comps = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            for i in range(body[0]):
                c = next(c for c in comps if c["id"] == body[1 + 2 * i])
                if c["q"] not in quant:
                    raise ValueError("no such quantiser")
                c["dc"], c["ac"] = huff[body[2 + 2 * i] >> 4], huff[16 | body[2 + 2 * i] & 15]
            break
    if not comps or not high or not wide or any("dc" not in c or not c["h"] or not c["v"] for c in comps):
        raise ValueError("no whole scan")
    top_h, top_v = max(c["h"] for c in comps), max(c["v"] for c in comps)
    single = len(comps) == 1
    if single:
        comps[0]["h"] = comps[0]["v"] = top_h = top_v = 1
    across, down = -(-wide // (8 * top_h)), -(-high // (8 * top_v))
    if across * down * sum(c["h"] * c["v"] for c in comps) > 4 * (len(raw) - at):  # a block has a bit for each of two codes at least
        raise ValueError("the frame is larger than its scan")
    luma = np.zeros((down * comps[0]["v"], across * comps[0]["h"], 64), np.int64)
    end = len(raw)
    data = raw[at : raw.rfind(b"\xff\xd9") if b"\xff\xd9" in raw[at:] else end]
    parts = re.split(rb"\xff[\xd0-\xd7]", data)
    unit, step = 0, restart or across * down
    for part in parts:
        bits, last = _Bits(part.replace(b"\xff\x00", b"\xff")), [0] * len(comps)
        for unit in range(unit, min(unit + step, across * down)):  # noqa: B020
            y, x = divmod(unit, across)
            for j, c in enumerate(comps):
                for v in range(c["v"]):
                    for h in range(c["h"]):
                        block = np.zeros(64, np.int64)
                        last[j] += bits.signed(bits.symbol(c["dc"]))
                        block[0], k = last[j], 1
                        while k < 64:
                            rs = bits.symbol(c["ac"])
                            if rs == 0:
                                break
                            k += rs >> 4
                            if k > 63:
                                raise ValueError("a block has too many terms")
                            if rs != 0xF0:
                                block[_ZIGZAG[k]] = bits.signed(rs & 15) * quant[c["q"]][k]
                            k += 1
                        block[0] *= quant[c["q"]][0]
                        if j == 0:
                            luma[y * c["v"] + v, x * c["h"] + h] = block
        unit += 1
    if unit < across * down:
        raise ValueError("the scan ends early")
    base = _cosines()
    pixels = np.einsum("ki,yxkl,lj->yxij", base, luma.reshape(*luma.shape[:2], 8, 8), base)
    grey = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    return grey.transpose(0, 2, 1, 3).reshape(luma.shape[0] * 8, -1)[:high, :wide]


def flat_samples(raw: bytes) -> np.ndarray | None:
    """Block levels of a frame in this module's own form, as one array; None for any other frame."""
    rows = struct.unpack_from(">H", raw, 2 + 69 + 5)[0] // 8 if len(raw) > 80 else 0
    head = _frame_head(rows) if 0 < rows <= MOST_ROWS else b"\0"
    if not raw.startswith(head):
        return None
    data = raw[len(head) : -2].replace(b"\xff\x00", b"\xff")
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    five = wide.view(">u8").ravel().astype(np.int64)
    w = np.stack([five >> 30, five >> 20, five >> 10, five], 1).ravel() & 1023
    return (np.cumsum(_DIFFERENCE[w]) + 128).astype(np.uint8)


_DIFFERENCE = np.zeros(1024, np.int64)
_DIFFERENCE[_WORDS.astype(np.int64)] = np.arange(-255, 256)


def frame_levels(raw: bytes) -> np.ndarray:
    """The samples that a frame's histogram counts: block levels of flat frames, else all grey levels."""
    found = flat_samples(raw)
    return decode_frame(raw).ravel() if found is None else found


def sound_levels(raw: bytes, spans: list[tuple[int, int]]) -> tuple[list[np.ndarray], list[bool]]:
    """The levels of all frames of a film, and which of them can't be decoded. A dropped (empty) or damaged frame shows
    the one before it, at the film's start the first that can be decoded; a film without any has no levels."""
    levels: list[np.ndarray | None] = []
    for a, b in spans:
        try:
            levels.append(frame_levels(raw[a:b]))
        except (ValueError, IndexError, KeyError, StopIteration, OverflowError, struct.error):
            levels.append(None)
    bad = [x is None for x in levels]
    last = next((x for x in levels if x is not None), None)
    if last is None:
        return [], bad
    for i, x in enumerate(levels):
        last = levels[i] = last if x is None else x
    return levels, bad


def cuts(histograms: np.ndarray, floor: float = 0.3, width: float = 3.0) -> list[int]:
    """First frames of the shots: local adaptive threshold on the differences of normalised histograms."""
    if len(histograms) < 2:
        return [0] * len(histograms)
    h = histograms / np.maximum(1, histograms.sum(1))[:, None]
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    i, size = np.arange(len(d)), min(len(d), 2 * REACH + 1)
    first = np.clip(i - REACH, 0, len(d) - size)
    others = np.lib.stride_tricks.sliding_window_view(d, size)[first][np.arange(size) != (i - first)[:, None]].reshape(len(d), size - 1)
    low = np.sort(others, axis=1)[:, : (size - 1) // 2]
    level = np.zeros(len(d))
    if low.shape[1]:
        middle = low[:, -1]
        level = middle + width * np.maximum(1.4826 * np.median(middle[:, None] - low, axis=1), middle / 10)
    return [0, *(np.flatnonzero((d > floor) & ((d > level) | (d > SURE))) + 1).tolist()]


def clips(film: dict, levels: list[np.ndarray]) -> list[dict]:
    """Timed clip rows: start and end in seconds, first frame, frames, mean level."""
    first = cuts(np.array([np.bincount(x >> 3, minlength=32) for x in levels]).reshape(-1, 32))
    out = []
    for a, b in zip(first, [*first[1:], len(levels)], strict=True):
        mean = float(np.mean([x.mean() for x in levels[a:b]]))
        out.append({"start": round(a * film["period"], 6), "end": round(b * film["period"], 6), "first": a, "frames": b - a, "mean_level": round(mean, 3)})
    return out


def restore(raw: bytes) -> tuple[bytes, dict, list[np.ndarray]]:
    """The payload of a stored film, the film, and its frames' levels."""
    film = read_avi(raw)
    levels = [frame_levels(raw[a:b]) for a, b in film["frames"]]
    payload = np.concatenate(levels).tobytes() if levels else b""
    return payload[: int(film["note"] or len(payload))], film, levels


# ---- DataFrame operators ---------------------------------------------------------------------------------------


def with_film(docs: DataFrame, text: str = "text", out: str = "film") -> DataFrame:
    """Replaces a text column by its film (binary)."""
    keep = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            films = [store(payload_of(x.encode() if x else b"")) for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(films, pa.binary())], names=[*keep, out])

    return docs.select(*keep, text).mapInArrow(run, docs.select(*keep).schema.add(out, "binary"))


def film_clips(films: DataFrame, film: str = "film", key: str = "doc_id") -> DataFrame:
    """One row for each shot of each film: key, clip, start_s, end_s, frames, mean_level, bad_frames (those that can't be
    decoded). A film none of whose frames can be decoded is one clip without a mean level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, raw in zip(b.column(key).to_pylist(), b.column(film).to_pylist(), strict=True):
                if raw and (found := read_avi(raw)) and found["frames"]:
                    levels, bad = sound_levels(raw, found["frames"])
                    shots = clips(found, levels) if levels else [{"start": 0.0, "end": round(len(bad) * found["period"], 6), "first": 0, "frames": len(bad), "mean_level": None}]
                    out += [(k, i, c["start"], c["end"], c["frames"], c["mean_level"], sum(bad[c["first"] : c["first"] + c["frames"]])) for i, c in enumerate(shots)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [b.column(key).type, pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "clip", "start_s", "end_s", "frames", "mean_level", "bad_frames"])

    kind = films.schema[key].dataType.simpleString()
    return films.select(key, film).mapInArrow(run, f"`{key}` {kind}, clip int, start_s double, end_s double, frames int, mean_level double, bad_frames int")


def film_digests(docs: DataFrame) -> DataFrame:
    """Stores each text as a film, reads it back in the same task, and gives sizes, digests and the shots."""

    def row(text: bytes) -> tuple:
        raw = store(payload_of(text))
        payload, film, levels = restore(raw)
        shots = clips(film, levels)
        feature = f"frames={len(levels)};shots={len(shots)};" + ",".join(f"{c['start']:g}-{c['end']:g}:{c['mean_level']:.3f}" for c in shots)
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(row(x.encode() if x else b"") for x in b.column("text").to_pylist()), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return film_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op8_avi_mjpeg": op8_avi_mjpeg}
ORACLES: dict[str, str] = {}
