"""JSON inside running text: spans of balanced brackets at any depth, found over the Arrow bytes of a batch of texts at once.

A quote toggles whether brackets count, unless an odd number of backslashes stands before it. A text may hold stray quotes
outside its JSON, so brackets are matched in two classes, by the parity of the quotes before them: a value starts
outside a string of its own, whatever the text around it does. In a class, the running depth gives each bracket its level; the next
bracket of a level in a text closes it. All of it is prefix sums and sorts, so depth costs nothing.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.base import col
from harborlight.functions.text import decode_entities

_QUOTE, _BACKSLASH = 34, 92


def spans(buf: np.ndarray, offsets: np.ndarray, pair: str = "{}") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, class) of all balanced spans of a kind of bracket, by text and start; end is the closing bracket's place."""
    at = np.arange(len(buf))
    quotes = np.flatnonzero(buf == _QUOTE)
    if len(quotes):
        plain = np.maximum.accumulate(np.where(buf != _BACKSLASH, at, -1))
        first = offsets[np.searchsorted(offsets, quotes, "right") - 1]
        before = np.where(quotes > first, np.maximum(plain[np.maximum(quotes - 1, 0)], first - 1), quotes - 1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    marks = np.flatnonzero((buf == ord(pair[0])) | (buf == ord(pair[1])))
    kind = np.searchsorted(quotes, marks) & 1
    found = []
    for c in (0, 1):
        pos = marks[kind == c]
        opens = buf[pos] == ord(pair[0])
        level = np.cumsum(np.where(opens, 1, -1)) + ~opens
        text = np.searchsorted(offsets, pos, "right") - 1
        order = np.lexsort((pos, level, text))
        pos, opens, level, text = pos[order], opens[order], level[order], text[order]
        hit = np.flatnonzero(opens[:-1] & ~opens[1:] & (level[1:] == level[:-1]) & (text[1:] == text[:-1]))
        found.append((text[hit], pos[hit], pos[hit + 1], np.full(len(hit), c)))
    text, start, end, kind = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start, kind="stable")
    return text[order], start[order], end[order], kind[order]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column's texts; a null is empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: Bytes of texts that are scanned at a time; a longer text is scanned by itself.
BLOCK = 1 << 20


def in_blocks(answer: Callable[[pa.Array], list], column: pa.Array, kind: pa.DataType) -> pa.Array:
    """answer over runs of rows of about BLOCK bytes, so that a batch of long texts needs no more memory than one run."""
    _, off = texts(column)
    out, lo = [], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1)
        out += answer(column.slice(lo, hi - lo))
        lo = hi
    return pa.array(out, kind)


def _strict(name: str) -> None:
    raise ValueError(name)


_DECODE = json.JSONDecoder(parse_constant=_strict)


def json_values(raw: bytes, found: list[tuple[int, int, int]]) -> Iterator[tuple[str, object]]:
    """(text, value) of the outermost spans that are JSON, in order; found: (start, end, class) by start.

    Where a span fails at a place, spans of its class around that place fail too, and those before it were read with success, so that a
    byte is read about twice however deep it lies.
    """
    done, failed = -1, [-1, -1]
    for start, end, kind in found:
        if start <= done or start < failed[kind] <= end:
            continue
        try:
            text = raw[start : end + 1].decode()
            value, stop = _DECODE.raw_decode(text)
            if stop != len(text):
                continue
        except json.JSONDecodeError as e:
            failed[kind] = start + len(text[: e.pos].encode())
            continue
        except (ValueError, RecursionError):
            continue
        done = end
        yield text, value


def _scanned(column: pa.Array, answer: Callable[[Iterator[tuple[str, object]]], object], kind: pa.DataType) -> pa.Array:
    return in_blocks(lambda part: _scan(part, answer), column, kind)


def _scan(column: pa.Array, answer: Callable[[Iterator[tuple[str, object]]], object]) -> list:
    buf, off = texts(column)
    text, start, end, cls = (np.concatenate(x) for x in zip(spans(buf, off, "{}"), spans(buf, off, "[]")))
    order = np.argsort(start, kind="stable")
    text, start, end, cls = text[order], start[order], end[order], cls[order]
    cuts = np.searchsorted(text, np.arange(len(off)))
    out = []
    for i, valid in enumerate(column.is_valid().to_pylist()):
        lo, hi = cuts[i], cuts[i + 1]
        found = list(zip((start[lo:hi] - off[i]).tolist(), (end[lo:hi] - off[i]).tolist(), cls[lo:hi].tolist()))
        out.append(answer(json_values(buf[off[i] : off[i + 1]].tobytes(), found)) if valid else None)
    return out


def _list_of_values(column: pa.Array) -> pa.Array:
    return _scanned(column, lambda found: [text for text, _ in found], pa.list_(pa.string()))


def holds_jobs(node: object) -> bool:
    return isinstance(node, dict) and (isinstance(node.get("jobs"), list) or (isinstance(node.get("positions"), list) and any(isinstance(x, dict) for x in node["positions"])))


def jobs_node(value: object) -> dict | None:
    """The first object, in reading order and at any depth, with a list of jobs, or of positions that are objects."""
    stack = [value]
    while stack:
        node = stack.pop()
        if holds_jobs(node):
            return node
        children = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        stack.extend(reversed([c for c in children if isinstance(c, (dict, list))]))
    return None


def _first_jobs(column: pa.Array) -> pa.Array:
    def first(found: Iterator[tuple[str, object]]) -> str | None:
        node = next((n for n in (jobs_node(value) for _, value in found) if n is not None), None)
        return None if node is None else json.dumps(node, ensure_ascii=False, separators=(",", ":"))

    return _scanned(column, first, pa.string())


def _without_objects(markers: list[bytes]) -> Callable[[pa.Array], pa.Array]:
    def cut(column: pa.Array) -> list[str | None]:
        buf, off = texts(column)
        text, start, end, _ = spans(buf, off)
        cuts = np.searchsorted(text, np.arange(len(off)))
        out: list[str | None] = []
        for i, valid in enumerate(column.is_valid().to_pylist()):
            raw = buf[off[i] : off[i + 1]].tobytes()
            places = sorted(p for m in markers for p in _places(raw, m))
            kept, done = [], 0
            for s, e in zip((start[cuts[i] : cuts[i + 1]] - off[i]).tolist(), (end[cuts[i] : cuts[i + 1]] - off[i]).tolist()) if places else ():
                at = bisect.bisect_right(places, s)
                if s >= done and at < len(places) and places[at] < e:
                    kept += [raw[done:s], b" "]
                    done = e + 1
            out.append((b"".join(kept) + raw[done:]).decode() if valid and kept else None)
        return out

    return lambda column: in_blocks(cut, column, pa.string())


def _places(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


def values_in(c: Column | str) -> Column:
    """The outermost JSON objects and arrays of a text, as texts in order; none for a text without any, null for null.

    Constants that JSON does not have (NaN) make a value unsound; so does a depth beyond the reader's (about a thousand), whose inner values count then.
    """
    return F.arrow_udf(_list_of_values, "array<string>")(col(c))


def without_objects(c: Column | str, markers: list[str]) -> Column:
    """The text with its outermost balanced objects that hold a marker each as one space; null where there is none."""
    return F.arrow_udf(_without_objects([m.encode() for m in markers]), "string")(col(c))


def unfenced(c: Column | str) -> Column:
    """A reply's text without code fences around it, or what stands in its first fence; escapes that JSON doesn't know lose their backslash."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    inner = F.regexp_extract(t, r"(?is)```(?:json)?\n(.*?)\n```", 1)
    bare = F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z0-9_-]*\n?", ""), r"\n?```$", ""))).when(inner != "", F.trim(inner)).otherwise(t)
    return F.regexp_replace(bare, r'\\(?!["\\/bfnrtu])', "")


def jobs_payload(c: Column | str) -> Column:
    """The board listing that a text holds, as JSON: from bare or fenced JSON, from a page's <pre> block with its entities decoded, or from
    among other words; null without one."""
    pre = F.regexp_extract(col(c), r"(?is)<pre\b[^>]*>(.*?)</pre>", 1)
    body = F.when(pre != "", decode_entities(pre)).otherwise(col(c))
    return F.arrow_udf(_first_jobs, "string")(unfenced(body))


def merged_fragments(parts: Column) -> Column:
    """A listing that a provider sent in pieces (array of texts), joined; null for fewer than two pieces, or where no bracket or no list is named."""
    held = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    whole = F.array_join(held, "")
    return F.when((F.size(held) >= 2) & whole.rlike(r"[{}\[\]]") & whole.rlike("jobs|positions"), whole)
