"""JSON in running text and nested payloads against plain scanners."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harborlight.functions import jsonscan, markdown
from harborlight.operators import nested


def plain_end(text: str, start: int, pair: str) -> int | None:
    depth, inside, i = 0, False, start
    while i < len(text):
        c = text[i]
        slashes = 0
        while text[i - 1 - slashes : i - slashes] == "\\" and i - 1 - slashes >= 0:
            slashes += 1
        if c == '"' and slashes % 2 == 0:
            inside = not inside
        elif not inside and c in pair:
            depth += 1 if c == pair[0] else -1
            if not depth:
                return i
        i += 1
    return None


def strict(name):
    raise ValueError(name)


def plain_values(text: str) -> list[str]:
    out, i = [], 0
    while i < len(text):
        if text[i] in "{[":
            try:
                _, end = json.JSONDecoder(parse_constant=strict).raw_decode(text, i)
                out.append(text[i:end])
                i = end
                continue
            except ValueError:
                pass
        i += 1
    return out


def random_texts(n: int) -> list[str]:
    rng = random.Random(4)
    pieces = ["{", "}", "[", "]", '"', "\\", ":", ",", "a", "é", " ", "1", '{"a": 1}', '[{"b": "}"}]', '"k"', "true", '{"x": [', "]}"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 24))) for _ in range(n)]


@pytest.mark.parametrize("pair", ["{}", "[]"])
def test_spans_are_those_of_a_scanner_that_starts_at_each_bracket(pair):
    rows = random_texts(3000)
    buf, off = jsonscan.texts(pa.array(rows))
    text, start, end, _ = jsonscan.spans(buf, off, pair)
    assert (np.diff(start) > 0).all()
    got = {(t, s - off[t]): e - off[t] for t, s, e in zip(text.tolist(), start.tolist(), end.tolist())}
    want = {}
    for t, row in enumerate(rows):
        for i, c in enumerate(row):
            if c == pair[0] and (end := plain_end(row, i, pair)) is not None:
                want[t, len(row[:i].encode())] = len(row[:end].encode())
    assert got == want


def test_values_are_those_that_a_decoder_reads_from_left_to_right():
    rows = [r for r in random_texts(4000)] + ['say "{"a": [1, {"b": "}"}]} [', '{"n": NaN} [2]', '{bad [3, 4] x}', '{"a": 1, "b": {"c": [1, 2}, "d": {"e": 5}}']
    got = jsonscan._list_of_values(pa.array(rows)).to_pylist()
    assert got == [plain_values(r) for r in rows]


def test_null_empty_deep_and_sliced_columns():
    deep = '{"a": ' * 50 + "1" + "}" * 50
    column = pa.array(["x", None, "", f"t {deep} {{", "[" * 3000 + "]" * 3000]).slice(1)
    got = jsonscan._list_of_values(column).to_pylist()
    assert got[:3] == [None, [], [deep]]
    assert len(got[3]) == 1 and json.loads(got[3][0]) is not None
    assert jsonscan._list_of_values(pa.array([], pa.string())).to_pylist() == []


def values(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_theme_objects_go_whole_or_not_at_all(spark):
    cut = lambda t: values(spark, markdown.cut_theme_objects(F.lit(t)))[0]
    deep = '{"a": ' * 50 + '{"customTheme": "}{"}' + "}" * 50
    assert cut(f"before  {deep}\n\n\n\nafter") == "before\n\nafter"
    assert cut('{"a": {"b": {"c": {"d": {"e": {"customTheme": 1}}}}}} tail') == "tail"
    assert cut('x {"a": {"customTheme": 1}  y') == 'x {"a": y'  # the outer one is unclosed
    assert cut('x  {"a": {"customTheme": 1') == 'x  {"a": {"customTheme": 1'
    assert cut('k {"a": 1}  {\\"varTheme\\": {}} {"b": {"themeOptions": 2}} z') == 'k {"a": 1} z'
    assert cut("  customTheme without braces ") == "customTheme without braces"


def test_listing_payloads(spark):
    found = lambda t: values(spark, jsonscan.jobs_payload(F.lit(t)))[0]
    assert found('<html><PRE>{&quot;a&quot;: {&quot;jobs&quot;: []}}</PRE>') == '{"jobs":[]}'
    assert found('```\n{"positions": [1]}\n```') is None
    assert found('text {"x": "jobs"} [{"y": {"positions": [{"id": 1}]}}]') == '{"positions":[{"id":1}]}'
    assert found('{"t": "a\\- b", "jobs": [1]}') == '{"t":"a- b","jobs":[1]}'
    assert found("nothing") is None and found("") is None
    whole = values(spark, jsonscan.merged_fragments(F.array(F.lit(' {"jobs": '), F.lit(None), F.lit("[1]} "))), jsonscan.merged_fragments(F.array(F.lit('{"jobs": []}'))))
    assert whole == ('{"jobs":[1]}', None)


def test_many_levels_are_one_job(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(nested, "kept", lambda df, name: jobs.append(name) or df.localCheckpoint())
    rows = [(1, '{"z": [0, ' * 9 + '{"Raw": "deep"}' + "]}" * 9), (2, '{"text": "near", "a": {}}')]
    got = nested.first_text_under(spark.createDataFrame(rows, "n int, p string"), "n", "p", nested.BODY_TEXT_KEYS)
    assert sorted(map(tuple, got.collect())) == [(1, "Raw", "deep", 19), (2, "text", "near", 1)] and len(jobs) == 2


def test_first_text_of_nested_payloads(spark):
    deep = '{"z": [0, ' * 40 + '{"Raw": "deep"}' + "]}" * 40
    rows = [(1, deep), (2, '{"a": {"text": "inner"}, "text": " "}'), (3, '{"text": "t", "content": "c"}'), (4, "not json"), (5, None), (6, "[]"), (7, '[{"body": {"text": 5}}, {"body": "second"}]'), (8, '{"b": {"body": "x"}, "a": {"raw": "first by key"}}')]
    got = {r.id: (r.key, r.text, r.depth) for r in nested.first_text_under(spark.createDataFrame(rows, "n int, p string"), "n", "p", nested.BODY_TEXT_KEYS).collect()}
    assert got == {1: ("Raw", "deep", 81), 2: ("text", "inner", 2), 3: ("content", "c", 1), 7: ("body", "second", 2), 8: ("raw", "first by key", 2)}
    assert nested.first_text_under(spark.createDataFrame([], "n int, p string"), "n", "p", nested.EVENT_TITLE_KEYS).collect() == []
