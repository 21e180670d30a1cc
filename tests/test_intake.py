"""The dump data source, validated intake and timers, over restarts and replays."""

from __future__ import annotations

import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from harborlight.sources import dumps, intake
from harborlight.streaming import flows, timers


def put(folder, provider, day, name, data: bytes):
    at = folder / f"provider={provider}" / f"day={day}"
    at.mkdir(parents=True, exist_ok=True)
    (at / ("." + name)).write_bytes(data)
    os.rename(at / ("." + name), at / name)


def test_pieces_of_a_dump_hold_each_line_once(tmp_path):
    rows = [b"a" * n for n in (1, 5, 0, 3000, 2, 7)] + [b"\xff bad", "é".encode() * 9, b"  ", b"last"]
    for end in (b"", b"\n", b"\r\n"):
        put(tmp_path, "p", "d", f"f{len(end)}", b"\n".join(rows) + end)
    for d in dumps.dumps(f"file://{tmp_path}"):
        for size in (1, 2, 3, 7, 100, 3003, 1 << 20):
            got = [(a, t) for p in dumps.pieces(f"file://{tmp_path}", [d], size) for b in dumps.lines(p) for a, t in zip(b.column("at").to_pylist(), b.column("body").to_pylist())]
            want, at = [], 0
            for r in rows:
                if r.strip():
                    want.append((at, r.decode("utf-8", "replace")))
                at += len(r) + 1
            assert got == want


def test_batch_reads_prune_by_folder(spark, tmp_path):
    for p, day in (("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-02")):
        put(tmp_path, p, day, "x.jsonl", f'{{"p": "{p}{day}"}}\n'.encode() * 3)
    put(tmp_path, "b", "2024-01-02", "_SUCCESS", b"no dump")
    query = lambda: dumps.read_dumps(spark, f"file://{tmp_path}").where("provider = 'a' and day > '2024-01-01' and at >= 0")
    plain = sorted(map(tuple, query().collect()))
    assert len(plain) == 3 and {r[:2] for r in plain} == {("a", "2024-01-02")}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = query()
        assert sorted(map(tuple, df.collect())) == plain
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert ">= 0" in plan and " = a)" not in plan and "> 2024-01-01" not in plan  # what the source answers is asked no more
        assert df.rdd.getNumPartitions() == 1  # of three files
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert dumps.read_dumps(spark, f"file://{tmp_path}/none").collect() == []


def test_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    drain = lambda: flows.to_files(dumps.stream_dumps(spark, f"file://{folder}"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    want = []
    for n in range(3):
        for i in range(2):
            body = json.dumps({"n": n, "i": i})
            put(folder, "p", f"2024-01-0{n + 1}", f"f{n}{i}", body.encode() + b"\n")
            want.append(body)
        time.sleep(0.02)
        assert sorted(r.body for r in drain().collect()) == sorted(want)
    assert sorted(r.body for r in drain().collect()) == sorted(want)
    assert sorted(r.body for r in dumps.read_dumps(spark, f"file://{folder}").collect()) == sorted(want)


GOOD = {"title": "t", "company": "c", "description": "d", "location": "l", "remote": True, "level": "mid", "totalCompensation": 5, "url": "u"}


@pytest.mark.parametrize(
    "body, reason",
    [
        (json.dumps(GOOD), None),
        (json.dumps({**GOOD, "test": True, "other": [1]}), None),
        (json.dumps({**GOOD, "level": "boss"}), "invalid:level"),
        (json.dumps({**GOOD, "level": None}), "missing:level"),
        (json.dumps({k: v for k, v in GOOD.items() if k != "url"}), "missing:url"),
        (json.dumps({**GOOD, "remote": "yes"}), "bad_json"),
        ("[1]", "bad_json"),
        ("", "bad_json"),
        (None, "bad_json"),
        ('{"title": "t"', "bad_json"),
        ("{}", "missing:title"),
    ],
)
def test_reasons(spark, body, reason):
    r = intake.judged(spark.createDataFrame([(1, body, "x")], "n int, body string, title string"), intake.FORMS["job"]).first()
    assert r.reason == reason and (r.parsed is None) == (reason is not None)


def test_replayed_batches_change_nothing(spark, tmp_path):
    rows = [(i, json.dumps({**GOOD, "totalCompensation": i}) if i % 3 else "{") for i in range(30)]
    write = intake.writer(f"file://{tmp_path}/sinks", intake.FORMS["job"])
    df = spark.createDataFrame(rows, "n int, body string")
    for number, part in enumerate(("n < 10", "n >= 10")):
        write(df.where(part), number)
    write(df.where("n >= 10"), 1)
    out = spark.read.parquet(f"file://{tmp_path}/sinks")
    good, bad = intake.written(out, "accepted"), intake.written(out, "rejected")
    assert sorted(r.n for r in good.collect()) == [i for i in range(30) if i % 3] and good.select(F.sum("totalCompensation")).first()[0] == sum(i for i in range(30) if i % 3)
    assert sorted((r.n, r.body, r.reason) for r in bad.collect()) == [(i, "{", "bad_json") for i in range(0, 30, 3)]


def test_last_heartbeat_wins(spark):
    rows = [("w", 1, "a"), ("w", 3, "c"), ("w", 3, "b"), ("v", 2, None)]
    got = intake.latest_workers(spark.createDataFrame(rows, "workerId string, at long, taskQueue string"), "at").collect()
    assert sorted((r.workerId, r.at, r.taskQueue) for r in got) == [("v", 2, None), ("w", 3, "c")]


def test_recoveries_over_restarts_with_bounded_state(spark, tmp_path):
    """Three deliveries with a restart between each: outcomes once a key, events behind the watermark left out, state gone for keys that are long settled."""
    base = datetime.datetime(2024, 1, 1)
    deliveries = [
        [("a", 0, "view"), ("a", 5, "buy"), ("b", 0, "view"), ("c", 1, "view"), ("c", 2, "view")],
        [("a", 6, "view"), ("b", 3, "view"), ("d", 40, "view")],
        [("c", 41, "buy"), ("e", 200, "buy"), ("e", 199, "view")],
    ]
    schema = "user string, ts timestamp, event_type string"
    place = tmp_path / "in"
    out = None
    with timers.keyed_state(spark):
        for n, rows in enumerate(deliveries):
            spark.createDataFrame([(u, base + datetime.timedelta(minutes=m), t) for u, m, t in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{place}")
            stream = spark.readStream.schema(schema).parquet(f"file://{place}")
            q = timers.recoveries(stream, "user", "buy", 10 * 60_000, "0 seconds").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            last = [p for p in q.recentProgress if p.stateOperators]
            out = spark.read.parquet(f"file://{tmp_path}/out")
    minute = lambda r: (r.at - int(base.replace(tzinfo=datetime.UTC).timestamp() * 1000)) / 60_000
    got = sorted((r.key, r.outcome, minute(r), r.events) for r in out.collect())
    assert got == [("a", "closed", 5, 2), ("b", "expired", 10, 1), ("c", "expired", 11, 2), ("d", "expired", 50, 1), ("e", "closed", 200, 2)]
    assert last[-1].stateOperators[0].numRowsTotal <= 6  # only the last key's
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != timers._ROCKS
