"""Neighbour search, whitening and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import op11_nn_descent as op11
from harborlight.llm import op12_chebyshev_whitening as op12
from harborlight.llm import op13_conversation_repair as op13

VECTORS = "vec_id long, embedding array<double>, label int, id string, v string, rep int, x int, q int"
TURNS = "conv_id long, turn long, role string, text string, copies int, h string, symbol int"


def plain_nearest(rows, every):
    rows = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in (i for i in rows if i % every == 0):
        near = sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        out[q] = near[:10]
    return out


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", 1, 2, 3) for i, v in rows], VECTORS)


def test_nearest_exact_on_small_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(60 + i, rows[20][1]) for i in range(15)]  # copies of one query's vector, more than ten
    rows += [(100 + 20 * i, [1.0 + i, 2.0]) for i in range(4)]  # another length, fewer than ten candidates
    junk = [(1000, None), (1020, []), (1040, [0.0] * 6), (1060, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1080, [float("nan")] * 6), (1100, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    got = {}
    for r in op11.nearest(vectors_table(spark, rows + rows[:7] + junk), every=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = plain_nearest(rows, 20)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [k for k, _, _ in sorted(got[q])] == list(range(1, len(near) + 1))
        assert [v for _, _, v in sorted(got[q])] == [v for _, v in near]
        assert np.allclose([s for _, s, _ in sorted(got[q])], [s for s, _ in near], rtol=1e-14)


def test_nearest_of_nothing(spark):
    assert op11.nearest(vectors_table(spark, [])).collect() == []
    assert op11.nearest(vectors_table(spark, [(0, [1.0, 2.0])])).collect() == []


def test_nearest_recall_beyond_one_cell(spark, monkeypatch):
    """Several cells, a beam far smaller than the table, and a group of near copies that holds a third of it."""
    monkeypatch.setattr(op11, "CELL", 128)
    monkeypatch.setattr(op11, "BEAM", 200)
    monkeypatch.setattr(op11, "BLOCK", 1 << 12)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 12))
    x[::3] = x[0] + 1e-3 * rng.standard_normal((1000, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in op11.nearest(vectors_table(spark, rows)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_nearest(rows, 100)
    assert np.mean([len(got[q] & {v for _, v in near}) / 10 for q, near in want.items()]) >= 0.9


def whitened_plainly(x, k):
    n = len(x)
    c = x - x.mean(0)
    e, q = np.linalg.eigh(c.T @ c / n)
    return e[::-1][:k], q[:, ::-1][:, :k], c


@pytest.mark.parametrize("shape", [(400, 70, 8), (90, 20, 5)])
def test_whitening_against_dense_eigenvectors(spark, shape):
    n, d, k = shape
    rng = np.random.default_rng(7)
    v = rng.standard_normal((n, d)) * np.linspace(3, 0.5, d)
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    out = op12.whiten(vectors_table(spark, [*rows, (n, None), (n + 1, [1.0, None]), (n + 2, [float("nan")] * d)]), components=k).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * v).astype(np.int64) + 1000000
    e, q, c = whitened_plainly(x, k)
    got = out["whitened"].to_numpy().reshape(n, k)
    want = c @ q / np.sqrt(e)
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8
    assert out["deviation"].to_list()[::k] == [int(s) for s in ((n * x - x.sum(0)) ** 2).sum(1)]
    assert set(out["n"]) == {n} and out["identity_error"].max() < 1e-10
    assert np.allclose(out["explained"].to_numpy()[:k], e / (c * c).sum() * n, rtol=1e-12)


def test_whitening_odd_tables(spark):
    assert op12.whiten(vectors_table(spark, [])).collect() == []
    assert op12.whiten(vectors_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])])).collect() == []  # no variance
    out = op12.whiten(vectors_table(spark, [(1, [0.0, 5.0]), (None, [1.0, 5.0]), (1, [0.0, 5.0]), (4, [1.0]), (5, [3.0]), (6, [1e300]), (7, [2.0])])).collect()
    assert sorted({(r.n, r.component) for r in out}) == [(3, 1), (4, 1)] and len(out) == 7
    assert [r.deviation for r in out if r.vec_id is None] == [(3 * 64 - 64) ** 2]
    assert all(r.deviation is None for r in out if r.n == 4 and r.vec_id == 6)


def test_chebyshev_filter_damps_the_unwanted():
    e = np.array([9.0, 8.0, 3.0, 2.5, 1.0, 0.2])
    y = op12.chebyshev(lambda q: e[:, None] * q, np.ones((6, 1)), 0.1, 3.0, 9.0, degree=8)[:, 0]
    assert np.abs(y[2:]).max() < 1e-3 * y[1] and y[0] == pytest.approx(1, abs=1e-9)


def crc_kind(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def plain_repairs(rows):
    """All edit strings tried by a search over rows, states and insertions; rows: (role, fault) with fault in order."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    frontier, seen = [(0, "", "", 0, ())], set()
    while frontier:
        cost, audit, state, at, lines = heapq.heappop(frontier)
        if (state, at) in seen:
            continue
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        seen.add((state, at))
        heapq.heappush(frontier, (cost + 2, audit + "I", nxt[state], at, (*lines, (nxt[state], None))))
        if at < len(rows):
            role, fault = rows[at]
            heapq.heappush(frontier, (cost + 3, audit + "D", state, at + 1, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(frontier, (cost + 2 + more, audit + "R", nxt[state], at + 1, (*lines, (nxt[state], at))))
                if role[:1] == nxt[state] or (role[:1] == "s" and state == ""):
                    heapq.heappush(frontier, (cost + more, audit + "K", role[:1], at + 1, (*lines, (role, at))))


def plain_conversation(rows):
    """rows: (turn, role, text) after damage, in order."""
    seen, judged = set(), []
    for _, role, text in rows:
        solid = [c for c in text if c not in " \t\n\v\f\r"]
        judged.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "fine")
        seen.add((role, text))
    cost, audit, lines = plain_repairs([(r[1], f) for r, f in zip(rows, judged)])
    full = {"u": "user", "a": "assistant"}
    said = [f"{full.get(role, role) if at is None or role in full else role}:{'' if at is None else rows[at][2]}" for role, at in lines]
    turns = {r[0] for r in rows if r[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, judged.count("blank"), judged.count("duplicate"), judged.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text, kind = role if role is not None else " ", text if text is not None else " ", crc_kind(conv, turn)
        if kind:
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def check_conversations(spark, rows):
    table = spark.createDataFrame([(*r, 7, "h", 1) for r in rows], TURNS)
    got = {r.conv_id: tuple(r)[1:] for r in op13.repair(op13.damaged(table)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got == {c: plain_conversation(plain_damage(own)) for c, own in by.items()}


def test_conversations_against_search(spark):
    rng = np.random.default_rng(8)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["One.", "Two!", "three", "", " \t", None, "Why?\n", "Four.", "five,", "Ünd."]
    rows = []
    for conv in range(60):
        for turn in sorted(rng.integers(0, 14, rng.integers(1, 12)).tolist()):
            rows.append((conv if conv else None, turn if rng.random() > 0.1 else None, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    check_conversations(spark, rows)


def test_conversations_dropped_whole_repeated_and_long(spark):
    dropped = next(c for c in range(1000, 2000) if crc_kind(c, 0) == 0)
    rows = [(dropped, 0, "user", "Gone.")]
    rows += [(1, 3, "user", "Same.")] * 9 + [(1, 4, "assistant", "Same.")] * 2  # equal rows of one turn
    rows += [(2, t, "assistant" if t % 7 else "system", f"Row {t}." if t % 5 else "cut off") for t in range(1500)]  # long runs, over many stretches
    check_conversations(spark, rows)
    assert op13.repair(op13.damaged(spark.createDataFrame([], TURNS))).collect() == []


def test_runs_of_any_length_cost_the_same_as_rows():
    for symbol in range(16):
        go = step = op13._END
        for length in range(1, 40):
            step = op13._before(op13._step(symbol), step)
            assert op13.cost_to_go(symbol, length, go) == step


@pytest.mark.parametrize("module, name", [(op11, "op11_nn_descent"), (op13, "op13_conversation_repair")])
def test_queries_match_their_sql(spark, module, name):
    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    df = module.QUERIES[name](spark, "/root/testdata/sf0.01")
    r = duck.execute(module.ORACLES[name])
    names = [x[0] for x in r.description]
    plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    assert sorted(map(plain, df.select(*names).collect())) == sorted(map(plain, r.fetchall()))


def test_whitening_query(spark):
    df = op12.op12_chebyshev_whitening(spark, "/root/testdata/sf0.001")
    r = df.agg(F.count("*").alias("n"), F.max("component").alias("k"), F.max("identity_error").alias("e"), F.avg(F.col("whitened") ** 2).alias("v")).first()
    assert r.n == 500 * 32 and r.k == 32 and r.e < 1e-9 and abs(r.v - 1) < 1e-9


def test_url_rules_beyond_an_expression_and_odd_pages(spark, monkeypatch):
    """A rule table gives what the expression gives; very long addresses, clashing columns, equal lengths on different hosts."""
    from harborlight.llm import op05_url_filters as op5

    rules = [*op5.RULES, ("block", "example.com", "/en/8"), ("allow", "b.org", "/x"), ("block", "a.b.org", ""), ("allow", "org", "/xyz/")]
    urls = ["https://www.Example.com/en/71", "http://example.com/en/8", "https://a.b.org/x", "https://q.a.b.org/xyz/1", "https://net/de/" + "a" * 20000, "x://", None, "no scheme", "https://b.org", "http://example.net/de/8?q", "https://example.com/en/71"]
    pages = spark.createDataFrame([(i, u, None, "h", "p", "r", "v", "a") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string, rule string, verdict string, fit string")
    plain = sorted(map(tuple, op5.judge(pages, rules).collect()), key=repr)
    monkeypatch.setattr(op5, "MOST_RULES", 3)
    assert sorted(map(tuple, op5.judge(pages, rules).collect()), key=repr) == plain
    by = {r[0]: r for r in plain}
    assert by[0][3:5] == ("example.com/en/7", "allow") and by[2][3:5] == ("b.org/x", "allow") and by[3][3:5] == ("org/xyz/", "allow") and by[6][1:5] == ("", "", None, "allow")
