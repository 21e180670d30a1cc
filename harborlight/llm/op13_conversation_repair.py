"""Repair of conversation structure by a run-length dynamic program.

A conversation's rows, in turn order, become symbols of role and fault. Rows that agree in turn, role and text are one row with a
count before anything is sorted; a fault of repetition is found by the least position of each text, which is aggregated map-side.
The symbols are sorted by range, so that a long conversation spreads over tasks, and each task writes its stretches of
equal symbols as runs. The program over a conversation's runs has four states (nothing yet, after system, user,
assistant); a row's edits, with the insertions before it, are one min-plus matrix. A run's matrix is raised to its length
by cached binary powers, backwards from the end, which gives the cost to go before every run; the edits are then unrolled
forwards, at each step the least initial that stays on a cheapest path. The edits of a conversation are one value, so one task makes
them; the texts are not in it. A last pass sorts the texts by conversation and streams each one, after its
edits, into SHA-256, holding a batch of texts at a time; that hash is sequential by nature.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3; required for blank and repeated rows), Insert an empty text of
user or assistant (2); a truncated row that stays costs 1 more. Initials of the result's roles match (s?(ua)+)?.

Defined cases: null role and text are one space; a null conv_id is a conversation of its own; null turns come first and don't
count for gaps; rows of one turn go by role, then by the MD5 of their text; roles count by their first character, and one that is
neither s, u nor a can't be kept; a conversation without rows after damage has zeros, an empty audit and the hash of nothing; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import materialize, table, text_batches

#: Roles by their initial (any other is OTHER), faults, and the symbol of a conversation without rows.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
NO_ROW = 255
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATION = 2, 3, 2, 1
#: Rows of a run, at most: a longer stretch is several runs, so that unrolling one holds that many vectors.
RUN = 4096

_NEVER = 1 << 60
#: States: nothing yet, after system, after user, after assistant. Where user or assistant comes next, and where system may.
_START, _AFTER_S, _AFTER_U, _AFTER_A = range(4)
_NEXT = (_AFTER_U, _AFTER_U, _AFTER_A, _AFTER_U)
_ROLE_OF = {_AFTER_S: SYSTEM, _AFTER_U: USER, _AFTER_A: ASSISTANT}
_END = (0, 2 * INSERT, INSERT, 0)


def _own_step(symbol: int, state: int) -> int | None:
    """The state after a row whose role is kept, or None where it can't be."""
    role = symbol % 4
    if role == SYSTEM:
        return _AFTER_S if state == _START else None
    return _NEXT[state] if _ROLE_OF[_NEXT[state]] == role else None


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, state after) of the edits of one row, by initial."""
    yield "D", DELETE, state
    if symbol // 4 in (FINE, TRUNCATED):
        more = TRUNCATION if symbol // 4 == TRUNCATED else 0
        own = _own_step(symbol, state)
        if own is not None:
            yield "K", more, own
        yield "R", REROLE + more, _NEXT[state]


@cache
def _step(symbol: int) -> tuple[tuple[int, ...], ...]:
    """The min-plus matrix of one row and the insertions before it."""
    rows = []
    for state in range(4):
        best, at, cost = [_NEVER] * 4, state, 0
        for _ in range(4):
            for _, price, after in _edits(symbol, at):
                best[after] = min(best[after], cost + price)
            at, cost = _NEXT[at], cost + INSERT
        rows.append(tuple(best))
    return tuple(rows)


@cache
def _power(symbol: int, bit: int) -> tuple[tuple[int, ...], ...]:
    """The matrix of 2**bit equal rows."""
    if not bit:
        return _step(symbol)
    m = _power(symbol, bit - 1)
    return tuple(tuple(min(m[i][k] + m[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _before(m: tuple[tuple[int, ...], ...], go: tuple[int, ...]) -> tuple[int, ...]:
    a, b, c, d = go
    return tuple(min(r[0] + a, r[1] + b, r[2] + c, r[3] + d) for r in m)


def cost_to_go(symbol: int, length: int, go: tuple[int, ...]) -> tuple[int, ...]:
    """The cost to go before a run, from that behind it."""
    bit = 0
    while length:
        if length & 1:
            go = _before(_power(symbol, bit), go)
        length >>= 1
        bit += 1
    return go


@cache
def _choices(symbol: int, state: int) -> tuple[tuple[str, int, int, bool], ...]:
    """(initial, cost, state after, whether the row is behind us) of what may come next, by initial."""
    edits = [(*e, True) for e in _edits(symbol, state)]
    return tuple(sorted([*edits, ("I", INSERT, _NEXT[state], False)]))


def cheapest_edits(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """The least cost of repairing runs of (symbol, length), and of the cheapest edits' initials the least."""
    behind = [_END]
    for symbol, length in reversed(runs):
        behind.append(cost_to_go(symbol, length, behind[-1]))
    behind.reverse()
    out, state = [], _START
    for (symbol, length), end in zip(runs, behind[1:]):
        go = [end]
        for _ in range(length):
            go.append(_before(_step(symbol), go[-1]))
        while len(go) > 1:
            here, after = go[-1], go[-2]
            initial, state, done = next((i, then, done) for i, price, then, done in _choices(symbol, state) if price + (after if done else here)[then] == here[state])
            out.append(initial)
            if done:
                go.pop()
    while _END[state]:
        out.append("I")
        state = _NEXT[state]
    return behind[0][_START], "".join(out)


_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def faults(runs: list[tuple[int, int]]) -> dict[str, int]:
    """Rows by fault, and neighbours whose roles don't follow each other."""
    of = [0] * 4
    illegal, before = 0, None
    for symbol, length in runs:
        of[symbol // 4] += length
        illegal += length - 1 + (before is not None and (before, symbol % 4) not in _LEGAL)
        before = symbol % 4
    return {"blank": of[BLANK], "duplicate": of[DUPLICATE], "truncated": of[TRUNCATED], "illegal": illegal}


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults of crc32(conv_id:turn) % 20; copies: how often a row now stands there, 0 for dropped ones."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _role_of(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


_ORDER = ["conv_id", "timed", "turn", "role", "h"]


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, timed, turn, role, h, piece, symbol, length) of rows (conv_id, turn, role, text, copies); a conversation's dropped rows leave one NO_ROW."""
    solid = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(~solid, BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), FINE).otherwise(TRUNCATED)
    there = F.col("copies") > 0
    held = lambda c: F.when(there, c)
    keyed = rows.select("conv_id", held(F.col("turn").isNotNull()).alias("timed"), held(F.col("turn")).alias("turn"), held(F.col("role")).alias("role"), held(F.md5("text")).alias("h"), held(fault).alias("fault"), "copies")
    alike = materialize(keyed.groupBy(*_ORDER, "fault").agg(F.sum("copies").alias("n")), "turns")
    place = F.struct("timed", "turn")
    # Only texts that stand in more than one place of a conversation have later places.
    first = alike.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "h").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("t"), "first")
    met = alike.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("t")), "left")
    own = F.when(F.coalesce((F.col("fault") != BLANK) & (place > F.col("first")), F.lit(False)), DUPLICATE).otherwise(F.col("fault"))
    symbol = lambda f: (_role_of(F.col("role")) + 4 * f).cast("int")
    piece = lambda f, n: F.struct(symbol(f).alias("symbol"), n.cast("long").alias("length"))
    alone = F.array(piece(F.col("own"), F.col("n")))
    copied = F.array(piece(F.col("own"), F.lit(1)), piece(F.lit(DUPLICATE), F.col("n") - 1))
    none = F.array(F.struct(F.lit(NO_ROW).alias("symbol"), F.lit(0).cast("long").alias("length")))
    pieces = F.when(F.col("fault").isNull(), none).when((F.col("n") > 1) & F.col("own").isin(FINE, TRUNCATED), copied).otherwise(alone)
    return met.withColumn("own", own).select(*_ORDER, F.posexplode(pieces).alias("piece", "p")).select(*_ORDER, "piece", "p.symbol", "p.length")


def _starts(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are alike."""
    n = len(column)
    valid = np.asarray(column.is_valid())
    differs = np.asarray(pa.compute.fill_null(pa.compute.not_equal(column.slice(1), column.slice(0, n - 1)), False))
    return np.concatenate([[True], np.where(valid[1:] & valid[:-1], differs, valid[1:] != valid[:-1])])


def runs_of(rows: DataFrame) -> DataFrame:
    """Stretches of each conversation in order, as runs: (conv_id, at, symbols, lengths, low, high, turns, head, tail).

    at orders the stretches; low, high, turns, head and tail are the least, greatest, number of different, first and last turn."""
    ordered = rows.repartitionByRange(*_ORDER, "piece").sortWithinPartitions(*_ORDER, "piece")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            ids, turn = b.column("conv_id"), b.column("turn")
            symbol, length = np.asarray(b.column("symbol")), np.asarray(b.column("length"))
            cuts = np.append(np.flatnonzero(_starts(ids)), b.num_rows)
            timed, when = np.asarray(turn.is_valid()), np.asarray(pa.compute.fill_null(turn, 0))
            out: dict[str, list] = {k: [] for k in ("at", "symbols", "lengths", "low", "high", "turns", "head", "tail")}
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                there = np.flatnonzero(symbol[lo:hi] != NO_ROW) + lo
                s, t = symbol[there], when[there][timed[there]]
                begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
                out["at"].append(at)
                out["symbols"].append(s[begin].astype(np.uint8).tobytes())
                out["lengths"].append(np.add.reduceat(length[there], begin).astype(np.int64).tobytes() if len(s) else b"")
                out["turns"].append(1 + int((t[1:] != t[:-1]).sum()) if len(t) else 0)
                for k, v in (("low", 0), ("high", -1), ("head", 0), ("tail", -1)):
                    out[k].append(int(t[v]) if len(t) else None)
                at += 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cuts[:-1])), *(pa.array(v, pa.binary() if k in ("symbols", "lengths") else pa.int64()) for k, v in out.items())], names=["conv_id", *out])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), "symbol", "length").mapInArrow(task, f"conv_id {kind}, at long, symbols binary, lengths binary, low long, high long, turns long, head long, tail long")


_FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(stretches: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
    kind = stretches.schema["conv_id"].dataType.simpleString()
    whole = stretches.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "symbols", "lengths", "low", "high", "turns", "head", "tail"))).alias("parts"))

    def figures(parts: list[dict]) -> dict:
        runs = []
        for p in parts:
            for symbol, length in zip(p["symbols"], np.frombuffer(p["lengths"], np.int64).tolist()):
                runs += [(symbol, RUN)] * (length // RUN) + ([(symbol, length % RUN)] if length % RUN else [])
        timed = [p for p in parts if p["turns"]]
        gaps = 0
        if timed:
            shared = sum(a["tail"] == b["head"] for a, b in zip(timed, timed[1:]))
            gaps = timed[-1]["high"] - timed[0]["low"] + 1 - sum(p["turns"] for p in timed) + shared
        cost, audit = cheapest_edits(runs)
        return {"gaps": gaps if gaps < 1 << 63 else None, **faults(runs), "cost": cost, "audit": audit}

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [figures(p.as_py()) for p in b.column("parts")]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array([r[c] for r in rows], pa.int64()) for c in _FIGURES), pa.array([r["audit"] for r in rows], pa.string())], names=["conv_id", *_FIGURES, "audit"])

    return whole.mapInArrow(task, f"conv_id {kind}, {', '.join(c + ' long' for c in _FIGURES)}, audit string")


class Replay:
    """Plays a conversation's edits over its rows in order and hashes the result as role:text lines."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.lines = audit, 0, _START, 0
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _due(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == _AFTER_U else "assistant"

    def _insertions(self) -> None:
        while self.audit.startswith("I", self.at):
            self._line(self._due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._line(self._due(), text)
        elif edit == "K":
            self.state = {"s": _AFTER_S, "u": _AFTER_U, "a": _AFTER_A}[role[0]]
            self._line(role, text)

    def digest(self) -> str:
        self._insertions()
        if self.at != len(self.audit):
            raise RuntimeError("the edits do not fit the conversation's rows")
        return self.hash.hexdigest()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256; each conversation's row of edits stands before its texts in one sorted stream."""
    text_batches(rows.sparkSession)
    kind = found.schema["conv_id"].dataType.simpleString()
    edits = found.withColumn("body", F.lit(False))
    texts = rows.where("copies > 0").select("conv_id", F.col("turn").isNotNull().alias("timed"), "turn", "role", F.md5("text").alias("h"), "text", "copies", F.lit(True).alias("body"))
    stream = edits.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "body", *_ORDER[1:])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *_FIGURES, "audit"]
        head, play = None, None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * (len(names) + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], names=[*names, "repaired_sha256"])

        for b in batches:
            fields = [*(b.schema.field(n) for n in names), pa.field("repaired_sha256", pa.string())]
            heads = np.flatnonzero(~np.asarray(b.column("body"))).tolist()
            listed = dict(zip(heads, b.select(names).take(pa.array(heads, pa.int64())).to_pylist()))
            out = []
            for i, (role, text, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("role", "text", "copies")))):
                if i in listed:
                    if play:
                        out.append((*head, play.digest()))
                    head, play = tuple(listed[i][n] for n in names), Replay(listed[i]["audit"])
                else:
                    for _ in range(copies):
                        play.row(role, text)
            yield done(out)
        if play:
            yield done([(*head, play.digest())])

    return stream.select("conv_id", *_FIGURES, "audit", "body", "role", "text", "copies").mapInArrow(task, f"conv_id {kind}, {', '.join(c + ' long' for c in _FIGURES)}, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """Figures, edits and the repaired text's hash of every conversation of rows (conv_id, turn, role, text, copies)."""
    return repaired(rows, materialize(audits(runs_of(symbols(rows))), "audits"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


_ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(k)), lambda i: ascii(substr(k, i::BIGINT + 1, 1))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM keyed
), broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM summed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS rn FROM broken
), judged AS (
  SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'fine' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || substr(role, 1, 1) AS pair FROM placed
), ins(st, here, more, letters, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
    (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (3, 3, 4, 'II', ['user:', 'assistant:'])
), edit(letter, st, i, next, price, says) AS (
  SELECT 'D', st, NULL::VARCHAR, st, 3, NULL::VARCHAR FROM (VALUES (0), (1), (2), (3)) v(st)
  UNION ALL SELECT 'R', st, NULL::VARCHAR, CASE WHEN st = 2 THEN 3 ELSE 2 END, 2, CASE WHEN st = 2 THEN 'assistant' ELSE 'user' END FROM (VALUES (0), (1), (2), (3)) v(st)
  UNION ALL SELECT 'K', st, i, next, 0, NULL::VARCHAR FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) v(st, i, next)
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, 0 AS st, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM conversations
  UNION ALL
  SELECT conv_id, rn, st, cost, audit, said FROM (
    SELECT j.conv_id, j.rn, e.next AS st, w.cost + n.more + e.price + CASE WHEN e.letter <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END AS cost, w.audit || n.letters || e.letter AS audit,
      w.said || n.lines || CASE WHEN e.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(e.says, j.role) || ':' || j.text] END AS said
    FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.rn = w.rn + 1 JOIN ins n ON n.st = w.st
      JOIN edit e ON e.st = n.here AND (e.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.i = j.i)
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, rn, st ORDER BY cost, audit) = 1
), size AS (
  SELECT c.conv_id, count(j.rn) AS n, coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON c.conv_id IS NOT DISTINCT FROM j.conv_id GROUP BY c.conv_id
), final AS (
  SELECT w.conv_id, w.cost + n.more AS cost, w.audit || n.letters AS audit, w.said || n.lines AS said
  FROM walk w JOIN size s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.rn = s.n JOIN ins n ON n.st = w.st AND n.here IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + n.more, w.audit || n.letters) = 1
)
SELECT s.conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, cost::BIGINT AS cost, audit,
  sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM size s JOIN final f ON s.conv_id IS NOT DISTINCT FROM f.conv_id
"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES = {"op13_conversation_repair": _ORACLE}
