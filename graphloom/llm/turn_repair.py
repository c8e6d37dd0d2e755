"""Repair of conversations: the cheapest edits that give a grammatical order of roles, by Dijkstra's search.

Nodes are (turns read, state of the grammar `(s?(ua)+)?` over initials of roles); edges are edits, made up as the search
reaches a node. The priority is (cost, audit), the audit being the initials of the edits so far: Delete, Insert, Keep, Rerole.
The first accepting node with all turns read that comes off the heap ends the search.

An audit names one way through the lattice, so two audits of equal cost to one node are never prefixes of each other and
appending keeps their order. Hence a long conversation can be searched in pieces of at most PIECE turns, each from every state
to every state, and the pieces' tables are folded in order. Turns are dealt by ranges of (conversation, turn), so a
conversation that holds a third of all rows is searched by many tasks. Its digest is sequential by definition: one
task streams its turns, sorted on disk, with no more than the audit and one batch in memory.

Defined cases. Null role and text are one space, as are nulls in the key of a damage. Turns go by number, nulls first; turns
of one number by a digest of role and text, so a repeated row stands beside its first. Rows with a null conv_id are one
conversation. conv_id keeps its type. A conversation without turns has zeros, an empty audit and the empty string's digest. Roles that the grammar
doesn't know can't be kept, only reroled or deleted. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1024
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: State after a turn whose role has this initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


def due(state: int) -> int:
    """The state after the turn that must come next: an inserted one, or one with a new role."""
    return ASSISTANT if state == USER else USER


def repair(turns: list[tuple[str, str]], start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of the cheapest repair of turns (initial of the role, fault)."""
    heap, done = [(0, "", 0, start)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(turns) and state in ends:
            return cost, audit, state
        done.add((i, state))
        for price, edit, j, to in _edits(turns, i, state):
            if (j, to) not in done:
                heapq.heappush(heap, (cost + price, audit + edit, j, to))
    raise ValueError("the grammar accepts no end")


def _edits(turns: list[tuple[str, str]], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    yield INSERT, "I", i, due(state)
    if i < len(turns):
        initial, fault = turns[i]
        yield DELETE, "D", i + 1, state
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED * (fault == "truncated")
            kept = KEPT.get((state, initial))
            if kept is not None:
                yield KEEP + more, "K", i + 1, kept
            yield REROLE + more, "R", i + 1, due(state)


def table_of(turns: list[tuple[str, str]]) -> dict[str, tuple[int, str]]:
    """(cost, audit) from each state to each state that can be reached, under the two numbers of the states."""
    out = {}
    for start in STATES:
        for end in STATES:
            try:
                out[f"{start}{end}"] = repair(turns, start, (end,))[:2]
            except ValueError:  # no edits lead there
                continue
    return out


class Fold:
    """Pieces of one conversation in order: sums, and the cheapest way to each state."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = self.last = None
        self.common: list[str] = []
        self.ways: dict[int, tuple[int, str]] = {START: (0, "")}
        self.whole: list | None = None

    def add(self, p: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + p[name])
        if self.last is not None:
            self.illegal += self.last + p["first"] not in ("su", "ua", "au")
        self.last = p["last"]
        if p["low"] is not None:
            self.turns -= p["low"] == self.last_turn
            self.low = p["low"] if self.low is None else self.low
            self.high = self.last_turn = p["high"]
        if p["whole"]:
            self.whole = p["whole"]
            return
        after: dict[int, tuple[int, str]] = {}
        for key, (cost, audit) in p["table"].items():
            a, b = int(key[0]), int(key[1])
            if a in self.ways:
                way = self.ways[a][0] + cost, self.ways[a][1] + audit
                after[b] = min(after.get(b, way), way)
        shared = len(commonprefix([w[1] for w in after.values()]))
        self.common.append(next(iter(after.values()))[1][:shared])
        self.ways = {s: (c, a[shared:]) for s, (c, a) in after.items()}

    def result(self) -> tuple[int, str]:
        if self.whole:
            return self.whole[0], self.whole[1]
        cost, audit = min(self.ways[s] for s in ENDS if s in self.ways)
        return cost, "".join(self.common) + audit

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _key(conversations: DataFrame) -> Column:
    return F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): a fifth or so of the rows dropped, emptied, without marks at the ends of sentences, repeated, or said by the user."""
    hit = F.crc32(_key(conversations)) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, initial, fault, later): no texts; later says that an earlier turn number has the same role and text."""
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(said == "", "blank").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = turns.select("conv_id", "turn", digest().alias("digest"), F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    place = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    firsts = rows.filter("fault <> 'blank'").groupBy("conv_id", "digest").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p <> q").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "p")
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return met.select("conv_id", "turn", "digest", "initial", "fault", F.coalesce(F.col("p") < place, F.lit(False)).alias("later"))


_PIECES = ("conv_id", "seq", "payload")


def pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, seq, payload): sums and tables of at most `piece` turns of a conversation, as JSON; seq orders them.

    A conversation that surely lies whole in one task, in one piece, is searched once, from the start to an end.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first = TaskContext.get().partitionId() << 32, True
        conv, turns, before, out = None, None, None, []

        def close(whole: bool) -> None:
            nonlocal seq
            out.append((conv, seq, json.dumps(_summed(turns, whole))))
            seq += 1

        for b in batches:
            kind = b.schema.field("conv_id").type
            for c, turn, key, initial, fault, later in zip(*(x.to_pylist() for x in b.columns), strict=True):
                begins = turns is None or c != conv
                if begins or len(turns) == piece:
                    if turns is not None:
                        close(begins and not first)
                        first = not begins
                    conv, turns = c, []
                same = not begins and before == (turn, key)
                before = turn, key
                turns.append((turn, initial, "duplicate" if fault != "blank" and (later or same) else fault))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (kind, pa.int64(), pa.string()), strict=True)], _PIECES)
            out.clear()
        if turns is not None:
            close(False)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string()), strict=True)], _PIECES)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(solve, f"conv_id {kind}, seq long, payload string")


def _summed(turns: list[tuple[int | None, str, str]], whole: bool) -> dict:
    numbers = [t for t, _, _ in turns if t is not None]
    initials = [i for _, i, _ in turns]
    marks = [(i, f) for _, i, f in turns]
    out = {f: sum(x == f for _, x in marks) for f in ("blank", "duplicate", "truncated")}
    out |= {"illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "first": initials[0], "last": initials[-1]}
    out |= {"low": min(numbers, default=None), "high": max(numbers, default=None), "turns": len(set(numbers))}
    return out | ({"whole": repair(marks)[:2]} if whole else {"whole": None, "table": table_of(marks)})


class Writer:
    """The repaired turns of one conversation, digested as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _due(self, text: str) -> None:
        self.state = due(self.state)
        self._put("user" if self.state == USER else "assistant", text)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._due("")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self._put(role, text)
        elif edit == "R":
            self._due(text)

    def hexdigest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(turns: DataFrame, ids: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of all ids. turns: (conv_id, turn, role, text)."""
    none = F.lit(None)
    every = ids.select("conv_id").distinct()
    found = pieces(faults(turns), piece)
    rows = every.select("conv_id", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("seq"), none.cast("long").alias("turn"), none.cast("string").alias("digest"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    rows = rows.unionByName(found.select("conv_id", F.lit(0).alias("kind"), "seq", none.cast("long").alias("turn"), none.cast("string").alias("digest"), none.cast("string").alias("role"), F.col("payload").alias("text")))
    rows = rows.unionByName(turns.select("conv_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), "turn", digest().alias("digest"), "role", "text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "seq", F.col("turn").asc_nulls_first(), "digest").drop("digest", "turn", "seq")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, writer, conv, kind, out = None, None, None, None, []

        def close() -> None:
            cost, audit = fold.result()
            made = (writer or Writer(audit)).hexdigest()
            out.append((conv, fold.gaps(), fold.blank, fold.duplicate, fold.truncated, fold.illegal, cost, audit, made))

        def batch() -> pa.RecordBatch:
            kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], ("conv_id", *_SUMS, "audit", "repaired_sha256"))
            out.clear()
            return done

        for b in batches:
            kind = b.schema.field("conv_id").type
            for c, what, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if fold is None or c != conv:
                    if fold is not None:
                        close()
                    fold, writer, conv = Fold(), None, c
                if what == 0:
                    if text is not None:
                        fold.add(json.loads(text))
                else:
                    writer = writer or Writer(fold.result()[1])
                    writer.turn(role, text)
            yield batch()
        if fold is not None:
            close()
            yield batch()

    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(write, f"conv_id {kind}, {', '.join(f'{c} long' for c in _SUMS)}, audit string, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    return repaired(damaged(conversations), conversations)


SQL = r"""
WITH RECURSIVE
  polynomial AS (SELECT list(c ORDER BY n) AS tbl FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(n))),
  k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
  h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM k, polynomial),
  d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, range(CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
  f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
               CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
  sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
  w AS (SELECT conv_id, n, 0::BIGINT AS i, {'c': 0::BIGINT, 't': '', 'r': ''} AS z, {'c': 1000000000::BIGINT, 't': '', 'r': ''} AS s,
               {'c': 2::BIGINT, 't': 'I', 'r': chr(10) || 'user:'} AS u, {'c': 4::BIGINT, 't': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a FROM sums
        UNION ALL
        SELECT conv_id, n, i, z, s, u, list_min([a, {'c': u.c + 2, 't': u.t || 'I', 'r': u.r || chr(10) || 'assistant:'}])
        FROM (SELECT conv_id, n, i, z, s, a, list_min([u, {'c': z.c + 2, 't': z.t || 'I', 'r': z.r || chr(10) || 'user:'}, {'c': s.c + 2, 't': s.t || 'I', 'r': s.r || chr(10) || 'user:'},
                                                         {'c': a.c + 2, 't': a.t || 'I', 'r': a.r || chr(10) || 'user:'}]) AS u
        FROM (SELECT conv_id, n, i,
             {'c': z.c + 3, 't': z.t || 'D', 'r': z.r} AS z,
             list_min([{'c': s.c + 3, 't': s.t || 'D', 'r': s.r}, {'c': z.c + kept + never + CASE WHEN ini = 's' THEN 0 ELSE 1000000000 END, 't': z.t || 'K', 'r': z.r || own}]) AS s,
             list_min([{'c': u.c + 3, 't': u.t || 'D', 'r': u.r}] || list_transform([z, s, a], lambda x: {'c': x.c + kept + never + CASE WHEN ini = 'u' THEN 0 ELSE 1000000000 END, 't': x.t || 'K', 'r': x.r || own})
                      || list_transform([z, s, a], lambda x: {'c': x.c + 2 + kept + never, 't': x.t || 'R', 'r': x.r || chr(10) || 'user:' || text})) AS u,
             list_min([{'c': a.c + 3, 't': a.t || 'D', 'r': a.r}, {'c': u.c + kept + never + CASE WHEN ini = 'a' THEN 0 ELSE 1000000000 END, 't': u.t || 'K', 'r': u.r || own},
                       {'c': u.c + 2 + kept + never, 't': u.t || 'R', 'r': u.r || chr(10) || 'assistant:' || text}]) AS a
        FROM (SELECT w.conv_id, w.n, f.i, w.z, w.s, w.u, w.a, f.ini, f.text, chr(10) || f.role || ':' || f.text AS own, CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS kept,
                     CASE WHEN f.fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END AS never
              FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)))),
  best AS (SELECT conv_id, list_min([z, a]) AS b FROM w WHERE i = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0) AS cost, coalesce(b.t, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""
