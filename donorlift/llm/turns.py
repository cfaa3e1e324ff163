"""Conversation structure repair (operator 13) by Wagner-Fischer alignment.

A conversation shall read ``(s?(ua)+)?`` in role initials.  Its turns are aligned
to the grammar string of every feasible length: Keep costs 0, Rerole to user or
assistant 2, Delete 3, Insert of an empty user or assistant turn 2, and a
truncated turn that is not deleted 1 more; blank and duplicate turns must be
deleted.  A table E[i][r] holds the least cost of aligning turns i.. with the
last r symbols of the alternating string.  All grammar strings share these
suffixes, so one table serves every length; an s can only be a kept turn, with
all turns before it deleted.  An incumbent (keep or rerole every turn that may
stay) bounds the cost, and only cells within Ukkonen's band are filled: those
whose surplus or lack of symbols does not alone cost more.  From each length of
least cost the alignment is read out from the first turn on, taking the
ASCII-least edit among the cheapest, and the audits are compared.

Long conversations are aligned in segments of SEGMENT turns: a segment is
aligned to the pieces of the grammar string between any two of its four states
(nothing yet, after s, after u, after a); costs to go are carried back over the
segments, audits forward.  Inserts at a seam belong to the segment after it, so
pieces of equal cost compare as the whole audits do.

Rows are dealt out by conversation and sorted twice over, first as narrow rows
(a class, a fault and a digest), then as texts: a task knows a conversation's
edits before its first text comes, and never holds texts of a conversation
together.  What it holds are one letter, one class and a 32-byte digest per turn.
A conversation stays in one task, since its audit and its SHA-256 are one value
each and the latter can only be taken in order.

Defined results: null roles and texts count as one space; an empty role has the
initial of one; turns are ordered null first, rows of an equal turn by role and
then by the SHA-256 of role and text; rows of a null conv_id are a conversation;
conversations without rows, or whose turns are all deleted, have an empty
repair; texts of any length are hashed one by one; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.llm.common import table, tidy
from donorlift.llm.queries import query

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Turns aligned in one table.
SEGMENT = 64
NEVER = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
NEXT = {"0": "u", "s": "u", "a": "u", "u": "a"}  # symbol that must follow a state

# A turn in the alignment: x must go; else s, u, a or o (any other role), in
# capitals if truncated.


class Piece:
    """A run of turns against pieces of the alternating string."""

    def __init__(self, code: str, last: bool, ends: str):
        self.code, self.last, self.n = code, last, len(code)
        stay = [c.lower() for c in code if c != "x"]
        wrong = [sum(c != ("ua", "au")[k][i & 1] for i, c in enumerate(stay)) for k in (0, 1)]
        # cost above that of the forced deletions which no best alignment exceeds
        self.slack = TRUNCATED * sum(c.isupper() for c in code) + REROLE * max(wrong) + 2 * INSERT
        self.tables = {end: self.table(end) for end in ends}

    def table(self, end: str) -> tuple[list[int], list[list[int]]]:
        """E for pieces that end in ``end``: for each turn, the least r of the
        band and the costs from there on."""
        other = "u" if end == "a" else "a"
        under, over, stay = self.slack // DELETE, self.slack // INSERT, 0
        low, rows = [0] * (self.n + 1), [[]] * (self.n + 1)
        rows[self.n] = [0] + [INSERT * r if self.last else NEVER for r in range(1, over + 1)]
        for i in range(self.n - 1, -1, -1):
            c = self.code[i]
            stay += c != "x"
            lo, hi = max(0, stay - under), stay + over
            below, at, keeps = rows[i + 1], low[i + 1], c.lower()
            late = TRUNCATED if c.isupper() else 0
            row, before = [], NEVER
            for r in range(lo, hi + 1):
                best = before + INSERT
                if 0 <= r - at < len(below):
                    best = min(best, below[r - at] + DELETE)
                if c != "x" and r and 0 <= r - 1 - at < len(below):
                    best = min(best, below[r - 1 - at] + late + (0 if keeps == (end if r & 1 else other) else REROLE))
                before = min(best, NEVER)
                row.append(before)
            low[i], rows[i] = lo, row
        return low, rows

    def cost(self, end: str, i: int, r: int) -> int:
        low, rows = self.tables[end]
        k = r - low[i]
        return rows[i][k] if 0 <= k < len(rows[i]) else NEVER

    def options(self, entry: str, exits: dict[str, int]):
        """(cost with that of going on from the exit, exit, kept s turn or None,
        end and length of the piece after it)."""
        starts = [(None, 0, 0)]
        if entry == "0":  # turns before a kept s are deleted
            starts += [(p, p + 1, DELETE * p + TRUNCATED * c.isupper()) for p, c in enumerate(self.code) if c in "sS"]
        for p, i, paid in starts:
            out = entry if p is None else "s"
            if exits[out] < NEVER:
                yield paid + DELETE * (self.n - i) + exits[out], out, p, None, 0
            for end in self.tables:
                if exits[end] < NEVER:
                    low, rows = self.tables[end]
                    for k, c in enumerate(rows[i]):
                        r = low[i] + k
                        if r and c < NEVER and ((end == NEXT[out]) == (r & 1 == 1)):
                            yield paid + c + exits[end], end, p, end, r

    def least(self, entry: str, exits: dict[str, int]) -> int:
        return min((o[0] for o in self.options(entry, exits)), default=NEVER)

    def best(self, entry: str, exits: dict[str, int]) -> tuple[str, str]:
        """ASCII-least audit of least cost, and the state after it."""
        found = list(self.options(entry, exits))
        least = min(o[0] for o in found)
        return min((self.audit(p, end, r), out) for c, out, p, end, r in found if c == least)

    def audit(self, p: int | None, end: str | None, r: int) -> str:
        """Edits of the alignment, the least of the cheapest at every step."""
        out, i = ([], 0) if p is None else (["D" * p, "K"], p + 1)
        other = "u" if end == "a" else "a"
        while i < self.n or r:
            if end is None:
                return "".join(out) + "D" * (self.n - i)
            here = self.cost(end, i, r)
            if i < self.n and here == self.cost(end, i + 1, r) + DELETE:
                out.append("D")
                i += 1
            elif r and here == self.cost(end, i, r - 1) + INSERT:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.code[i].lower() == (end if r & 1 else other) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def align(code: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Least cost of a repair, and the ASCII-least audit of that cost."""
    done = {"0": 0, "s": NEVER, "u": NEVER, "a": 0}
    cuts = [code[i : i + segment] for i in range(0, len(code), segment)] or [""]
    to_go = [done]
    if len(cuts) > 1:
        for k in range(len(cuts) - 1, 0, -1):
            piece = Piece(cuts[k], k == len(cuts) - 1, "ua")
            to_go.append({q: piece.least(q, to_go[-1]) for q in "0sua"})
    to_go.reverse()
    state, audits, cost = "0", [], 0
    for k, cut in enumerate(cuts):
        piece = Piece(cut, k == len(cuts) - 1, "a" if len(cuts) == 1 else "ua")
        if k == 0:
            cost = piece.least("0", to_go[0])
        audit, state = piece.best(state, to_go[k])
        audits.append(audit)
    return cost, "".join(audits)


def symbols(audit: str) -> str:
    """The grammar string that an audit leads to."""
    n = len(audit) - audit.count("D")
    return "s" * (n & 1) + "ua" * (n // 2)


# -- rows ---------------------------------------------------------------------
def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): rows after the damage that the CRC-32
    of conv_id:turn picks; a dropped row stays, with ``there`` false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    out = rows.select("conv_id", "turn", "role", "text", fate.alias("fate"))
    role = F.when(F.col("fate") == 4, "user").otherwise(text("role"))
    return out.select("conv_id", "turn", role.alias("role"), said.alias("text"), (F.col("fate") != 0).alias("there"), times.alias("copy")).drop("copy")


def arranged(rows: DataFrame) -> DataFrame:
    """Every conversation's rows in one partition: narrow ones in the order of
    the turns, then those with texts in the same order."""
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    one_space = lambda c: F.coalesce(c, F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one_space(F.col("role")).alias("role"), one_space(F.col("text")).alias("text"), there.alias("there"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    end = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise(".")
    initial = F.left(F.col("role"), F.lit(1))
    kind = F.when(~F.col("there"), "-").otherwise(F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), fault))
    rows = rows.withColumn("digest", digest).withColumn("kind", kind)
    steps = F.when(F.col("there"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("step", F.explode(steps))
    narrow = F.col("step") == 0
    rows = rows.select("conv_id", "step", "turn", "role", "digest", F.when(narrow, F.col("kind")).alias("kind"), F.when(~narrow, F.col("text")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "step", F.col("turn").asc_nulls_first(), "role", "digest")


class Conversation:
    """What is known of a conversation, first from its narrow rows."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.classes, self.faults, self.digests = bytearray(), bytearray(), bytearray()
        self.least = self.last = None
        self.turns = 0

    def add(self, turn, digest: bytes, kind: str) -> None:
        if kind == "-":
            return
        if turn is not None and turn != self.last:  # turns come in order
            self.least = turn if self.least is None else self.least
            self.last = turn
            self.turns += 1
        self.classes.append(ord(kind[0]))
        self.faults.append(ord(kind[1]))
        self.digests += digest

    def settle(self, known: dict[str, tuple[int, str]]) -> None:
        """Faults, and the audit of the cheapest repair."""
        n = len(self.classes)
        if n < 1000:
            seen, first = set(), []
            for i in range(n):
                d = bytes(self.digests[32 * i : 32 * i + 32])
                first.append(d not in seen)
                seen.add(d)
        else:
            each = np.frombuffer(bytes(self.digests), [(c, "<u8") for c in "abcd"])
            first = np.zeros(n, bool)
            first[np.unique(each, return_index=True)[1]] = True
            first = first.tolist()
        self.digests = bytearray()
        faults = ["b" if f == 98 else "d" if not new else chr(f) for f, new in zip(self.faults, first, strict=True)]
        roles = self.classes.decode()
        self.blank, self.duplicate, self.truncated = (faults.count(f) for f in "bdt")
        self.illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(n - 1))
        self.gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        code = "".join("x" if f in "bd" else c.upper() if f == "t" else c for c, f in zip(roles, faults, strict=True))
        if code not in known:
            if len(known) > 100_000:
                known.clear()
            if n > 1000:
                self.cost, self.audit = align(code)
            else:
                known[code] = align(code)
        if code in known:
            self.cost, self.audit = known[code]
        self.symbols = symbols(self.audit)
        self.at = self.place = 0

    def inserts(self):
        """Turns inserted before the next row: (place, role)."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.place, ROLES[self.symbols[self.place]]
            self.at, self.place = self.at + 1, self.place + 1

    def edit(self, role: str) -> tuple[str, int, str]:
        """Edit of the next row: (letter, place, role after it)."""
        did, place = self.audit[self.at], self.place
        self.at += 1
        if did == "D":
            return did, place, role
        self.place += 1
        return did, place, role if did == "K" else ROLES[self.symbols[place]]


def walked(it, make):
    """Rows that ``make(conversation)`` gives: its ``turn(did, place, turn, role,
    text)`` is called for each repaired or deleted turn, its ``end()`` once."""
    known: dict[str, tuple[int, str]] = {}
    one = out = None
    started = False

    def close():
        if not started:
            one.settle(known)
        sink = out or make(one)
        for place, role in one.inserts():
            yield from sink.turn("I", place, None, role, "")
        yield from sink.end()

    for b in it:
        cols = [b.column(b.schema.get_field_index(c)) for c in ("conv_id", "step", "turn", "role", "digest", "kind", "text")]
        for conv_id, step, turn, role, digest, kind, text in zip(*(c.to_pylist() for c in cols), strict=True):
            if one is None or conv_id != one.conv_id:
                if one is not None:
                    yield from close()
                one, out, started = Conversation(conv_id), None, False
            if step == 0:
                one.add(turn, digest, kind)
                continue
            if not started:
                one.settle(known)
                out, started = make(one), True
            for place, new in one.inserts():
                yield from out.turn("I", place, None, new, "")
            did, place, new = one.edit(role)
            yield from out.turn(did, place, turn, new, text)
    if one is not None:
        yield from close()


class _Report:
    def __init__(self, one: Conversation):
        self.one, self.hash, self.some = one, hashlib.sha256(), False

    def turn(self, did, place, turn, role, text):
        if did != "D":
            self.hash.update(f"{chr(10) * self.some}{role}:".encode())
            self.hash.update(text.encode())
            self.some = True
        return ()

    def end(self):
        c = self.one
        yield c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, c.audit, self.hash.hexdigest()


class _Repaired:
    def __init__(self, one: Conversation):
        self.one = one

    def turn(self, did, place, turn, role, text):
        if did != "D":
            yield self.one.conv_id, place, turn, role, text, did

    def end(self):
        return ()


def _batches(rows, schema: pa.Schema, limit: int = 1 << 20):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + sum(len(v) for v in r if isinstance(v, str))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _mapped(rows: DataFrame, make, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    id_type = dict(rows.dtypes)["conv_id"]

    def run(it):
        it = iter(it)
        head = next(it, None)
        if head is None:
            return
        schema = pa.schema([("conv_id", head.schema.field("conv_id").type), *[(n, t) for n, _, t in fields]])

        def again():
            yield head
            yield from it

        yield from _batches(walked(again(), make), schema)

    return arranged(rows).mapInArrow(tidy(run), ", ".join([f"conv_id {id_type}", *[f"{n} {t}" for n, t, _ in fields]]))


def audits(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text, and
    optionally there: false for a row that only names its conversation)."""
    counts = [(n, "long", pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _mapped(rows, _Report, [*counts, ("audit", "string", pa.string()), ("repaired_sha256", "string", pa.string())])


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns: (conv_id, place from 0, turn, role, text, edit);
    inserted turns have no turn number and an empty text."""
    return _mapped(rows, _Repaired, [("place", "long", pa.int64()), ("turn", "long", pa.int64()), ("role", "string", pa.string()), ("text", "string", pa.string()), ("edit", "string", pa.string())])


# -- SQL: the same repair as shortest paths over the grammar's four states ------
def _plus(state: str, cost: str, edit: str) -> str:
    return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{edit}'"


_INS_U = f"least(u, {_plus('z', '2', 'I')}, {_plus('s', '2', 'I')}, {_plus('a', '2', 'I')})"
_INS_A = f"least(a, {_plus('u1', '2', 'I')})"
_FROM = "least(z, s, a1)"
SQL = rf"""
WITH RECURSIVE bits AS (SELECT CAST(range AS BIGINT) AS n FROM range(256)),
tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM bits),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
fate AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM raw, tab),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM raw)),
hurt AS (SELECT ids.c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
         FROM fate JOIN ids ON fate.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(concat(length(role), ':', role, text)), copy) AS i,
             right(rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1) AS tail, left(concat(role, ' '), 1) AS initial FROM hurt),
flags AS (SELECT *, tail = '' AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
            tail <> '' AND tail NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM placed),
rows_ AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 1 ELSE 0 END AS late FROM flags),
seen AS (SELECT c, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT again AND cut) AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM rows_ GROUP BY c),
path AS (SELECT c, CAST(0 AS BIGINT) AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM ids
  UNION ALL
  SELECT c, i, {_plus('z', '3', 'D')}, least({_plus('s', '3', 'D')}, CASE WHEN NOT gone AND initial = 's' THEN {_plus('z', 'late', 'K')} END),
    least({_plus('u1', '3', 'D')}, CASE WHEN gone THEN NULL WHEN initial = 'u' THEN {_plus(_FROM, 'late', 'K')} ELSE {_plus(_FROM, '2 + late', 'R')} END),
    least({_plus('a1', '3', 'D')}, CASE WHEN gone THEN NULL WHEN initial = 'a' THEN {_plus('u1', 'late', 'K')} ELSE {_plus('u1', '2 + late', 'R')} END)
  FROM (SELECT *, {_INS_A} AS a1 FROM (SELECT path.c, r.i, z, s, u, a, gone, initial, late, {_INS_U} AS u1 FROM path JOIN rows_ r ON r.c = path.c AND r.i = path.i + 1))),
ends AS (SELECT c, arg_max(z, i) AS z, arg_max({{'v': s}}, i).v AS s, arg_max({{'v': u}}, i).v AS u, arg_max({{'v': a}}, i).v AS a FROM path GROUP BY c),
best AS (SELECT c, least(z, {_INS_A}) AS best FROM (SELECT *, {_INS_U} AS u1 FROM ends)),
steps AS (SELECT c, substr(best, 10) AS audit, unnest(range(10, length(best) + 1)) AS p, substr(best, p, 1) AS did FROM best),
where_ AS (SELECT c, p, did, count(*) FILTER (did <> 'I') OVER w AS i, count(*) FILTER (did <> 'D') OVER w AS o, count(*) FILTER (did <> 'D') OVER (PARTITION BY c) AS n
           FROM steps WINDOW w AS (PARTITION BY c ORDER BY p)),
made AS (SELECT w.c, sha256(string_agg(concat(CASE WHEN did = 'K' THEN r.role WHEN (n - o) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN did = 'I' THEN '' ELSE r.text END), chr(10) ORDER BY p)) AS h
         FROM where_ w LEFT JOIN rows_ r ON r.c = w.c AND r.i = w.i WHERE did <> 'D' GROUP BY w.c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids JOIN best USING (c) LEFT JOIN seen USING (c) LEFT JOIN made USING (c)
"""


@query("op13_turns", SQL)
def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits(damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
