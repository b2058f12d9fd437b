"""Repair of conversation structure: the cheapest edits, found by A* on the edit lattice.

A lattice node is (rows consumed, what the output ends in); edits are its edges.
The heuristic is a suffix sum: a row that must be deleted will cost 2, and a
truncated one at least 2 (deleted; kept it would cost 5).  It is consistent, so
the first goal taken off the queue is cheapest; as the queue is keyed by (cost
plus heuristic, audit), it also has the ASCII-least audit.  Audits are kept as a
tree with skew-binary jump pointers, so two are compared in logarithmic time and
a conversation takes memory linear in its rows, however long.

Only flags meet in one task: rows are placed by ranges (``_running``), so no
conversation is gathered; a row becomes one letter, letters come in pieces of
``PIECE``, and A* reads a conversation's letters, one byte a row.  Texts move once,
to the stream that hashes the repaired conversation in order; a digest has no
other order, so one conversation's texts are read by one task, held one at a time.

Defined results: a null conv_id is a conversation of its own; a null turn comes
first; rows that tie on turn go by digest, so equal rows are adjacent; null role
and text are one space; a role's initial is its first character (none for an
empty one); texts are read whole; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm._running import running

PIECE = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

_SPACE = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)  # what the output ends in
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
#: Letter of a row: initial (s, u, a or other) by fault (none, blank, duplicate, truncated).
_INITIALS, _FAULTS = "suao", "kbdt"


def _turn_after(state: int) -> int:
    return _ASSISTANT if state == _USER else _USER


class _Audit:
    """A string of edits as a node of their tree."""

    __slots__ = ("edit", "jump", "parent", "size")

    def __init__(self, edit: str, parent: _Audit | None):
        self.edit, self.parent = edit, parent
        if parent is None:
            self.size, self.jump = 0, self
        else:
            self.size = parent.size + 1
            far = parent.jump
            self.jump = far.jump if parent.size - far.size == far.size - far.jump.size else parent

    def first(self, size: int) -> _Audit:
        at = self
        while at.size > size:
            at = at.jump if at.jump.size >= size else at.parent
        return at

    def __lt__(self, other: _Audit) -> bool:
        size = min(self.size, other.size)
        a, b = self.first(size), other.first(size)
        if a is b:
            return self.size < other.size
        while a.parent is not b.parent:
            a, b = (a.parent, b.parent) if a.jump is b.jump else (a.jump, b.jump)
        return a.edit < b.edit

    def __str__(self) -> str:
        out, at = [], self
        while at.parent is not None:
            out.append(at.edit)
            at = at.parent
        return "".join(reversed(out))


def letter(initial: str, fault: str) -> str:
    return chr(97 + _INITIALS.index(initial if initial in "sua" and initial else "o") * 4 + _FAULTS.index(fault))


def cheapest(letters: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows given as ``letter``s."""
    rows = [(_INITIALS[(ord(c) - 97) // 4], _FAULTS[(ord(c) - 97) % 4]) for c in letters]
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0 if rows[i][1] == "k" else min(DELETE, TRUNCATED))
    closed = bytearray(4 * len(ahead))
    queue = [(ahead[0], _Audit("", None), 0, _START)]
    while True:
        f, audit, i, state = heapq.heappop(queue)
        if closed[4 * i + state]:
            continue
        closed[4 * i + state] = 1
        if i == len(rows) and state in (_START, _ASSISTANT):
            return f, str(audit)
        cost, then = f - ahead[i], _turn_after(state)
        steps = [("I", i, then, INSERT)]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append(("D", i + 1, state, DELETE))
            if fault in "kt":
                charge = TRUNCATED if fault == "t" else 0
                if initial == "s" and state == _START:
                    steps.append(("K", i + 1, _SYSTEM, KEEP + charge))
                if initial == "ua"[then == _ASSISTANT]:
                    steps.append(("K", i + 1, then, KEEP + charge))
                else:
                    steps.append(("R", i + 1, then, REROLE + charge))
        for edit, j, after, price in steps:
            if not closed[4 * j + after]:
                heapq.heappush(queue, (cost + price + ahead[j], _Audit(edit, audit), j, after))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that each row's ``conv_id:turn`` calls for."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return rows.drop("_copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def flagged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, x, idx, initial, fault) of (conv_id, turn, role, text), in pieces of one letter a row."""
    bare = F.btrim("text", F.lit(_SPACE))
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")
    initial = F.left("role", F.lit(1))
    slim = rows.select("conv_id", "turn", _digest().alias("x"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"), F.lit(0).cast("long").alias("n_bytes"))
    slim = C.materialize(slim.withColumn("tie", F.monotonically_increasing_id()), "flags")
    placed = running(slim, "conv_id", F.col("turn").asc_nulls_first(), F.col("x").asc(), F.col("tie").asc())
    placed = C.materialize(placed.select("conv_id", "turn", "x", "idx", "initial", "fault"), "placed")
    # keys of both sides are unique: one row a place, one first row a text
    firsts = placed.groupBy("conv_id", "x").agg(F.min("idx").alias("at")).select(F.col("conv_id").alias("c"), "at")
    marked = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("idx") == F.col("at")), "left")
    again = F.col("at").isNull() & (F.col("fault") != "b")
    return marked.select("conv_id", "turn", "x", "idx", "initial", F.when(again, "d").otherwise(F.col("fault")).alias("fault"))


_FOUND = "conv_id long, piece long, turn long, x binary, edits string, cost long, blank long, duplicate long, truncated long, illegal long, audit string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of letters in order -> the same pieces with their edits; the first of a conversation carries its totals."""
    names = [f.split()[0] for f in _FOUND.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in _FOUND.split(", ")]
    key, pieces = None, []

    def solved() -> list[tuple]:
        letters = "".join(p[3] for p in pieces)
        cost, audit = cheapest(letters)
        faults = [letters.count(chr(97 + 4 * i + f)) for f in (1, 2, 3) for i in range(4)]
        initials = [_INITIALS[(ord(c) - 97) // 4] for c in letters]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        totals = (cost, sum(faults[:4]), sum(faults[4:8]), sum(faults[8:]), illegal, audit)
        out, at = [], 0
        for n, (piece, turn, x, own) in enumerate(pieces):
            start, rows = at, 0
            while at < len(audit) and (rows < len(own) or n == len(pieces) - 1):
                rows += audit[at] != "I"
                at += 1
            out.append((key, piece, turn, x, audit[start:at], *(totals if n == 0 else [None] * 6)))
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for b in batches:
        rows: list[tuple] = []
        for c, piece, turn, x, own in zip(*(b.column(n).to_pylist() for n in ("conv_id", "piece", "turn", "x", "letters")), strict=True):
            if pieces and c != key:
                rows += solved()
                pieces = []
            key = c
            pieces.append((piece, turn, x, own))
        yield batch(rows)
    yield batch(solved() if pieces else [])


def searched(flags: DataFrame) -> DataFrame:
    """Pieces of ``flagged`` rows with their edits, cost and counts."""
    code = F.lit(0)
    for k, i in enumerate(_INITIALS):
        code = F.when(F.col("initial") == i, 4 * k).otherwise(code)
    for k, f in enumerate(_FAULTS):
        code = F.when(F.col("fault") == f, k).otherwise(F.lit(0)) + code
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.chr((code + 97).cast("long")).alias("c")))), lambda s: s["c"]), "")
    first = F.min_by(F.struct("turn", "x"), "idx")
    pieces = flags.groupBy("conv_id", F.floor((F.col("idx") - 1) / PIECE).alias("piece")).agg(letters.alias("letters"), first.alias("first"))  # PIECE rows at most
    ordered = pieces.select("conv_id", "piece", F.col("first.turn").cast("long").alias("turn"), "first.x", "letters")
    return C.materialize(ordered.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_search, _FOUND), "edits")


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and rows of a conversation in order -> the digest of the repaired conversation."""
    key, edits, at, state, digest, empty = None, None, 0, _START, None, True

    def say(line: str) -> None:
        nonlocal empty
        digest.update(b"" if empty else b"\n")
        digest.update(line.encode("utf-8", "surrogatepass"))
        empty = False

    def insert() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = _turn_after(state)
            say(f"{_ROLES[state]}:")
            at += 1

    def finish() -> tuple:
        insert()
        return (key, digest.hexdigest())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])

    for b in batches:
        rows: list[tuple] = []
        for c, more, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "edits", "role", "text")), strict=True):
            if edits is None or c != key:
                if edits is not None:
                    rows.append(finish())
                key, edits, at, state, digest, empty = c, "", 0, _START, hashlib.sha256(), True
            if more is not None:
                edits, at = edits[at:] + more, 0
                continue
            insert()
            edit = edits[at]
            at += 1
            if edit == "K":
                state = _SYSTEM if role[:1] == "s" else _turn_after(state)
                say(f"{role}:{text}")
            elif edit == "R":
                state = _turn_after(state)
                say(f"{_ROLES[state]}:{text}")
        yield batch(rows)
    yield batch([finish()] if edits is not None else [])


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the only place to which texts move."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    said = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _digest().alias("x"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("piece"), none("edits"), "role", "text")
    edits = found.select("conv_id", "turn", "x", F.lit(0).alias("kind"), "piece", "edits", none("role"), none("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("x"), F.col("kind"), F.col("piece")]
    return edits.unionByName(said).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_spell, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, cost and audit of its repair, and the digest of what it becomes."""
    rows = damaged(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))
    flags = flagged(rows)
    found = searched(flags)
    turn = F.col("turn").cast("long")
    seen = rows.where("turn is not null").groupBy("conv_id", turn.alias("turn")).agg(F.lit(1).alias("_"))
    gaps = seen.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    totals = ["cost", "blank", "duplicate", "truncated", "illegal", "audit"]
    parts = [gaps, found.where("piece = 0").select("conv_id", *totals), digests(rows, found)]
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for k, part in enumerate(parts):  # unique keys on both sides
        out = out.join(part.withColumnRenamed("conv_id", f"_{k}"), F.col("conv_id").eqNullSafe(F.col(f"_{k}")), "left").drop(f"_{k}")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(C.table(spark, sf_dir, "conversations"))


def repair_sql() -> str:
    """The same in DuckDB SQL: row by row, the cheapest (cost, audit, text) for each end of the output."""
    never = {"c": "1000000000::bigint", "a": "''", "t": "''"}

    def state(c: str, a: str, t: str) -> str:
        return f"{{'c': {c}, 'a': {a}, 't': {t}}}"

    def more(s: str, price: str, edit: str, line: str | None = None) -> str:
        return state(f"{s}.c + {price}", f"{s}.a || {edit}", f"{s}.t" if line is None else f"{s}.t || chr(10) || {line}")

    def best(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    charge = f"case when f.fault = 't' then {TRUNCATED} else 0 end"

    def taken(s: str, initial: str, name: str) -> str:
        kept = more(s, f"{KEEP} + {charge}", "'K'", "f.role || ':' || f.text")
        other = more(s, f"{REROLE} + {charge}", "'R'", f"'{name}:' || f.text")
        return f"case when f.fault not in ('k', 't') then {state(**never)} when f.initial = '{initial}' then {kept} else {other} end"

    system = f"case when f.fault in ('k', 't') and f.initial = 's' then {more('s.s0', f'{KEEP} + {charge}', chr(39) + 'K' + chr(39), 'f.role || ' + chr(39) + ':' + chr(39) + ' || f.text')} else {state(**never)} end"
    dropped = [more(f"s.s{q}", str(DELETE), "'D'") for q in range(4)]
    user = best(dropped[2], *(taken(f"s.s{q}", "u", "user") for q in (0, 1, 3)))
    assistant = best(dropped[3], taken("s.s2", "a", "assistant"))
    says_user, says_assistant = (lambda s: more(s, str(INSERT), "'I'", "'user:'")), (lambda s: more(s, str(INSERT), "'I'", "'assistant:'"))
    start = state("0::bigint", "''", "''")
    first = f"{start} as s0, {state(**never)} as s1, {state('5::bigint', chr(39) + 'I' + chr(39), 'chr(10) || ' + chr(39) + 'user:' + chr(39))} as s2, {state('10::bigint', chr(39) + 'II' + chr(39), 'chr(10) || ' + chr(39) + 'user:' + chr(39) + ' || chr(10) || ' + chr(39) + 'assistant:' + chr(39))} as s3"
    return f"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {C.crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
dam as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) as copy from raw),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text), copy) as idx from dam),
flags as materialized (select conv_id, turn, role, text, idx, left(role, 1) as initial, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b'
  when row_number() over (partition by conv_id, role, text order by idx) > 1 then 'd' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 't' else 'k' end as fault from placed),
steps as (select conv_id, 0::bigint as i, {first} from (select distinct conv_id from flags)
  union all select conv_id, i, s0, s1, {best('s2', says_user('s0'), says_user('s1'), says_user('s3'))} as s2, {best('s3', says_assistant('s2'), says_assistant(f"({best('s2', says_user('s0'), says_user('s1'))})"))} as s3 from (
    select s.conv_id, f.idx as i, {dropped[0]} as s0, {best(dropped[1], system)} as s1, {user} as s2, {assistant} as s3
    from steps s join flags f on f.conv_id is not distinct from s.conv_id and f.idx = s.i + 1)),
ends as (select s.conv_id, {best('s.s0', 's.s3')} as e from steps s join (select conv_id, max(idx) as n from flags group by conv_id) l on l.conv_id is not distinct from s.conv_id and l.n = s.i),
pairs as (select conv_id, initial, lag(initial) over (partition by conv_id order by idx) as before, fault, turn from flags),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
  count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from pairs group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(e.c, 0)::bigint as cost, coalesce(e.a, '') as audit, sha256(coalesce(substr(e.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join told t on t.conv_id is not distinct from c.conv_id left join ends on ends.conv_id is not distinct from c.conv_id
"""
