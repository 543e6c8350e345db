"""Conversation structure repair by cost layers of grammar states.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials. Four states follow that grammar: nothing yet,
after s, after u, after a. For every turn, from the last to the first, a word of 64 bits has a nibble for each cost
layer: the states from which the rest can be repaired for that cost or less. Keeping, rerolling, deleting and inserting
are shifts and masks of the next turn's word. What the states of one turn cost differs by ten at most, as inserts lead
from any state to an accepting one, so the layers from the least cost on fit the word; the least cost itself is carried
beside it. The first layer that holds the start gives the cost,
and a walk forwards through the words, taking the least letter that loses nothing, gives the audit.

Two shuffles by conversation carry this. The first has a digest and a few flags of each row and ends in one audit for each
conversation; the second has the texts, sorted behind their audit, and hashes them as they stream by. A conversation
is one task's work, as one hash over all its text and one audit are asked for; the task holds some dozen bytes a row
of it, and never its texts.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import Scratch, trimmed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: By state, the state after u or a, of which each state takes one, and the role that leads there.
NEXT, ROLE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U), ("user", "user", "assistant", "user")
#: Conversations that go to Spark at once.
AT_ONCE = 1 << 12
_EACH, _FULL = 0x1111111111111111, 0xFFFFFFFFFFFFFFFF
#: A role's initial and the faults of a row, as one byte.
S, USER, ASSISTANT, OTHER = range(4)
DEAD, SHORT = 4, 8
NO_TURN = 16  # stands for a conversation that may have no turns
WHITE = " \t\n\x0b\x0c\r"


def _settled(w: int) -> tuple[int, int]:
    """A word with what inserts add, every layer with those below it, from the least cost on; and that cost."""
    for n in (1, 2, 4, 8):
        w |= w << 4 * n & _FULL
    for _ in range(2):  # no state needs more than two inserts
        w |= _before(w) << 4 * INSERT & _FULL
    least = _layer(w)
    return w >> 4 * least | (_FULL << 64 - 4 * least & _FULL), least  # the layers that come in hold every state


def _layer(w: int) -> int:
    """The first layer that is not empty."""
    return ((w & -w).bit_length() - 1) // 4


def _before_u(w: int) -> int:
    """In every layer the states from which u leads to one of the layer."""
    to = w >> AFTER_U & _EACH
    return to | to << AFTER_S | to << AFTER_A


def _before_a(w: int) -> int:
    return (w >> AFTER_A & _EACH) << AFTER_U


def _before(w: int) -> int:
    return _before_u(w) | _before_a(w)


@functools.cache
def _advance(w: int, code: int) -> tuple[int, int]:
    """(word, least cost added) of a turn before the word w; code is the turn's byte. Few words ever occur, so few are worked out."""
    stay = 0
    if not code & DEAD:
        keep = {USER: _before_u(w), ASSISTANT: _before_a(w), S: w >> AFTER_S & _EACH, OTHER: 0}[code & 3]
        stay = (keep | _before(w) << 4 * REROLE) << (4 * TRUNCATED if code & SHORT else 0)
    return _settled((stay | w << 4 * DELETE) & _FULL)


#: Behind the last turn, nothing yet and after a are accepted.
LAST = _settled(1 << NOTHING | 1 << AFTER_A)[0]


def _above(w: int, state: int) -> int:
    """The first layer of a word that holds a state."""
    return _layer(w >> state & _EACH)


def audit(code: bytes) -> tuple[int, str]:
    """(cost, least audit) of a conversation given by the bytes of its turns."""
    words, base = array("Q", [LAST]), array("q", [0])
    for c in reversed(code):
        w, least = _advance(words[-1], c)
        words.append(w)
        base.append(base[-1] + least)
    words.reverse()
    base.reverse()

    def rest(i: int, s: int) -> int:
        return base[i] + _above(words[i], s)

    state, at, out, n = NOTHING, 0, [], len(code)
    cost = left = rest(0, NOTHING)
    while at < n or left:
        c = code[at] if at < n else None
        if c is not None and DELETE + rest(at + 1, state) == left:
            out.append("D")
            at, left = at + 1, left - DELETE
            continue
        if INSERT + rest(at, NEXT[state]) == left:
            out.append("I")
            state, left = NEXT[state], left - INSERT
            continue
        more = TRUNCATED if c & SHORT else 0
        role = c & 3
        takes = {USER: state != AFTER_U, ASSISTANT: state == AFTER_U, S: state == NOTHING, OTHER: False}[role]
        after = AFTER_S if role == S else NEXT[state]
        if takes and KEEP + more + rest(at + 1, after) == left:
            out.append("K")
            state, left = after, left - KEEP - more
        else:
            out.append("R")
            state, left = NEXT[state], left - REROLE - more
        at += 1
    return cost, "".join(out)


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows, with code and same: the initial, faults of the row alone, and a digest of role and text.

    Null roles and texts become one space. Rows go by turn, nulls first, then by same.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
    first, end = F.substring("role", 1, 1), F.rtrim(F.col("text"), F.lit(WHITE))
    role = F.when(first == "s", S).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(end == "", DEAD).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(SHORT)
    same = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    return rows.select("*", (role + fault).cast("byte").alias("code"), same.alias("same"))


def _facts(turns: np.ndarray, known: np.ndarray, code: np.ndarray, same: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(the FACTS but the cost, bytes of turns with duplicates dead) of one conversation in order."""
    blank = code & DEAD > 0
    again = np.ones(len(code), bool)
    again[np.unique(same, return_index=True)[1]] = False
    again &= ~blank
    short = (code & SHORT > 0) & ~again
    role = code & 3
    a, b = role[:-1], role[1:]
    fine = ((a == S) & (b == USER)) | ((a == USER) & (b == ASSISTANT)) | ((a == ASSISTANT) & (b == USER))
    some = np.unique(turns[known])
    gaps = min(int(some[-1]) - int(some[0]) + 1 - len(some), (1 << 63) - 1) if len(some) else 0
    marked = role + np.where(blank | again, DEAD, 0) + np.where(short, SHORT, 0)
    return [gaps, int(blank.sum()), int(again.sum()), int(short.sum()), len(a) - int(fine.sum())], marked.astype(np.uint8)


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _changes(c: pa.Array) -> list[int]:
    """Where the values of a column change, 0 and its length included."""
    a, b = c.slice(0, len(c) - 1), c.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(~same) + 1).tolist(), len(c)]


@dataclass
class _Open:
    """What a task holds of the conversation at hand: turns, which are known, bytes, digests."""

    key: object
    parts: list[tuple[np.ndarray, ...]] = field(default_factory=list)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, FACTS, audit from sorted rows (conv_id, turn, code, same)."""
    now: _Open | None = None
    held: list[tuple] = []
    kind = None

    def close() -> None:
        if now is not None:
            facts, code = _facts(*[np.concatenate(c) for c in zip(*now.parts, strict=True)])
            held.append((now.key, *facts, *audit(code.tobytes())))

    def flush() -> pa.RecordBatch:
        kinds = (kind, *[pa.int64()] * len(FACTS), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *FACTS, "audit"])

    for b in batches:
        if not len(b):
            continue
        kind = b.schema.field(0).type
        known, turns = b.column(1).is_valid().to_numpy(zero_copy_only=False), b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        code, (raw, offs) = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), wh.strings(b.column(3))
        same, real = raw[offs[0] : offs[-1]].view("V16"), code != NO_TURN
        at = _changes(b.column(0))
        for i, j in zip(at[:-1], at[1:], strict=True):
            key, r = b.column(0)[i].as_py(), real[i:j]
            if now is None or key != now.key:
                close()
                now = _Open(key)
                if len(held) >= AT_ONCE:
                    yield flush()
            now.parts.append((turns[i:j][r], known[i:j][r], code[i:j][r], same[i:j][r]))
    close()
    if held:
        yield flush()


def plans(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, FACTS and audit of each conversation of rows(conv_id, turn, role, text), and of those of ids(conv_id) without a row; see repair()."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    small = flagged(rows).select("conv_id", "turn", "code", "same")
    if ids is not None:
        none = F.lit(b"\0" * 16)
        small = small.unionAll(ids.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long"), F.lit(NO_TURN).cast("byte"), none))
    dealt = small.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "same")
    return dealt.mapInArrow(trimmed(_audited), f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string")


class _Mender:
    """Turns of one conversation as its audit has them, fed in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield ROLE[self.state], "", "I"
            self.state, self.at = NEXT[self.state], self.at + 1

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield (ROLE[self.state] if edit == "R" else role), text, edit
            self.state = AFTER_S if edit == "K" and role[:1] == "s" else NEXT[self.state]


def _dealt(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Plans, and behind each the turns of its conversation in order, a conversation in one partition."""
    one = planned.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("same", "binary"))])
    two = flagged(rows).select("conv_id", *[F.lit(None).cast("long").alias(c) for c in FACTS], F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "same")
    both = one.unionAll(two).withColumn("_row", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_row", "turn", "same").drop("_row", "same")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    for b in batches:
        yield b, b.column("audit").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit, turn: the repaired turns of rows(conv_id, turn, role, text), numbered from 0 in each conversation.

    The edits are those of report(): K kept, R with another role, I inserted, which have no turn and an empty text.
    Null roles and texts count as one space. Rows go by turn, nulls first; rows of one turn by a digest of role and text,
    which puts repeated rows side by side. All rows without a conv_id are one conversation. Columns other than the four
    are ignored, and an empty table gives no rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    planned = Scratch(rows.sparkSession, "conversations").keep(plans(rows), "plans")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender, key, place = None, None, 0
        for b, audit, role, text in _rows(batches):
            out: list[tuple] = []
            keys, turns = b.column("conv_id").to_pylist(), b.column("turn").to_pylist()

            def put(found: Iterator, turn: int | None, out: list = out) -> None:
                nonlocal place
                for r, t, e in found:
                    out.append((key, place, r, t, e, None if e == "I" else turn))
                    place += 1

            for i, a in enumerate(audit):
                if a is not None:
                    if mender is not None:
                        put(mender.inserted(), None)
                    mender, key, place = _Mender(a), keys[i], 0
                else:
                    put(mender.turn(role[i], text[i]), turns[i])
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield _batch(columns, b.schema.field("conv_id").type)
        if mender is not None and (rest := list(mender.inserted())):
            yield _batch(zip(*[(key, place + n, r, t, e, None) for n, (r, t, e) in enumerate(rest)], strict=True), b.schema.field("conv_id").type)

    return _dealt(rows, planned).mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string, turn long")


def _batch(columns, kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "role", "text", "edit", "turn"])


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, FACTS, audit, repaired_sha256 of every conversation of rows, and of ids(conv_id), if given, those without a row too.

    gaps: turns missing between the least and the largest. A row's first fault counts: blank, duplicate (role and text
    seen before), truncated (no end mark). illegal: neighbouring roles that don't follow each other. cost and audit: the
    cheapest edits that give roles of the grammar, and of these the least by letters; repaired_sha256 is the digest of
    the repaired `role:text` lines. A conversation without rows has zeros, an empty audit and the digest of nothing.
    For nulls, ties, repeated rows and clashing columns see repair().
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    planned = Scratch(rows.sparkSession, "conversations").keep(plans(rows, ids), "plans")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender, digest, new, known = None, None, True, None

        def put(found: Iterator) -> None:
            nonlocal new
            for r, t, _ in found:
                digest.update(f"{'' if new else chr(10)}{r}:{t}".encode())
                new = False

        def close() -> pa.RecordBatch:
            put(mender.inserted())
            return pa.RecordBatch.from_arrays([*known.columns, pa.array([digest.hexdigest()])], names=[*known.schema.names, "repaired_sha256"])

        for b, audit, role, text in _rows(batches):
            done = []
            for i, a in enumerate(audit):
                if a is not None:
                    if mender is not None:
                        done.append(close())
                    mender, digest, new, known = _Mender(a), hashlib.sha256(), True, b.select(["conv_id", *FACTS, "audit"]).slice(i, 1)
                else:
                    put(mender.turn(role[i], text[i]))
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if mender is not None:
            yield close()

    return _dealt(rows, planned).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows, of which a fixed fifth is dropped, blanked, left without end marks, repeated or made the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("_fate")).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def damaged_report(rows: DataFrame) -> DataFrame:
    """report() of the damaged rows, for every conversation of the undamaged ones."""
    return report(damage(rows), rows.select("conv_id"))


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


def _oracle() -> str:
    """The same in SQL: damage, faults by windows, and the cheapest edits backwards over the turns, with cost, letters and lines of each state."""
    none = "{'c': 1000000000, 'a': '', 'r': ''}"
    edit = lambda cost, letter, line, to: f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {line} || {to}.r}}"
    insert = lambda s, of: edit(INSERT, "I", f"chr(10) || '{ROLE[s]}:'", f"{of}{NEXT[s]}")
    inserted = lambda of, to: ", ".join(f"{_least(f'{of}{s}', insert(s, of))} as {to}{s}" for s in range(4))

    def turn(s: int) -> str:
        more = f"case when short then {TRUNCATED} else 0 end"
        after = f"case when ini = 's' then f{AFTER_S} else f{NEXT[s]} end" if s == NOTHING else f"f{NEXT[s]}"
        takes = {NOTHING: "ini in ('s', 'u')", AFTER_S: "ini = 'u'", AFTER_U: "ini = 'a'", AFTER_A: "ini = 'u'"}[s]
        line = "chr(10) || role || ':' || body"
        keep = edit(f"{KEEP} + {more}", "K", line, f"({after})")
        rerole = edit(f"{REROLE} + {more}", "R", f"chr(10) || '{ROLE[s]}:' || body", f"f{NEXT[s]}")
        return _least(edit(DELETE, "D", "''", f"f{s}"), f"case when dead or not ({takes}) then {none} else {keep} end", f"case when dead then {none} else {rerole} end") + f" as h{s}"

    done = "{'c': 0, 'a': '', 'r': ''}"
    return f"""with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as body, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
fated as (
  select *, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda h: cast('0x' || h as bigint))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 as fate from raw, crc_table),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role, case when fate = 1 then '' when fate = 2 then translate(body, '.!?', '') else body end as body
  from fated cross join (select unnest([0, 1]) as copy) where fate <> 0 and (copy = 0 or fate = 3)),
placed as (
  select *, substr(role, 1, 1) as ini, rtrim(body, {_sql_text(WHITE)}) as trimmed,
         row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || ':' || body)) as i from damaged),
marked as (
  select *, trimmed = '' as blank, right(trimmed, 1) not in ('.', '!', '?') as open, row_number() over (partition by conv_id, role, body order by i) > 1 as again,
         lag(ini) over (partition by conv_id order by i) || ini as step, count(*) over (partition by conv_id) as n from placed),
faulty as (select *, blank or again as dead, not blank and not again and open as short from marked),
edits as (
  select conv_id, max(n) as i, {', '.join(f'{done if s in (NOTHING, AFTER_A) else none} as g{s}' for s in range(4))} from faulty group by conv_id
  union all
  select conv_id, i - 1, {', '.join(f'h{s}' for s in range(4))} from (
    select e.conv_id, e.i, {', '.join(turn(s) for s in range(4))}
    from (select conv_id, i, {inserted('k', 'f')} from (select conv_id, i, {inserted('g', 'k')} from edits)) e
    join faulty t on t.conv_id is not distinct from e.conv_id and t.i = e.i)),
best as (select conv_id, f0 as b from (select conv_id, {inserted('k', 'f')} from (select conv_id, {inserted('g', 'k')} from edits where i = 0))),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
         count(*) filter (short) as truncated, count(*) filter (step is not null and step not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id)
select i.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
       cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(b.c, 0) as bigint) as cost, coalesce(b.a, '') as audit, sha256(coalesce(substr(b.r, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join facts f on f.conv_id is not distinct from i.conv_id left join best on best.conv_id is not distinct from i.conv_id"""


def _sql_text(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


ORACLE = _oracle()
