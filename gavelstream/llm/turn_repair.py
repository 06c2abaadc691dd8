"""Structure repair of conversations by iterative-deepening A*.

A conversation's rows become codes: which role, and which fault. The cheapest edits that give the legal order of roles
are searched depth first, in the order of the edits' initials, under a cost bound that rises to the least cost
that is still possible; the first accepting path is the answer. What a failed state was found to cost at least is kept
in a transposition table, which is also where the next bound comes from. Long conversations are searched from the end
in stretches of rows, whose table then holds exact costs, so that the work grows with the rows.

One task goes through a conversation's rows in order and holds a byte for each of them, not their texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import SPACES, Rows, key_runs

#: What the edits cost, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = ("user", "assistant")
#: Rows in a stretch.
STRETCH = 64
#: Short conversations whose edits a task keeps for the next one alike.
REMEMBERED = 50_000

# states: nothing yet, after a system row, after a user row, after an assistant row
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEPT = {(_NOTHING, "s"): _SYSTEM, (_NOTHING, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_MADE = (_USER, _USER, _ASSISTANT, _USER)
_ACCEPTED = (_NOTHING, _ASSISTANT)
_INITIALS = "sua?"
_GONE = 8  # code of a row that has to go; else the initial's place, and 4 more if truncated


def _moves(code: int | None, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """Edits in the order of their initials: (initial, cost, rows they use up, next state)."""
    found = [("D", DELETE, 1, state)] if code is not None else []
    found.append(("I", INSERT, 0, _MADE[state]))
    if code is not None and code != _GONE:
        more = TRUNCATED * (code >= 4)
        if (state, _INITIALS[code % 4]) in _KEPT:
            found.append(("K", more, 1, _KEPT[state, _INITIALS[code % 4]]))
        found.append(("R", REROLE + more, 1, _MADE[state]))
    return tuple(found)


_MOVES = tuple(tuple(_moves(code, state) for state in range(4)) for code in range(_GONE + 1))
_AT_END = tuple(_moves(None, state) for state in range(4))
#: What a row costs at least, whatever the state.
_LEAST = tuple(min(cost for state in range(4) for edit, cost, used, _ in _MOVES[code][state] if used) for code in range(_GONE + 1))


def _search(codes: bytes, low: array, place: int, state: int, goal: int) -> str | None:
    """The first path in edit order from ``place`` to ``goal`` within the least cost known; raises ``low`` where there is none.

    ``low[4 * place + state]`` is what the rest costs at least. From ``goal`` on, if that isn't the end, it is exact.
    """
    n = len(codes)
    edits: list[str] = []
    left = low[4 * place + state]
    stack = [[place, state, left, 0]]
    while stack:
        at = stack[-1]
        place, state, left, tried = at
        if place == goal and not tried and (goal < n or state in _ACCEPTED):
            return "".join(edits)
        moves = _MOVES[codes[place]][state] if place < n else _AT_END[state]
        while tried < len(moves):
            edit, cost, used, after = moves[tried]
            tried += 1
            if cost + low[4 * (place + used) + after] <= left:
                at[3] = tried
                edits.append(edit)
                stack.append([place + used, after, left - cost, 0])
                break
        else:
            node = 4 * place + state
            low[node] = max(low[node], min(cost + low[4 * (place + used) + after] for _, cost, used, after in moves))
            stack.pop()
            if edits:
                edits.pop()
    return None


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a conversation; of several the least string.

    A row's code is its role's place among system, user, assistant and others, 4 more if it is truncated, and 8 if it has to go.
    """
    n = len(codes)
    low = array("q", bytes(32 * (n + 1)))
    rest = 0
    for place in range(n - 1, -1, -1):
        rest += _LEAST[codes[place]]
        low[4 * place:4 * place + 4] = array("q", (rest,) * 4)
    path, goal = None, n
    place = (n - 1) // STRETCH * STRETCH if n else 0
    while place:
        for state in range(4):
            while _search(codes, low, place, state, goal) is None:
                pass
        goal, place = place, place - STRETCH
    while path is None:
        path = _search(codes, low, 0, _NOTHING, goal)
    if goal < n:
        # the costs from here on are exact: go through to the end
        path = _search(codes, low, 0, _NOTHING, n)
    return low[0], path


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, turn, role, digest, text``; nulls of role and text are one space."""
    picked = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                         F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    return picked.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "digest")


def audit(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row per conversation of ``rows``.

    Rows count in the order of their turn, nulls first, and those of one turn by role and then by their text's SHA-256. A null role or
    text is one space, a null ``conv_col`` a conversation like any other; an empty role is neither user, assistant nor system.
    A row's first fault counts: blank, duplicate (same role and text earlier), truncated (not ended by one of ``.!?``).
    ``illegal`` are neighbours whose roles' initials don't follow one another, ``gaps`` missing numbers between
    the least and greatest turn. ``audit`` has an initial for each edit (keep, rerole, delete, insert). Other columns play no part.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    rows = _ordered(rows, conv_col, turn_col, role_col, text_col)
    tail = F.right(F.rtrim(F.col("text"), F.lit(SPACES.decode())), F.lit(1))
    # copies within a turn and rows without their texts, before anything is brought together
    small = (rows.withColumn("end", F.when(tail == "", "blank").when(~tail.isin(".", "!", "?"), "cut").otherwise("whole"))
             .groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("end").alias("end")))
    earliest = (small.groupBy("conv_id", "role", "digest")
                .agg(F.min(F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))).alias("first"))
                .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.b").alias("first")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    small = small.join(earliest, same).select(
        "conv_id", "turn", "role", "digest", F.left("role", F.lit(1)).alias("initial"), "n", "end",
        F.col("turn").eqNullSafe(F.col("first")).alias("new"))

    return _in_order(small).mapInArrow(_audits, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    def __init__(self) -> None:
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns = 0
        self.least = self.last_turn = None
        self.last = ""

    def add(self, turn: int | None, initial: str, n: int, end: str, new: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        # the first of the copies may be new, the others aren't
        repeats = n if not new else n - 1
        if end == "blank":
            self.blank += n
        else:
            self.duplicate += repeats
            self.truncated += n > repeats and end == "cut"
        if end == "blank" or not new:
            self.codes += bytes([_GONE]) * n
        else:
            known = _INITIALS.find(initial) if initial else -1
            self.codes.append((known if 0 <= known < 3 else 3) + 4 * (end == "cut"))
            self.codes += bytes([_GONE]) * (n - 1)
        if self.last is not None and len(self.codes) > n:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += n - 1  # no initial may follow itself
        self.last = initial

    def result(self, known: dict[bytes, tuple[int, str]]) -> tuple:
        codes = bytes(self.codes)
        cost, edits = known.get(codes) or cheapest(codes)
        if len(codes) <= STRETCH and len(known) < REMEMBERED:
            known[codes] = cost, edits
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.turns
        return min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, cost, edits


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, now, key, known = None, None, None, {}
    for key_now, begins, part in key_runs(batches, "conv_id"):
        out = out or Rows(pa.schema([part.schema.field("conv_id"), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())]))
        if begins:
            if now is not None:
                yield from out.add(key, *now.result(known))
            now, key = _Conversation(), key_now
        for row in zip(*(part.column(c).to_pylist() for c in ("turn", "initial", "n", "end", "new")), strict=True):
            now.add(*row)
    if now is not None:
        yield from out.add(key, *now.result(known))
        yield from out.rest()


def repaired(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``conv_id, place, role, text``: the conversations after the edits of ``audits``.

    ``place`` counts from 0. A conversation's rows stand in one partition, in order; one of which nothing is left has no rows.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    given = _ordered(rows, conv_col, turn_col, role_col, text_col).withColumn("audit", F.lit(None).cast("string"))
    edits = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
                          F.lit(None).cast("binary").alias("digest"), "audit")
    both = given.unionByName(edits).withColumn("given", F.col("audit").isNull())
    return _in_order(both, "given").mapInArrow(_edited, f"conv_id {kind}, place long, role string, text string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, key, edits, at, place, state = None, None, "", 0, 0, _NOTHING

    def insert() -> Iterator[pa.RecordBatch]:
        nonlocal at, place, state
        while at < len(edits) and edits[at] == "I":
            state = _MADE[state]
            yield from out.add(key, place, ROLES[state - _USER], "")
            at, place = at + 1, place + 1

    for key_now, begins, part in key_runs(batches, "conv_id"):
        out = out or Rows(pa.schema([part.schema.field("conv_id"), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
        if begins:
            yield from insert()
            key, at, place, state = key_now, 0, 0, _NOTHING
        for role, text, found in zip(*(part.column(c).to_pylist() for c in ("role", "text", "audit")), strict=True):
            if found is not None:
                edits = found
                continue
            yield from insert()
            edit = edits[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = _MADE[state]
                role = ROLES[state - _USER]
            else:
                state = _KEPT[state, role[0]]
            yield from out.add(key, place, role, text)
            place += 1
    if out is not None:
        yield from insert()
        yield from out.rest()


def digest(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of conversations in order (``repaired``): of ``role:text`` joined by line ends."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, sha = None, None, None
        for key_now, begins, part in key_runs(batches, "conv_id"):
            out = out or Rows(pa.schema([part.schema.field("conv_id"), ("repaired_sha256", pa.string())]))
            if begins:
                if sha is not None:
                    yield from out.add(key, sha.hexdigest())
                key, sha = key_now, hashlib.sha256()
            for place, role, text in zip(*(part.column(c).to_pylist() for c in ("place", "role", "text")), strict=True):
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if sha is not None:
            yield from out.add(key, sha.hexdigest())
            yield from out.rest()

    return turns.mapInArrow(hashed, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
