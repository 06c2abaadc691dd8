"""Chat formatting by incremental black-box rendering.

Nothing is known of a template but what it renders. Each turn's prefix of the conversation is rendered, and the turn's span
is what the output has more than that of the prefix before; where the output before is not its beginning, the template rewrites
history. Where a turn's text stands in its span is found by two renderings of the turn with probes as its text.

One task goes through a conversation's turns in order. It holds at most twice as many turns as the template looks back, and a
turn's span goes out as soon as it is known; the formatted conversation is its spans, one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import Rows, key_runs

Turn = tuple[str, str]
_PROBES = ("0", "1")


@dataclass(frozen=True)
class Template:
    """How a conversation is rendered, given its turns so far (role, text).

    How a turn comes out may depend on ``looks_back`` turns before it; None: on all of them, which are then held
    and rendered again for each turn.
    """

    render: Callable[[list[Turn]], str]
    looks_back: int | None = None


#: What the instruction template writes around texts; none of it is left in a text, or in the name of a role.
OPENS, SYSTEM, END_SYSTEM, USER, END_USER = "<s>", "[SYS]", "[/SYS]", "[INST] ", " [/INST]"
ASSISTANT, END_ASSISTANT, OTHER, END_OTHER = " ", "</s>", "[TURN]", "[/TURN]"
_AROUND = {"system": (SYSTEM, END_SYSTEM), "user": (USER, END_USER), "assistant": (ASSISTANT, END_ASSISTANT)}
_CONTROL = r"<(?=\\*/?s>)|\[(?=\\*/?(?:INST|SYS|TURN)\])"
_ESCAPED = r"<\\(?=\\*/?s>)|\[\\(?=\\*/?(?:INST|SYS|TURN)\])"


def escaped(text: str) -> str:
    """``text`` with one backslash more behind the first sign of every control string, escaped ones too."""
    return re.sub(_CONTROL, lambda m: m[0] + "\\", text)


def unescaped(text: str) -> str:
    return re.sub(_ESCAPED, lambda m: m[0][0], text)


def _instructed(turns: list[Turn]) -> str:
    out = [OPENS]
    for role, text in turns:
        before, after = _AROUND.get(role) or (OTHER + escaped(role) + OTHER, END_OTHER)
        out += (before, escaped(text), after)
    return "".join(out)


#: The instruction template. Conversations of up to 64 turns are rendered from their beginning.
INSTRUCTIONS = Template(_instructed, 64)


class Reader:
    """Reads turns back from the instruction template's output, which may come in pieces."""

    def __init__(self) -> None:
        self.rest, self.begun = "", False

    def read(self, piece: str) -> list[Turn]:
        """The turns that end with this piece."""
        text, found, at = self.rest + piece, [], 0
        if not self.begun:
            if not text.startswith(OPENS[:len(text)]):
                raise ValueError("not what the instruction template writes")
            self.begun = len(text) >= len(OPENS)
            at = len(OPENS) * self.begun
        while self.begun and at < len(text):
            role, start, end = self._turn(text, at)
            if end < 0:
                break
            found.append((role, unescaped(text[start:end])))
            at = end + len(_AROUND[role][1] if role in _AROUND else END_OTHER)
        self.rest = text[at:]
        return found

    @staticmethod
    def _turn(text: str, at: int) -> tuple[str, int, int]:
        for role, (before, after) in _AROUND.items():
            if text.startswith(before, at):
                return role, at + len(before), text.find(after, at + len(before))
        middle = text.find(OTHER, at + len(OTHER))
        if not text.startswith(OTHER, at) or middle < 0:
            return "", at, -1
        return unescaped(text[at + len(OTHER):middle]), middle + len(OTHER), text.find(END_OTHER, middle + len(OTHER))


class _Rendering:
    """One conversation, turn by turn."""

    def __init__(self, template: Template, loss_roles: Collection[str]):
        self.template, self.loss_roles = template, loss_roles
        self.turns: list[Turn] = []
        self.before = template.render([])
        self.number = self.at = 0
        self.rewritten = False

    def add(self, role: str, text: str) -> tuple:
        """(place, role, piece, start, end, text_start, text_end, in_loss, rewritten)"""
        place, self.number = self.number, self.number + 1
        back = self.template.looks_back
        if back is not None and len(self.turns) > 2 * back:
            self.turns = self.turns[len(self.turns) - back:]
            self.before = self.template.render(self.turns)
        output = self.template.render([*self.turns, (role, text)])
        # what a template writes when there is no turn yet belongs to the first one
        known = self.before if place else ""
        self.rewritten |= not output.startswith(self.before)
        if self.rewritten:
            return place, role, None, None, None, None, None, False, True
        inside = self._inside(role, output, len(known))
        start, shift = self.at, self.at - len(known)
        self.turns.append((role, text))
        self.before = output
        self.at = shift + len(output)
        text_start, text_end = (None, None) if inside is None else (inside[0] + shift, inside[1] + shift)
        return (place, role, output[len(known):], start, self.at, text_start, text_end,
                inside is not None and role in self.loss_roles, False)

    def _inside(self, role: str, output: str, least: int) -> tuple[int, int] | None:
        """Where the turn's text is in the output: between what two other texts in its place have in common."""
        one, other = (self.template.render([*self.turns, (role, probe)]) for probe in _PROBES)
        if one == other or len(one) != len(other):
            return None
        first = self._differ(one, other)
        tail = len(one) - first - 1
        end = len(output) - tail
        fits = least <= first <= end and output.startswith(one[:first]) and output.endswith(one[first + 1:])
        return (first, end) if fits and one[first + 1:] == other[first + 1:] else None

    @staticmethod
    def _differ(one: str, other: str) -> int:
        """The first place at which two texts of one length differ, by halves."""
        low, high = 0, len(one)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if one[low:middle] == other[low:middle] else (low, middle)
        return low


_PIECES = (("place", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
           ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_()), ("rewritten", pa.bool_()))


def formatted(rows: DataFrame, template: Template = INSTRUCTIONS, loss_roles: Collection[str] = ("assistant",), conv_col: str = "conv_id",
              turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, role, piece, start, end, text_start, text_end, in_loss, rewritten``, one row per row of ``rows``.

    A conversation's turns count in the order of ``turn_col``, nulls first, those of one turn by role and text; its rows stand in one
    partition in order, ``place`` counting from 0, and its formatted text is all ``piece`` joined. Spans are in code points of that
    text; the turn's own text, as the template wrote it, is from ``text_start`` to ``text_end`` (null where the template does not
    write the text as it is given), and under the loss mask if ``in_loss``. From the turn at which the template changes what it wrote before,
    ``rewritten`` is true and there are no pieces; the ones before are as they were. Null roles and texts are empty, a null
    ``conv_col`` is a conversation like any other, repeated rows are turns of their own, and other columns play no part.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    loss_roles = frozenset(loss_roles)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = None, None
        for key, begins, part in key_runs(batches, "conv_id"):
            out = out or Rows(pa.schema([part.schema.field("conv_id"), *_PIECES]))
            if begins:
                now = _Rendering(template, loss_roles)
            for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                yield from out.add(key, *now.add(role, text))
        if out is not None:
            yield from out.rest()

    picked = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                         *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))))
    return (picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(render, f"conv_id {kind}, place long, role string, piece string, start long, end long, text_start long, "
                                "text_end long, in_loss boolean, rewritten boolean"))


def read_back(pieces: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read from what ``formatted`` wrote.

    The turns are read from the formatted text alone (``role, \\n, text, \\n`` of each is hashed), what the loss is taken of from the
    mask. It reads the instruction template's output, in the partitions in which ``formatted`` leaves it.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, held = None, None, None
        for key_now, begins, part in key_runs(batches, "conv_id"):
            out = out or Rows(pa.schema([part.schema.field("conv_id"), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                         ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
            if begins:
                if held is not None:
                    yield from out.add(key, *held.result())
                key, held = key_now, _Read()
            for row in zip(*(part.column(c).to_pylist() for c in ("piece", "start", "text_start", "text_end", "in_loss")), strict=True):
                held.add(*row)
        if held is not None:
            yield from out.add(key, *held.result())
            yield from out.rest()

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                   "formatted_chars long")


class _Read:
    def __init__(self) -> None:
        self.reader, self.turns, self.loss = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, piece: str, start: int, text_start: int, text_end: int, in_loss: bool) -> None:
        self.chars += len(piece)
        for role, text in self.reader.read(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if in_loss:
            text = unescaped(piece[text_start - start:text_end - start])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def result(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
