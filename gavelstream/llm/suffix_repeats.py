"""Repeated byte strings by a difference-cover sample of the suffixes.

Only whether two suffixes agree in their first ``length`` bytes matters, not which comes first, so a name is a
64-bit hash of a prefix and a sort brings equal names together.

1. Suffixes that start at a difference cover modulo ``period`` are sampled. Whatever two places agree in ``length`` bytes,
   some offset under ``period`` is in the sample at both. The names of the sampled short tuples are sorted;
   a tuple without an equal neighbour is in no repeat.
2. Recursion on those that have one: names of longer tuples around the sampled suffix, one for each part of the window
   that may lie before it.
3. The remaining suffixes, those whose window reaches such a tuple, are merged in with their full names, and
   neighbours in sorted order are compared: equal ones are repeats.

Texts travel in slices of about a MB; a sort partition is asked about a slice's names with one packed row
and answers with one bit each. Texts that occur several times as a whole are taken once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import LARGE_ROWS, mixed, slices, text_of, written

LENGTH = 400
#: A perfect difference set; every residue modulo 273 is a difference of two of them.
PERIOD = 273
COVER = (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256)
#: Parts in which the second round looks at where a window may begin.
PARTS = 4
SLICE = 1 << 20
#: Names that one sort partition holds on average.
SORTED_NAMES = 1 << 20

_SLICE_SCHEMA = "slice long, keys array<string>, starts array<long>, offsets array<long>, marks array<long>, data binary"


@dataclass(frozen=True)
class Plan:
    """How repeats of ``length`` bytes are sampled."""

    length: int
    period: int
    cover: tuple[int, ...]

    @property
    def short(self) -> int:
        """Bytes of a tuple of the first round: what two windows share from their common sampled place on, at least."""
        return self.length - self.period + 1

    @property
    def step(self) -> int:
        return -(-self.period // PARTS)

    @property
    def long(self) -> int:
        return self.length - self.step + 1

    @property
    def piece(self) -> int:
        """Bytes of a longer text that go into one slice, a multiple of the period."""
        return max(1, SLICE // self.period) * self.period


def plan_for(length: int) -> Plan:
    if length < 2:
        raise ValueError("length: 2 bytes or more")
    if length >= PERIOD + 64:
        return Plan(length, PERIOD, COVER)
    period = max(1, 2 * length // 3)
    root = max(1, int(period ** 0.5))
    return Plan(length, period, tuple(sorted({*range(min(root, period)), *range(0, period, root)})))


@dataclass
class Slice:
    """Pieces of texts one after another; ``marks`` are positions in ``data``."""

    number: int
    keys: list[str]
    starts: np.ndarray
    offsets: np.ndarray
    marks: np.ndarray
    data: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch, i: int) -> Slice:
        starts, offsets, marks = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "offsets", "marks"))
        return Slice(batch.column("slice")[i].as_py(), batch.column("keys")[i].as_py(), starts, offsets, marks,
                     np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8))

    def piece_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


def _batch(parts: list[Slice]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([p.number for p in parts], pa.int64()), pa.array([p.keys for p in parts], pa.list_(pa.string())),
         *(pa.array([getattr(p, c) for p in parts], longs) for c in ("starts", "offsets", "marks")),
         pa.array([p.data.tobytes() for p in parts], pa.binary())],
        ["slice", "keys", "starts", "offsets", "marks", "data"])


class Names:
    """Names of byte windows, by prefix sums of a polynomial hash."""

    def __init__(self) -> None:
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            self.power, self.inverse = (np.full(n, np.uint64(b)) for b in (self.base, pow(self.base, -1, 1 << 64)))
            for p in (self.power, self.inverse):
                p[0] = 1
                np.multiply.accumulate(p, out=p)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[:len(data)], out=sums[1:])
        return sums

    def at(self, sums: np.ndarray, where: np.ndarray, length: int, salt: np.ndarray | int = 0) -> np.ndarray:
        name = (sums[where + length] - sums[where]) * self.inverse[where]
        return mixed(name + np.asarray(salt, np.uint64) * np.uint64(0xD1342543DE82EF95))


def _spread(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Positions under ``n`` that lie in one of the ranges from ``low`` up to but without ``high``."""
    edge = np.zeros(n + 1, np.int32)
    keep = high > low
    np.add.at(edge, low[keep], 1)
    np.add.at(edge, high[keep], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


# what each round asks of a slice: positions, and their names

def _sampled(s: Slice, plan: Plan, names: Names) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(s.offsets)
    longest = int(sizes.max(initial=0))
    grid = (np.arange(0, longest + plan.period, plan.period)[:, None] + np.array(plan.cover)).ravel()
    upto = np.searchsorted(grid, sizes - plan.short, "right")
    at = np.concatenate([o + grid[:k] for o, k in zip(s.offsets.tolist(), upto.tolist(), strict=False)] or [grid[:0]])
    return at, names.at(names.prefixes(s.data), at, plan.short)


def _around(s: Slice, plan: Plan, names: Names) -> tuple[np.ndarray, np.ndarray]:
    part = np.tile(np.arange(PARTS), len(s.marks))
    at = np.repeat(s.marks, PARTS) - part * plan.step
    piece = s.piece_of(np.repeat(s.marks, PARTS))
    fits = (at >= s.offsets[piece]) & (at + plan.long <= s.offsets[piece + 1])
    at, part = at[fits], part[fits]
    return at, names.at(names.prefixes(s.data), at, plan.long, part)


def _windows(s: Slice, plan: Plan, names: Names) -> tuple[np.ndarray, np.ndarray]:
    return s.marks, names.at(names.prefixes(s.data), s.marks, plan.length)


_Ask = Callable[[Slice, Plan, Names], tuple[np.ndarray, np.ndarray]]


def _answered(table: DataFrame, ask: _Ask, plan: Plan, n_names: int, use: Callable[[Slice, np.ndarray], list], schema: str,
              pack: Callable[[list], pa.RecordBatch]) -> DataFrame:
    """One round: each slice asks for its names; ``use`` gets the positions whose name is also anywhere else."""
    bits = max(0, min(40, (n_names // SORTED_NAMES).bit_length()))
    shift = np.uint64(64 - bits) if bits else None

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice.read(batch, i)
                name = np.unique(ask(s, plan, names)[1])
                part = (name >> shift).astype(np.int64) if bits else np.zeros(len(name), np.int64)
                first = np.flatnonzero(np.diff(part, prepend=-1))
                ends = [*first[1:].tolist(), len(name)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[first]), pa.array([s.number] * len(first), pa.int64()),
                     pa.array([name[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=False)], pa.binary())],
                    ["part", "slice", "names"])

    def sort(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(b, np.uint64) for b in table.column("names").to_pylist()]
        name = np.concatenate(found)
        order = np.argsort(name)
        name = name[order]
        equal = np.zeros(len(name) + 1, bool)
        equal[1:-1] = name[1:] == name[:-1]
        met = np.zeros(len(name), bool)
        met[order] = equal[1:] | equal[:-1]
        ends = np.cumsum([len(f) for f in found])
        return pa.table({"slice": table.column("slice"), "part": table.column("part"),
                         "met": pa.array([np.packbits(m).tobytes() for m in np.split(met, ends[:-1])], pa.binary())})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice.read(batch, i)
                at, name = ask(s, plan, names)
                unique, which, count = np.unique(name, return_inverse=True, return_counts=True)
                met = count > 1
                part = (unique >> shift).astype(np.int64) if bits else np.zeros(len(unique), np.int64)
                for answer in batch.column("answers")[i].as_py() or ():
                    a, b = np.searchsorted(part, [answer["part"], answer["part"] + 1])
                    met[a:b] |= np.unpackbits(np.frombuffer(answer["met"], np.uint8), count=b - a).astype(bool)
                if out := use(s, at[met[which]]):
                    yield pack(out)

    answers = (table.mapInArrow(asked, "part long, slice long, names binary")
               .groupBy("part").applyInArrow(sort, "slice long, part long, met binary")
               .groupBy("slice").agg(F.collect_list(F.struct("part", "met")).alias("answers")))
    return table.join(answers, "slice", "left").mapInArrow(apply, schema)


def _pack_texts(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    none = np.empty(0, np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, starts, ends, held = [], [], [0], []

        def done() -> pa.RecordBatch:
            return _batch([Slice(number, keys, np.array(starts), np.array(ends), none, np.frombuffer(b"".join(held), np.uint8))])

        for batch in batches:
            for part in slices(batch, "data"):
                for key, data in zip(part.column("key").to_pylist(), part.column("data"), strict=True):
                    data = memoryview(data.as_buffer())
                    for start in range(0, len(data) - plan.length + 1, plan.piece):
                        piece = data[start:start + plan.piece + plan.length - 1]
                        keys.append(key)
                        starts.append(start)
                        ends.append(ends[-1] + len(piece))
                        held.append(piece)
                        if ends[-1] >= SLICE:
                            yield done()
                            number += 1
                            keys, starts, ends, held = [], [], [0], []
        if keys:
            yield done()

    return pack


def _regions(plan: Plan) -> Callable[[Slice, np.ndarray], list[Slice]]:
    """Cuts a slice down to the bytes that a window over a met sampled place can have; the places are the new marks."""
    def cut(s: Slice, met: np.ndarray) -> list[Slice]:
        if not len(met):
            return []
        met = np.sort(met)
        piece = s.piece_of(met)
        inside = _spread(np.maximum(met - plan.period + 1, s.offsets[piece]), np.minimum(met + plan.length, s.offsets[piece + 1]), len(s.data))
        first = np.flatnonzero((np.diff(inside, prepend=-2) > 1) | np.isin(inside, s.offsets[1:-1]))
        offsets = np.append(first, len(inside))
        of = s.piece_of(inside[first])
        return [Slice(s.number, [s.keys[p] for p in of.tolist()], s.starts[of] + inside[first] - s.offsets[of], offsets,
                      np.searchsorted(inside, met), s.data[inside])]

    return cut


def _candidates(plan: Plan) -> Callable[[Slice, np.ndarray], list[Slice]]:
    """Marks the windows that hold a met longer tuple where the second round put it."""
    def mark(s: Slice, met: np.ndarray) -> list[Slice]:
        if not len(met):
            return []
        piece = s.piece_of(met)
        low = np.maximum(met - plan.step + 1, s.offsets[piece])
        s.marks = _spread(low, np.minimum(met, s.offsets[piece + 1] - plan.length) + 1, len(s.data))
        return [s] if len(s.marks) else []

    return mark


def _covered(plan: Plan) -> Callable[[Slice, np.ndarray], list[tuple[str, int, int]]]:
    def cover(s: Slice, met: np.ndarray) -> list[tuple[str, int, int]]:
        if not len(met):
            return []
        met = np.sort(met)
        piece = s.piece_of(met)
        opens = np.flatnonzero((np.diff(met, prepend=-plan.length - 1) > plan.length) | (np.diff(piece, prepend=-1) > 0))
        closes = np.append(opens[1:], len(met)) - 1
        shift = s.starts[piece[opens]] - s.offsets[piece[opens]]
        return list(zip((s.keys[p] for p in piece[opens].tolist()), (met[opens] + shift).tolist(),
                        (met[closes] + plan.length + shift).tolist(), strict=True))

    return cover


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key, start, end``: byte ranges of the distinct texts (``key, data``) that hold a repeat; some may overlap or touch."""
    plan = plan_for(length)
    table = written(texts.select("key", "data").mapInArrow(_pack_texts(plan), _SLICE_SCHEMA), "repeat-slices", LARGE_ROWS)
    total = table.agg(F.sum(F.length("data"))).first()[0] or 0

    def count(table: DataFrame) -> int:
        return table.agg(F.sum(F.size("marks"))).first()[0] or 0

    table = written(_answered(table, _sampled, plan, total * len(plan.cover) // plan.period, _regions(plan), _SLICE_SCHEMA, _batch),
                    "repeat-regions", LARGE_ROWS)
    table = written(_answered(table, _around, plan, count(table) * PARTS, _candidates(plan), _SLICE_SCHEMA, _batch), "repeat-windows",
                    LARGE_ROWS)

    def rows(found: list[tuple[str, int, int]]) -> pa.RecordBatch:
        key, start, end = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                                          ["key", "start", "end"])

    return _answered(table, _windows, plan, count(table), _covered(plan), "key string, start long, end long", rows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``, one row per row of ``docs``.

    ``spans`` are the maximal runs of bytes (UTF-8, end exclusive) covered by strings of ``length`` bytes that also start anywhere
    else, in the same text or another, judged on the input; ``kept`` are the remaining bytes. A null text is empty; texts
    shorter than ``length`` stay whole; of repeated rows and copies of a text nothing stays. Other columns play no part.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("key"), text.cast("binary").alias("data"))
    long = rows.where(F.length("data") >= length)
    copies = long.groupBy("key").agg(F.count("*").alias("copies"))
    spans = (repeated_spans(long.dropDuplicates(["key"]), length)
             .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    found = written(copies.join(spans, "key", "left").where("copies > 1 OR spans IS NOT NULL"), "repeat-spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "data"):
                sizes, all_spans, kept = [], [], []
                for data, copies, spans in zip(*(part.column(c).to_pylist() for c in ("data", "copies", "spans")), strict=True):
                    runs: list[dict] = []
                    for s in ([{"start": 0, "end": len(data)}] if (copies or 0) > 1 else spans or ()):
                        if runs and s["start"] <= runs[-1]["end"]:
                            runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                        else:
                            runs.append(dict(s))
                    ends = [0, *(r["end"] for r in runs)]
                    sizes.append(len(data))
                    all_spans.append(runs)
                    kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(r["start"] for r in runs), len(data)], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(all_spans, span), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"])

    return rows.join(found, "key", "left").drop("key").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
