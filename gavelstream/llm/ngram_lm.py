"""Stupid-backoff scores from n-gram counts of the corpus itself.

Texts travel in slices of a few MB. For each order a slice sends its distinct n-grams with their counts to the
count table, which is partitioned by the n-grams' hash; every partition sums what it gets and returns the
totals to the slices that asked. A slice then joins the totals to its exploded n-grams, backs off
where a table has no entry, and sums per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import LARGE_ROWS, SPACES, ascii_lower, byte_set, mixed, run_hashes, runs, slices, text_of, written

ORDER, CUTOFF, BACKOFF = 3, 2, 0.4
SLICE = 4 << 20
#: n-grams that one partition of a count table gets on average.
TABLE_NGRAMS = 1 << 20

_SPACE = byte_set(SPACES)


def _pieces(data: bytes, context: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about ``SLICE`` bytes, cut at white space; each but the first repeats ``context`` words as its beginning."""
    start = skip = upto = 0
    while True:
        upto += SLICE
        while upto < len(data) and data[upto] not in SPACES:
            upto += 1
        yield data[start:upto], skip
        if upto >= len(data):
            return
        start, skip = upto, 0
        while skip < context:
            at = start
            while at and data[at - 1] in SPACES:
                at -= 1
            if not at:
                break
            while at and data[at - 1] not in SPACES:
                at -= 1
            start, skip = at, skip + 1


def _pack(context: int, id_type: pa.DataType):
    schema = pa.schema([("slice", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(id_type)),
                        ("skips", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("texts", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            rows, ids, skips, texts = (list(c) for c in zip(*held, strict=True))
            offsets = [0, *accumulate(map(len, texts))]
            packed = zstandard.ZstdCompressor().compress(b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((number, rows, ids, skips, offsets, packed), schema, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch, "data"):
                for doc_id, data in zip(part.column("doc_id").to_pylist(), part.column("data").to_pylist(), strict=True):
                    for piece, skip in _pieces(data, context):
                        held.append((row, doc_id, skip, piece))
                        size += len(piece)
                        if size >= SLICE:
                            yield done()
                            number, held, size = number + 1, [], 0
                    row += 1
        if held:
            yield done()

    return pack


class _Words:
    """The words of a slice: hash, place in its piece, piece, and whether they are the piece's own."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, skips: np.ndarray) -> None:
        data = ascii_lower(data)
        starts, ends, first = runs(~_SPACE[data], offsets)
        self.hash = run_hashes(data, starts, ends)
        counts = np.diff(first)
        self.first = first
        self.piece = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.hash)) - first[self.piece]
        self.own = self.place >= skips[self.piece]

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Where an n-gram of ``order`` ends, and its hash."""
        at = np.flatnonzero(self.place >= order - 1)
        value = np.full(len(at), np.uint64(order))
        for back in range(order - 1, -1, -1):
            value = value * np.uint64(0x9E3779B97F4A7C15) + self.hash[at - back]
        return at, mixed(value)


def _parts(names: np.ndarray, bits: int) -> np.ndarray:
    return (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)


def _read(batch: pa.RecordBatch, i: int) -> _Words:
    data = zstandard.ZstdDecompressor().decompress(batch.column("texts")[i].as_py())
    return _Words(np.frombuffer(data, np.uint8), batch.column("offsets")[i].values.to_numpy(), batch.column("skips")[i].values.to_numpy())


def count_table(table: DataFrame, order: int, bits: int) -> DataFrame:
    """``slice, part, counts``: for each slice's distinct n-grams of a partition, by hash, how often the corpus has them.

    Counts are packed, for most are small.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = _read(batch, i)
                at, name = words.grams(order)
                name, which = np.unique(name, return_inverse=True)
                count = np.bincount(which, words.own[at], minlength=len(name)).astype(np.uint32)
                part = _parts(name, bits)
                first = np.flatnonzero(np.diff(part, prepend=-1))
                ranges = list(zip(first.tolist(), [*first[1:].tolist(), len(name)], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[first]), pa.array([batch.column("slice")[i].as_py()] * len(first), pa.int64()),
                     *(pa.array([x[a:b].tobytes() for a, b in ranges], pa.binary()) for x in (name, count))],
                    ["part", "slice", "names", "counts"])

    def total(asked: pa.Table) -> pa.Table:
        names = [np.frombuffer(b, np.uint64) for b in asked.column("names").to_pylist()]
        _, which = np.unique(np.concatenate(names), return_inverse=True)
        counts = np.frombuffer(b"".join(asked.column("counts").to_pylist()), np.uint32)
        totals = np.bincount(which, counts).astype(np.int64)[which]
        ends = np.cumsum([len(n) for n in names])[:-1]
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.table({"slice": asked.column("slice"), "part": asked.column("part"),
                         "counts": pa.array([pack(t.tobytes()) for t in np.split(totals, ends)], pa.binary())})

    return (table.mapInArrow(ask, "part long, slice long, names binary, counts binary")
            .groupBy("part").applyInArrow(total, "slice long, part long, counts binary"))


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, cutoff: int = CUTOFF,
                   backoff: float = BACKOFF) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score``, one row per row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z in lower case; counts are over all rows, repeated rows as often as they
    come. A word's score is count(n-gram) / count(context) at the highest order whose n-gram has at least
    ``cutoff`` occurrences (single words: one), times ``backoff`` for each order passed over, of those for which the
    document has enough words before; at order 1 it is count(word) / count(all words). ``log_score`` is the sum of natural
    logarithms. Null, empty and wordless texts have 0 words, log score 0 and a null mean. Other columns
    play no part. n-grams are told apart by 64-bit hashes.
    """
    if order < 1 or cutoff < 1 or not 0 < backoff <= 1:
        raise ValueError("order and cutoff: 1 or more; backoff: over 0, at most 1")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("data"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    if kind not in ("string", "int", "bigint"):
        raise ValueError("ids: int, bigint or string")
    table = written(rows.mapInArrow(_pack(order - 1, id_type), f"slice long, rows array<long>, ids array<{kind}>, skips array<int>, "
                                    "offsets array<long>, texts binary"), "lm-slices", LARGE_ROWS)
    # a word and its white space take two bytes at least, six or so on average
    n_bytes = table.agg(F.sum(F.element_at("offsets", -1))).first()[0] or 0
    bits = max(0, min(40, (n_bytes // 6 // TABLE_NGRAMS).bit_length()))
    counts = [written(count_table(table, k, bits).withColumn("k", F.lit(k)), f"lm-counts-{k}") for k in range(1, order + 1)]
    answers = counts[0]
    for c in counts[1:]:
        answers = answers.unionByName(c)
    answers = answers.groupBy("slice").agg(F.collect_list(F.struct("k", "part", "counts")).alias("answers"))
    n_words = _own_words(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                words = _read(batch, i)
                n = len(words.hash)
                totals: dict[tuple[int, int], bytes] = {(a["k"], a["part"]): a["counts"] for a in batch.column("answers")[i].as_py() or ()}
                best, used, below = np.zeros(n), np.ones(n, np.int64), np.zeros(n, np.int64)
                for k in range(1, order + 1):
                    at, name = words.grams(k)
                    unique, which = np.unique(name, return_inverse=True)
                    parts = _parts(unique, bits)
                    found = [np.frombuffer(unpack(totals[k, p]), np.int64) for p in np.unique(parts).tolist()]
                    count = np.zeros(n, np.int64)
                    if found:
                        count[at] = np.concatenate(found)[which]
                    if k == 1:
                        best = np.log(np.maximum(count, 1)) - math.log(max(1, n_words))
                    else:
                        hit = at[count[at] >= cutoff]
                        best[hit] = np.log(count[hit]) - np.log(below[hit - 1])
                        used[hit] = k
                    below = count
                best += math.log(backoff) * (np.minimum(order, words.place + 1) - used)
                pieces = len(words.first) - 1
                own = words.own
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rows")[i].values, batch.column("ids")[i].values,
                     pa.array(np.bincount(words.piece[own], minlength=pieces).astype(np.int64)),
                     pa.array(np.bincount(words.piece[own], best[own], minlength=pieces).astype(np.float64))],
                    ["row", "doc_id", "n_words", "log_score"])

    return (table.join(answers, "slice", "left").mapInArrow(score, f"row long, doc_id {kind}, n_words long, log_score double")
            .groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
            .select("doc_id", "n_words", "log_score",
                    F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score")))


def _own_words(table: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([int(_read(batch, i).own.sum())], pa.int64())], ["n"])

    return table.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
