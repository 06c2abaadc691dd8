"""Helpers of several operators: written intermediate tables, whole-batch tokenising, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream.session import scratch_dir

#: What a word is not: space and the five ASCII controls from tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are worked on at once inside a task.
SLICE_BYTES = 4 << 20
_HASHED = 1 << 19


#: For tables with rows of about a MB: by default a Parquet page has 100 rows at least, and each is held unpacked outside the heap.
LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 2, "parquet.page.row.count.limit": 1,
              "parquet.block.size": 8 << 20, "parquet.enable.dictionary": "false", "compression": "zstd"}


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` as a table in the shared scratch folder, read back.

    Cuts the lineage: a lost executor costs no recomputation of what is above, and
    every later use reads the same rows. The files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.options(**(options or {})).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` as a written table, hinted for broadcast if its counted rows (ids or short keys) are at most ``most``."""
    df = written(df, "few")
    return F.broadcast(df) if df.count() <= most else df


def bounded(spark: SparkSession) -> None:
    """Sets what keeps the operators' disk and memory low.

    Shuffle files go when the query that wrote them has ended, not when the driver collects garbage, and
    rows go to Python workers in small batches, of which the JVM and the worker hold several.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def text_of(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of ``column``; a longer text is a run by itself."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings without nulls, and where each row's begin (and the last ends)."""
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], width)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of True that lies in one row, and for each row its first run (one more at the end)."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; equal runs have equal hashes, in any task."""
    if not len(starts):
        return np.empty(0, np.uint64)
    value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    length = ends - starts
    power = np.full(int(length.max()), np.uint64(0xD1342543DE82EF95))
    power[0] = 1
    power = np.multiply.accumulate(power)
    # in blocks, for what is made along the way has eight bytes for each byte of text
    upto, found, at = np.cumsum(length), np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _HASHED, "right")))
        some = length[at:end]
        first = np.cumsum(some) - some
        within = np.arange(int(some.sum())) - np.repeat(first, some)
        byte = value[data[np.repeat(starts[at:end], some) + within]]
        byte *= power[within]
        found[at:end] = np.add.reduceat(byte, first)
        at = end
    return mixed(found + length.astype(np.uint64))


class Rows:
    """Gathers rows and gives them out as batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 4 << 20):
        self.schema, self.most = schema, most
        self.columns: list[list] = [[] for _ in schema]
        self.size = 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
            self.size += 8 + (len(value) if isinstance(value, (str, bytes)) else 0)
        if self.size >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
            self.columns, self.size = [[] for _ in self.schema], 0


def key_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """The batches of a sorted partition cut where ``column`` changes: its value, whether its rows begin here, and the rows."""
    last: tuple | None = None
    for batch in batches:
        keys = batch.column(column).to_pylist()
        at = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[at]:
                yield keys[at], last != (keys[at],), batch.slice(at, end - at)
                last, at = (keys[at],), end


def components(links: DataFrame, name: str) -> DataFrame:
    """``node, root``: for each node of ``links`` (``a, b``, any type with an order) the least node it reaches.

    Rounds of large-star and small-star: every node is tied to the least of its neighbours, first the
    greater ones, then all others, until nothing changes. Links stay in written tables; the
    number of rounds grows with the logarithm of the longest chain.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, f"{name}-links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .distinct(), f"{name}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.*").where("a <> b").distinct(), f"{name}-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
