"""Benchmark decontamination by MinHash containment.

Test items are short, documents may be long, so similarity of whole sets says nothing; asked is which
share of an item's shingles a document contains. Items are partitioned by their number of
shingles; the size sets how many of the item's least hashes (its MinHash sketch) a document that
contains enough of the item cannot miss. Documents that meet a sketch are verified shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.llm.common import ascii_lower, byte_set, mixed, run_hashes, runs, slices, text_of, utf8, written

SHINGLE, CONTAINMENT = 5, 0.8
#: Sketch entries (16 bytes each) up to which a sketch goes to every task; beyond, it is joined by shuffle.
LOOKUP_ENTRIES = 1 << 20

#: Words are runs of ASCII letters, digits and everything beyond ASCII, A-Z in lower case.
_WORD_BYTES = byte_set(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


def shingle_hashes(texts: pa.Array, words: int, like: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``words`` words (all words, if a row has fewer), and each row's first one.

    With ``like``, a run has the hash that a row of just these words has among runs of ``like`` words.
    """
    data, offsets = utf8(texts)
    data = ascii_lower(data)
    starts, ends, first = runs(_WORD_BYTES[data], offsets)
    word = run_hashes(data, starts, ends)
    if not len(word):
        return word, np.zeros(len(texts) + 1, np.int64)
    counts = np.diff(first)
    per_row = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    row_start = np.concatenate([[0], np.cumsum(per_row)])
    at = np.repeat(first[:-1], per_row) + np.arange(row_start[-1]) - np.repeat(row_start[:-1], per_row)
    end = np.repeat(first[1:], per_row)
    value = np.zeros(len(at), np.uint64)
    for k in range(max(words, like)):
        here = at + k
        inside = (here < end) & (k < words)
        value = value * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(here, len(word) - 1)], np.uint64(k + 1))
    return mixed(value), row_start


def _lengths_below(items: DataFrame, words: int) -> list[int]:
    """The numbers of words, fewer than ``words``, that texts of ``id, text`` rows have."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                counts = np.unique(np.diff(runs(_WORD_BYTES[ascii_lower(data)], offsets)[2]))
                yield pa.RecordBatch.from_arrays([pa.array(counts[(counts > 0) & (counts < words)].astype(np.int32))], ["n"])

    return sorted(r["n"] for r in items.mapInArrow(lengths, "n int").distinct().collect())


def _by_shingle(rows: DataFrame, words: int, short: Sequence[int] = ()) -> DataFrame:
    """``id, shingle``: the distinct shingles of each row of ``id, text``, and those of the lengths ``short``."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingle_hashes(part.column("text"), n, words) for n in (words, *short)]
                value = np.concatenate([v for v, _ in found])
                row = np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(first)) for _, first in found])
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                keep = np.ones(len(row), bool)
                keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row[keep])), pa.array(value[keep].view(np.int64))], ["id", "shingle"])

    return rows.mapInArrow(hashes, f"id {rows.schema['id'].dataType.simpleString()}, shingle long")


def sketches(items: DataFrame, words: int = SHINGLE, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """All shingles (``item, shingle``) of ``id, text`` rows, and the items' sketches.

    An item of n shingles needs m = ceil(containment * n) of them; whoever has m of n has one of any
    n - m + 1. Items of 2^c to 2^(c+1) - 1 shingles are one partition, and its sketches are the
    least hashes in the number that its largest size asks for.
    """
    shingles = written(_by_shingle(items, words).withColumnRenamed("id", "item").distinct(), "items")
    per_item = Window.partitionBy("item")
    ranked = (shingles.withColumn("n", F.count("*").over(per_item))
              .withColumn("place", F.row_number().over(per_item.orderBy("shingle")))
              .withColumn("needed", F.ceil(F.col("n") * F.lit(containment) - 1e-9)))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    length = largest - F.ceil(largest * F.lit(containment) - 1e-9) + 1
    return shingles, written(ranked.where(F.col("place") <= length).select("item", "n", "needed", "shingle"), "sketch")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_id_col: str = "item_id", item_text_col: str = "text", words: int = SHINGLE,
              containment: float = CONTAINMENT, short_items: bool = False) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every pair with enough shared shingles.

    Shingles are distinct. A text of fewer words than a shingle is one shingle; null, empty and wordless texts
    have none and match nothing. Rows that share an id count as one document or item with
    the shingles of all its rows; null ids take no part. No candidate is left out: a sketch cannot be
    missed by a document that qualifies. Other columns play no part. With ``short_items``, documents have the runs of as
    many words as any shorter item has for shingles too, so that such an item is found inside a longer text.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    items = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).alias("id"), text_of(item_text_col).alias("text"))
    shingles, sketch = sketches(items, words, containment)
    wanted = shingles.select("shingle").distinct()
    short = _lengths_below(items, words) if short_items else []
    n_entries = wanted.count()
    if n_entries <= LOOKUP_ENTRIES:
        # each task keeps the rows' shingles that any item has; documents that meet no sketch go at once
        keys = np.sort(np.array([r[0] for r in wanted.collect()], np.int64).view(np.uint64))
        first = np.sort(np.array([r[0] for r in sketch.select("shingle").distinct().collect()], np.int64).view(np.uint64))
        found = written(_lookup(docs, keys, first, words, short), "docs-shared")
    else:
        found = written(_by_shingle(docs, words, short).join(wanted, "shingle", "left_semi").select("id", "shingle").distinct(),
                        "docs-shared")
    candidates = found.join(sketch, "shingle").select("id", "item", "n", "needed").distinct()
    return (candidates.join(shingles, "item").join(found, ["id", "shingle"])
            .groupBy("id", "item", "n", "needed").agg(F.count("*").alias("n_shared"))
            .where("n_shared >= needed")
            .select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("n_shingles"),
                    "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")))


def _among(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_keys, values)
    return sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == values if len(sorted_keys) else np.zeros(len(values), bool)


def _lookup(docs: DataFrame, keys: np.ndarray, first: np.ndarray, words: int, short: Sequence[int] = ()) -> DataFrame:
    """``id, shingle`` of all shingles in ``keys``, of the rows that have one in ``first``."""
    # most shingles are in no item: a bit for each 22-bit prefix turns them away
    shift = np.uint64(42)
    known = np.zeros(1 << 22, bool)
    known[keys >> shift] = True
    known = np.packbits(known)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = np.unpackbits(known).astype(bool)
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for n in (words, *short):
                    value, starts = shingle_hashes(part.column("text"), n, words)
                    at = np.flatnonzero(likely[value >> shift])
                    at = at[_among(keys, value[at])]
                    found.append((np.searchsorted(starts, at, "right") - 1, value[at]))
                row, value = (np.concatenate(c) for c in zip(*found, strict=True))
                met = np.zeros(part.num_rows, bool)
                met[row[_among(first, value)]] = True
                row, value = row[met[row]], value[met[row]]
                pairs = np.unique(np.rec.fromarrays([row, value], names="row,value")) if len(row) else None
                if pairs is not None:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(pairs["row"])), pa.array(pairs["value"].view(np.int64))], ["id", "shingle"])

    return docs.mapInArrow(look, f"id {docs.schema['id'].dataType.simpleString()}, shingle long").distinct()
