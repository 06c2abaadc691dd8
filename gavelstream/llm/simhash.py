"""Near-duplicates by SimHash, found with vantage-point trees.

Equal fingerprints are one point. Two fingerprints within k bits are within k // 2 bits in their lower or
their upper half, so each half has a tree of its own, searched with that small radius. A tree's
upper levels are laid out over a bounded sample and deal all points to shards by their Hamming distance to
vantage points; a point whose ball crosses a shell visits the shard beyond, every other branch is
pruned by the triangle inequality. A shard goes on splitting in the same way by itself and compares
whole fingerprints in its leaves, so every pair within k bits is met, none by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import components, slices, text_of, written

SHINGLE, MOST_BITS, SEED = 3, 3, 42
#: Points of a leaf, and of a shard on average while the sample below allows for enough of them.
LEAF, SHARD = 512, 8192
#: Fingerprints that lay out the upper levels (they choose where to cut, not what is found); points of it per shard.
SAMPLE, PER_SHARD = 65_536, 16
_COUNTED = 65_536
#: Pairs that wait for a union.
_JOINED = 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the hashes of the text's shingles, repeats included."""
    words = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    size = min(shingle, len(words))
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1:], strict=False)),
                         np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _COUNTED):
        part = hashes[at:at + _COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` (the 64 bits as a long) of every row's whole text."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))],
                                                 ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(take, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


@dataclass(frozen=True)
class Tree:
    """Inner node i has vantage point ``point[i]`` and children 2i + 1 (distance up to ``radius[i]``) and 2i + 2."""

    point: np.ndarray
    radius: np.ndarray
    depth: int


def _cut(halves: np.ndarray) -> tuple[int, int]:
    """A vantage point and the radius that best halves the points (of the first few by position)."""
    tried = halves[:: max(1, len(halves) // 2048)]
    best = (len(tried) + 1, 0, 0)
    for point in tried[:: max(1, len(tried) // 5)][:5]:
        below = np.cumsum(np.bincount(np.bitwise_count(tried ^ point), minlength=65))
        radius = int(np.argmin(np.abs(2 * below - len(tried))))
        best = min(best, (abs(2 * int(below[radius]) - len(tried)), int(point), radius))
    return best[1], best[2]


def lay_out(halves: np.ndarray, depth: int) -> Tree:
    inner = (1 << depth) - 1
    point, radius, held = np.zeros(inner, np.uint64), np.zeros(inner, np.int64), {0: halves}
    for i in range(inner):
        here = held.pop(i)
        if len(here):
            point[i], radius[i] = _cut(here)
        near = np.bitwise_count(here ^ point[i]) <= radius[i]
        held[2 * i + 1], held[2 * i + 2] = here[near], here[~near]
    return Tree(point, radius, depth)


def route(tree: Tree, halves: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point its home shard and the shards it visits: position, shard, whether it is the home.

    Of a pair parted by a shell, the inner point visits the outer one's side; visitors go wherever their ball reaches.
    """
    at, node, home = np.arange(len(halves)), np.zeros(len(halves), np.int64), np.ones(len(halves), bool)
    for _ in range(tree.depth):
        radius = tree.radius[node]
        apart = np.bitwise_count(halves[at] ^ tree.point[node]).astype(np.int64)
        inside = np.where(home, apart <= radius, apart - reach <= radius)
        outside = np.where(home, apart > radius, apart + reach > radius)
        visits = home & (apart <= radius) & (apart + reach > radius)
        at, node, home = (np.concatenate(x) for x in (
            (at[inside], at[outside], at[visits]),
            (2 * node[inside] + 1, 2 * node[outside] + 2, 2 * node[visits] + 2),
            (home[inside], home[outside], np.zeros(int(visits.sum()), bool))))
    return at, node - ((1 << tree.depth) - 1), home


class _Classes:
    """Union of positions; pairs are reduced to pairs of classes and gathered, for a union looks at every position."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if apart.any():
            self.pairs.append(np.unique(np.minimum(a, b)[apart] * len(self.root) + np.maximum(a, b)[apart]))
            self.held += len(self.pairs[-1])
            if self.held >= _JOINED:
                self.settle()

    def settle(self) -> None:
        if not self.pairs:
            return
        n = len(self.root)
        pairs = np.unique(np.concatenate(self.pairs))
        self.pairs, self.held = [], 0
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for p in pairs.tolist():
            x, y = sorted((top(p // n), top(p % n)))
            if x != y:
                parent[y] = x
        moved = np.array(sorted(parent))
        to = np.array([top(x) for x in moved.tolist()])
        at = np.searchsorted(moved, self.root)
        at[at == len(moved)] = 0
        hit = moved[at] == self.root
        self.root[hit] = to[at[hit]]


def _part(points: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return (points >> np.uint64(shift)) & np.uint64((1 << bits) - 1)


def search(points: np.ndarray, home: np.ndarray, side: int, most_bits: int) -> np.ndarray:
    """For each point of a shard the position of its class: every pair with a home point within ``most_bits`` is tied.

    Points that share this half are told apart by the other one: two of them are within ``most_bits`` // 4 bits in one of its
    four bytes, so they are cut by each in turn.
    """
    classes = _Classes(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home), 32 * side, 32)]
    while todo:
        homes, visitors, shift, bits = todo.pop()
        reach = most_bits // (2 if bits == 32 else 4)
        if len(homes) > LEAF:
            point, radius = _cut(_part(points[homes], shift, bits))
            apart_h, apart_v = (np.bitwise_count(_part(points[at], shift, bits) ^ np.uint64(point)).astype(np.int64) for at in (homes, visitors))
            near = apart_h <= radius
            if near.any() and not near.all():
                todo.append((homes[near], visitors[apart_v - reach <= radius], shift, bits))
                todo.append((homes[~near], np.concatenate(
                    [visitors[apart_v + reach > radius], homes[near & (apart_h + reach > radius)]]), shift, bits))
                continue
            if bits == 32:
                todo += [(homes, visitors, 32 - shift + at, 8) for at in range(0, 32, 8)]
                continue
        step = max(1, (1 << 21) // max(1, len(homes)))
        for others, own in ((homes, True), (visitors, False)):
            for i in range(0, len(others), step):
                rows = others[i:i + step]
                cols = homes[i:] if own else homes
                r, c = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[cols][None, :]) <= most_bits)
                classes.join(rows[r], cols[c])
    classes.settle()
    return classes.root


def linked_fingerprints(points: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``a, b`` links that tie every two of the distinct ``fingerprint`` values within ``most_bits``, directly or by others."""
    reach = most_bits // 2
    n = points.count()
    depth = max(0, min(SAMPLE // PER_SHARD, n // SHARD)).bit_length()
    sample = np.array([r[0] for r in points.orderBy(F.xxhash64("fingerprint"), "fingerprint")
                       .limit(SAMPLE if depth else 1).collect()], np.int64).view(np.uint64)
    trees = [lay_out(sample & np.uint64(0xFFFFFFFF), depth), lay_out(sample >> np.uint64(32), depth)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0).to_numpy().view(np.uint64)
            for side, tree in enumerate(trees):
                at, shard, home = route(tree, value >> np.uint64(32) if side else value & np.uint64(0xFFFFFFFF), reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * 2 + side), pa.array(home), pa.array(value[at].view(np.int64))], ["shard", "home", "fingerprint"])

    def tie(table: pa.Table) -> pa.Table:
        value = table.column("fingerprint").to_numpy().view(np.uint64)
        root = search(value, table.column("home").to_numpy(), table.column("shard")[0].as_py() % 2, most_bits)
        value = value.view(np.int64)
        moved = root != np.arange(len(root))
        return pa.table({"a": value[moved], "b": value[root[moved]]})

    return (points.mapInArrow(deal, "shard long, home boolean, fingerprint long")
            .groupBy("shard").applyInArrow(tie, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    ``component_id`` is the least id among all rows whose fingerprints are reached by links of at most ``most_bits``
    differing bits. Null, empty and wordless texts have fingerprint 0 and are linked like others; a null id
    is never the least, a component without ids has a null one. Repeated rows stay rows. Other columns
    play no part.
    """
    own = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = written(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "points")
    links = linked_fingerprints(points.select("fingerprint"), most_bits)
    tied = points.join(components(links, "near"), points["fingerprint"] == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = tied.join(least, "root").select("fingerprint", "component_id")
    return own.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one of least id, then of least hash of its text, then of the row.

    Rows that share an id are told apart by their texts. Rows without an id stay as they are.
    """
    named = docs.where(F.col(id_col).isNotNull())
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.xxhash64(*hashed).alias("row"))
    key = "key"
    while key in docs.columns:
        key += "_"
    keyed = named.withColumn(key, own)
    found = near_duplicates(keyed, key, text_col, shingle, most_bits)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return (keyed.join(kept, key, "left_semi").dropDuplicates([key])
            .select(docs.columns).unionByName(docs.where(F.col(id_col).isNull())))
