"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order in which it sees the pivots, nearest first, and posted under the first few of
them: a pivot's inverted file holds the vectors that see it among their nearest. A query reads the files of its own nearest
pivots and ranks what they hold by footrule distance, how far the places of all pivots differ between two
orders. The best of all its files, with everything that is as good as the last of them, are reranked by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.llm.common import written

#: Bound of the fit: the pivots are chosen among this many vectors at most. There are as many as the square root of the rows, up to ``PIVOTS``.
SAMPLE, PIVOTS = 20_000, 128
#: Inverted files that a vector is posted in, and that a query reads.
POSTED, PROBES = 8, 16
#: Vectors that are reranked for a query, at least, and for each square root of the rows.
RERANKED, RERANKED_BY_ROOT = 1_000, 8
#: Orders this share of the largest footrule apart tell nothing: whatever is so near is reranked, however many there are.
ALIKE = 0.05
#: Steps in which footrules are counted to find a query's last one.
STEPS = 512
#: Postings of one inverted file, and queries, that meet in one go; longer files and more queries are split. Wide vectors
#: are split to ``FILE_BYTES`` as doubles.
FILE_ROWS, FILE_BYTES = 20_000, 32 << 20
#: How far a product of matrices may be from the cosine of the same two vectors taken alone.
_SLACK = 1e-12


def usable(vector: str | Column) -> Column:
    """Whether a vector can take part: not null, no null or non-finite component, not all zero."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that neither huge nor tiny components overflow or vanish when squared
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors far from each other: each next one is the sampled vector least like those chosen so far."""
    unit = _unit(vectors)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, unit @ unit[at])
    return unit[chosen]


def orders(rows: DataFrame, pivots: np.ndarray, most: int, single: bool) -> DataFrame:
    """``vec_id, asks, vector, places, near``: the vector packed as bytes (of floats if ``single``), the place of each pivot in its order
    as a byte, and the first ``most`` pivots of the order."""
    packed = np.float32 if single else np.float64

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = np.argsort(-(_unit(vectors) @ pivots.T), axis=1, kind="stable")
            places = np.argsort(order, axis=1).astype(np.uint8)
            near = order[:, :most].astype(np.int32)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * near.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("asks"), pa.array([v.tobytes() for v in vectors.astype(packed)], pa.binary()),
                 pa.array([p.tobytes() for p in places], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))],
                ["vec_id", "asks", "vector", "places", "near"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(rank, f"vec_id {kind}, asks boolean, vector binary, places binary, near array<int>")


def footrule(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sums over all pivots of how far its place in one order is from its place in others."""
    return (np.maximum(own, others) - np.minimum(own, others)).sum(axis=1, dtype=np.int32)


def _without_copies(ids: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` least ids of each distinct vector, ids ascending: no list of ``most`` - 1 others has room for more."""
    by_id = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(unit).view(np.dtype((np.void, unit.shape[1] * unit.itemsize))).ravel(), return_inverse=True)
    by_vector = by_id[np.argsort(same[by_id], kind="stable")]
    starts = np.flatnonzero(np.diff(same[by_vector], prepend=-1))
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(starts, append=len(ids)))
    kept = np.zeros(len(ids), bool)
    kept[by_vector[place < most]] = True
    return by_id[kept[by_id]]


def first_met(own: np.ndarray, others: np.ndarray, pivot: int, posted: int) -> np.ndarray:
    """Which of a file's vectors (places of all pivots) are in no file that the query reads before this one."""
    before = np.flatnonzero(own < own[pivot])
    return ~(others[:, before] < posted).any(axis=1)


def best_of(query_id: int, query: np.ndarray, ids: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The exact ``k`` nearest others of a query (unit vectors): places of ``ids``, ascending, and the cosines."""
    near = unit @ query
    near[ids == query_id] = -np.inf
    edge = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else -np.inf
    v = np.flatnonzero((near >= edge - _SLACK) & (near > -np.inf))
    # again pair by pair: the last digits of a product of matrices depend on where a vector stands
    score = np.einsum("ij,ij->i", np.broadcast_to(query, (len(v), len(query))), unit[v])
    top = np.lexsort((ids[v], -score))[:k]
    return v[top], score[top]


def _matrix(column: pa.ChunkedArray, packed: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), packed).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            pivots: int = PIVOTS, posted: int = POSTED, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` picks the ``k`` nearest of all other rows that it finds.

    Score is the cosine in double precision of the original vectors; ties go to the smaller id. Vectors that are null,
    zero, of another length than most, or hold a null or non-finite component take no part, nor do rows without an id. Rows of
    one id are one vector (the least by value). Every other row is indexed; the pivots (256 at most, and no more than the square root of
    the rows) are chosen in a bounded sample. Of what a query's ``probes`` files hold, the ``RERANKED`` nearest by footrule or more are compared
    exactly. Where orders tell little, among copies and near copies, everything as near as the last of these, and all within ``ALIKE`` of the
    largest footrule, is compared exactly as well, without a limit.
    """
    if not 1 <= pivots <= 256:
        raise ValueError("pivots: 1 to 256")
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                            queries.alias("asks")).where(F.col("vec_id").isNotNull() & usable("vector"))
    rows = written(picked.groupBy("vec_id").agg(F.min(F.struct("vector", "asks")).alias("v"))
                   .select("vec_id", "v.vector", F.coalesce("v.asks", F.lit(False)).alias("asks")), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    width, n = sizes[0]
    rows = rows.where(F.size("vector") == width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    root = int(np.ceil(np.sqrt(n)))
    chosen = choose_pivots(np.array([r[0] for r in sample]), min(pivots, root))
    posted, probes = min(posted, len(chosen)), min(probes, len(chosen))
    best, step = max(RERANKED, RERANKED_BY_ROOT * root), max(1, len(chosen) ** 2 // 2 // STEPS)
    alike = int(ALIKE * (len(chosen) ** 2 // 2)) // step

    index = written(orders(rows, chosen, max(posted, probes), single), "orders")
    def of_index(rows: DataFrame, most: int) -> DataFrame:
        # under names of their own, for both sides of the index meet below
        return rows.select(*(F.col(c).alias(c) for c in ("vec_id", "vector", "places")), F.explode(F.slice("near", 1, most)).alias("pivot"))

    files, asked = of_index(index, posted), of_index(index.where("asks"), probes)
    # the numbers of postings and of queries of a pivot say into how many parts either goes; every two parts meet
    most = max(1, min(FILE_ROWS, FILE_BYTES // (8 * width)))

    def dealt(table: DataFrame) -> dict[int, int]:
        return {r["pivot"]: -(-r["count"] // most) for r in table.groupBy("pivot").count().collect()}

    def of_pivot(counts: dict[int, int]) -> Column:
        return F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))[F.col("pivot")]

    parts, asks_parts = dealt(files), dealt(asked)
    met = parts.keys() & asks_parts.keys()
    if not met:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")

    def cut(table: DataFrame, own: str, counts: dict[int, int], other: str, others: dict[int, int]) -> DataFrame:
        return (table.where(F.col("pivot").isin(*met))
                .withColumn(own, F.pmod(F.xxhash64("vec_id"), of_pivot(counts)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), of_pivot(others) - 1))))

    files = cut(files, "part", parts, "asks_part", asks_parts)
    asked = cut(asked, "asks_part", asks_parts, "part", parts)
    by, packed = ["pivot", "part", "asks_part"], np.float32 if single else np.float64

    def met_by(asks: pa.Table, file: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query the vectors that it meets in this file first, and the steps of their footrules."""
        own, there = _matrix(asks.column("places"), np.uint8), _matrix(file.column("places"), np.uint8)
        ids, query_ids, pivot = file.column("vec_id").to_numpy(), asks.column("vec_id").to_numpy(), asks.column("pivot")[0].as_py()
        for i, places in enumerate(own):
            at = np.flatnonzero(first_met(places, there, pivot, posted) & (ids != query_ids[i]))
            yield i, at, footrule(places, there[at]) // step

    def count(asks: pa.Table, file: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
        for i, _, far in met_by(asks, file) if asks.num_rows and file.num_rows else ():
            n_at = np.bincount(far)
            # beyond the step at which this file alone has enough, no other file's vectors are asked for either
            n_at = n_at[:int(np.searchsorted(np.cumsum(n_at), best)) + 1]
            at = np.flatnonzero(n_at)
            found.append((np.full(len(at), i), at, n_at[at]))
        i, at, n_at = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": asks.column("vec_id").take(pa.array(i)), "far": pa.array(at, pa.int32()), "n": pa.array(n_at, pa.int64())})

    def rerank(asks: pa.Table, file: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asks.num_rows and file.num_rows:
            own, there = (_unit(_matrix(t.column("vector"), packed).astype(float)) for t in (asks, file))
            # copies have equal orders: more than k + 1 of one vector cannot all be wanted
            file, there = file.take(pa.array(kept := _without_copies(file.column("vec_id").to_numpy(), there, k + 1))), there[kept]
            ids, query_ids, last = file.column("vec_id").to_numpy(), asks.column("vec_id").to_numpy(), asks.column("last").to_numpy()
            for i, at, far in met_by(asks, file):
                at = at[far <= last[i]]
                v, score = best_of(query_ids[i], own[i], ids[at], there[at], k)
                found.append((np.full(len(v), i), at[v], score))
        i, v, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": asks.column("vec_id").take(pa.array(i)), "vec_id": file.column("vec_id").take(pa.array(v)), "score": pa.array(score)})

    # first the footrules are only counted, to know how far each query has to go in all its files together
    counts = (asked.select(*by, "vec_id", "places").groupBy(*by).cogroup(files.select(*by, "vec_id", "places").groupBy(*by))
              .applyInArrow(count, f"query_id {kind}, far int, n long").groupBy("query_id", "far").agg(F.sum("n").alias("n")))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("far"))
    last = (counts.withColumn("upto", upto).groupBy("query_id")
            .agg(F.greatest(F.coalesce(F.min(F.when(F.col("upto") >= best, F.col("far"))), F.max("far")), F.lit(alike)).alias("last")))
    last = written(last.select(F.col("query_id").alias("vec_id"), "last"), "last-footrules")
    found = (asked.join(last, "vec_id").select(*by, "vec_id", "vector", "places", "last").groupBy(*by)
             .cogroup(files.select(*by, "vec_id", "vector", "places").groupBy(*by))
             .applyInArrow(rerank, f"query_id {kind}, vec_id {kind}, score double"))
    # a vector is met in one file only; at most k * probes * parts short rows of a query come together here
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return (found.groupBy("query_id").agg(top.alias("t")).select("query_id", F.posexplode("t").alias("p", "t"))
            .select("query_id", (F.col("p") + 1).alias("rank"), "t.vec_id", (-F.col("t.s")).alias("score")))
