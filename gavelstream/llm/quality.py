"""Quality by compression.

Two zstandard dictionaries are built from texts labelled good and bad. A text is compressed with
either, block by block; the difference of the sizes over their sum says which of the two it is like.
A logistic curve over that difference and the plain compression ratios makes it a probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import slices, text_of, written

#: Bytes that are compressed at once with a dictionary; in a longer block the text is its own dictionary.
BLOCK = 512
DICTIONARY_BYTES = 112_640
#: Bounds of the fit: labelled rows of each class for a dictionary, code points of each, labelled rows for the curve.
DICTIONARY_ROWS, EXCERPT, CURVE_ROWS = 3_000, 4_000, 20_000
FEATURES = ("difference", "good_ratio", "plain_ratio")
_FEATURE_TYPE = "struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"


@dataclass(frozen=True)
class Model:
    """``good`` and ``bad`` dictionaries, or None where a class has no labelled text; ``curve``: constant, then weights."""

    good: bytes | None
    bad: bytes | None
    curve: tuple[float, ...]


def dictionary(texts: list[str]) -> bytes | None:
    """A dictionary of distinct texts; too few for training are the dictionary themselves."""
    samples = [t.encode() for t in sorted(set(texts)) if t]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def meter(good: bytes, bad: bytes) -> Callable[[str], tuple[float, float, float]]:
    plainly = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}

    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(content)
        made.precompute_compress(level=3)
        return zstandard.ZstdCompressor(dict_data=made, **plainly)

    by_good, by_bad = compressor(good).compress, compressor(bad).compress
    alone = zstandard.ZstdCompressor(level=1, **plainly).compress

    def features(text: str) -> tuple[float, float, float]:
        data = text.encode()
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
        to_good = sum(len(by_good(b)) for b in blocks)
        to_bad = sum(len(by_bad(b)) for b in blocks)
        size = max(1, len(data))
        return ((to_bad - to_good) / (to_bad + to_good), math.log(to_good / size), math.log(len(alone(data)) / size))

    return features


def measured(docs: DataFrame, model: Model, text_col: str, column: str) -> DataFrame:
    """``docs`` with the compression features of the whole text as one more column."""
    good, bad = model.good, model.bad
    kind = pa.struct([(f, pa.float64()) for f in FEATURES])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = meter(good, bad)
        for batch in batches:
            for part in slices(batch, text_col):
                found = [dict(zip(FEATURES, features(t or ""), strict=True)) for t in part.column(text_col).to_pylist()]
                yield part.append_column(pa.field(column, kind), pa.array(found, kind))

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(measure, f"{schema}, `{column}` {_FEATURE_TYPE}")


def _terms(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x[:, 1] ** 2, x[:, 2] ** 2])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton's method; weights are for the plain, unscaled terms."""
    terms = _terms(x)
    mean, scale = terms.mean(0), terms.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (terms - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + ridge * w
        bend = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    weights = w[1:] / scale
    return (float(w[0] - weights @ mean), *map(float, weights))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """A model from the labelled rows (``label_col`` 0 or 1; others and nulls are ignored).

    Bounded sample: of each class the ``DICTIONARY_ROWS`` labelled ids of least hash give an excerpt of
    ``EXCERPT`` code points each, at a hash-random place, to the dictionary; ``CURVE_ROWS`` further ids
    give the features of their whole texts to the curve. An id with several texts counts once.
    """
    ids = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
           .withColumn("draw", F.xxhash64(F.lit("quality"), "id")))
    for_dictionary = F.pmod("draw", F.lit(2)) == 0
    chosen = None
    for part, most in ((ids.where(for_dictionary & (F.col("label") == 1)), DICTIONARY_ROWS),
                       (ids.where(for_dictionary & (F.col("label") == 0)), DICTIONARY_ROWS),
                       (ids.where(~for_dictionary), CURVE_ROWS)):
        part = part.orderBy("draw", "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = written(chosen.withColumn("dictionary", for_dictionary), "quality-sample")
    text = text_of(text_col)
    # at most 2 * DICTIONARY_ROWS + CURVE_ROWS ids: small enough to send to every task
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    place = F.pmod("draw", F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)).cast("int") + 1
    excerpts = (rows.where("dictionary").groupBy("id", "label")
                .agg(F.min(F.substring("text", place, F.lit(EXCERPT))).alias("text")).collect())
    good, bad = (dictionary([r["text"] for r in excerpts if r["label"] == k]) for k in (1, 0))
    model = Model(good, bad, ())
    if good is None or bad is None:
        counts = dict(ids.groupBy("label").count().collect())
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(good, bad, (math.log(share / (1 - share)),))
    curve = (measured(rows.where("NOT dictionary"), model, "text", "features")
             .groupBy("id", "label").agg(F.min("features").alias("f")).select("label", "f.*").toPandas())
    if curve["label"].nunique() < 2:
        return Model(good, bad, (0.0, 10.0, 0.0, 0.0, 0.0, 0.0))
    return Model(good, bad, fit_curve(curve[list(FEATURES)].to_numpy(), curve["label"].to_numpy(float)))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a row's whole text is good.

    Null and empty texts are scored as the empty text. Where the model has only one class, all
    rows have the smoothed share of label 1. Rows are neither dropped nor moved.
    """
    def curve(f: str) -> Column:
        d, g, p = (F.col(f"`{f}`.{n}") for n in FEATURES)
        terms = zip(model.curve[1:], (d, g, p, g * g, p * p), strict=True)
        return 1 / (1 + F.exp(-sum((w * t for w, t in terms), F.lit(model.curve[0]))))

    if len(model.curve) == 1:
        return docs.withColumn(score_col, F.lit(1 / (1 + math.exp(-model.curve[0]))))
    features = "features"
    while features in docs.columns:
        features += "_"
    return measured(docs, model, text_col, features).withColumn(score_col, curve(features)).drop(features)
