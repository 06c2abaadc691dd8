"""Held-out accuracy, bounds and odd inputs of the compression classifier."""

import math

import pytest
import zstandard
from llm_support import clashing, docs, rows_of  # noqa: F401
from pyspark.sql import functions as F

from gavelstream.llm import quality, queries

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = queries.op3_quality(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert scored.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    of = {k: [r for r in rows if r.quality == k] for k in (0, 1)}
    assert len(rows) > 1000
    assert sum(r.predicted == 1 for r in of[1]) >= 0.98 * len(of[1])
    assert sum(r.predicted == 0 for r in of[0]) >= 0.9 * len(of[0])
    # calibrated: of what gets about p, about p is good
    middle = [r for r in rows if 0.2 < r.score < 0.8]
    assert abs(sum(r.score - r.quality for r in middle)) <= max(8, 0.35 * len(middle))
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(3000)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("quality", F.when(queries.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels.where(~queries.held_out())) == quality.fit(docs, turned.where(~queries.held_out()))


@pytest.fixture(scope="module")
def model():
    good = [f"The quick brown fox {i} jumps over the lazy dog and rests by the river until evening." for i in range(200)]
    bad = [f"BUY!! {i} $$$ CLICK### now%%% win*** {i * 7}" for i in range(200)]
    return quality.Model(quality.dictionary(good), quality.dictionary(bad), (0.0, 20.0, 0.0, 0.0, 0.0, 0.0))


def test_rows(docs, model):
    given = [(1, "The quick brown fox jumps over the lazy dog by the river."), (2, "CLICK### now%%% win*** $$$"), (3, None), (4, ""),
             (5, "The river rests. " * 50_000), (5, "The river rests. " * 50_000), (None, "x")]
    out = quality.scored(clashing(docs(given)), model, score_col="p")
    assert out.columns == [*clashing(docs(given)).columns, "p"] and out.count() == 7
    score = {r.doc_id: r.p for r in out.collect()}
    assert score[1] > 0.5 > score[2] and score[3] == score[4]
    assert quality.scored(docs([]), model).count() == 0


def test_labels_of_one_class_or_none(docs, spark):
    texts = docs([(i, f"text {i}") for i in range(6)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(texts, quality.fit(texts, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(4)] + [(None, 0), (5, None)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality.scored(texts, quality.fit(texts, ones)).collect()} == {round(5 / 6, 6)}
    few = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (4, 1), (5, 0)], "doc_id long, quality int")
    assert rows_of(quality.scored(texts, quality.fit(texts, few)), "doc_id") == [(i,) for i in range(6)]


def test_scores_against_a_plain_computation(docs, model):
    """Sizes of frames that give the texts back, and the curve written out."""
    curve = (0.3, 20.0, -1.5, 0.7, 0.4, -0.2)
    fitted = quality.Model(model.good, model.bad, curve)
    texts = ["", "a", "The quick brown fox rests.", "CLICK### now%%% " * 100, "é" * 700, "jumps over the lazy dog " * 60 + "$$$"]

    def size(data, content):
        found = 0
        for at in range(0, max(1, len(data)), 512):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=3)
            made = zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
            frame = made.compress(data[at:at + 512])
            back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)).decompress(frame, max_output_size=512)
            assert back == data[at:at + 512]
            found += len(frame)
        return found

    def score(text):
        data = text.encode()
        good, bad = size(data, fitted.good), size(data, fitted.bad)
        plain = len(zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
        length = max(1, len(data))
        d, g, p = (bad - good) / (bad + good), math.log(good / length), math.log(plain / length)
        return 1 / (1 + math.exp(-(curve[0] + curve[1] * d + curve[2] * g + curve[3] * p + curve[4] * g * g + curve[5] * p * p)))

    got = {r.doc_id: r.score for r in quality.scored(docs(list(enumerate(texts))), fitted).collect()}
    assert got == {i: pytest.approx(score(t), abs=1e-12) for i, t in enumerate(texts)}
