"""Recall against brute force, and defined results for odd vectors."""

import numpy as np
import pytest
from llm_support import clashing
from pyspark.sql import functions as F

from gavelstream.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, ids, k=5):
    """The k nearest by cosine, ties to smaller ids."""
    known = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            known.setdefault(i, np.array(v, np.float32).astype(float))
    order = sorted(known)
    unit = {i: known[i] / np.linalg.norm(known[i]) for i in order}
    out = {}
    for q in ids:
        if q in known:
            near = sorted(((-round(float(unit[q] @ unit[i]), 12), i) for i in order if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected = plain(rows, [i for i, _ in rows if i % 50 == 0])
    got = found(queries.op10_neighbours(spark, sf))
    assert got.keys() == expected.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    assert all(abs(s - unit[q] @ unit[i]) < 1e-12 for q, v in got.items() for i, s in v)


def test_recall_with_hot_vectors_and_split_files(spark, monkeypatch):
    monkeypatch.setattr(ann, "FILE_ROWS", 100)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).round(3).tolist()) for i in range(2000)]
    rows += [(i, rows[7][1]) for i in range(2000, 3000)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    got, expected = found(ann.nearest(df, F.col("vec_id") % 50 == 0)), plain(rows, range(0, 3000, 50))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)
    assert [i for i, _ in got[2950]] == [7, 2000, 2001, 2002, 2003]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1e-30, 1e-30]), (9, [1e30, -1e30]), (50, [-1.0, 0.0]), (100, [0.0, 0.0]), (150, None), (None, [1.0, 0.0]), (10, [1.0]),
            (1, [2.0, 0.0]), (11, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = found(ann.nearest(clashing(df), F.col("vec_id") % 50 == 0))
    expected = plain([r for r in rows if r[0] not in (10, 11)], [0, 50])
    assert got.keys() == expected.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]])
    assert [i for i, _ in got[0]][:1] == [1] and len(got[50]) == 5


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None), (50, [0.0])]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert ann.nearest(df, F.col("vec_id") % 50 == 0).count() == 0


def test_footrule():
    own, others = np.array([0, 1, 2], np.uint8), np.array([[0, 1, 2], [2, 1, 0], [1, 0, 2]], np.uint8)
    assert ann.footrule(own, others).tolist() == [0, 4, 2]


@pytest.mark.parametrize("noise", [0.3, 0.1, 0.03, 0.01, 0.0001])
def test_recall_among_near_copies(spark, monkeypatch, noise):
    monkeypatch.setattr(ann, "FILE_ROWS", 300)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(3000, 32))
    vectors[::3] = vectors[0] + noise * rng.normal(size=(1000, 32))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    got, expected = found(ann.nearest(df, F.col("vec_id") % 25 == 0)), plain(rows, range(0, 3000, 25))
    alike = [q for q in expected if q % 3 == 0]
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in alike) >= 0.99 * 5 * len(alike)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected) >= 0.9 * 5 * len(expected)


def test_best_of_a_file_are_exact():
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(400, 8))
    unit[100:300] = unit[5]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = rng.permutation(400)
    for k in (1, 5, 500):
        kept = ann._without_copies(ids, unit, k + 1)
        for i in range(120):
            v, score = ann.best_of(ids[i], unit[i], ids[kept], unit[kept], k)
            cosine = np.einsum("ij,ij->i", np.broadcast_to(unit[i], unit.shape), unit)
            best = [j for j in np.lexsort((ids, -cosine)) if j != i][:k]
            assert kept[v].tolist() == best and score.tolist() == cosine[best].tolist()


def test_vectors_are_met_once():
    rng = np.random.default_rng(8)
    orders = np.argsort(rng.random((300, 20)), axis=1).astype(np.uint8)
    own, posted, probes = orders[0], 4, 7
    files = np.argsort(own)[:probes]
    held = [np.flatnonzero(orders[:, p] < posted) for p in files]
    met = [h[ann.first_met(own, orders[h], p, posted)].tolist() for p, h in zip(files, held)]
    assert sorted(sum(met, [])) == sorted(set(np.concatenate(held).tolist())) and len(met[-1]) < len(held[-1])


def test_footrule_decides_what_is_reranked(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=24).round(3).tolist()) for i in range(2000)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    compared, expected = [], plain(rows, range(0, 2000, 50))
    for least in (40, 400):
        monkeypatch.setattr(ann, "RERANKED", least)
        monkeypatch.setattr(ann, "RERANKED_BY_ROOT", 0)
        got = found(ann.nearest(df, F.col("vec_id") % 50 == 0))
        compared.append(sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected) / (5 * len(expected)))
    assert 0.4 < compared[0] < compared[1] and compared[1] > 0.85
