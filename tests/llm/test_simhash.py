"""Fingerprints bit by bit, and components against all pairs."""

import random
import time

import numpy as np
import pytest
import xxhash
from llm_support import clashing, docs, rows_of  # noqa: F401

from gavelstream.llm import simhash


def plain_fingerprint(text, n=3):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(points, most=3):
    parent = {p: p for p in points}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    points = np.array(sorted(points), np.uint64)
    for i in range(0, len(points), 256):
        for a, b in zip(*np.nonzero(np.bitwise_count(points[i:i + 256, None] ^ points[None]) <= most)):
            x, y = sorted((top(int(points[i + a])), top(int(points[b]))))
            parent[y] = x
    return {p: top(p) for p in parent}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO", "a b c", "É x É x É x É", "w " * 5000, "\x0ba\x0cb\x1cc d", "A,b C"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hashes_alike(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = [base]
    for flips in (1, 3, 4):
        near = base[: n // 2].copy()
        for _ in range(flips):
            near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
        out.append(near)
    ball = np.full(300, base[0])
    for _ in range(2):
        ball ^= np.uint64(1) << rng.integers(0, 64, len(ball)).astype(np.uint64)
    chain = base[1] ^ (np.uint64(2) ** np.arange(0, 60, dtype=np.uint64) - np.uint64(1))
    return sorted({int(x) for x in np.concatenate([*out, ball, chain, np.array([0, 2**64 - 1], np.uint64)])})


@pytest.mark.parametrize("leaf, shard, most_bits", [(512, 8192, 3), (8, 64, 3), (16, 100, 2), (8, 50, 5)])
def test_all_pairs_within_the_distance_are_tied(spark, monkeypatch, leaf, shard, most_bits):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SHARD", shard)
    points = planted(700, leaf + most_bits)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "fingerprint long").repartition(3)
    expected = plain_classes(points, most_bits)
    parent = {p: p for p in points}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash.linked_fingerprints(df, most_bits).collect():
        a, b = a % 2**64, b % 2**64
        assert expected[a] == expected[b]
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert {p: top(p) for p in points} == expected


def test_components_over_documents(docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    given = [(0, None), (1, ""), (2, " \n"), (3, "one"), (None, "one"), (None, "lonely text without a number")]
    for i in range(10, 60):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 300))]
        given.append((1000 - i, " ".join(text)))
        given.append((i, "  ".join(text).upper()))
        if len(text) > 200:
            text[7] = "changed"
            given.append((2000 + i, " ".join(text)))
    given.append((3, "one"))
    got = simhash.near_duplicates(clashing(docs(given)))
    classes = plain_classes({plain_fingerprint(t) for _, t in given})
    least = {}
    for i, t in given:
        c = classes[plain_fingerprint(t)]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    expected = sorted(((i, plain_fingerprint(t), least[classes[plain_fingerprint(t)]]) for i, t in given), key=repr)
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got.collect()), key=repr) == expected
    assert simhash.near_duplicates(docs([])).count() == 0
    kept = simhash.representatives(docs(given))
    assert rows_of(kept.where("doc_id IS NOT NULL"), "doc_id") == sorted(
        {(c,) for c in least.values() if c is not None}, key=repr)
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash.representatives(docs([])).count() == 0


def test_rows_that_share_an_id(docs):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) + str(rng.randrange(999)) for _ in range(80)) for _ in range(12)]
    given = [(1, t) for t in texts[:6]] + [(2, t) for t in texts[3:9]] + [(3, texts[0]), (4, texts[9]), (5, texts[9]), (1, texts[2])]
    expected = [(1, t) for t in texts[:6]] + [(2, t) for t in texts[6:9]] + [(4, texts[9])]
    for parts in (1, 4):
        kept = simhash.representatives(clashing(docs(given)).repartition(parts))
        assert rows_of(kept, "doc_id", "text") == sorted(expected, key=repr) and "key" in kept.columns


@pytest.mark.parametrize("side", [0, 1])
def test_points_that_share_a_half(side):
    rng = np.random.default_rng(11)
    other = np.unique(rng.integers(0, 1 << 32, 6000, dtype=np.uint64))
    other = np.unique(np.concatenate([other, *(other[:900] ^ np.uint64(m) for m in (1, 1 << 20 | 1 << 3, 7 << 13, 15 << 9))]))
    points = other << np.uint64(32) | np.uint64(5) if side == 0 else other | np.uint64(5 << 32)
    points = np.concatenate([points, points[:50] ^ np.uint64(1 << (32 * side))])
    home = rng.random(len(points)) < 0.8
    root = simhash.search(points, home, side, 3)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    a, b = np.nonzero(near & (home[:, None] | home[None, :]))
    assert (root[a] == root[b]).all()
    tied = np.flatnonzero(root != np.arange(len(root)))
    assert len(tied) > 1000 and near[np.ix_(tied, range(len(points)))].sum(1).min() > 1


def test_many_points_that_share_a_half_take_little_time():
    rng = np.random.default_rng(12)
    points = np.unique(rng.integers(0, 1 << 32, 100_000, dtype=np.uint64))
    started = time.perf_counter()
    simhash.search(points << np.uint64(32), np.ones(len(points), bool), 0, 3)
    assert time.perf_counter() - started < 10
