"""Budgets by pouring by hand, and what the mix takes."""

from collections import defaultdict
from fractions import Fraction

import pytest
from llm_support import clashing, docs  # noqa: F401

from gavelstream.llm import mixing


def poured(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = Fraction(share) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > most * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        free -= full
    return {**{s: weight[s] * level for s in free}, **target}


CASES = [
    {"a": [5, 3], "b": [100, 7, 0], "c": [1] * 20, "d": [9], None: [4, 4]},
    {"z": [1000], "é": [1, 2, 3], "~": [50] * 4, "A": [0, 0]},
    {"only": [3, 4]}, {"e": [0]}, {None: [2, 2, 2]},
    {f"s{i}": [i] * 3 for i in range(25)},
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_targets_and_takings(spark, case, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    rows = [(i, " \n".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, sizes in CASES[case].items() for n in sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(clashing(df)).collect()
    again = mixing.mix(df.repartition(1)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)
    total, taken = {s: sum(n) for s, n in CASES[case].items()}, defaultdict(int)
    expected = poured(total)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == total[r.source] and abs(r.target - float(expected[r.source])) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(expected[s]) for s in total)


def test_cut_is_by_random_key(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'one two' AS text", "if(id < 2900, 'big', 'small') AS source")
    found = mixing.mix(df, weights=(1, 1), share=0.5).where("source = 'big'").collect()
    got = {r.doc_id for r in found if r.taken}
    assert abs(len(got) - len(found) * 0.48) < 100
    assert abs(sum(got) / len(got) - 1450) < 120
    other = {r.doc_id for r in mixing.mix(df, weights=(1, 1), share=0.5, seed="other").where("source = 'big' AND taken > 0").collect()}
    assert len(got & other) < 0.7 * len(got)


def test_nulls_and_repeated_rows(docs, spark):
    given = docs([(1, "a b"), (1, "a b"), (None, None), (2, ""), (None, "c " * 10_000), (3, None)])
    found = mixing.mix(given).collect()
    assert len(found) == 6 and sorted(r["size"] for r in found) == [0, 0, 0, 2, 2, 10_000]
    assert mixing.mix(docs([])).count() == 0
