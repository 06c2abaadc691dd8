"""Removed bytes against every window of every text."""

import random
from collections import Counter

import pytest
from llm_support import clashing, docs, rows_of  # noqa: F401

from gavelstream.llm import suffix_repeats as s


def plain(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        spans, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and covered[j] == covered[i]:
                j += 1
            if covered[i]:
                spans.append((i, j))
            i = j
        out.append((len(t), spans, bytes(b for b, c in zip(t, covered) if not c)))
    return out


@pytest.mark.parametrize("length", [*range(2, 40, 3), 100, 336, 337, 400, 1000])
def test_cover_has_every_difference(length):
    plan = s.plan_for(length)
    assert {(a - b) % plan.period for a in plan.cover for b in plan.cover} == set(range(plan.period))
    assert plan.short >= 1 and plan.long >= 1 and plan.step * s.PARTS >= plan.period and plan.piece % plan.period == 0


def test_perfect_difference_set():
    differences = Counter((a - b) % s.PERIOD for a in s.COVER for b in s.COVER if a != b)
    assert set(differences.values()) == {1} and len(differences) == s.PERIOD - 1


@pytest.mark.parametrize("length, slice_bytes", [(5, 700), (20, 3000), (400, 5000), (400, 4 << 20)])
def test_against_all_windows(docs, monkeypatch, length, slice_bytes):
    monkeypatch.setattr(s, "SLICE", slice_bytes)
    monkeypatch.setattr(s, "SORTED_NAMES", 300)
    rng = random.Random(length)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(length * 5))) for _ in range(15)]
    texts = [None, "", "x", *base]
    for _ in range(20):
        text = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            text += b[a:a + rng.randint(0, 3 * length)] + rng.choice(["", "Q", "zz"])
        texts.append(text)
    texts += [base[0], base[0], "ab" * length, "z" * (length + 1), "y" * length, "é" * length]
    found = s.remove_repeats(clashing(docs(list(enumerate(texts)))), length=length)
    got = {r.doc_id: (r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in found.collect()}
    assert got == dict(enumerate(plain(texts, length))) and found.count() == len(texts)


def test_repeated_ids_and_empty_tables(docs):
    text = "".join(random.Random(1).choice("abc") for _ in range(900))
    found = s.remove_repeats(docs([(1, text), (1, text[:700] + "#"), (None, "#" + text[300:])]))
    assert sorted(r.n_bytes - len(r.kept) for r in found.collect()) == [600, 700, 900]
    assert s.remove_repeats(docs([])).count() == 0
    assert rows_of(s.remove_repeats(docs([(1, "short")])), "doc_id", "n_bytes") == [(1, 5)]
    with pytest.raises(ValueError):
        s.remove_repeats(docs([]), length=1)
