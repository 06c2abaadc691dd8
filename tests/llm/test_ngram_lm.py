"""Stupid-backoff scores against counters."""

import math
import random
from collections import Counter

import pytest
from llm_support import clashing, docs  # noqa: F401

from gavelstream.llm import ngram_lm as lm


def plain(texts, order, cutoff, backoff):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    texts = [(t or "").encode().translate(lower).split() for t in texts]
    counts = [Counter(tuple(w[i - k + 1:i + 1]) for w in texts for i in range(k - 1, len(w))) for k in range(1, order + 1)]
    total = sum(map(len, texts))
    out = []
    for w in texts:
        score = 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            for k in range(most, 0, -1):
                gram = tuple(w[i - k + 1:i + 1])
                if k == 1 or counts[k - 1][gram] >= cutoff:
                    below = total if k == 1 else counts[k - 2][gram[:-1]]
                    score += math.log(counts[k - 1][gram] / below) + (most - k) * math.log(backoff)
                    break
        out.append((len(w), round(score, 6)))
    return out


@pytest.mark.parametrize("slice_bytes, order, cutoff", [(50, 3, 2), (1000, 2, 1), (4 << 20, 4, 3), (30, 3, 2), (20, 1, 1)])
def test_against_counters(docs, monkeypatch, slice_bytes, order, cutoff):
    monkeypatch.setattr(lm, "SLICE", slice_bytes)
    monkeypatch.setattr(lm, "TABLE_NGRAMS", 50)
    rng = random.Random(order)
    words = ["a", "b", "The", "the", "é", "cc" * 40, "x"]
    texts = [None, "", "  \n"] + ["".join(rng.choice(words) + rng.choice([" ", "\n", " \t "]) for _ in range(rng.randrange(60)))
                                  for _ in range(50)]
    texts += texts[5:9]
    rows = [*enumerate(texts), (3, "a b the a b"), (None, "the a")]
    found = lm.backoff_scores(clashing(docs(rows)), order=order, cutoff=cutoff)
    got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in found.collect())
    expected = plain([t for _, t in rows], order, cutoff, 0.4)
    assert got == sorted((str(i), *e) for (i, _), e in zip(rows, expected))
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in found.collect())


def test_pieces_repeat_their_context():
    text = b"one two  three four five six"
    lm_slice, lm.SLICE = lm.SLICE, 10
    try:
        pieces = list(lm._pieces(text, 2))
    finally:
        lm.SLICE = lm_slice
    assert [p.split()[skip:] for p, skip in pieces] == [[b"one", b"two", b"three"], [b"four", b"five"], [b"six"]]
    assert all(skip == 2 for _, skip in pieces[1:])


def test_parameters_and_empty_table(docs, spark):
    assert lm.backoff_scores(docs([])).count() == 0
    for options in ({"order": 0}, {"cutoff": 0}, {"backoff": 0}, {"backoff": 2}):
        with pytest.raises(ValueError):
            lm.backoff_scores(docs([]), **options)
    named = spark.createDataFrame([("k", "a a")], "doc_id string, text string")
    assert lm.backoff_scores(named).first().doc_id == "k"
