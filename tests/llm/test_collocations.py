"""Phrases against plain counting, filters against dictionaries, and the query against its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_support import DOCS, clashing

from gavelstream.llm import collocations as c
from gavelstream.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=4, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = tuple(w for w in re.split("[ \t]", piece) if w)
            n[lang] += len(words)
            f.update((lang, words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = []
    candidates = [(lang, g) for (lang, g), a in f.items() if len(g) > 1 and a >= least]
    for lang, g in candidates:
        a = f[lang, g]
        if any(of == lang and len(h) > len(g) and 100 * f[of, h] >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h)))
               for of, h in candidates):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        found.append((lang, -score, -a, " ".join(g).encode(), left, right))
    out = []
    for lang in n:
        ranked = sorted(x for x in found if x[0] == lang)[:top]
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (_, s, a, p, left, right) in enumerate(ranked)]
    return sorted(out)


def texts(rng, n):
    words = ["a", "B", "new", "York", "é", "the", "of", "x\xa0y", "\x00", "zz", " "]
    for i in range(n):
        text = "".join(rng.choice(words + ["New York", "the end of"]) + rng.choice([" "] * 6 + ["\t", "  ", ". ", ",", "\n", "\x0b", "!?"])
                       for _ in range(rng.randrange(60)))
        yield rng.choice([None, "", text, text]), rng.choice([None, "en", "de", "und", ""])


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS)
    return clashing(df.repartition(3)) if rows else df


@pytest.mark.parametrize("slice_bytes, shard, least", [(4 << 20, 1 << 20, 3), (300, 8, 3), (1000, 100, 1)])
def test_against_plain_counting(spark, monkeypatch, slice_bytes, shard, least):
    real = c.slices
    monkeypatch.setattr(c, "slices", lambda batch, column: real(batch, column, slice_bytes))
    monkeypatch.setattr(c, "SHARD", shard)
    rows = list(texts(random.Random(least + shard), 60))
    got = sorted(map(tuple, c.collocations(frame(spark, rows), least=least).collect()))
    assert got == plain(rows, least) and got


def test_top_and_longest(spark):
    rows = list(texts(random.Random(1), 40))
    got = sorted(map(tuple, c.collocations(frame(spark, rows), least=2, longest=3, top=4).collect()))
    assert got == plain(rows, 2, 3, 4)
    assert c.collocations(frame(spark, rows), longest=1).count() == 0


def test_empty_tables_and_texts(spark):
    assert c.collocations(frame(spark, [])).count() == 0
    assert c.collocations(frame(spark, [(None, "en"), ("", None), (" .\t", "en"), ("one word", "en")])).count() == 0
    long = "new york " * 40_000
    assert [tuple(r) for r in c.collocations(frame(spark, [(long, "en")])).collect()] == plain([(long, "en")], 30)


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 17), (2, 32), (2, 60), (3, 7), (3, 21), (3, 40), (4, 9), (4, 16), (4, 27), (4, 32)])
def test_filters_lose_nothing(n, bits):
    rng = random.Random(n * bits)
    packing = c.Packing(n, bits)
    grams = [tuple(rng.randrange(1, 1 << bits) for _ in range(n)) for _ in range(400)] + [((1 << bits) - 1,) * n]
    given = [rng.choice(grams) for _ in range(5000)]
    columns = [np.array(x, np.int64) for x in zip(*given, strict=True)]
    high, low = packing.pack(columns)
    assert [x.tolist() for x in packing.unpack(high, low)] == [x.tolist() for x in columns]
    assert len(set(zip(*(x.tolist() for x in packing.permuted(high, low)), strict=True))) == len(set(given))
    for shard_bits in (0, min(3, packing.half), min(40, packing.half)):
        shards = {}
        for a in range(0, 5000, 1000):
            one, entry = c.Filter.counted(packing, *packing.permuted(high[a:a + 1000], low[a:a + 1000]))
            numbers, begins = one.parts(shard_bits)
            for number, x, y in zip(numbers.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                shards.setdefault(number, []).append(c.Filter.read(packing, one.write(x, y, shard_bits), number, shard_bits))
        total = Counter()
        for filters in shards.values():
            whole, entries = c.Filter.merged(filters)
            ids = zip(*(x.tolist() for x in packing.unpack(*packing.restored(whole.high, whole.low))), strict=True)
            total.update(dict(zip(ids, whole.counts.tolist(), strict=True)))
            assert [whole.high[e].tolist() for e in entries] == [f.high.tolist() for f in filters]
        assert total == Counter(given)


def test_counts_beyond_a_byte():
    values = np.array([0, 1, 254, 255, 256, 1 << 40], np.int64)
    assert c._read_small(c._small(values), 6).tolist() == values.tolist()
    for width in (0, 1, 7, 8, 9, 33, 64):
        values = np.array([random.getrandbits(width) if width else 0 for _ in range(99)], np.uint64)
        assert c.unpacked(c.packed(values, width), width, 99).tolist() == values.tolist()


def test_whole_table_against_sql(spark):
    path = "/root/testdata/sf0.001"
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    expected = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op11_collocations']})").fetchall())
    got = queries.op11_collocations(spark, path)
    assert got.columns == names and sorted(map(tuple, got.collect())) == expected and expected
