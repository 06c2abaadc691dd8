"""Containment against sets of shingles."""

import random
import re

import duckdb
import pytest
from llm_support import clashing, docs, rows_of  # noqa: F401

from gavelstream.llm import decontaminate as d
from gavelstream.llm import queries


def shingles(text, n=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").translate(lower))
    return {" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain(docs, items, share=0.8):
    def by_id(rows):
        out = {}
        for i, t in rows:
            if i is not None:
                out.setdefault(i, set()).update(shingles(t))
        return out

    docs, items = by_id(docs), by_id(items)
    return sorted((i, j, len(b), len(a & b)) for i, a in docs.items() for j, b in items.items() if b and len(a & b) >= share * len(b) - 1e-9)


@pytest.mark.parametrize("entries", [0, 1 << 20])
def test_against_sets(spark, docs, monkeypatch, entries):
    monkeypatch.setattr(d, "LOOKUP_ENTRIES", entries)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["É", "été", "X-y"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 9, 30, 70])))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "..."), (None, "w1 w2 w3 w4 w5"), (53, items[5][1]), (54, "same same " * 30), (5, "w1 w2 w3 w4 w5 w6")]
    given = [(900, None), (901, ""), (None, items[9][1]), (902, "same " * 500)]
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 0, 1, 1, 3, 6])):
                if item:
                    item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in item]
        given.append((i, rng.choice([" ", "\n", " - "]).join(text)))
    given += given[10:14] + [(903, " ".join(["w7"] * 60_000) + " " + items[30][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = d.contained(clashing(docs(given)), clashing(table))
    expected = plain(given, items)
    assert rows_of(found, "doc_id", "item_id", "n_shingles", "n_shared") == sorted(expected, key=repr) and len(expected) > 30
    assert all(r.containment == r.n_shared / r.n_shingles for r in found.collect())


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.contained(docs([(1, "a b c d e f")]), none).count() == 0
    assert d.contained(docs([]), some).count() == 0
    assert d.contained(docs([(1, "x a b c d e f y")]), some).count() == 1


@pytest.mark.parametrize("entries", [0, 1 << 20])
def test_short_items_inside_long_documents(spark, docs, monkeypatch, entries):
    monkeypatch.setattr(d, "LOOKUP_ENTRIES", entries)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(i % 7))) for i in range(40)] + [(3, "w1 w2"), (None, "w3")]
    given = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 30])))) for i in range(60)]
    lengths = {n for i, t in items if i is not None and 0 < (n := len(t.split())) < 5}
    expected = []
    for i, text in given:
        has = shingles(text).union(*(shingles(text, n) for n in lengths))
        for j in {j for j, _ in items} - {None}:
            b = set().union(*(shingles(t) for k, t in items if k == j))
            if b and len(has & b) >= 0.8 * len(b) - 1e-9:
                expected.append((i, j, len(b), len(has & b)))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = d.contained(docs(given), table, short_items=True)
    assert rows_of(found, "doc_id", "item_id", "n_shingles", "n_shared") == sorted(expected, key=repr)
    assert len(expected) > d.contained(docs(given), table).count()
    con = duckdb.connect()
    con.register("documents", docs(given).toPandas())
    con.register("benchmark", table.selectExpr("item_id", "text").toPandas().astype({"item_id": "Int64"}))
    sql = con.execute(queries.oracle_sql()["op9_decontamination"]).fetchall()
    assert sorted((r[:4] for r in sql), key=repr) == sorted(expected, key=repr)


def test_query_finds_short_items(spark, tmp_path):
    spark.createDataFrame([(1, "far away a Short item stands"), (2, "short items"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "short, item"), (8, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in queries.op9_decontamination(spark, str(tmp_path)).collect()] == [(1, 7, 1, 1, 1.0)]
