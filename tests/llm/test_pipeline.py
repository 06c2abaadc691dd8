"""The stages against plain versions, the registered SQL, and the library without this subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from llm_support import ROOT, clashing, docs, rows_of  # noqa: F401
from test_decontaminate import plain as plain_contained
from test_simhash import plain_classes, plain_fingerprint

import __spark_entry__ as registry
import corpus_pipeline
from gavelstream.llm import common, pii, queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", DATA])
def test_same_rows_as_sql(spark, name, data):
    result = registry.queries()[name](spark, data)
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    columns = sorted(result.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows_of(result, *columns) == sorted(expected, key=repr) and expected


def test_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert registry.queries()["pipeline"] is corpus_pipeline.run


def test_stages_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, DATA), "stage")
        if name != "mixing":
            assert docs.columns == before.columns
        after[name] = {r.doc_id: r.asDict() for r in docs.collect()}
        assert len(after[name]) == docs.count() > 0
    score = {r.doc_id: r.predicted for r in queries.op3_quality(spark, DATA).collect()}
    assert after["quality"].keys() == {i for i, p in score.items() if p}
    texts = {i: r["text"] for i, r in after["quality"].items()}
    classes = plain_classes({plain_fingerprint(t) for t in texts.values()})
    least = {}
    for i, t in texts.items():
        least[classes[plain_fingerprint(t)]] = min(i, least.get(classes[plain_fingerprint(t)], i))
    assert after["simhash"].keys() == set(least.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = {i for i, *_ in plain_contained([(i, texts[i]) for i in after["simhash"]], items)}
    assert after["decontamination"].keys() == after["simhash"].keys() - hit and hit
    find = pii.finder()
    for i, r in after["pii"].items():
        assert not [s for s in find(r["text"]) if s[0] in ("email", "phone", "ip")] and r["n_chars"] == len(r["text"])
        if not find(texts[i]):
            assert r["text"] == texts[i]
    assert after["pii"].keys() == after["decontamination"].keys()
    assert after["mixing"].keys() <= after["pii"].keys() and all(0 < r["taken"] <= 2 * r["size"] for r in after["mixing"].values())
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, DATA).collect()} == {
        (i, r["taken"]) for i, r in after["mixing"].items()}


def test_stages_on_odd_rows(spark, docs):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    given = docs([(1, None), (2, ""), (3, "the same words again and again"), (3, "the same words again and again"), (4, "The same words again and again"),
                  (None, "a row without an id"), (None, None), (5, f"before {item} after"), (None, f"so {item} too"), (6, "mail me@example.com")])
    clash = clashing(given)
    kept = corpus_pipeline.drop_near_duplicates(spark, clash, DATA)
    assert kept.columns == clash.columns
    assert rows_of(kept, "doc_id") == sorted([(1,), (3,), (5,), (6,), (None,), (None,), (None,)], key=repr)
    clean = corpus_pipeline.drop_test_items(spark, clash, DATA)
    assert clean.columns == clash.columns and clean.count() == 8
    assert corpus_pipeline.redact(spark, clash, DATA).where("text = 'mail [EMAIL]' AND n_chars = 12").count() == 1
    assert corpus_pipeline.keep_good(spark, clash, DATA).columns == clash.columns
    assert corpus_pipeline.mix(spark, clash, DATA).columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), DATA).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 240)] + [(300, 300), (7, 5), (500, 499)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect())
    assert {got.get(i, i) for i in range(61)} == {0} and {got.get(i, i) for i in (100, *range(200, 240))} == {100} and got[500] == 499
    assert common.components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_the_rest_works_without_this_subpackage(tmp_path):
    for name in ("gavelstream", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    script = "import __spark_entry__ as e; n = e.queries(); assert 'q5_hot_items' in n and n.keys() == e.oracle_sql().keys()"
    assert subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True).returncode == 0
    for path in (Path(ROOT) / "gavelstream").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gavelstream.llm" not in path.read_text()
