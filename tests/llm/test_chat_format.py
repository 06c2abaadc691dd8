"""Formatted conversations read back, templates of several kinds, and the query against plain hashes and SQL."""

import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_support import clashing

from gavelstream.llm import chat_format as c
from gavelstream.llm import queries

ROWS = "conv_id long, turn long, role string, text string"
SIGNS = st.lists(st.sampled_from([*"<>[]/\\s INSTYURo\n", "[INST]", "</s>", "[/SYS]", "[TURN]", " [/INST]"]), max_size=30).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[TURN]x", "a\nb"]), SIGNS), max_size=6), st.randoms())
def test_round_trip(turns, rng):
    text = c.INSTRUCTIONS.render(turns)
    reader, found, at = c.Reader(), [], 0
    while at < len(text):
        n = rng.randint(1, 9)
        found += reader.read(text[at:at + n])
        at += n
    assert found == turns and reader.rest == ""


@settings(max_examples=500, deadline=None)
@given(SIGNS)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    out = c.escaped(text)
    assert c.unescaped(out) == text
    assert not any(mark.strip() in out for mark in (c.OPENS, c.SYSTEM, c.END_SYSTEM, c.USER, c.END_USER, c.END_ASSISTANT, c.OTHER, c.END_OTHER))


def rendered(template, turns):
    now = c._Rendering(template, {"assistant"})
    return [now.add(*t) for t in turns]


def plain_template(turns):
    return "".join(f"<{r}>{x}</{r}>" for r, x in turns)


def trimming(turns):
    return "".join(f"{r}: {x.strip()}\n" for r, x in turns)


def only_last_thought(turns):
    """Leaves out what is thought in all turns but the last."""
    return "".join(f"{r}: {x if i == len(turns) - 1 else x.split('=')[-1]}\n" for i, (r, x) in enumerate(turns))


def counting(turns):
    return f"{len(turns)} turns\n" + plain_template(turns)


TURNS = [("system", "be"), ("user", "0"), ("assistant", "1 1"), ("user", ""), ("assistant", "a=b"), ("user", "</user>x")]


@pytest.mark.parametrize("template", [plain_template, trimming])
@pytest.mark.parametrize("looks_back", [None, 0, 1, 3])
def test_spans_of_a_black_box(template, looks_back):
    rows = rendered(c.Template(template, looks_back), TURNS)
    whole = "".join(r[2] for r in rows)
    assert whole == template(TURNS)
    assert [whole[r[3]:r[4]] for r in rows] == [r[2] for r in rows]
    assert [whole[r[5]:r[6]] for r in rows] == [x for _, x in TURNS]
    assert [r[7] for r in rows] == [r == "assistant" for r, _ in TURNS] and not any(r[8] for r in rows)


@pytest.mark.parametrize("template, first", [(only_last_thought, 5), (counting, 0)])
def test_rewritten_history_is_detected(template, first):
    rows = rendered(c.Template(template), TURNS)
    assert [r[8] for r in rows] == [i >= first for i in range(len(TURNS))]
    assert all((r[2] is None) == r[8] and not (r[8] and r[7]) for r in rows)


def test_text_that_a_template_changes_has_no_span():
    rows = rendered(c.Template(lambda turns: "".join(f"[{x[::-1].upper()}]" if r == "user" else "-" for r, x in turns)), TURNS[1:3])
    assert rows[1][5:8] == (None, None, False)


def expected(rows):
    turns = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in rows).encode()).hexdigest()
    loss = "".join(x for r, x in rows if r == "assistant")
    return len(rows), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(c.INSTRUCTIONS.render(rows))


def test_whole_table_against_hashes_and_sql(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "hello", "</s>", "[\\INST] a", "é" * 3, "<\\\\s>", "[/INST]", "x" * 50_000, " "]
    rows = [(conv, rng.choice([None, *range(200)]), rng.choice(["user", "assistant", "system", "tool", None, "[SYS]"]), rng.choice(texts))
            for conv in [None, 0, *range(5, 40)] for _ in range(rng.choice([1, 2, 5, 300 if conv == 0 else 9]))]
    path = str(tmp_path / "conversations.parquet")
    clashing(spark.createDataFrame(rows, ROWS)).repartition(4).write.parquet(path)
    got = queries.op12_chat(spark, str(tmp_path))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert got.columns == names
    cases = {-1: [("user", queries.HOSTILE), ("assistant", queries.HOSTILE)]}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
    for conv in {r[0] for r in rows}:
        cases[conv] = [(r or "", x or "") for k, _, r, x in order if k == conv]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted(((k, *expected(v)) for k, v in cases.items()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op12_chat']})").fetchall(), key=repr) == found


def test_empty_table(spark):
    assert c.formatted(spark.createDataFrame([], ROWS)).count() == 0
    assert c.read_back(c.formatted(spark.createDataFrame([], ROWS))).count() == 0
