"""Repairs against a search over all edits in order of cost and initials."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from llm_support import clashing

from gavelstream.llm import queries
from gavelstream.llm import turn_repair as t

ROWS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        if not text.strip(SPACES):
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        elif text.rstrip(SPACES)[-1] not in ".!?":
            found.append("truncated")
        else:
            found.append(None)
        seen.add((role, text))
    return found


def plain(rows):
    """(cost, edits, repaired) of (role, text) rows by uniform cost; edits are tried one after another, roles freely."""
    fault = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, initials, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, edits, [f"{r}:{x}" for r, x in out]
        if (at, initials[-1:], bool(initials)) in done or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        done.add((at, initials[-1:], bool(initials)))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, edits + "I", at, initials + role[0], (*out, (role, ""))))
        if at == len(rows):
            continue
        role, text = rows[at]
        heapq.heappush(heap, (cost + 4, edits + "D", at + 1, initials, out))
        if fault[at] in ("blank", "duplicate"):
            continue
        more = 3 * (fault[at] == "truncated")
        if role:
            heapq.heappush(heap, (cost + more, edits + "K", at + 1, initials + role[0], (*out, (role, text))))
        for to in ("user", "assistant"):
            heapq.heappush(heap, (cost + more + 3, edits + "R", at + 1, initials + to[0], (*out, (to, text))))


def expected(rows):
    """Of (turn, role, text) rows in order."""
    cost, edits, out = plain([r[1:] for r in rows])
    fault = faults([r[1:] for r in rows])
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def in_order(rows):
    def key(row):
        turn, role, text = row
        return turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).digest()
    return sorted(((turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows), key=key)


def found(spark, rows):
    given = clashing(spark.createDataFrame(rows, ROWS).repartition(3)) if rows else spark.createDataFrame([], ROWS)
    audits = t.audit(given)
    hashes = {r.conv_id: r.repaired_sha256 for r in t.digest(t.repaired(given, audits)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = [(r[0], (*r[1:], hashes.get(r[0], empty))) for r in audits.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


def test_against_uniform_cost(spark):
    rng = random.Random(3)
    rows, cases = [], {}
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "us", None]
    texts = ["Yes.", "No", "a\n.\t", " \x0b", "", None, "é!", "\xa0", "why?", "so it is.", "x.y"]
    for conv in [None, *range(150)]:
        case = []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            case.append((rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.2:
                case.append(case[-1])
        cases[conv] = expected(in_order(case))
        rows += [(conv, *r) for r in case]
    assert found(spark, rows) == cases


def test_long_conversations_in_stretches(monkeypatch):
    rng = random.Random(5)
    for stretch in (1, 2, 7, 64):
        monkeypatch.setattr(t, "STRETCH", stretch)
        for n in (0, 1, 2, 3, 20, 100, 300):
            codes = [rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 8]) for _ in range(n)]
            rows = [("" if c == 8 else "suax"[c % 4], "" if c == 8 else f"{i}" + "." * (c < 4)) for i, c in enumerate(codes)]
            assert t.cheapest(bytes(codes)) == plain(rows)[:2]


def test_work_grows_with_the_rows():
    codes = bytes(random.Random(7).choice([0, 1, 1, 2, 2, 3, 5, 6, 8]) for _ in range(50_000))
    cost, edits = t.cheapest(codes)
    assert cost > 0 and len(edits.replace("I", "")) == len(codes)


def test_empty_long_and_extreme(spark):
    assert found(spark, []) == {}
    rows = [(1, -(1 << 63), "user", "x" * 300_000), (1, (1 << 63) - 1, "assistant", " " * 300_000 + "!")]
    got = found(spark, rows)[1]
    assert got[0] == (1 << 63) - 1 and got[1:7] == (0, 0, 1, 0, 3, "KK")
    assert found(spark, [(1, None, "user", "a."), (1, None, "assistant", "b.")])[1][:7] == (0, 0, 0, 0, 0, 6, "IKKI")


def test_damage_and_whole_table(spark, tmp_path):
    rng = random.Random(11)
    rows = [(c, n, rng.choice(["user", "assistant", "system", None]), rng.choice(["Well. It is!", "no", None, "so."]))
            for c in [None, *range(60)] for n in [None, 0, 1, 2, 5]]
    spark.createDataFrame(rows, ROWS).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    cases = {}
    for c in {r[0] for r in rows}:
        case = []
        for conv, turn, role, text in rows:
            if conv != c:
                continue
            key = ":".join(" " if v is None else str(v) for v in (conv, turn))
            kind, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            case += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        cases[c] = expected(in_order(case))
    got = queries.op13_turns(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == cases
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op13_turns']})").fetchall()
    assert {r[0]: r[1:] for r in found} == cases and len(found) == len(cases)


@pytest.mark.parametrize("rows, result", [
    ([], (0, "")),
    ([("user", "a.")], (3, "KI")),
    ([("assistant", "a.")], (3, "IK")),
    ([("system", "a.")], (4, "D")),
    ([("user", "a."), ("user", "b.")], (3, "KR")),
    ([("user", "a"), ("assistant", "b.")], (3, "KK")),
])
def test_small_cases(rows, result):
    codes = bytes({"system": 0, "user": 1, "assistant": 2}[r] + 4 * (x[-1] != ".") for r, x in rows)
    assert t.cheapest(codes) == result == plain(rows)[:2]
