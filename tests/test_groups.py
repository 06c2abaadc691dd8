"""Stateful processors over groups of keys: calls and state by the group, rows as if each key stood alone."""

import random

import pytest
from conftest import auction_rows, bid_rows, person_rows, rows

from gavelstream.operators.joins import Shares
from gavelstream.plans import batch
from gavelstream.streaming import firings, keyed
from gavelstream.streaming.runner import run_discarding, run_to_table

FAR = 100_000
STATES = ["OR", "CA", None]


def given(seed, sellers=60):
    """Files of auctions and of persons, times rising from file to file; a seller's name may be missing."""
    rng = random.Random(seed)
    listed = [[(2**61 + 1000 * f + i, rng.randrange(sellers), 10, 5, f * 50 + rng.randrange(400) / 8) for i in range(150)] for f in range(2)]
    known = [[(rng.randrange(sellers), rng.choice(["Ann", "Bo", None]), f"c{i % 4}", rng.choice(STATES), f * 50 + rng.randrange(400) / 8)
              for i in range(90)] for f in range(2)]
    return listed, known


def text_first(got):
    return sorted(tuple(map(str, r)) for r in got)


def keys_held(progress, name):
    """Keys of the processors' states after each micro-batch with input."""
    return [op["numRowsTotal"] for p in progress if p["numInputRows"] for op in p["stateOperators"] if op["operatorName"].startswith(name)]


def joined(listed, known):
    return text_first((*p[1:4], a[0]) for f in listed for a in f for g in known for p in g if a[1] == p[0])


def test_expiring_join(stream):
    listed, known = given(1)

    def df(**options):
        return keyed.expiring_join(stream(*[auction_rows(*f) for f in listed]), stream(*[person_rows(*f) for f in known]), "1 day", **options)
    for options in ({"groups": 3}, {"groups": 2, "shares": Shares(3, hot=[1, 2])}):
        assert text_first(run_to_table(df(**options), "expiring", empty_batches=False).collect()) == joined(listed, known)
    held = keys_held(run_discarding(df(groups=3), "held", empty_batches=False), "transformWithState")
    assert held and max(held) < 60


def test_as_of(stream, table):
    listed, known = given(2)
    auctions, persons = [auction_rows(*f) for f in listed], [person_rows(*f) for f in known]
    expected = text_first(batch.local_items_latest(table(auctions[0]).union(table(auctions[1])), table(persons[0]).union(table(persons[1])),
                                                   states=["OR", "CA"]).collect())
    assert len(expected) > 100
    persons = [p[p["state"].notna()] for p in persons]
    ends = auction_rows((-1, -1, 10, 0, FAR)), person_rows((-2, "End", "Salem", "OR", FAR))
    df = keyed.lookup_as_of(stream(*auctions, ends[0]), stream(*persons, ends[1]), chunk="5 seconds", groups=3)
    assert text_first(r for r in run_to_table(df, "as-of").collect() if r[3] != -1) == expected


def test_pending(stream):
    listed, known = given(3)
    late = [(2**61 + 7, 999, 10, 5, 1.0)]
    # persons only with the second file: what came first waits
    auctions = [auction_rows(*listed[0], *late), auction_rows(*listed[1])]
    persons = [person_rows((777, "No", "Napa", "CA", 0)), person_rows(*known[1])]
    newest = {}
    for p in known[1]:
        key = (p[4], [(t is not None, t or "") for t in p[1:4]])
        newest[p[0]] = max(newest.get(p[0], (key, p)), (key, p), key=lambda n: n[0])
    expected = text_first((*newest[a[1]][1][1:4], a[0]) for f in listed for a in f if a[1] in newest)
    df = keyed.pending_join(stream(*auctions), stream(*persons), wait="1 hour", groups=3)
    assert text_first(run_to_table(df, "pending").collect()) == expected


@pytest.mark.parametrize("groups", [1, 4])
def test_firings_by_slots(stream, table, groups):
    rng = random.Random(4)
    bids = sorted(((i, rng.randrange(40), 1, rng.randrange(480) / 8) for i in range(600)), key=lambda b: b[3])
    frames = [bid_rows(*rng.sample(part, len(part))) for part in (bids[:250], bids[250:300], bids[300:])]
    expected = rows(batch.session_firings(table(bid_rows(*bids)), "4 seconds", 3))
    end = bid_rows((-1, -1, 0, FAR))
    df = firings.session_firings_by_slots(stream(*frames, end), "4 seconds", 3, slot="1 second", groups=groups)
    assert [r for r in rows(run_to_table(df, "firings")) if r[0] != -1] == expected
    progress = run_discarding(firings.session_firings_by_slots(stream(*frames, end), "4 seconds", 3, slot="1 second", groups=groups), "held")
    held = keys_held(progress, "transformWithState")
    # of each group the open sessions, the first timer and its index
    assert held and max(held) <= 5 * groups


def test_groups_are_one_or_more(stream):
    with pytest.raises(ValueError):
        firings.session_firings_by_slots(stream(bid_rows((1, 1, 1, 1))), "4 seconds", 3, groups=0)
