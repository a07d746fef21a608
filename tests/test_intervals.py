import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from epochgrid.operators.intervals import FURTHEST, dyadic_blocks, entity_periods, merge_intervals, periods
from epochgrid.operators.timelines import flat_items


def brute(intervals):
    out = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-500, 500), st.integers(0, 80)), max_size=30))
def test_periods(rows):
    g, a, b = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    got = periods(g, 2 * a, 2 * (a + b))
    want = [(k, 2 * x, 2 * y) for k in range(4) for x, y in brute([(p, p + q) for i, p, q in rows if i == k])]
    assert list(zip(*(x.tolist() for x in got))) == want


def test_blocks_are_canonical():
    g, level, k = dyadic_blocks(np.zeros(1, np.int64), np.array([-3]), np.array([12]))
    from epochgrid.operators.intervals import _SHIFT

    cover = sorted((int(x) << int(l), (int(x) + 1) << int(l)) for l, x in zip(level, k))
    assert cover[0][0] - _SHIFT == -3 and cover[-1][1] - _SHIFT == 13
    assert all(a[1] == b[0] for a, b in zip(cover, cover[1:])) and len(cover) <= 2 * max(level) + 2


def test_merge(spark):
    random.seed(2)
    rows = [("hot" if random.random() < 0.4 else f"k{random.randrange(40)}", random.choice([None, "x"]), a := random.randrange(-900, 900), a + random.randrange(-5, 40)) for _ in range(6000)]
    rows += [("k1", "x", None, 5), ("k1", "x", 5, None), (None, "x", 1, 2), ("one", "x", 7, 7), ("one", "x", 8, 8), ("two", "x", 1, 5), ("two", "x", 5, 9), ("far", "x", -(2**40), 2**40), ("further", "x", -(2**60), 2**60)]
    df = spark.createDataFrame([(*r, 0) for r in rows * 2], "key string, sub string, a bigint, b bigint, rel int")  # a clashing name
    got = merge_intervals(df, ["key", "sub"], "a", "b").collect()
    want = set()
    for key in {(r[0], r[1]) for r in rows}:
        found = brute([(a, b) for k, s, a, b in rows if (k, s) == key and a is not None and b is not None and a <= b and abs(a) <= FURTHEST])
        want |= {(*key, "period", a, b) for a, b in found} | {(*key, "gap", x[1], y[0]) for x, y in zip(found, found[1:])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r)[2:] for r in got if r[0] == "one"} == {("period", 7, 7), ("gap", 7, 8), ("period", 8, 8)}
    assert merge_intervals(df.limit(0), ["key"], "a", "b").collect() == []


def test_entity_periods(spark):
    text = '{"polity":[{"from":1,"to":5,"value":{"name":"A","wikidata":" Q1"}},{"value":"A","wikidata":"Q1"},{"from":3,"value":{"name":"B","wikidata":" "}}],"name":[{"from":1,"value":{"text":"x"}}]}'
    df = spark.createDataFrame([("s", text, 20, None), ("s", text, 20, None), ("t", text, None, 4), ("u", None, 1, 2)], "id string, timeline string, inception_year int, dissolution_year int")
    got = {tuple(r) for r in entity_periods(df).collect()}
    assert got == {("s", "polity", "Q1", "period", 1, 5), ("s", "polity", "Q1", "gap", 5, 20), ("s", "polity", "Q1", "period", 20, 9999), ("t", "polity", "Q1", "period", 1, 5)}


def test_vast_years(spark):
    big = 2**59
    rows = [("a", -big, 0), ("a", 5, big), ("a", 0, 5), ("b", 9 * 10**18, 9 * 10**18), ("b", 3 * 10**9, 10**10), ("b", 10**10 + 1, 10**10 + 2), ("c", -(2**62), 3)]
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint")
    got = {tuple(r) for r in merge_intervals(df, ["k"], "a", "b").collect()}
    assert got == {("a", "period", -big, big), ("b", "period", 3 * 10**9, 10**10), ("b", "period", 10**10 + 1, 10**10 + 2), ("b", "gap", 10**10, 10**10 + 1)}


def test_years_beyond_int(spark):
    entry = '{"value": {"name": "x", "wikidata": "Q%d"}, "from": %s, "to": %s}'
    years = [("3000000000", "3000000001"), ("9000000000000000000", "null"), ("-9999999999", "5"), ("1", "3000000000"), ("1", "2")]
    text = '{"polity": [' + ", ".join(entry % (i, *y) for i, y in enumerate(years)) + "]}"
    sites = spark.createDataFrame([("s", text, None, None, None)], "id string, timeline string, inception_year int, dissolution_year int, last_updated timestamp")
    assert {tuple(r) for r in entity_periods(sites).collect()} == {("s", "polity", "Q4", "period", 1, 2)}
    dump = spark.createDataFrame([], "id string, timeline string, extracted_at string")
    assert sorted(r["year"] for r in flat_items(sites, dump).collect()) == [0, 0, 0, 1, 1]
