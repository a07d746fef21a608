import json

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from epochgrid.operators.arrow import bytes_of
from epochgrid.operators.structural import LIST, OBJECT, JsonIndex, indexed
from epochgrid.operators.timelines import flat_items, timeline_items

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(max_size=12),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4),
    max_leaves=25,
)


def rebuilt(index: JsonIndex, token: int):
    """The value of a token, read back from the links of the index."""
    kind = index.kind[token]
    kids = np.flatnonzero(index.value & (index.parent == token))
    if kind == OBJECT:
        return {json.loads(index.data[index.at[k - 2] : index.end[k - 2]].tobytes()): rebuilt(index, k) for k in kids}
    if kind == LIST:
        assert list(index.ordinal[kids]) == list(range(len(kids)))
        return [rebuilt(index, k) for k in kids]
    return json.loads(index.data[index.at[token] : index.end[token]].tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(VALUES, st.booleans(), st.sampled_from([None, 1])), max_size=6))
def test_round_trip(rows):
    texts = [json.dumps(v, ensure_ascii=a, indent=i) for v, a, i in rows]
    index = JsonIndex(*bytes_of(pa.array(texts, pa.string())))
    assert index.valid.all()
    for (value, _, _), root in zip(rows, index.roots()):
        assert rebuilt(index, root) == value


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(VALUES, st.integers(0, 60), st.sampled_from(list('{}[]",:\\ 0-etru\n'))), min_size=1, max_size=5))
def test_validity_is_that_of_json(rows):
    texts = []
    for value, at, sign in rows:
        text = json.dumps(value)
        at = min(at, len(text))
        texts.append(text[:at] + sign + text[at + 1 :])
    index = JsonIndex(*bytes_of(pa.array(texts, pa.string())))
    for text, valid in zip(texts, index.valid):
        try:
            json.loads(text, parse_constant=lambda x: 1 / 0)
            good = True
        except (ValueError, ZeroDivisionError):
            good = False
        assert valid == good, text


def test_odd_texts():
    texts = ["", " ", None, "nul", "[1,]", '{"a":1}x', '"' + json.dumps({"a": 1}).replace('"', '\\"') + '"', '{"a":1,"a":2}', "[" * 600 + "]" * 600, '"\\ud800"', "\x01"]
    index, rows = indexed(pa.array(texts, pa.string()))[0]
    assert list(index.valid) == [False, False, False, False, False, False, True, True, True, True, False]
    inner, at = indexed(pa.array(texts, pa.string()))[1]
    assert at[0] == 6 and inner.valid[0]
    f = index.fields(["a"])["a"]
    assert index.numbers(f[index.roots()])[7].as_py() == 2
    assert index.texts(index.roots()).to_pylist()[9] == "�"


def test_numbers():
    texts = ["5", '"-12"', '" 7 "', "1.9", '"x"', "null", "1e3", "99999999999999999999", "true"]
    index = JsonIndex(*bytes_of(pa.array(texts, pa.string())))
    assert index.numbers(index.roots()).to_pylist() == [5, -12, 7, 1, None, None, 1000, None, None]


TIMELINE = {
    "site_type": {"entries": [{"from": -5, "value": "town"}, {"value": None}]},
    "polity": [{"from": "12", "to": 14, "value": {"name": "A", "wikidata": " Q1 "}}, {"from": None, "value": "B", "wikidata": "Q2"}],
    "population": {"entries": [{"from": 1, "value": 1200}, {"from": 2, "value": "7"}]},
    "name": {"entries": [{"from": 3, "value": {"text": "Ü\"x", "lang": "de"}}]},
    "events": [{"year": 9, "type": "siege"}, 5, {"type": "fire"}],
    "missing_entities": None,
    "other": [{"from": 1}],
}
ROWS = {
    ("site_type", 0, -5, "town"), ("site_type", 1, None, None), ("polity", 0, 12, "A"), ("polity", 1, None, "B"), ("population", 0, 1, "1200"),
    ("population", 1, 2, "7"), ("name", 0, 3, 'Ü"x'), ("events", 0, 9, "siege"), ("events", 2, None, "fire"),
}


def test_forms(spark):
    bare = {k: v["entries"] if isinstance(v, dict) else v for k, v in TIMELINE.items()}
    forms = [TIMELINE, bare, {"tracks": TIMELINE}, json.dumps(TIMELINE), json.dumps(json.dumps({"tracks": bare}))]
    rows = [(str(i), json.dumps(f, indent=i % 2 or None), 7, "s") for i, f in enumerate(forms)]
    rows += [("r", '{"rejection": {"reason": "x"}}', 1, ""), ("e", "", 1, ""), ("n", None, 1, ""), ("b", '{"polity": [', 1, ""), ("l", "[]", 1, "")]
    rows += [("big", json.dumps({"events": [{"year": i, "type": "t" * 50} for i in range(100_000)]}), 2, "")]
    df = spark.createDataFrame(rows, "id string, timeline string, year int, section string")  # two columns named as results are
    out = timeline_items(df, "id", "timeline", ["record_id", "section", "ordinal", "year", "label"]).collect()
    for i in range(len(forms)):
        assert {tuple(r)[1:] for r in out if r[0] == str(i)} == ROWS
    assert sum(r[0] == "big" for r in out) == 100_000 and {r[0] for r in out} == {*map(str, range(5)), "big"}
    kept = timeline_items(df.withColumnRenamed("year", "n"), "id", "timeline", ["label"], ["polity"], keep=["n"]).collect()
    assert {tuple(r) for r in kept} == {("A", 7), ("B", 7)} and len(kept) == 10


def test_each_record_once(spark):
    text = json.dumps(TIMELINE)
    rows = [("a", text, "2020"), ("a", text, "2021"), ("a", text, None), (None, text, "2020")]
    dump = spark.createDataFrame(rows, "id string, timeline string, extracted_at string")
    sites = spark.createDataFrame([], "id string, timeline string, last_updated timestamp")
    out = flat_items(sites, dump).collect()
    assert len(out) == len(ROWS) and {r["origin"] for r in out} == {"timeline_dump"}
    assert {(r["year"], r["label"]) for r in out if r["section"] == "site_type"} == {(-5, "town"), (0, "")}


def test_no_depth_is_too_deep(spark):
    deep = '{"events": [{"type": "siege", "year": 5, "more": ' + "[" * 100_000 + "{}" + "]" * 100_000 + "}]}"
    df = spark.createDataFrame([("a", deep), ("b", '{"events": [{"type": "fire"}]}'), ("c", "[" * 60_000)], "id string, timeline string")
    got = {(r["record_id"], r["section"], r["label"]) for r in timeline_items(df, "id", "timeline", ["record_id", "section", "label"]).collect()}
    assert got == {("a", "events", "siege"), ("b", "events", "fire")}
