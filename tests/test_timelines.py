"""Worked cases of reading, deriving and repairing timelines."""

import random

from pyspark.sql import functions as F

from epochgrid.functions import numbers
from epochgrid.functions.text import entity_key, normalised, plain_name, unaccent
from epochgrid.operators import quality as q
from epochgrid.operators import temporal as t

SCHEMA = "site_id string, track string, ordinal int, from_year bigint, to_year bigint, label string, qid string, role string, confidence string, entity string"


def entries(spark, rows):
    """(track, from, to, label, qid, role) of one site s, or with the site in front."""
    made = []
    for k, r in enumerate(rows):
        site, (track, a, b, label, qid, role) = (r[0], r[1:]) if len(r) == 7 else ("s", r)
        made.append((site, track, k, a, b, label, qid, role, None, f"qid:{qid}" if qid else f"name:{label.lower()}" if label else None))
    return spark.createDataFrame(made, SCHEMA)


def test_as_of(spark):
    e = entries(spark, [("polity", 5, 9, "A", None, None), ("polity", 5, None, "B", None, None), ("polity", None, None, "C", None, None), ("name", 1, 3, "N", None, None), ("polity", 20, 30, "D", None, None)])
    read = lambda year, how=False: {(r["track"], r["label"]) for r in t.as_of(e, year, how).collect()}
    assert read(4) == {("name", "N")} and read(5) == {("polity", "B"), ("name", "N")}  # of one year the later counts
    assert read(40) == {("polity", "D"), ("name", "N")} and read(40, True) == set() and read(40, None) == {("name", "N")}
    assert t.as_of(e.limit(0), 5).collect() == []


def test_active(spark):
    e = entries(spark, [("religion", 1, None, "A", "Q1", "major"), ("religion", 5, 8, "A", "Q1", "state"), ("religion", 2, None, "B", None, "minor"), ("religion", 2, None, None, None, None), ("polity", 1, 4, "P", None, None), ("site_type", 1, None, "town", None, None)])
    got = t.ranked(t.active(e, 6)).orderBy("position").collect()
    assert [(r["label"], r["role"]) for r in got] == [("A", "state"), ("B", "minor")]
    assert {r["label"] for r in t.active(e, 9).collect()} == {"B"} and {r["label"] for r in t.active(e, 3).collect()} == {"A", "B", "P"}


def test_sovereign(spark):
    e = entries(spark, [("polity", 100, None, "Empire", "Q1", None), ("polity", 1037, 1804, "county", "Q2", None), ("polity", 1806, None, "France", "Q3", None)])
    known = spark.createDataFrame([("Q1", False, 1453), ("Q2", True, None)], "qid string, subordinate boolean, dissolution int")
    assert [r["label"] for r in t.sovereign(e, known, 1380).collect()] == ["Empire"]
    assert t.sovereign(e, known, 1460).collect() == [] and [r["label"] for r in t.sovereign(e, known, 1900).collect()] == ["France"]


def test_lanes(spark):
    e = entries(spark, [("religion", 1, None, "A", "Q1", "minor"), ("religion", 9, None, "A", "Q1", "state"), ("religion", 2, 1, "B", "Q2", "major"), ("language", 3, None, None, None, None)])
    got = {(r["label"], r["role_rank"], r["segments"], r["lane"]) for r in t.lanes(e, 50).collect()}
    assert got == {("A", 0, "1:9 9:50+", 1), ("B", 1, "2:2", 2)}
    p = entries(spark, [("polity", 1, None, "S", "Q1", None), ("polity", 5, None, "c", "Q2", None), ("polity", 8, 9, "T", "Q3", None)])
    known = spark.createDataFrame([("Q2", True)], "qid string, subordinate boolean")
    assert {(r["label"], r["tier"], r["to_year"], r["open"]) for r in t.polity_lanes(p, known, 50).collect()} == {("S", "sovereign", 8, False), ("c", "subordinate", 8, False), ("T", "sovereign", 9, False)}


def test_occupation(spark):
    sites = spark.createDataFrame([("s",), ("x",)], "id string")
    e = entries(spark, [("site_type", 1, 5, "town", None, None), ("site_type", 9, None, "ruins", None, None)])
    events = spark.createDataFrame([("s", 0, 20, "abandonment")], "site_id string, ordinal int, year bigint, type string")
    at = lambda year: {tuple(r) for r in t.occupied(sites, e, year).collect()}
    assert at(5) == {("s", True), ("x", True)} and at(6) == {("s", False), ("x", True)} and at(0) == {("s", True), ("x", True)}
    assert [tuple(r) for r in t.occupation_gaps(e).collect()] == [("s", 5, 9)]
    assert [tuple(r) for r in t.dissolution(e, events).collect()] == [("s", 9)]
    town = entries(spark, [("site_type", 1, None, "town", None, None), ("polity", 30, None, "P", None, None)])
    assert t.dissolution(town, events).first()["dissolution"] is None
    assert t.dissolution(town.filter("track = 'site_type'"), events).first()["dissolution"] == 20


def test_bounds(spark):
    known = spark.createDataFrame([("Q1", True, "One", 100, 7, 200), ("Q2", False, "Two", 1, 9, 2), ("Q3", True, "Three", None, None, None)], "qid string, active boolean, label_en string, inception int, inception_precision int, dissolution int")
    rows = [("a", "religion", 50, None, "x", "Q1", None), ("b", "religion", 201, None, "x", "Q1", None), ("c", "religion", 10, 99, "x", "Q1", None), ("d", "religion", 10, 100, "x", "Q1", None), ("e", "religion", 150, 160, "x", "Q1", None), ("f", "religion", 1, None, "x", "Q2", None)]
    got = {r["site_id"]: (r["new_from"], r["new_to"], r["from_circa"], r["actions"]) for r in q.bounded(entries(spark, rows), known).collect()}
    assert got == {"a": (100, 200, True, ["shorten", "close"]), "b": (201, None, False, ["incompatible"]), "c": (10, 99, False, ["incompatible"]), "d": (10, 100, False, []), "e": (150, 160, False, [])}
    again = entries(spark, [("a", "religion", 100, 200, "x", "Q1", None)])
    assert q.bounded(again, known).first()["actions"] == []  # idempotent


def model(rows):
    """The passes on one entity's entries, step by step."""
    es = sorted(([a, b, k] for k, (a, b) in enumerate(rows)), key=lambda e: e[0])
    zero = [e for e in es if e[1] is not None and e[1] <= e[0]]
    for z in zero:
        target = None
        for e in es:
            if e is z or e[0] >= z[0] or e[1] is not None:
                continue
            if target is None or e[0] > target[0]:
                target = e
        if target:
            target[1] = z[0]
    es = [e for e in es if all(e is not z for z in zero)]
    closed = {e[0] for e in es if e[1] is not None}
    es = [e for e in es if e[1] is not None or e[0] not in closed]
    out = []
    for i, (a, b, k) in enumerate(es):
        if b is not None and (b <= a or (i + 1 < len(es) and b >= es[i + 1][0])):
            b = None
        out.append((k, a, b))
    return sorted(out)


def test_fold(spark):
    random.seed(7)
    groups = [[(642, None), (800, 800)], [(250, None), (250, 380)], [(1, 1394), (1791, None)], []]
    groups += [[(a := random.randrange(8), random.choice([None, a, a - 1, a + 3])) for _ in range(random.randrange(1, 7))] for _ in range(400)]
    rows = [(f"s{g:03}", "religion", k, a, b, "A", "Q1", None, None, "qid:Q1") for g, pairs in enumerate(groups) for k, (a, b) in enumerate(pairs)]
    got: dict = {}
    for r in q.folded(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["site_id"], []).append((r["ordinal"], r["from_year"], r["to_year"]))
    for g, pairs in enumerate(groups):
        assert sorted(got.get(f"s{g:03}", [])) == model(pairs), pairs
    assert got["s000"] == [(0, 642, 800)] and got["s001"] == [(1, 250, 380)]


def test_state_is_exclusive(spark):
    e = entries(spark, [("language", 985, None, "Latin", "Q1", "state"), ("language", 1349, None, "French", "Q2", "state"), ("language", 1000, None, "x", "Q3", "major")])
    assert {(r["label"], r["to_year"]) for r in q.exclusive_state(e).collect()} == {("Latin", 1349), ("French", None), ("x", None)}


def test_qids(spark):
    known = spark.createDataFrame([("Q1", "religion", "Blue Rite", True), ("Q2", "polity", "Kingdom of Ash", True), ("Q9", "polity", "Gone", False)], "qid string, kind string, label_en string, active boolean")
    rows = [("religion", "Blue rite", "Q1", None), ("polity", "Blue rite", "Q1", None), ("polity", "Oak empire", "Q2", None), ("polity", "Ash", "Q2", None), ("polity", "Ash coast", "Q2", None), ("religion", "New", "Q8", None), ("polity", "One", "Q7", None), ("polity", "Two", "Q7", None), ("culture", "Gone", "Q9", "using Q9 as a broad reference QID"), ("polity", "Sole", "Q6", None)]
    df = spark.createDataFrame([("s", a, k, b, c, d) for k, (a, b, c, d) in enumerate(rows)], "site_id string, track string, ordinal int, label string, qid string, notes string")
    got = [r["reason"] for r in q.checked_qids(df, known).orderBy("ordinal").collect()]
    assert got == [None, "wrong_track", "wrong_name", "several_names", "several_names", "not_listed", "several_names", "several_names", "confessed", None]


def test_whole_pipeline(spark):
    known = spark.createDataFrame(
        [("Q1", "religion", "Blue Rite", True, 100, 7, 900), ("Q2", "polity", "Kingdom of Ash", True, 300, 9, 400), ("Q3", "language", "Old Tongue", True, None, None, None)],
        "qid string, kind string, label_en string, active boolean, inception int, inception_precision int, dissolution int",
    )
    rows = [
        ("site_type", 1, 50, "town", None, None), ("site_type", 40, None, "city", None, None),  # a redundant end
        ("polity", 200, None, "Ash", "Q2", None), ("polity", 350, 350, "Ash", "Q2", None),  # a closing instruction, then shortened
        ("polity", 500, None, "Oak empire", "Q2", None),  # loses its QID, so isn't incompatible
        ("culture", 10, None, "Hill folk", None, None), ("culture", None, 30, "Dune folk", None, None), ("culture", 60, 70, None, None, None),
        ("religion", 50, None, "Blue rite", "Q1", "state"), ("religion", 600, None, "New rite", "Q8", "state"),  # one state, then shortened; not listed
        ("language", 5, None, "Old tongue", "Q3", "major"), ("name", 1, 9, "Ashton", None, None), ("population", 7, 8, "500", None, None),
    ]
    e = entries(spark, rows).withColumn("notes", F.lit(None).cast("string"))
    events = spark.createDataFrame([("s", 0, 90, "fire"), ("s", 1, 91, "party")], "site_id string, ordinal int, year bigint, type string")
    missing = spark.createDataFrame([("s", 0, "polity", " ", None), ("s", 1, "language", "OLD  tongue", None), ("s", 2, "religion", "New Rite", "Q80"), ("s", 3, "culture", "Hill folk", None)], "site_id string, ordinal int, kind string, name string, proposed_qid string")
    got = {tuple(r[c] for c in ("track", "ordinal", "kind", "label", "qid", "reason", "new_from", "new_to", "from_circa")) + (",".join(r["actions"]),) for r in q.processed(e, events, missing, known).collect()}
    assert got == {
        ("site_type", 0, None, "town", None, None, 1, None, False, ""), ("site_type", 1, None, "city", None, None, 40, None, False, ""),
        ("polity", 2, None, "Ash", "Q2", None, 300, 350, False, "shorten"), ("polity", 4, None, "Oak empire", None, "wrong_name", 500, None, False, ""),
        ("culture", 5, None, "Hill folk", None, None, 10, None, False, ""), ("culture", 6, None, "Dune folk", None, None, None, 30, False, ""), ("culture", 7, None, None, None, None, 60, 70, False, ""),
        ("religion", 8, None, "Blue rite", "Q1", None, 100, 600, True, "shorten"), ("religion", 9, None, "New rite", None, "not_listed", 600, None, False, ""),
        ("language", 10, None, "Old tongue", "Q3", None, 5, None, False, ""), ("name", 11, None, "Ashton", None, None, 1, None, False, ""), ("population", 12, None, "500", None, None, 7, None, False, ""),
        ("events", 0, None, "fire", None, None, 90, None, False, ""), ("missing_entities", 5, "religion", "New rite", None, "not_listed", None, None, False, ""),  # resolved at first, then recorded anew
        ("missing_entities", 3, "culture", "Hill folk", None, None, None, None, False, ""), ("missing_entities", 4, "polity", "Oak empire", None, "wrong_name", None, None, False, ""),
    }


def test_functions(spark):
    c = F.col
    rows = spark.createDataFrame([(0, None), (0, "u"), (3, "u"), (10, "u"), (100, "u"), (1000, "u"), (None, None)], "n int, url string")
    assert [r[0] for r in rows.select(numbers.base_importance(c("n"), c("url"))).collect()] == [0, 8, 20, 29, 48, 68, 0]
    years = spark.createDataFrame([("-0752-04-21T00:00:00Z",), ("0000-01-01",), ("1991-01-01",), ("-84000000000-01-01",), ("x",)], "s string")
    assert [r[0] for r in years.select(numbers.wikidata_year(c("s"))).collect()] == [-753, -1, 1991, None, None]
    names = spark.createDataFrame([("Norse/Viking culture", None), ("Norse / Viking culture", " "), ("Andosin tribe (pre-Roman)", "Q1 "), (None, None)], "n string, q string")
    assert [r[0] for r in names.select(plain_name(c("n"))).collect()] == ["norse viking culture"] * 2 + ["andosin tribe", None]
    assert [r[0] for r in names.select(entity_key(c("q"), c("n"))).collect()] == ["name:norse/viking culture", "name:norse / viking culture", "qid:Q1", None]
    odd = spark.createDataFrame([("Ṣãö́ Ÿ",)], "x string").select(unaccent(c("x")), normalised(c("x"))).first()
    assert tuple(odd) == ("Sao Y", "sao y")
    shown = spark.createDataFrame([(-753, 9, False), (-753, 7, True), (1991, 8, False), (-3500, 6, False)], "y int, p int, c boolean")
    assert [r[0] for r in shown.select(numbers.year_text(c("y"), c("p"), c("c"))).collect()] == ["753 BC", "c. 8th c. BC", "1990s AD", "4th mill. BC"]
    assert spark.range(1).select(numbers.fnv1a(F.lit("a")), numbers.fnv1a(F.lit(""))).first()[:] == (0xE40C292C, 0x811C9DC5)
