"""Merges, landed answers, stored tables and SQL functions on small made-up rows."""

import json

from pyspark.sql import functions as F

from epochgrid.api import Atlas
from epochgrid.functions import sql
from epochgrid.functions.text import by_locale
from epochgrid.operators import merge
from epochgrid.operators import quality as q
from epochgrid.operators.skew import hot_keys, salted_join
from epochgrid.sources import files, silver

FOLDER = "/root/testdata/sf0.001"


def test_lists_in_parts(spark):
    df = spark.createDataFrame([("hot", f"m{i}") for i in range(300)] * 2 + [("one", "x"), ("one", None), (None, "y")], "k string, m string")
    got = merge.listed(df, ["k"], "m", 50).collect()
    assert len([r for r in got if r["k"] == "hot"]) == 6
    assert sorted(x for r in got if r["k"] == "hot" for x in r["list"].split(",")) == sorted(f"m{i}" for i in range(300))
    assert {(r["k"], r["part"], r["members"], r["list"]) for r in got if r["k"] != "hot"} == {("one", 0, 1, "x"), (None, 0, 1, "y")}
    assert merge.listed(df.limit(0), ["k"], "m").collect() == []


def test_groups_replaced(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 8), ("d", 7)], "k string, v int")
    touched = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    assert {tuple(r) for r in merge.replaced(old, new, touched, "k").collect()} == {("a", 9), ("c", 4), (None, 5)}


def test_stamps(spark):
    old = spark.createDataFrame([("a", "x", 1, 10), ("b", "x", 2, 50)], "k string, l string, v int, seen int")
    new = spark.createDataFrame([("a", "x", 3, 20), ("a", "x", 4, 15), ("b", "x", None, 40), ("c", "x", 5, 1), (None, "x", 6, 1)], "k string, l string, v int, seen int")
    assert {tuple(r) for r in merge.stamped(old, new, ["k", "l"], ["v"], "seen").collect()} == {("a", "x", 3, 20), ("b", "x", None, 50), ("c", "x", 5, 1)}


def test_hot_keys_lose_nothing(spark):
    large = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(400)] + [(None, 1)], "k string, v int").repartition(4)
    small = spark.createDataFrame([("hot", "h"), ("hot", "g")] + [(f"k{i}", "x") for i in range(0, 40, 2)] + [(None, "n")], "k string, w string")
    hot = hot_keys(large.groupBy("k").count(), "k", "count", 16)
    assert hot.count() < 16 and hot.filter("k = 'hot'").count() == 1
    for how in ("inner", "left"):
        for by in (None, F.col("v")):
            got = sorted(map(str, salted_join(large, small, "k", hot, how, by).select("k", "v", "w").collect()))
            assert got == sorted(map(str, large.join(small, "k", how).select("k", "v", "w").collect()))


def test_conflicts_repairs_and_bounds(spark):
    listed = spark.createDataFrame([("Q1", "A", True, 100, 7, 200, "list"), ("Q2", "B", True, None, None, None, None)], "qid string, label_en string, active boolean, inception int, inception_precision int, dissolution int, bounds_source string")
    held = q.bounded(spark.createDataFrame([("s", "polity", 0, 50, 150, "A", "Q1", None)], "site_id string, track string, ordinal int, from_year bigint, to_year bigint, label string, qid string, role string"), listed).first()
    assert (held["new_from"], held["from_circa"], held["from_precision"]) == (100, True, 7)
    found = spark.createDataFrame([("Q1", 1, 2), ("Q2", 3, None)], "qid string, first int, last int")
    assert {(r["qid"], r["inception"], r["dissolution"], r["bounds_source"]) for r in q.filled_bounds(listed, found, "timelines").collect()} == {("Q1", 100, 200, "list"), ("Q2", 3, None, "timelines")}
    rows = [("s", "site_type", 0, None, 5, "a", None), ("s", "site_type", 1, 10, 20, "b", None), ("s", "site_type", 2, 20, 30, "c", None), ("s", "language", 0, 1, None, "l", "state"), ("s", "language", 1, 5, 6, "m", "state"), ("s", "language", 2, None, 9, "n", "state")]
    e = spark.createDataFrame(rows, "site_id string, track string, ordinal int, from_year bigint, to_year bigint, label string, role string")
    assert {(r["label"], r["to_year"]) for r in q.without_redundant_ends(e).collect()} == {("a", 5), ("b", None), ("c", 30)}
    assert {(r["label"], r["to_year"]) for r in q.exclusive_state(e).collect()} == {("l", 5), ("m", 6), ("n", 9)}
    told = [("Q9", "country in the north"), ("Q8", "former country"), ("Q28513", None), ("Q7", "Country, former kingdom"), ("Q6", None)]
    skipped = {r["qid"]: r["skipped"] for r in q.historical(spark.createDataFrame(told, "qid string, description_en string")).collect()}
    assert skipped == {"Q9": None, "Q8": "description", "Q28513": "known", "Q7": None, "Q6": None}


def test_occurrences(spark):
    gaps = spark.createDataFrame([("s", 0, "polity", "Norse / X"), ("s", 1, "polity", "Known"), ("t", 0, "culture", "Lost"), ("t", 1, "culture", "(!)")], "site_id string, ordinal int, kind string, name string")
    entries = spark.createDataFrame(
        [("s", "polity", 1, 5, 6, "Norse/X", None, "major", None), ("s", "polity", 0, 7, 8, "norse x", None, None, "high"), ("s", "polity", 2, 1, 2, "known", "Q1", None, None)],
        "site_id string, track string, ordinal int, from_year bigint, to_year bigint, label string, qid string, role string, confidence string",
    )
    got = {(r["name"], r["site_id"], r["from_year"], r["confidence"]) for r in q.occurrences(gaps, entries).collect()}
    assert got == {("Norse / X", "s", 7, "high"), ("Lost", "t", None, None), ("(!)", "t", None, None)}


def test_landed_answers(spark, tmp_path):
    v = lambda x: {"value": x} if x else None
    names = ["e", "enLabel", "frLabel", "desc", "country", "alias"]
    rows = [("http://x/entity/Q1", "One", None, None, "http://x/entity/Q9", "Uno"), ("http://x/entity/Q1", "One", "Un", "d", None, "Ein"), ("http://x/entity/Q1", "One", None, None, None, "Uno"), ("http://x/entity/Q2", None, "Deux", None, None, None)]
    schema = "row int, " + ", ".join(f"{n} struct<value: string>" for n in names)
    df = spark.createDataFrame([(i, *map(v, r)) for i, r in enumerate(rows)], schema)
    assert [tuple(r) for r in files.entity_aliases(df).collect()] == [("Q1", "One", "Un", "d", "Q9", "Ein | Uno")]
    links = spark.createDataFrame([(v("x/Q1"), v("5")), (v("x/Q1"), v("7")), (v("x/Q2"), v("many")), (None, v("1"))], "e struct<value: string>, links struct<value: string>")
    assert [tuple(r) for r in files.sitelinks(links).collect()] == [("Q1", 7)]
    told = spark.createDataFrame([(v("x/entity/Q1"), v("x/entity/Q5"))] * 2 + [(v("x/entity/Q1"), None)], "c struct<value: string>, site struct<value: string>")
    assert [tuple(r) for r in files.attributions(told).collect()] == [("Q1", "Q5")]
    claim = lambda i: {"mainsnak": {"datavalue": {"value": {"id": i}}}}
    answer = {"entities": {"Q1": {"labels": {"en": {"value": "One"}}, "claims": {"P31": [claim("Q48349"), {"mainsnak": {}}, claim("Q5")]}, "sitelinks": {"enwiki": {"title": "One"}, "commonswiki": {"title": "x"}, "frwiki": {"title": "Un"}}}, "Q2": {"missing": ""}, "Q3": {}}}
    (tmp_path / "a.json").write_text(json.dumps(answer))
    assert {(r["qid"], r["label_en"], tuple(r["types"])) for r in files.entity_claims(spark, str(tmp_path / "a.json")).collect()} == {("Q1", "One", ("Q48349", "Q5")), ("Q3", None, ())}
    assert {tuple(r) for r in files.article_links(spark, str(tmp_path / "a.json")).collect()} == {("Q1", "en", "One"), ("Q1", "fr", "Un")}
    (tmp_path / "s.json").write_text(json.dumps({"parse": {"title": "One", "sections": [{"index": "1", "level": "2", "line": "Name"}, {"index": "2", "level": "x", "line": "Age"}]}}))
    assert [tuple(r) for r in files.article_sections(spark, str(tmp_path / "s.json")).collect()] == [("One", 0, "1", 2, "Name"), ("One", 1, "2", None, "Age")]


def test_sql_functions_and_order(spark):
    sql.register(spark)
    row = spark.sql("SELECT f_unaccent('Éá Ṣx'), sites_build_search_text('b', map('en', 'a', 'fr', ''), NULL, array('b', 'c')), sites_build_search_text('', NULL, NULL, NULL)").first()
    assert tuple(row) == ("Ea Sx", "a b c", None)
    df = spark.createDataFrame([("Zoo",), ("éa",), ("eb",), ("Ea",), (None,)], "l string")
    assert [r[0] for r in df.orderBy(by_locale(F.col("l")), "l").collect()] == [None, "Ea", "éa", "eb", "Zoo"]


def test_stored_tables_give_the_same(spark, tmp_path):
    silver.write(spark, FOLDER, str(tmp_path))
    parsed, stored = Atlas(spark, FOLDER), Atlas(spark, FOLDER, str(tmp_path))
    key = parsed.entries(["polity"]).select("site_id").orderBy("site_id").first()[0]
    for ask in (lambda a: a.site(key), lambda a: a.sites_at(1000, 12, (-180, -90, 180, 90), "all"), lambda a: a.conflicts(), lambda a: a.entries(["polity"], key)):
        one, two = (sorted(map(str, ask(a).select(sorted(ask(a).columns)).collect())) for a in (parsed, stored))
        assert one == two and one
    plan = stored.site(key)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "EqualTo(site_id" in plan and "PartitionFilters: [isnotnull(track" in plan
    assert "EqualTo(id" in parsed.site(key)._jdf.queryExecution().toString()
    assert parsed.listed("polity", limit=5).count() == 5
    edits = spark.createDataFrame([(key, "polity", 0, None, "add", "Q1", -5000, "New")], "site_id string, track string, ordinal int, expected string, action string, qid string, from_year bigint, label string")
    assert parsed.edited(edits).filter("label = 'New' and ordinal = 0").count() == 1
