from pyspark.sql import functions as F

from epochgrid.operators import curation as c


def test_titles(spark):
    rows = [
        (1, {"en": "A", "fr": "B"}, None, None), (2, {"en": " ", "en-gb": "C"}, None, None), (3, {"fr": "B"}, "https://x.org/wiki/Carpi,_Emilia%20R", None),
        (4, {"es": "E", "fr": "F"}, None, "es"), (5, {"ru": "Ж", "de": "D", "fr": "F"}, None, "ru"), (6, {"ru": "Ж", "xx": "X"}, None, "ru"), (7, {"ru": "Ж", "ka": "ბ"}, None, "ru"),
        (8, {"zh": "水", "ka": "ბ"}, None, "ru"), (9, {}, "https://x.org/", None), (10, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, labels map<string,string>, url string, lang string")
    got = {r["id"]: (r["best_title"], r["title_source"]) for r in c.titles(df, "labels", "url", "lang").collect()}
    assert got == {
        1: ("A", "label:en"), 2: ("C", "label:en-gb"), 3: ("Carpi, Emilia R", "article"), 4: ("E", "label:es"), 5: ("F", "label:fr"), 6: ("X", "label:xx"),
        7: ("Ж", "label:ru"), 8: ("ბ", "label:ka"), 9: (None, None), 10: (None, None),
    }


def test_sections(spark):
    rows = [("p", k, level, title) for k, (level, title) in enumerate([(2, "History"), (3, "Antiquity"), (4, "Finds"), (3, "Climate history"), (2, "Geography"), (3, "Rivers"), (2, "Name"), (2, "Notes")])] + [("q", 0, 2, None)]
    df = spark.createDataFrame(rows, "page string, position int, level int, title string")
    assert [r["title"] for r in c.sections_selected(df, r"\bhistor|\bname\b", r"\bclimat|\bnotes\b").orderBy("position").collect()] == ["History", "Antiquity", "Finds", "Climate history", "Name"]


def test_tolerant_json(spark):
    rows = [('{"a":1}',), ('x ```json\n{"a":2}\n``` y ```\n{"a":3}\n```',), ('so {"a":4} it is',), ("none",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.try_variant_get(c.tolerant_json(F.col("t")), "$.a", "int").alias("a"))
    assert [r["a"] for r in df.collect()] == [1, 3, 4, None, None]


def test_closure(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "x"), (None, "a")], "child string, parent string")
    roots = spark.createDataFrame([("a",), ("x",)], "node string")
    got = {tuple(r) for r in c.closure(edges, roots).collect() if r["node"]}
    assert got == {(n, "a") for n in "abc"} | {("x", "x"), ("d", "x")}
    labels = spark.createDataFrame([("k1", "A", "fort"), ("k1", "B", "fort"), ("k2", "C", "old fort"), ("k3", "C", "river"), ("k4", "A", "bad")], "node string, root string, label string")
    gone = spark.createDataFrame([("k4",)], "node string")
    assert {tuple(r) for r in c.whitelist(labels, gone, ["B", "A"], "C", "fort").collect()} == {("k1", "B"), ("k2", "C")}


def test_triage_and_coverage(spark):
    rows = [(["Region", "culture"],), (["archaeological site"],), (["archaeological site", "archaeological culture"],), (["ethnic group", "culture"],), ([],), (None,)]
    got = spark.createDataFrame(rows, "t array<string>").select(c.triage(F.col("t"), ["region"], ["archaeological site"], ["culture", "period"], ["ethnic group"], F.lit(False)).alias("v"))
    assert [r["v"] for r in got.collect()] == ["exclude", "exclude", "keep", "signal", "check", "check"]
    a = spark.createDataFrame([("e", s) for s in "1123456"], "entity string, site string")
    t = spark.createDataFrame([("1", "ok"), ("1", "no"), ("2", "ok"), ("3", "no"), ("4", "ok")], "site string, class string")
    s = spark.createDataFrame([("1", True, True), ("2", False, False), ("3", True, False)], "site string, extracted boolean, attributed boolean")
    r = c.coverage(a, t, spark.createDataFrame([("ok",)], "class string"), s).first()
    assert r.asDict() == {"entity": "e", "sites": 6, "in_scope": 3, "out_of_scope": 1, "unknown": 2, "indexed": 2, "extracted": 1, "attributed": 1, "gain": 1}


def test_edits(spark):
    e = spark.createDataFrame([("s", "polity", 0, 1, "A", None), ("s", "polity", 1, 5, "B", None), ("s", "polity", 2, 9, "C", "Q3")], "site_id string, track string, ordinal int, from_year bigint, label string, qid string")
    edits = spark.createDataFrame([("s", "polity", 0, "A", "set_qid", "Q1", None, None), ("s", "polity", 1, "stale", "delete", None, None, None), ("s", "polity", 2, "C", "delete", None, None, None), ("s", "polity", None, None, "add", "Q7", 3, "N")], "site_id string, track string, ordinal int, expected string, action string, qid string, from_year bigint, label string")
    assert [tuple(r)[2:] for r in c.edited(e, edits).orderBy("ordinal").collect()] == [(0, 1, "A", "Q1"), (1, 3, "N", "Q7"), (2, 5, "B", None)]
