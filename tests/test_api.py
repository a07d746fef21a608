import json
import os

import pytest

from epochgrid.functions import sql
from epochgrid.sources import files

FOLDER = "/root/testdata/sf0.01"


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    entries = "array(named_struct('from', 1L, 'ordinal', 0, 'to', 4L, 'value', 'a'), named_struct('from', 1L, 'ordinal', 1, 'to', 3L, 'value', 'b'), named_struct('from', 9L, 'ordinal', 2, 'to', CAST(NULL AS BIGINT), 'value', 'c'))"
    row = spark.sql(
        f"SELECT base_importance(10, 'u'), role_rank('minor'), compute_importance('city', 1000L, true), entity_key(' ', ' A  b'), track_value_at({entries}, 5L), site_occupied_at({entries}, 5L), site_occupied_at({entries}, 10L), track_value_at({entries}, 0L)"
    ).first()
    assert tuple(row) == (29, 2, 100, "name:a b", "b", False, True, None)


def test_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("Q1\nx\nQ2 \nQ1\n")
    assert {r["qid"] for r in files.qid_list(spark, str(tmp_path / "q.txt")).collect()} == {"Q1", "Q2"}
    (tmp_path / "r.json").write_text(json.dumps([{"name": "a", "qid": "Q1"}, {"name": "b", "qid": "NOT_FOUND"}, {"name": "c"}]))
    assert [r["name"] for r in files.reviewed(spark, str(tmp_path / "r.json")).collect()] == ["a"]
    kinds = "site siteLabel d type typeLabel coord country sl pop inception enwiki".split()
    schema = "row int, " + ", ".join(f"{k} struct<value: string>" for k in kinds)
    rows = [
        (0, ("http://x/Q1",), ("Q1",), None, None, None, ("Point(2.5 -3)",), None, ("x",), None, ("-0752-01-01",), None),
        (1, ("http://x/Q1",), ("Rome",), ("d",), ("http://x/Q7",), ("town",), ("bad",), ("http://x/Q9",), ("5",), ("70",), None, ("u",)),
        (2, ("http://x/L3",), None, None, None, None, None, None, None, None, None, None),
    ]
    r = files.site_bindings(spark.createDataFrame(rows, schema)).collect()
    assert len(r) == 1 and r[0].asDict() == {"qid": "Q1", "label": "Rome", "description": "d", "lon": 2.5, "lat": -3.0, "country_qid": "Q9", "sitelinks_count": 5, "population": 70, "inception_year": -753, "wikipedia_page_en_url": "u", "type": "town", "type_qid": "Q7"}
    b = [(("http://x/Q1",), (k,), (t,), (p,)) for k, t, p in (("inception", "0100-01-01", "7"), ("inception", "0050-01-01", "9"), ("dissolution", "0200-01-01", "8"), ("dissolution", "x", "9"))]
    assert tuple(files.entity_bounds(spark.createDataFrame(b, "e struct<value: string>, kind struct<value: string>, time struct<value: string>, precision struct<value: string>")).first()) == ("Q1", 50, 9, 200, 8)
    df = spark.createDataFrame([(1, "x")], "a int, geometry string")
    files.append(df, str(tmp_path / "log"), "a")
    files.append(df, str(tmp_path / "log"), "a")
    files.replace(df, str(tmp_path / "state"))
    files.dump_json(df, str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 and spark.read.json(str(tmp_path / "dump")).count() == 1
    assert json.loads(files.features(df.withColumn("geometry", df.a * 0 + 1), ["a"]).first()[0]) == {"type": "Feature", "properties": {"a": 1}, "geometry": 1}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_atlas(spark):
    from epochgrid.api import Atlas

    atlas = Atlas(spark, FOLDER)
    some = atlas.sites.filter("timeline is not null").first()["id"]
    assert atlas.site(some).count() == 1 and atlas.site("none").count() == 0
    assert atlas.sites_at(1000, 6, timeline="all").count() >= 40 and atlas.search("velo").count() == 8
    assert atlas.search_entities("gif", "polity", 5).count() == 5 and atlas.entity("Q1").first()["sites"] == 0
    assert atlas.conflicts().count() > 0 and atlas.gaps("timeline_dump").first()["sites"] > 1
    for feature in atlas.hulls(1800, "language", "minority", 60).collect():
        assert json.loads(feature[0])["geometry"]["type"] == "Polygon"
    assert atlas.hulls(1000, "polity").count() >= 0 and Atlas.thresholds(5.9) == (50, 44)
    for wrong in (lambda: atlas.entity("X1"), lambda: atlas.hulls(1, "name"), lambda: atlas.sites_at(1, timeline="x")):
        with pytest.raises(ValueError):
            wrong()
