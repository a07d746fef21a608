import random

from hypothesis import given, settings
from hypothesis import strategies as st

from epochgrid.llm import canonical, variants
from epochgrid.llm.names import allowed, edit_distances, fold, near, sounded, tokens


def distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


WORDS = st.text("abcé", max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), max_size=8))
def test_distances(pairs):
    assert edit_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [distance(a, b) for a, b in pairs]


@settings(max_examples=100, deadline=None)
@given(st.lists(WORDS, max_size=6), st.lists(WORDS, max_size=6))
def test_near(words, vocabulary):
    i, j, d = near(words, vocabulary)
    want = {(x, y, distance(a, b)) for x, a in enumerate(words) for y, b in enumerate(vocabulary) if distance(a, b) <= allowed(max(len(a), len(b)))}
    assert set(zip(i.tolist(), j.tolist(), d.tolist())) == want


def test_folding():
    assert fold("Tugnоfеsti") == "tugnofesti" and fold("Ḣöt​fóut") == "hotfout"
    assert sounded("g0ksiresti") == "goksiresti" and sounded("phitty.") == "fiti" and sounded("105") == "105"
    assert tokens(fold("Mid. Old-Xese (a_b)")) == ["mid.", "old", "xese", "a", "b"]


LISTED = [("Q1", "Tugnofesti"), ("Q2", "Old Tugnofesti"), ("Q3", "Middle Gifbidic"), ("Q4", "Proto-Hizlopian"), ("Q5", "Gifbidic")]


def test_matching(spark):
    # as many stages stand beside other languages too, they set entries apart
    rows = LISTED + [(f"Q{100 + 20 * k + i}", f"{s} Lang{'abcdefghij'[i]}uxor{'klmnopqrst'[i]}esh") for k, s in enumerate(("Old", "Middle", "Late", "Proto", "Classical")) for i in range(10)]
    listed = spark.createDataFrame([(a, b, None) for a, b in rows] + [("Q5", "x", "alternative name: Setnofish")], "qid string, label string, notes string").filter("label <> 'x'")
    listed = canonical.other_names(listed.unionByName(spark.createDataFrame([("Q5", None, "also called Setnofish")], "qid string, label string, notes string")), "qid", "label", "notes")
    want = {
        "Tugnofesti": "Q1", "tugnofsti": "Q1", "old-tugnofesti": "Q2", "Tugnofesti (Old)": "Q2", "Ol. Tugn0fesit": "Q2", "the Old Tügnofesti tongue": "Q2", "Middle Tugnofesti": "NOT_FOUND",
        "Mid. Gifbidique": "Q3", "Gifbidic, Middle": "Q3", "language: Hizlopien (Proto)": "Q4", "Setnofihs": "Q5", "Kaksupese": "NOT_FOUND", "n/a": "NOT_FOUND", "Old": "NOT_FOUND", "": "NOT_FOUND", " ": "NOT_FOUND",
        "Tugnofesti " * 3000: "Q1", None: "NOT_FOUND",
    }
    typed = spark.createDataFrame([(i, n, "old", 1.0) for i, n in enumerate(want)] * 2, "i int, name string, match string, score double")  # clashing names
    typed = typed.unionByName(spark.createDataFrame([(99, "tugnofsti", "old", 1.0)] * 3000, typed.schema))  # a hot value
    scores = []
    for block in (50_000, 15, 2):  # the list at once, and in blocks
        got = canonical.matched(typed, "name", listed, "key", "label", block).collect()
        assert len(got) == 2 * len(want) + 3000
        assert {r["name"]: r["match"] for r in got} == want
        assert all(r["score"] == 0 for r in got if r["name"] is None)
        scores.append({r["name"]: r["score"] for r in got})
    assert scores[0] == scores[1] == scores[2]
    assert canonical.matched(typed.limit(0), "name", listed, "key", "label").collect() == []
    assert {r["match"] for r in canonical.matched(typed, "name", listed.limit(0), "key", "label").collect()} == {"NOT_FOUND"}


def test_matching_keeps_all_entries_and_readings(spark):
    stems = [f"Lang{a}uxor{b}esh" for a, b in zip("abcdefghijklmnopqrst", "klmnopqrstabcdefghij")]
    vast = "Sign speech of the hearing impaired among Gifbidic Tugnofesti Zuzhot Vaiklat highlanders"
    rows = [("V", vast), ("G", "Gifbidic"), ("T", "Tugnofesti"), ("S", "Old"), ("W", "Late Dold")]
    for letter, stage, some in (("O", "Old", stems[:12]), ("C", "Cold", stems[6:16]), ("M", "Middle", stems[8:]), ("N", "Modern", stems[:9]), ("R", "Transitional", stems[:9]), ("L", "Late", stems[:9])):
        rows += [(f"{letter}{n[4]}", f"{stage} {n}") for n in some]
    rows += [(f"Q{n[4]}", n) for n in stems]
    want = {
        # an entry of many tokens is found, whole or not, and its tokens don't set others apart
        vast: "V", "sign speech of hearing impaired among Gifbidic Tugnofesti Zuzhott highlanders": "V", "Gifbidic": "G", "Tugnofsti language": "T",
        # an entry of nothing but a stage
        "Old": "S", "old": "S", "Old Kaksupevniwotese": "NOT_FOUND",
        # an abbreviation that fits two stages means the one that the list has, if any; one of any length counts
        "M. Langauxorkesh": "Na", "M. Langtuxorjesh": "Mt", "Md. Langauxorkesh": "Na", "M. Gifbidic": "NOT_FOUND", "Trans. Langauxorkesh": "Ra", "Transitl. Langauxorkesh": "Ra", "Transitl. Gifbidic": "NOT_FOUND",
        # a token as close to two stages, and to a stage and another token
        "Bold Langauxorkesh": "Oa", "Bold Langpuxorfesh": "Cp", "Late Dold": "W",
    }
    listed = spark.createDataFrame(rows, "qid string, label string")
    typed = spark.createDataFrame([(n,) for n in want], "name string")
    for block in (50_000, 3):
        assert {r["name"]: r["match"] for r in canonical.matched(typed, "name", listed, "qid", "label", block).collect()} == want


ENTITIES = [
    (["Kingdom of Zuzhotvaiklat", "kingdom of zuzhotvaiklat (sic)", "Zuzhotvaiklat, Kdm. of", "K. of Zúzhotvaiklat", "Zuzhotvaklat Kingd."], "polity"),
    (["Duchy of Zuzhotvaiklat", "Zuzhotvaiklat (duchy)", "Dchy of Zuzhotviaklat"], "polity"),
    (["Kingdom of Upper Zuzhotvaiklat", "Upp. Zuzhotvaiklat, Kingdom of"], "polity"),
    (["Sultanate of Pemgasgasbid", "the Pemgasgasbidans", "Pemgasgasbid state", "Pemgasgasbid"], "polity"),
    (["League of Tugdaifwitbol–Taimdaiffoutwez", "Taimdaiffoutwez / Tugdaifwitbol League"], "polity"),
    (["Worfigmumraf horizon", "Horizon of Worfigmuia", "WORFIGMUMRAF HORI."], "culture"),
    (["Sole rite"], "religion"),
]


def test_variants(spark):
    rows = [(n, kind, "x") for names, kind in ENTITIES for n in names] * 3 + [(None, "polity", "x"), (" ", "polity", "x"), ("Sole rite", None, "x")]
    df = spark.createDataFrame(rows, "name string, kind string, entity string")
    want = {tuple(sorted((a, b), key=str.encode)) for names, _ in ENTITIES for a in names for b in names if a != b}
    got = variants.linked_names(df, "name", "kind").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert variants.linked_names(df.limit(0), "name", "kind").collect() == []
    found = variants.entities(spark.createDataFrame([("!!", "polity"), ("Kingdom", "polity"), ("x" * 20000, None)], "name string, kind string"), "name", "kind").collect()
    assert len(found) == 3


def test_chunks_lose_nothing(spark):
    random.seed(3)
    stems = ["".join(random.choice(["zuz", "hot", "vaik", "lat", "gif", "pem", "tug", "nof", "mel", "dar"]) for _ in range(4)) for _ in range(60)]
    names = sorted({f"Kingdom of {s[:k]}{s[k + 1:]}".title() for s in stems for k in (2, 5, 8, 99)})
    df = spark.createDataFrame([(n, "polity") for n in names], "name string, kind string")
    one = {tuple(r) for r in variants.linked_names(df, "name", "kind").collect()}
    assert one and {tuple(r) for r in variants.linked_names(df, "name", "kind", chunk=7).collect()} == one
    assert {tuple(r) for r in variants.linked_names(df, "name", "kind", chunk=7, most=1).collect()} == one


def brute_linkage(pairs, size, least):
    """One join at a time over all pairs of clusters, each mean taken anew."""
    similar = {(a, b): s for a, b, s in pairs} | {(b, a): s for a, b, s in pairs}
    clusters = {c: [c] for c in size}
    while True:
        best = []
        for a in clusters:
            for b in clusters:
                if a < b:
                    total = sum(similar.get((x, y), 0) * size[x] * size[y] for x in clusters[a] for y in clusters[b])
                    best.append((-total / (sum(size[x] for x in clusters[a]) * sum(size[y] for y in clusters[b]) * variants.UNIT), a, b))
        if not best or -min(best)[0] < least:
            return {c: head for head, members in clusters.items() for c in members}
        _, a, b = min(best)
        clusters[a] += clusters.pop(b)


def test_linkage_equals_brute_force(spark):
    random.seed(9)
    for trial in range(60):
        names = [f"n{i}" for i in range(random.choice([2, 5, 9, 12]))]
        size = {n: random.choice([1, 1, 2, 5]) for n in names}
        pairs = [(a, b, random.choice([300_000, 500_000, 700_001])) for a in names for b in names if a < b and random.random() < 0.4]
        want = brute_linkage(pairs, size, 0.2)
        assert variants.average_linkage(pairs, size, 0.2) == want


def test_vast_components_are_parted(spark, monkeypatch):
    random.seed(5)
    names = set()
    for _ in range(3):  # chains: neighbours are two edits apart, the ends are different entities
        core = [random.choice("bdfglmnprtvz") if i % 2 == 0 else random.choice("aeiou") for i in range(12)]
        for step in range(30):
            i = step % 12
            core[i] = random.choice("bdfglmnprtvz" if i % 2 == 0 else "aeiou")
            names.add("Kingdom of " + "".join(core).title())
    df = spark.createDataFrame([(n, "polity") for n in sorted(names)], "name string, kind string")

    def linked(**how):
        return {tuple(r) for r in variants.linked_names(df, "name", "kind", **how).collect()}

    small = linked()
    assert linked(most=1) == small
    assert linked(most=1, chunk=7) == small
    monkeypatch.setattr(variants, "parted", lambda pairs: pairs.selectExpr("a AS core", "component AS cluster").unionByName(pairs.selectExpr("b AS core", "component AS cluster")).distinct())
    assert small < linked(most=1)  # whole components hold links that average linkage parts
