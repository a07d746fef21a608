import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochgrid.llm import leak, stuffing
from epochgrid.llm.encode import PATTERN, VOCABULARY, encode, encoder
from epochgrid.llm.words import words

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text("abAB 'stll12é\n", max_size=80))
def test_encoding_is_exact(reference, text):
    import regex

    made = encoder(VOCABULARY)
    assert [i for w in regex.findall(PATTERN, text) for i in made.piece(w.encode().decode("latin-1"))] == reference.encode_ordinary(text)


@needs_vocabulary
def test_encode(spark, reference):
    texts = [None, "", " ", "Hello  world<|endoftext|>", "a" * 200_000, "ab" * 30_000 + " é🙂", "x"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] * 2 + [(None, "x", 1)], "ids bigint, text string, other int")
    got = encode(df, "ids", "text").collect()
    assert len(got) == 15
    for r in got:
        assert r["token_ids"] == (reference.encode_ordinary(texts[r["ids"]] or "") if r["ids"] is not None else reference.encode_ordinary("x"))
    assert encode(df.limit(0).withColumnRenamed("ids", "id"), "id", "text").columns == ["id", "ids"]


def test_words():
    assert words("Of <b>1,209</b> mónks' Qal’at&amp;co [[a b|North-East]] [x](http://y.z/q) so­ft <p>énd") == "of 1209 monks qalat co north east x soft end".split()


def brute(item: list[str], text: list[str], need: int) -> bool:
    """Whether a span of at least ``need`` item words is there with one edit in eight at most, ends shared."""
    for i in range(len(item)):
        for to in range(len(text)):
            if item[i] != text[to]:
                continue
            best = [k for k in range(len(text) - to)]  # by text words after `to`: least edits
            for j in range(i + 1, len(item)):
                new = [best[0] + 1]
                for k in range(1, len(best)):
                    new.append(min(best[k] + 1, new[-1] + 1, best[k - 1] + (item[j] != text[to + k])))
                for k in range(1, len(best)):
                    span = j - i + 1
                    if span >= need and item[j] == text[to + k] and best[k - 1] <= span // 8:
                        return True
                best = new
    return False


def test_spans_equal_brute_force():
    random.seed(6)
    tried = [0, 0]
    for _ in range(250):
        item = [f"w{random.randrange(300)}" for _ in range(random.choice([24, 30, 45]))]
        a = random.randrange(len(item) - 15)
        part = item[a : a + random.choice([17, 19, 20, 21, 26, 40])]
        for _ in range(random.choice([0, 1, 2, 3, 4])):
            k = random.randrange(len(part))
            part = part[:k] + random.choice([[], ["new"], ["new", part[k]]]) + part[k + 1 :]
        text = [f"t{random.randrange(99)}" for _ in range(5)] + part + [f"t{random.randrange(99)}" for _ in range(5)]
        found = bool(leak.Items([1], [" ".join(item)]).found([" ".join(text)])[1])
        want = brute(item, text, 20)
        tried[want] += 1
        assert found == want, (item, text)
    assert min(tried) > 40


def test_leaks(spark):
    random.seed(8)
    items = [(k, " ".join(f"i{k}w{random.randrange(500)}" for _ in range(40))) for k in range(12)] + [(50, "two words"), (60, None), (70, " ")]
    docs = [(k, f"<p>Start. {items[k][1].upper().replace(' ', ' <b>-</b> ', 3)} end") for k in range(12)]
    docs += [(100, " ".join(items[3][1].split()[10:30])), (101, " ".join(items[3][1].split()[10:29])), (102, "So: TWO, words!"), (103, None), (104, ""), (105, "x " * 300_000 + items[5][1]), (None, items[0][1])]
    want = {(k, k) for k in range(12)} | {(100, 3), (102, 50), (105, 5), (None, 0)}
    d = spark.createDataFrame(docs, "id bigint, text string")
    i = spark.createDataFrame(items, "id bigint, body string")
    for most in (leak.ITEMS, 900):  # items sent to the tasks, and joined
        got = leak.leaked(d, "id", "text", i, "id", "body", most).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    twice = leak.leaked(d.unionByName(d.filter("id = 3")), "id", "text", i.unionByName(i.filter("id = 3")), "id", "body", 900)
    assert twice.filter("id = 3").count() == 4
    assert leak.leaked(d.limit(0), "id", "text", i, "id", "body").collect() == [] and leak.leaked(d, "id", "text", i.limit(0), "id", "body").collect() == []


SENTENCES = "The limestone moat was restored by weavers from Velsia in 1204. Its outer wall stood for two hundred years, then the river took it. Merchants paid for a new bridge with wool. "
GOODS, SALES = "relief pit moat floor tablet shrine tower".split(), "poster tours hotels booking voucher".split()
SPAM = {
    1: ", ".join(["tickets", "Velsia", "cheap", "island", "buy"] * 20),
    2: "\n".join(["hotels Velsia", "rental guide", "Velsia tours"] * 25),
    3: " ".join(["transfer", "buy", "Velsia", "hotels", "voucher", "hospice"] * 20),
    4: "\n".join(f"* http://www.x{i}.example/a?id={i}" for i in range(30)),
    5: " ".join(f'<a href="http://x{i}.test/q">buy tour</a> |' for i in range(30)),
    6: " ".join(f"#buy{i} #velsia_tour{i}" for i in range(40)),
    7: "\n".join(f"Town{chr(97 + i)}a online\nonline in Place{chr(97 + i)}o" for i in range(26)),
    8: SENTENCES + "\n" + "; ".join(["tickets", "Velsia", "cheap", "island"] * 30),
    9: "\n".join(f"granite {GOODS[i % 7]} {SALES[i % 5]} {'ref-' if i % 2 else 'SKU-'}{2000 + 37 * i} {i}.{10 + i} EUR [{SALES[i % 4]}, {SALES[i % 3]}]" for i in range(15)),
    10: ", ".join(f"ring {i}, amulet {i + 7}" for i in range(40)),
    11: "\n".join(f'<a href="http://x{i}.test/q">{"tickets for the old town " * 6}</a>' for i in range(9)) + "<!-- " + "x y z. " * 900 + "-->",
    12: "; ".join(f"${i}.50 {GOODS[i % 7]} {SALES[i % 5]} art-{100 + i}" for i in range(30)),
}
PLAIN = {
    20: SENTENCES * 4, 21: "Glossary\n" + "\n".join(f"wall{chr(97 + i)}: a rough stone used by smiths at Town{chr(97 + i)}." for i in range(20)),
    22: "\n".join(f"-{i}12: siege recorded; walls fell." for i in range(1, 20)), 23: SENTENCES * 2 + "See also:\n* http://a.test/b\n* http://c.test/d", 24: "tower, wall, gate",
    25: "\n".join(f"{i}. Town{i} (12.{i}, 4.{i}), fortress, first recorded {i}00 BC" for i in range(1, 30)), 26: None, 27: "", 28: "  \n ", 29: SENTENCES + "Keywords: tower, wall, gate, well",
    33: "\n".join(f"{i * 37 - 900} BC: siege {['doubtful', 'recorded'][i % 2]}" for i in range(1, 24)), 34: "\n".join(f"Town{chr(97 + i)}ia, fortress {i}00, port {i}50" for i in range(26)),
    35: "\n".join(f"{i}. Town{chr(97 + i)}ia (12.{i}, 4.{i}), fortress, first recorded c. {i}00 BC" for i in range(1, 26)),
    30: "\n".join(f"Smith {chr(65 + i)}. (19{i:02}). The walls of Town{chr(97 + i)}. Velsia Press, pp. {i}-{i + 9}." for i in range(20)), 31: "水城水大王人中明金大光光人町城。" * 20, 32: SENTENCES * 3000,
}


def test_long_texts_take_no_longer_than_they_are():
    import time

    for text in (" " * 300_000 + "x", "<!--" * 50_000, "<!--x-->" * 50_000, "<a " * 100_000, "[x" * 100_000, "1.1 EUR x-22 " * 30_000, "7" * 200_000, "A1" * 100_000, "[[" * 100_000, "a|" * 200_000, "word " * 200_000, "&amp;" * 100_000, "#" * 200_000, "http://" * 50_000, "'" * 200_000):
        began = time.time()
        stuffing.page_matter(text)
        words(text)
        assert time.time() - began < 10, text[:20]


def test_stuffed(spark):
    rows = [(k, t, f"h{k % 3}", 1) for k, t in {**SPAM, **PLAIN}.items()]
    rows += [(200 + k, SPAM[9 if k > 5 else 1 + k % 3], f"other{k}", 1) for k in range(12)] + [(1, SPAM[1], None, 1), (None, SPAM[4], "h", 1)]
    df = spark.createDataFrame(rows, "id bigint, text string, host string, total int")
    got = stuffing.stuffed(df, "id", "text", "host").collect()
    assert len(got) == len(set(got)) and {r["id"] for r in got} == {*SPAM, *range(200, 212), None}
    assert stuffing.stuffed(df.limit(0), "id", "text", "host").collect() == []
