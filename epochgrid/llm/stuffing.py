"""Pages made of repeated keywords, links or product tags rather than sentences or records.

A page is cut into links (with the few words that label them), hash tags and units: lines, sentences and the parts of
lists. A unit is list-like when its parts have a few words each and hardly a number, or when it is a long run of words that
repeats a small vocabulary; sentences aren't. The phrases of list-like units become shingles of one and two words,
exploded with the page's host; a shingle that distinct other hosts use the same way is replicated. A page is flagged when
more than half of its text is links, tags and list-like phrases that are stitched from shingles replicated on other hosts
or repeated on the page.

A line with numbers is a record. It is a phrase too where its template (the order of words, numbers, codes and prices) repeats
on the page, but a record states facts: its own numbers and names are replicated nowhere, and nearly all of its words must be.
Codes and prices are tags, as they name an article and nothing about it. Lines that begin with a date and lines that end as
sentences are never phrases.

Only pages whose list-like text could reach half are joined with the host counts, which prunes exactly; the shingles of all
pages count. Pairs of shingle and host are counted before they meet, and frequent shingles are salted by their counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.llm.words import without_comments
from epochgrid.operators.arrow import sliced

BLOCK = 8 << 20
#: Words of a list's part, of the shortest sentence of many parts and of a record; words in a row that make a sentence of a record.
PART, SENTENCE, RECORD, RUN = 5, 8, 30, 8
#: Hosts and share of all hosts that make a shingle replicated, repeats on the page that make a word or template repeated, least share of
#: such words in a phrase and in a record, least words of matter in a page.
HOSTS, SHARE, REPEATS, STITCHED, FACTLESS, LEAST = 5, 0.02, 3, 1 / 3, 3 / 4, 20
#: A shingle with more than one in ``HOT`` of all places is cut so that no part has more; there are fewer than ``HOT`` of them.
HOT = 4096

_LINK = re.compile(
    r"<a\s[^<>]*>[^<>]*</a>|\[[^\[\]\n]*\]\((?:https?://|www\.)[^()\s]*\)|\[(?:https?://|www\.)[^\[\]\n]*\]|(?:https?://|\bwww\.)[^\s<>\"\])]+"
)
_TAG = re.compile(r"(?<![\w&])#\w+")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|'{2,}|\*{2,}")
_SENTENCE = re.compile(r"(?<=[.!?।؟])[\"”’')\]]*\s+|(?<=[。؟])")
_PARTS = re.compile(r"\s*(?:[,;:|•·/>→»]|\s[-–—*]\s|[-=]>|[.!?](?=\s|$))+\s*")
#: A word; where writing has no spaces, a sign.
_WORD = re.compile(r"[⺀-鿿가-힯]|[^\W_]+(?:[-'’_][^\W_]+)*")
_SPACES = re.compile(r"[^\S\n\r]{2,}|\t")
_DIGIT = re.compile(r"\d")
_ORDINAL = re.compile(r"\s*[-*•]?\s*\d{1,6}[.)]\s+")
_DATED = re.compile(r"\s*(?:c\.\s*)?[-−]?\d+(?:\s*(?:BC|BCE|AD|CE))?\s*[:–—]")
#: Of a record: a price, a code of letters and digits, a number, a word.
_FIELD = re.compile(
    r"(?P<p>[$€£¥₩₹₽₺₴₪฿]\s?\d[\d.,]*|\d[\d.,]*\s?[$€£¥₩₹₽₺₴₪฿]|\d+[.,]\d\d\s?[A-Z]{3}\b)|(?P<c>\b(?:[^\W\d_]{1,8}[-_]\d{2,}|[A-Z]{2,8}\d{2,})\b)|(?P<n>\d[\d.,:]*)|(?P<w>"
    + _WORD.pattern
    + ")"
)
_ENDS = ".!?।؟。"
_GAP = "\x00"
#: In phrases: a number, which is a fact, and a code or price, which is a tag.
NUMBER, TAG = "0", "¤"


def _size(text: str) -> int:
    return len(text) - text.count(" ")


def _distinct(ws: list[str]) -> float:
    return len(set(ws)) / len(ws) if ws else 1.0


def _record(line: str) -> tuple[str, list[str]]:
    """(template, words) of a record; no words if it is a sentence or dated. A number of its own that opens it counts for nothing."""
    if _DATED.match(line):
        return "", []
    line = _ORDINAL.sub("", line, count=1) if _ORDINAL.match(line) else line
    kinds: list[str] = []
    ws: list[str] = []
    run = 0
    for m in _FIELD.finditer(line):
        kind = m.lastgroup
        run = run + 1 if kind == "w" else 0
        if run > RUN:
            return "", []
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
        ws.append(TAG if kind in "pc" else NUMBER if kind == "n" else m.group().lower())
    return "".join(kinds), ws


def _list_phrases(unit: str) -> list[tuple[str, int, float]]:
    """The phrases of a list-like unit with their lengths and the least share of known words, none if it isn't one."""
    blanks = unit.count(" ")
    if blanks >= SENTENCE - 1:
        rough = unit.lower().split()
        share = _distinct(rough)
        # a sentence hardly repeats its words; a list without end marks has at least many parts
        if share > 0.75 and (unit[-1:] in ".!?।؟" or len(_PARTS.split(unit)) * PART < len(rough)):
            return []
    parts = [(p, _WORD.findall(p.lower())) for p in _PARTS.split(unit) if p]
    parts = [(p, ws) for p, ws in parts if ws]
    words = sum(len(ws) for _, ws in parts)
    if sum(w[0].isdigit() for _, ws in parts for w in ws) > 0.1 * words:
        if blanks < RECORD or unit[-1:] in _ENDS:
            return []  # a sentence with numbers
        if all(len(ws) <= PART for _, ws in parts):
            return [(" ".join(ws), _size(p), FACTLESS) for p, _ in parts if (ws := _record(p)[1])]
        _, ws = _record(unit)
        return [(" ".join(ws), _size(unit), FACTLESS)] if ws else []
    if sum(len(ws) for _, ws in parts if len(ws) > PART) <= 0.1 * words:
        return [(" ".join(ws), _size(p), STITCHED) for p, ws in parts]
    if words >= LEAST and _distinct([w for _, ws in parts for w in ws]) <= 0.5:
        return [(" ".join(ws[k : k + 3]), sum(map(len, ws[k : k + 3])), STITCHED) for _, ws in parts for k in range(0, len(ws), 3)]
    return []


def page_matter(text: str) -> tuple[int, int, list[tuple[str, int, float]]]:
    """(length, length of links and tags, list-like phrases with the length and the least share of known words of each) of a page;
    white space doesn't count."""
    if "  " in text or "\t" in text:
        text = _SPACES.sub(" ", text)
    if "<" in text or "''" in text or "**" in text:
        text = _MARKUP.sub(_unmarked, without_comments(text, ""))
    sure = 0
    if "://" in text or "www." in text or "#" in text:
        found: list[int] = []

        def note(m: re.Match) -> str:
            found.append(_size(m.group()))
            return f" {_GAP} "

        text = _LINK.sub(note, text)
        if "#" in text:
            text = _TAG.sub(note, text)
        sure = sum(found)
    total = sure
    phrases: list[tuple[str, int, float]] = []
    records: list[tuple[str, str, int]] = []
    for line in text.splitlines():
        if not line or line.isspace():
            continue
        if _GAP in line:
            rest = []
            for piece in line.split(_GAP):
                if piece.count(" ") < 12 and len(_WORD.findall(piece)) <= PART + 1:
                    size = _size(piece)  # what labels a link
                    total, sure = total + size, sure + size
                else:
                    rest.append(piece)
            line = " ".join(rest)
        total += _size(line)
        if line.count(" ") < RECORD and _DIGIT.search(line):
            if line.rstrip()[-1:] not in _ENDS:
                template, ws = _record(line)
                if ws:
                    records.append((template, " ".join(ws), _size(line)))
            continue  # else a sentence with a number
        for unit in _SENTENCE.split(line.rstrip()):
            if unit:
                phrases += _list_phrases(unit)
    often = Counter(template for template, _, _ in records)
    phrases += [(ws, n, FACTLESS) for template, ws, n in records if often[template] >= REPEATS]
    return total, sure, phrases


def _unmarked(m: re.Match) -> str:
    tag = m.group()
    if tag[0] != "<":
        return ""
    return tag if tag[:3].lower() in ("<a ", "</a") else "\n"


_PAGE = pa.struct(
    [
        ("size", pa.int64()), ("times", pa.int64()), ("words", pa.int32()), ("need", pa.int32()), ("own", pa.int64()),
        ("shingles", pa.list_(pa.int64())), ("masks", pa.list_(pa.int64())),
    ]
)


def _phrase_rows(phrases: list[tuple[str, int, float]]) -> list[dict]:
    """Each different phrase once: its length over the page, how often it comes, its words and how many must be known, which of them are tags or repeat
    on the page, its shingles and the words each of them covers, as bits."""
    from xxhash import xxh64_intdigest

    size: Counter[tuple[str, float]] = Counter()
    times: Counter[tuple[str, float]] = Counter()
    seen: Counter[str] = Counter()
    named: Counter[str] = Counter()
    for phrase, n, least in phrases:
        ws = phrase.split(" ")
        for k in range(0, len(ws), 60):  # one bit for each word
            part = " ".join(ws[k : k + 60])
            size[part, least] += n * len(ws[k : k + 60]) // len(ws)
            times[part, least] += 1
        seen.update(ws)
        named.update({f"{a} {NUMBER}" for a, b in zip(ws, ws[1:]) if b == NUMBER and a not in (NUMBER, TAG)} if len(ws) <= 3 else ())
    rows = []
    for (phrase, least), n in size.items():
        ws = phrase.split(" ")
        own = sum(1 << i for i, w in enumerate(ws) if w == TAG or (w != NUMBER and seen[w] >= REPEATS))
        if len(ws) <= 3:  # a model number, where the same word is numbered again and again
            own |= sum(1 << i for i, w in enumerate(ws) if w == NUMBER and i and named[f"{ws[i - 1]} {NUMBER}"] >= REPEATS)
        made = [(w, 1 << i) for i, w in enumerate(ws) if w not in (NUMBER, TAG)]
        made += [(f"{a} {b}", 3 << i) for i, (a, b) in enumerate(zip(ws, ws[1:])) if not {a, b} & {NUMBER, TAG}]
        rows.append(
            {
                "size": n, "times": times[phrase, least], "words": len(ws), "need": math.ceil(least * len(ws)), "own": own,
                "shingles": [xxh64_intdigest(s) - 2**63 for s, _ in made], "masks": [m for _, m in made],
            }
        )
    return rows


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole, "__text", BLOCK):
            at, totals, sures, maybe, rows = [], [], [], [], []
            for i, text in enumerate(batch.column("__text").to_pylist()):
                total, sure, phrases = page_matter(text)
                reach = 2 * (sure + sum(n for _, n, _ in phrases)) > total
                if phrases or reach:
                    at.append(i)
                    totals.append(total)
                    sures.append(sure)
                    maybe.append(reach)
                    rows.append(_phrase_rows(phrases))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__key").take(where), batch.column("__host").take(where), pa.array(totals, pa.int64()),
                    pa.array(sures, pa.int64()), pa.array(maybe, pa.bool_()), pa.array(rows, pa.list_(_PAGE)),
                ],
                names=["__key", "__host", "total", "sure", "maybe", "phrases"],
            )


def stuffed(docs: DataFrame, key: str, text: str, host: str, hosts: int = HOSTS) -> DataFrame:
    """(key) of each page more than half of whose text is links, tags and stitched list phrases.

    A page needs ``LEAST`` words of such phrases or some links or tags. A shingle is replicated on ``hosts`` hosts and on ``SHARE``
    of all. Null, empty and blank texts aren't flagged, a null host is a host of its own, and a key that comes more than once comes
    out once if any of its rows is flagged.
    """
    from epochgrid.session import checkpoint

    source = docs.select(
        F.col(key).alias("__key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"), F.col(text).cast("string").alias("__text")
    ).filter(F.length("__text") > 0)
    kind = dict(docs.dtypes)[key]
    pages = checkpoint(
        source.mapInArrow(
            _pages,
            f"__key {kind}, __host string, total bigint, sure bigint, maybe boolean, "
            "phrases array<struct<size: bigint, times: bigint, words: int, need: int, own: bigint, shingles: array<bigint>, masks: array<bigint>>>",
        )
    )
    many = pages.agg(F.countDistinct("__host").alias("many"))
    posted = pages.select("__host", "maybe", F.explode(F.array_distinct(F.flatten("phrases.shingles"))).alias("shingle"))
    spread = (
        posted.groupBy("shingle", "__host")
        .agg(F.count_if("maybe").alias("asked"))
        .groupBy("shingle")
        .agg(F.count("*").alias("count"), F.sum("asked").alias("asked"))
        .crossJoin(F.broadcast(many))
        .filter((F.col("count") >= hosts) & (F.col("count") >= F.col("many") * SHARE) & (F.col("asked") > 0))
        .select("shingle", "asked")
    )
    share = F.col("asked") * HOT / F.col("all")
    hot = spread.crossJoin(F.broadcast(spread.agg(F.sum("asked").alias("all")))).filter(share > 1).select("shingle", F.ceil(share).cast("int").alias("salts"))
    hot = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    spread = spread.join(hot, "shingle", "left").select("shingle", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    open_ = pages.filter("maybe").withColumn("page", F.monotonically_increasing_id())
    parts = open_.select("page", F.posexplode("phrases").alias("at", "p")).select("page", "at", "p.*")
    pieces = parts.select("page", "at", F.explode(F.arrays_zip("shingles", "masks")).alias("s")).select(
        "page", "at", F.col("s.shingles").alias("shingle"), F.col("s.masks").alias("mask")
    )
    pieces = pieces.join(hot, "shingle", "left").withColumn("salt", F.pmod(F.xxhash64("page"), salts).cast("int")).drop("salts")
    replicated = pieces.join(spread, ["shingle", "salt"]).groupBy("page", "at").agg(F.bit_or("mask").alias("mask"))
    judged = (
        parts.select("page", "at", "size", "times", "words", "need", "own")
        .join(replicated, ["page", "at"], "left")
        .withColumn("known", F.bit_count(F.col("own").bitwiseOR(F.coalesce("mask", F.lit(0).cast("bigint")))))
        .filter("known >= need")
        .groupBy("page")
        .agg(F.sum("size").alias("stitched"), F.sum(F.col("words") * F.col("times")).alias("words"))
    )
    return (
        open_.select("page", "__key", "total", "sure")
        .join(judged, "page", "left")
        .filter(2 * (F.col("sure") + F.coalesce("stitched", F.lit(0))) > F.col("total"))
        .filter((F.col("sure") > 0) | (F.col("words") >= LEAST))
        .select(F.col("__key").alias(key))
        .distinct()
    )


def p8_found(spark, sf_dir: str) -> DataFrame:
    from epochgrid.sources.tables import table

    return stuffed(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
