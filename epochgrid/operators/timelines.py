"""Timeline JSON into flat, linked rows: one for each track entry, event and missing entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochgrid.operators.arrow import sliced
from epochgrid.operators.structural import LIST, OBJECT, SCALAR, STRING, JsonIndex, indexed

# The tracks of a timeline, in canonical order, and the two lists beside them.
TRACKS = ["site_type", "polity", "culture", "religion", "language", "name", "population"]
SECTIONS = [*TRACKS, "events", "missing_entities"]

#: Bytes of JSON that are indexed at once; the index takes some forty times as much memory.
BLOCK = 4 << 20

_TYPES = {
    "record_id": "string", "section": "string", "ordinal": "int", "year": "bigint", "to_year": "bigint", "label": "string",
    "qid": "string", "kind": "string", "role": "string", "confidence": "string", "lang": "string", "notes": "string",
    "context": "string", "proposed_qid": "string", "from_precision": "bigint", "from_circa": "string",
}
_DIRECT = {"kind", "role", "confidence", "notes", "context", "proposed_qid", "from_circa"}


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first in the given order; rows without a key are left out.

    The rank limit is applied before the shuffle too, so copies of a hot key stay where they are.
    """
    best = Window.partitionBy(key).orderBy(*order)
    return df.filter(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank")


def _int32(column: pa.Array) -> pa.Array:
    return column.cast(pa.int32())


def _rows(index: JsonIndex, ids: pa.Array, columns: list[str], sections: list[str]) -> pa.RecordBatch | None:
    f = index.fields(
        [*SECTIONS, "tracks", "rejection", "entries", "from", "to", "year", "value", "text", "wikidata", "type", "lang", "from_precision"]
        + sorted(_DIRECT & set(columns))
    )
    root = index.roots()
    root = np.where(index.kinds(root) == OBJECT, root, -1)
    root = np.where(index.is_null(f["rejection"][root]), root, -1)
    tracks = f["tracks"][root]
    tracks = np.where(index.kinds(tracks) == OBJECT, tracks, root)
    section_of = np.full(len(index.at) + 1, -1, np.int16)
    for k, name in enumerate(SECTIONS):
        if name not in sections:
            continue
        held = f[name][tracks]
        held = np.where(held >= 0, held, f[name][root])
        lists = np.where(index.kinds(held) == OBJECT, f["entries"][held], held)
        section_of[lists[index.kinds(lists) == LIST]] = k
    section_of[-1] = -1
    items = np.flatnonzero((index.kind == OBJECT) & index.value & (section_of[index.parent] >= 0))
    if not items.size:
        return None
    section = section_of[index.parent[items]]
    event, missing = section == SECTIONS.index("events"), section == SECTIONS.index("missing_entities")
    value = f["value"][items]
    inner = index.kinds(value) == OBJECT
    made: dict[str, pa.Array] = {}
    for c in columns:
        if c == "record_id":
            made[c] = ids.take(pa.array(index.text[items]))
        elif c == "section":
            made[c] = pa.DictionaryArray.from_arrays(pa.array(section.astype(np.int32)), pa.array(SECTIONS)).cast(pa.string())
        elif c == "ordinal":
            made[c] = _int32(pa.array(index.ordinal[items]))
        elif c == "year":
            made[c] = index.numbers(np.where(event, f["year"][items], f["from"][items]))
        elif c == "to_year":
            made[c] = index.numbers(f["to"][items])
        elif c == "label":
            own = np.where(section == SECTIONS.index("name"), f["text"][value], f["name"][value])
            made[c] = index.texts(
                np.where(event, f["type"][items], np.where(missing, f["name"][items], np.where(inner, own, value)))
            )
        elif c == "qid":
            beside = np.where(index.kinds(value) == STRING, f["wikidata"][items], -1)
            made[c] = index.texts(np.where(inner, f["wikidata"][value], beside))
        elif c == "lang":
            made[c] = index.texts(np.where(inner, f["lang"][value], -1))
        elif c == "from_precision":
            made[c] = index.numbers(f[c][items])
        else:
            made[c] = index.texts(f[c][items])
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def timeline_items(
    df: DataFrame, key: str, json: str, columns: list[str] | None = None, sections: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """One row for each item of the timelines in a column of JSON texts.

    Every list of a section gives its objects in order; ``ordinal`` is the position in the list, counted over all its
    members. The older forms are read too: bare lists for ``{"entries": ...}``, a ``tracks`` wrapper, JSON in a JSON
    string. Unreadable JSON, null, empty texts and rejections give no rows. ``year`` and ``to_year`` are null if absent
    or no number; texts are null if absent. Copies of a record are not removed here (see ``latest``). ``keep`` names
    columns of ``df`` that each item repeats; they come last, under their own names.
    """
    columns = columns or list(_TYPES)
    sections = sections or SECTIONS
    keep = keep or []
    source = df.select(F.col(key).cast("string").alias("__id"), F.col(json).alias("__json"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    source = source.filter(F.col("__json").isNotNull() & (F.length("__json") > 1))
    types = dict(df.dtypes)
    schema = ", ".join([f"{c} {_TYPES[c]}" for c in columns] + [f"`__k{i}` {types[c]}" for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "__json", BLOCK):
                for index, rows in indexed(batch.column("__json")):
                    # the row number travels as the id when columns are kept beside it
                    at = pa.array(rows)
                    ids = batch.column("__id").take(at)
                    if not keep:
                        if (out := _rows(index, ids, columns, sections)) is not None:
                            yield out
                        continue
                    named = [c for c in columns if c != "record_id"]
                    out = _rows(index, at, ["record_id", *named], sections)
                    if out is None:
                        continue
                    row = out.column("record_id")
                    arrays = [batch.column("__id").take(row) if c == "record_id" else out.column(c) for c in columns]
                    arrays += [batch.column(f"__k{i}").take(row) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *[f"__k{i}" for i in range(len(keep))]])

    out = source.mapInArrow(run, schema)
    return out.select(*columns, *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])


def flat_items(sites: DataFrame, dump: DataFrame) -> DataFrame:
    """All items of both tables, each record once: (origin, record_id, section, ordinal, year, label).

    Of rows with one id the last stamped counts. A missing year, and one that no INT holds, is 0, a missing label empty; rows without id are left out.
    """
    wanted = ["record_id", "section", "ordinal", "year", "label"]
    parts = []
    for origin, df, stamp in (("sites", sites, "last_updated"), ("timeline_dump", dump, "extracted_at")):
        records = df.select("id", "timeline", F.col(stamp).alias("__stamp")).filter(F.col("timeline").isNotNull())
        records = latest(records, "id", F.col("__stamp").desc_nulls_last())
        parts.append(timeline_items(records, "id", "timeline", wanted).select(F.lit(origin).alias("origin"), *wanted))
    return (
        parts[0]
        .unionByName(parts[1])
        .withColumn("year", F.coalesce(F.col("year").try_cast("int"), F.lit(0)))
        .withColumn("label", F.coalesce(F.col("label"), F.lit("")))
    )


def p3_found(spark, sf_dir: str) -> DataFrame:
    from epochgrid.sources.tables import table

    return flat_items(table(spark, sf_dir, "sites"), table(spark, sf_dir, "timeline_dump"))
