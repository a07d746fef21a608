"""The queries of this subpackage and their SQL. None of them can be told in SQL; tests compare them with brute force."""

from __future__ import annotations

from epochgrid.llm.canonical import p1_found
from epochgrid.llm.encode import p6_ids
from epochgrid.llm.leak import p7_found
from epochgrid.llm.stuffing import p8_found
from epochgrid.llm.variants import p5_found

QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}
ORACLE: dict[str, str] = {}
