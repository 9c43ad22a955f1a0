"""Text of records and tables: canonical keys, number formats, lines of Markdown tables."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def canonical(record: dict) -> str:
    """JSON with sorted keys: equal records have equal text."""
    return json.dumps(record, sort_keys=True, ensure_ascii=False)


def digest(record: dict, kind: str = "sha1", size: int | None = None) -> str:
    return hashlib.new(kind, canonical(record).encode()).hexdigest()[:size]


def key_of(x: float) -> str:
    """A number as a key: its shortest exact text."""
    return repr(float(x))


def number(x: Column, places: int = 2, comma: bool = True) -> Column:
    """Fixed places, with a decimal comma; a dash for null."""
    text = F.format_string(f"%.{places}f", F.bround(x, places))  # halves to even
    return F.when(x.isNull(), DASH).otherwise(F.translate(text, ".", ",") if comma else text)


def percent(x: Column, places: int = 2) -> Column:
    return number(x * 100, places)


def signed(x: Column, places: int = 2) -> Column:
    """With its sign, also for zero."""
    return F.when(x.isNull(), DASH).otherwise(F.concat(F.when(x < 0, "−").otherwise("+"), number(F.abs(x), places)))


def interval(lo: Column, hi: Column, places: int = 2, sign: bool = False) -> Column:
    f = signed if sign else number
    return F.when(lo.isNull() | hi.isNull(), DASH).otherwise(F.concat(F.lit("["), f(lo, places), F.lit("; "), f(hi, places), F.lit("]")))


def with_interval(x: Column, lo: Column, hi: Column, places: int = 2) -> Column:
    return F.when(x.isNull(), DASH).otherwise(F.when(lo.isNull(), number(x, places)).otherwise(F.concat(number(x, places), F.lit(" "), interval(lo, hi, places))))


def fraction(num: Column, den: Column) -> Column:
    """num/den as text."""
    return F.concat_ws("/", num.cast("string"), den.cast("string"))


def table_label(section: Column, no: Column) -> Column:
    return F.concat_ws(".", section.cast("string"), no.cast("string"))


def sections(markdown: str) -> dict[str, list[list[str]]]:
    """Tables of a Markdown text by the heading above them, as rows of cells; rules between heads and rows are left out."""
    out: dict[str, list[list[str]]] = {}
    head = ""
    for line in markdown.splitlines():
        if found := re.match(r"#+\s+(.*)", line):
            head = found[1].strip()
        elif line.lstrip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                out.setdefault(head, []).append(cells)
    return out


def numbered_tables(markdown: str, section: str) -> str:
    """Captions ``Table:`` of a text get their numbers, section.1 on."""
    n = iter(range(1, 1 + markdown.count("Table:")))
    return re.sub(r"Table:", lambda _: f"Table {section}.{next(n)}:", markdown)


def cell(rows: list[list[str]], row: str, column: str) -> float | None:
    """The number in a table's cell, by the first cell of its row and the head of its column; None for a dash."""
    at = rows[0].index(column)
    text = next(r[at] for r in rows[1:] if r[0] == row)
    found = re.match(r"[+−-]?[0-9]+(?:[.,][0-9]+)?", text)
    return float(found[0].replace(",", ".").replace("−", "-")) if found else None
