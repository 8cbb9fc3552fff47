"""True recurrences: what a row becomes decides how later rows are read. One group a document, in pandas.

Each rule is a plain function over a document's rows in order, so tests can call it without Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

ZONES = ("METADATA", "FRONT_MATTER", "BODY", "BACK_MATTER")
_front = re.compile(r"^\s*(?:chapter\s+\d+|learning objectives|key terms|outline|introduction)\b", re.I)
_body = re.compile(r"^\s*<(?:H1|body)>|^\s*#\s|^[A-Z][^.]{3,60}$")
_back = re.compile(r"^\s*(?:references|bibliography|suggested readings?|answers|index|glossary)\s*:?\s*$", re.I)
_box = re.compile(r"^\s*<(/?)(NBX|BX\d+)>", re.I)


def zones(texts: Iterable[str | None]) -> list[str]:
    """Zone of each row: metadata, front matter, body, back matter only go forward; boxes nest inside body."""
    at, boxes, out = 0, [], []
    for t in texts:
        t = t or ""
        m = _box.match(t)
        if m and not m[1]:
            boxes.append(f"BOX_{m[2].upper()}")
            out.append(boxes[-1])
            continue
        if m:
            out.append(boxes[-1] if boxes else ZONES[at])
            name = f"BOX_{m[2].upper()}"
            if name in boxes:
                while boxes.pop() != name:
                    pass
            continue
        if not boxes:
            if at < 3 and _back.match(t) and at >= 2:
                at = 3
            elif at < 1 and _front.match(t):
                at = 1
            elif at < 2 and _body.match(t):
                at = 2
        out.append(boxes[-1] if boxes else ZONES[at])
    return out


def repaired_levels(levels: Iterable[int | None]) -> list[int | None]:
    """Heading levels without jumps: a level goes down to one below the last repaired heading."""
    last, out = 0, []
    for v in levels:
        if v is None or v != v:
            out.append(None)
            continue
        last = min(int(v), last + 1)
        out.append(last)
    return out


def nested_positions(rows: Iterable[tuple[str | None, int]]) -> list[str | None]:
    """FIRST, MID or LAST for rows (family, level): deeper rows don't end an outer run, a row of another family at the
    same or an outer level does. Family None: no list; an empty one bridges."""
    rows = list(rows)
    out: list[str | None] = [None] * len(rows)
    open_: dict[int, tuple[str, list[int]]] = {}

    def close(level: int) -> None:
        for k in [k for k in open_ if k >= level]:
            _, members = open_.pop(k)
            for i in members:
                out[i] = "MID"
            out[members[-1]] = "LAST"
            out[members[0]] = "FIRST"

    for i, (family, level) in enumerate(rows):
        if family is None:
            close(0)
        elif family:
            close(level + 1)
            if level in open_ and open_[level][0] != family:
                close(level)
            open_.setdefault(level, (family, []))[1].append(i)
    close(0)
    return out


def box_segments(tags: Iterable[str]) -> list[tuple[int, int, bool, bool]]:
    """(start, end, has type, has title) of boxes between OPEN and CLOSE; an open box ends with the next one or the
    document."""
    out, start, kind, title = [], None, False, False
    tags = list(tags)
    for i, t in enumerate([*tags, None]):
        if start is not None and (t in ("OPEN", "CLOSE") or t is None):
            out.append((start, i if t == "CLOSE" else i - 1, kind, title))
            start = None
        if t == "OPEN":
            start, kind, title = i, False, False
        elif start is not None and t:
            kind, title = kind or t.endswith("TYPE"), title or t.endswith("TTL")
    return out


def continued(lines: Iterable[str]) -> list[str]:
    """Lines joined while round brackets are open."""
    out, held = [], ""
    for line in lines:
        held = f"{held} {line}".strip() if held else line
        if held.count("(") <= held.count(")"):
            out.append(held)
            held = ""
    return out + [held] if held else out


def by_document(df: DataFrame, doc: str, pos: list[str], columns: list[str], rule: Callable[..., list], name: str, kind: str) -> DataFrame:
    """Apply a rule to the columns of each document's rows in order; adds column ``name``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        values = [[None if v is None or v != v else v for v in pdf[c]] for c in columns]
        pdf[name] = pd.Series(rule(values[0] if len(values) == 1 else list(zip(*values, strict=True))), index=pdf.index, dtype="object")
        return pdf

    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(doc).applyInPandas(run, f"{keep}, {name} {kind}")
