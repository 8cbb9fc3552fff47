"""Citations in text: extraction with span priority, keys, matches and outcomes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_name = r"[A-Z][\w'’-]+"
_year = r"(?:1[89]|20)\d\d[a-z]?"
_authors = rf"{_name}(?:\s+et\s+al\.?|(?:,\s+{_name})*,?\s+(?:&|and)\s+{_name})?"
#: Kinds in order of priority; a span that an earlier kind holds isn't matched again.
_kinds = [
    ("secondary", re.compile(rf"(?P<a>{_authors}),?\s*\(?(?P<y>{_year})?,?\s*as\s+cited\s+in\s+(?P<b>{_authors}),?\s*(?P<z>{_year})")),
    ("multi_year", re.compile(rf"(?P<a>{_authors}),?\s*\(?(?P<y>{_year}(?:,\s*{_year})+)")),
    ("parenthetical", re.compile(rf"(?<=[(;])\s*(?:e\.g\.,\s*|see\s+)?(?P<a>{_authors}),\s*(?P<y>{_year})")),
    ("narrative", re.compile(rf"(?P<a>{_authors})\s*\((?P<y>{_year})")),
]


def found(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, authors, years) of the citations of a text, by position."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern in _kinds:
        for m in pattern.finditer(text or ""):
            if all(m.end() <= a or m.start() >= z for a, z in taken):
                taken.append(m.span())
                out.append((m.start(), m.end(), kind, m["a"], m["y"] or ""))
    return sorted(out)


_row = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), *(StructField(n, StringType()) for n in ("kind", "authors", "years"))])


@F.udtf(returnType=_row)
class Citations:
    """Table function: the citations of a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from found(text)


def extracted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, kind, authors, years) for each citation. Texts without a year in them never reach Python."""
    few = df.filter(F.col(text).rlike(r"(1[89]|20)[0-9]{2}")).select(key, text)
    return few.lateralJoin(Citations(F.col(text).outer())).drop(text)


def normal_name(c: Column) -> Column:
    """Lower case, apostrophes and et al. folded."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "’", "'"), r"\s*(,?\s*et\s+al\.?)$", ""))


def matched(cites: DataFrame, listed: DataFrame, doc: str) -> DataFrame:
    """Outcome of each citation (doc, cite, author, year) against the list (doc, ref, author, year): exact, same first
    surname, year with another suffix, other year, not found; the best class, then the first reference."""
    first = lambda c: F.regexp_extract(normal_name(c), r"^([^\s,&]+)", 1)
    c = cites.withColumns({"__first": first(F.col("author")), "__full": normal_name(F.col("author"))})
    r = listed.select(doc, "ref", normal_name(F.col("author")).alias("__rfull"), first(F.col("author")).alias("__first"), F.col("year").alias("__ryear"))
    both = c.join(r, [doc, "__first"], "left")
    bare = lambda y: F.regexp_replace(y, "[a-z]$", "")
    kind = (
        F.when(F.col("ref").isNull(), 9)
        .when((F.col("__full") == F.col("__rfull")) & (F.col("year") == F.col("__ryear")), 1)
        .when(F.col("year") == F.col("__ryear"), 2)
        .when(bare(F.col("year")) == bare(F.col("__ryear")), 3)
        .otherwise(4)
    )
    w = Window.partitionBy(doc, "cite").orderBy("__kind", "ref")
    names = F.create_map(*(F.lit(x) for kv in {1: "exact", 2: "smart", 3: "suffix", 4: "year_mismatch", 9: "not_found"}.items() for x in kv))
    return both.withColumn("__kind", kind).withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(doc, "cite", "author", "year", "ref", names[F.col("__kind")].alias("outcome"))
