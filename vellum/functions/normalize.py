"""Unicode normal forms, which Spark 4.1 has no function for: Arrow batches."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_punctuation, collapsed


def normal_form(c: Column, form: str) -> Column:
    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in x.to_pylist()], pa.string())

    return run(c)


def integrity_text(c: Column) -> Column:
    """NFKC, ASCII punctuation, markers dropped, white space collapsed."""
    return collapsed(F.regexp_replace(ascii_punctuation(normal_form(c, "NFKC")), r"</?[A-Za-z][A-Za-z0-9 _-]*>", " "))


def without_diacritics(c: Column) -> Column:
    """NFKD without combining marks."""
    return F.regexp_replace(normal_form(c, "NFKD"), r"\p{Mn}+", "")
