"""Language identification by nearest centroid.

A text's vector holds the TF-IDF weights of its hashed byte 1- to 4-grams (letters lower-cased, all that is neither
letter nor UTF-8 tail made a space), normalised to length 1. Each language has several centroids, found by spherical
k-means on a bounded sample of labelled texts; document frequencies come from all labelled texts. A text gets the
language of the centroid with the largest cosine; a text whose cosine is far below what texts of its length reach in
training is rejected.

Null texts and texts without a letter: language ``und``, score 0, rejected. Texts of any length are read whole.
Repeated rows: predicted each. No labelled text at all: every row is ``und``. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hash buckets of n-grams.
DIMS = 1 << 12
UND = "und"
_letter = regex.compile(r"\p{L}").search

#: Bytes to features: ASCII letters in lower case, UTF-8 bytes as they are, all else a space.
_fold = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (texts x DIMS) of hashed n-grams; none crosses from one text to the next."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)
    if not len(data):
        return out
    b = _fold[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    last = offsets[1:][doc]
    key, at = np.zeros(len(b), np.uint32), np.arange(len(b))
    total = np.zeros(n * DIMS, np.int64)
    for k in range(1, 5):
        m = len(b) - k + 1
        if m <= 0:
            break
        key = key[:m] * np.uint32(257) + b[k - 1 :] + np.uint32(1)
        whole = at[:m] + k <= last[:m]
        h = (key * np.uint32(2654435761)) >> np.uint32(32 - 12)
        total += np.bincount((doc[:m] * DIMS + h)[whole], minlength=n * DIMS)
    return total.reshape(n, DIMS).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, rows of length 1."""
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids of unit rows by spherical k-means, started from spread-out rows; the same for any order."""
    x = x[np.lexsort(x.T[:8])]
    mean = x.mean(0)
    chosen = [int((x @ mean).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def size_class(n: np.ndarray) -> np.ndarray:
    """Power of two of a text's bytes, 0 to 20."""
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), 20)


@dataclass
class Centroids:
    """A fitted model: languages of the centroids, centroids, weights, least usual cosine by language (in order) and size class."""

    langs: list[str] = field(default_factory=list)
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS, np.float32))
    least: np.ndarray = field(default_factory=lambda: np.zeros((0, 21)))

    def __call__(self, texts: pa.Array, sharpness: float = 12.0) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        common.kept("language")
        size = np.zeros(len(texts), np.int64)
        best_lang = np.zeros(len(texts), np.int64)
        score, reject = np.zeros(len(texts)), np.ones(len(texts), bool)
        names = sorted(set(self.langs))
        member = np.array([[lang == x for x in names] for lang in self.langs])
        data, offsets = common.raw(texts)
        for i, j in common.spans(np.diff(offsets)):
            part = offsets[i : j + 1]
            size[i:j] = np.diff(part)
            if not names:
                continue
            for a in range(i, j, 128):
                o = offsets[a : min(a + 128, j) + 1]
                x = vectors(gram_counts(data[o[0] : o[-1]], o - o[0]), self.idf)
                cos = x @ self.centroids.T
                by_lang = np.stack([cos[:, member[:, m]].max(1) for m in range(len(names))], 1)
                top = by_lang.argmax(1)
                e = np.exp(sharpness * (by_lang - by_lang.max(1, keepdims=True)))
                s = slice(a, a + len(o) - 1)
                best_lang[s], score[s] = top, e.max(1) / e.sum(1)
                reject[s] = by_lang.max(1) < self.least[top, size_class(np.diff(o))]
        out = []
        for k, t in enumerate(texts):
            text = t.as_py()
            ok = bool(names) and text is not None and _letter(text) is not None
            out.append(names[best_lang[k]] if ok else UND)
            if not ok:
                score[k], reject[k] = 0.0, True
        return out, score, reject


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, clusters: int = 4, slack: float = 0.8, unjudged: int = 5, low: float = 0.02, enough: int = 50) -> Centroids:
    """Fit on rows with a text and a language.

    Document frequencies: all rows. Centroids: a hash sample of about ``per_language`` rows of each language, which
    bounds what is fitted; each language is fitted in a task of its own. ``slack``: a text is rejected when its
    cosine is below this share of the ``low`` quantile among its language's training texts of its size class, and of as
    many smaller classes as it takes for ``enough`` texts, so that a few odd texts don't set the bar. ``unjudged``: texts of fewer
    than 2^this bytes hold too little to be rejected for their distance.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, F.col(lang_col).cast("string").alias(lang_col))
    counts = {r[lang_col]: r["n"] for r in rows.groupBy(lang_col).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Centroids()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("language")
        df, n = np.zeros(DIMS, np.int64), 0
        for b in common.blocks(batches, text_col):
            data, offsets = common.raw(b.column(text_col))
            for a in range(0, b.num_rows, 128):
                o = offsets[a : a + 129]
                df += (gram_counts(data[o[0] : o[-1]], o - o[0]) > 0).sum(0)
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS)), pa.array(df)], ["dim", "df"])

    found = rows.select(text_col).mapInArrow(frequencies, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIMS)
    for r in found:
        df[r["dim"]] = r["df"]
    idf = (np.log((1 + sum(counts.values())) / (1 + df)) + 0.1).astype(np.float32)

    share = F.lit(2.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, per_language / n)).otherwise(share)
    sample = rows.filter((F.xxhash64(F.col(id_col).cast("string"), F.lit(8)) % 1_000_003 + 1_000_003) % 1_000_003 < share * 1_000_003)

    def centroids(t: pa.Table) -> pa.Table:
        x, size = [], []
        for b in common.blocks(iter(t.select([text_col]).combine_chunks().to_batches()), text_col):
            data, offsets = common.raw(b.column(text_col))
            for a in range(0, b.num_rows, 128):
                o = offsets[a : a + 129]
                x.append(vectors(gram_counts(data[o[0] : o[-1]], o - o[0]), idf))
            size.append(np.diff(offsets))
        v = np.concatenate(x)
        c = clustered(v[(v != 0).any(1)], clusters) if (v != 0).any() else v[:1]
        cos, kind = (v @ c.T).max(1), size_class(np.concatenate(size))
        least = np.zeros(21)
        for k in range(unjudged, 21):
            of = next((m for j in range(k, -1, -1) if (m := (kind >= j) & (kind <= k)).sum() >= enough), kind <= k)
            least[k] = np.quantile(cos[of], low, method="lower") if of.any() else 0.0
        least = least.tolist()
        lang = t.column(lang_col)[0].as_py()
        return pa.table({"lang": [lang] * len(c), "centroid": list(c.astype(np.float32)), "least": [least] * len(c)})

    fitted = sorted(sample.groupBy(lang_col).applyInArrow(centroids, "lang string, centroid array<float>, least array<double>").collect(), key=lambda r: (r["lang"], r["centroid"]))
    by = {r["lang"]: r["least"] for r in fitted}
    least = np.array([by[x] for x in sorted(by)]).reshape(-1, 21)
    return Centroids([r["lang"] for r in fitted], np.array([r["centroid"] for r in fitted], np.float32).reshape(-1, DIMS), idf, least * slack)


def identified(text: F.Column, model: Centroids) -> F.Column:
    """Column: struct of lang_pred, score and rejected."""

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pa.Array) -> pa.Array:
        lang, score, reject = model(texts)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())], ["lang_pred", "score", "rejected"])

    return run(text)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text. Null texts and those without a letter are und; texts of any length count whole; of
    equally near languages the first by name is taken; repeated rows are judged each; an empty table gives no row; lang,
    source and doc_id never enter a prediction."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_mod("doc_id", 4) == 2
    model = fit(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), identified(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
