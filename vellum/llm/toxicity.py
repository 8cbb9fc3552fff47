"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon (whole terms and stems) is learned from labelled texts: those that toxic texts have far more often than
others. Its entries stand in a trie. A word of a text runs through the trie together with a Levenshtein automaton of
the word, so terms with one edit (insert, delete, replace, swap of neighbours) are found without listing variants.
Stems of five letters or more are found at the beginning of longer words too, shorter ones with an edit in whole words
only. A word that clean labelled texts have is a word of its own and no misspelling, and a term with several such words
one edit away stands where the language is dense: it is matched exactly only, as most words near it would be words too.
Each hit gets a context window; quotation marks around it and words of reporting before it part quotation from abuse.

A hit with an edit counts as 0.8 of an exact one, in all features alike, so that a disguised term scores above its
quotation and above a text without it. A logistic regression over counts and densities of these hits gives the score;
its weights of abuse aren't negative, and a quotation weighs at most half as much as abuse.

Null and empty texts: scored as texts without a hit. Texts are scanned whole. Repeated rows: scored each. Rows without
a label don't teach; of rows with one id one text (the least) teaches, and of an id's labels the largest counts. Ties
of edit distance: the first term in order. Without toxic or without clean labelled texts the score is the share of
toxic ones (0 if none is labelled). Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_word = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")
#: Digits and signs that stand for letters in disguised words.
_disguise = str.maketrans("013457@$", "oleastas")
#: Marks of quotation and words that report another's speech.
_quotes = re.compile("[\"“”„«»‘’]")
_reports = frozenset("said says wrote called quoted quote reported dit écrit sagte schrieb dijo escribió".split())


class Trie:
    """Terms and stems by letter; ``None`` as a letter holds (term, whether it's a stem)."""

    def __init__(self, terms: dict[str, bool]):
        self.root: dict = {}
        self.terms = terms
        for t, stem in terms.items():
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[None] = (t, stem)

    def search(self, word: str, most: int) -> tuple[str, int] | None:
        """The best term within ``most`` edits of the word (of some prefix of it, for stems), and the edits.

        The state of the word's Levenshtein automaton is the row of edit distances of the trie's path to each prefix
        of the word; a branch ends where no entry of the row is within ``most``.
        """
        best: tuple[int, str] | None = None
        n = len(word)
        stack = [(self.root, "", None, None, list(range(n + 1)))]
        while stack:
            node, last, before, _, row = stack.pop()
            for c, child in node.items():
                if c is None:
                    term, stem = child
                    d = min(row) if stem else row[n]
                    if d <= most and (best is None or (d, term) < best):
                        best = d, term
                    continue
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    d = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (word[i - 1] != c))
                    if before is not None and i > 1 and word[i - 1] == last and word[i - 2] == c:
                        d = min(d, before[i - 2] + 1)
                    new.append(d)
                if min(new) <= most:
                    stack.append((child, c, row, None, new))
        return (best[1], best[0]) if best else None


@dataclass
class Lexicon:
    """A trie with a quick test in front: within one edit, a term's first or its second half is intact, or the letters on
    both sides of its middle are swapped. Words in ``own`` are no misspellings; terms in ``strict`` have none."""

    terms: dict[str, bool] = field(default_factory=dict)
    own: frozenset[str] = frozenset()
    strict: frozenset[str] = frozenset()
    fuzzy_from: int = 5

    def __post_init__(self):
        self.exact = {n: {t for t in self.terms if len(t) == n} for n in {len(t) for t in self.terms}}
        entries = {t: stem and len(t) >= self.fuzzy_from for t, stem in self.terms.items() if t not in self.strict}
        stems = [t for t, stem in entries.items() if stem]
        self.fuzzy = Trie(entries)
        half = {t: len(t) // 2 for t in entries}
        self.heads = {t[: half[t]] for t in entries} | {t[: half[t] - 1] + t[half[t]] for t in entries if half[t]}
        self.tails = {t[half[t] :] for t, stem in entries.items() if not stem}
        # after one edit before it, a stem's second half stands at most one place away from its own
        self.inner = {(half[t] + d, t[half[t] :]) for t in stems for d in (-1, 0, 1)}
        self.head_sizes, self.tail_sizes = ({len(x) for x in y} for y in (self.heads, self.tails))
        self.inner_spans = {(at, len(x)) for at, x in self.inner}
        self.sizes = {len(t) + d for t, stem in entries.items() if not stem for d in (-1, 0, 1)}
        self.open_from = min((len(t) - 1 for t in stems), default=1 << 62)
        self.seen: dict[str, tuple[str, int] | None] = {}

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of a lower-case word; disguises count as one edit."""
        if word in self.seen:
            return self.seen[word]
        out = self._match(word)
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[word] = out
        return out

    def _match(self, word: str) -> tuple[str, int] | None:
        for n, terms in self.exact.items():
            if (t := word[:n]) in terms and (self.terms[t] or n == len(word)):
                return t, 0
        plain = word.translate(_disguise) if not word.isalpha() else word
        if plain != word and (m := self._match(plain)) is not None:
            return m[0], max(1, m[1])
        if word not in self.own and (len(word) in self.sizes or len(word) >= self.open_from) and self._may(plain):
            return self.fuzzy.search(plain, 1)
        return None

    def _may(self, word: str) -> bool:
        return (
            any(word[:n] in self.heads for n in self.head_sizes)
            or any(word[-n:] in self.tails for n in self.tail_sizes)
            or any((at, word[at : at + n]) in self.inner for at, n in self.inner_spans)
        )


#: What a text is scored by; all but the first grow with abuse.
FEATURES = ["quoted", "abuse", "share", "distinct"]


def features(texts: list[str | None], lexicon: Lexicon, window: int = 60, per_edit: float = 0.8) -> np.ndarray:
    """A row of FEATURES for each text; ``window``: characters of context on either side of a hit; ``per_edit``: what a
    hit with an edit counts of an exact one."""
    out = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        if not text:
            continue
        low = text.lower()
        words = _word.findall(low)
        hits = {w: m for w in set(words) if (m := lexicon.match(w)) is not None}
        if not hits:
            continue
        abuse = quoted = 0.0
        terms: dict[str, float] = {}
        for m in _word.finditer(low):
            hit = hits.get(m[0])
            if hit is None:
                continue
            before, after = low[max(0, m.start() - window) : m.start()], low[m.end() : m.end() + window]
            marks = len(_quotes.findall(before)) % 2 == 1 and _quotes.search(after) is not None
            if marks or not _reports.isdisjoint(_word.findall(before)[-4:]):
                quoted += 1
            else:
                weight = per_edit ** hit[1]
                abuse += weight
                terms[hit[0]] = max(weight, terms.get(hit[0], 0.0))
        out[k] = [np.log1p(quoted), np.log1p(abuse), abuse / len(words) * 20, np.log1p(sum(terms.values()))]
    return np.minimum(out, 8)


def weighed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of FEATURES and intercept; what speaks against abuse although it is a count of abuse is left out."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1] + 1)
        w[np.append(use, True)] = logistic(x[:, use], y)
        wrong = np.append(False, w[1:-1] < 0)
        if not wrong.any():
            break
        use &= ~wrong
    w[0] = min(w[0], w[1:-1].sum() / 2)
    return w


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights (the last one: intercept) by Newton's method with weight decay."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([decay] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Scorer:
    """A fitted model."""

    terms: dict[str, bool] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))
    constant: float | None = 0.0
    own: frozenset[str] = frozenset()
    strict: frozenset[str] = frozenset()
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        held = common.kept("toxicity")
        if held.get("name") != self.name:
            held.update(name=self.name, lexicon=Lexicon(self.terms, self.own, self.strict))
        z = features(texts, held["lexicon"]) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 20_000, least_ratio: float = 40.0, stems: tuple[int, ...] = (4, 5, 6, 7, 8), dense: int = 3) -> Scorer:
    """Fit on ``docs`` joined with ``labels`` by id.

    Of copies one teaches. ``most``: labelled ids that may, a hash sample of about that many (the bound of the fitted
    sample; the ids are broadcast). ``least_ratio``: how much more often toxic texts have a term. ``stems``: lengths of the stems that may
    enter the lexicon. It holds every term that passes; the sample bounds their number. ``dense``: words of clean texts
    one edit away from a term from which on it is matched exactly only.
    """
    labels = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    n = labels.count()
    if n > most:
        labels = labels.filter((F.xxhash64(F.col(id_col).cast("string"), F.lit(4)) % 1_000_003 + 1_000_003) % 1_000_003 < int(most / n * 1_000_003))
    sample = docs.select(id_col, text_col).join(F.broadcast(labels), id_col).groupBy(id_col).agg(F.max("__label").alias("__label"), F.min(text_col).alias(text_col))

    @F.arrow_udf("long")
    def kin(texts: pa.Array) -> pa.Array:
        """Least hash of a text's four-word shingles: copies, and most near copies, share it, other texts don't."""

        def least(text: str | None) -> int:
            w = _word.findall((text or "").lower())
            return min(crc32(" ".join(w[i : i + 4]).encode()) for i in range(max(1, len(w) - 3)))

        return pa.array([least(t) for t in texts.to_pylist()], pa.int64())

    # copies of one text would make its every word a sign of its label: one of each kin teaches
    one = sample.select(id_col, text_col, "__label", kin(text_col).alias("__kin")).groupBy("__kin", "__label").agg(F.min(F.struct(id_col, text_col)).alias("__one"))
    sample = common.saved(one.select(F.col(f"__one.{text_col}").alias(text_col), "__label"), "toxic-sample")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, docs_in = Counter(), Counter(), [0, 0]
        for b in common.blocks(batches, text_col):
            for text, label in zip(b.column(text_col).to_pylist(), b.column("__label").to_pylist(), strict=True):
                words = {w for w in _word.findall((text or "").lower()) if len(w) > 3}
                found = words | {f"{w[:k]}*" for w in words for k in stems if len(w) >= k}
                (toxic if label else clean).update(found)
                docs_in[bool(label)] += 1
        names = list(toxic.keys() | clean.keys())
        rows = [("", docs_in[1], docs_in[0])] + [(w, toxic[w], clean[w]) for w in names]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 50_000], strict=True)], ["term", "in_toxic", "in_clean"])

    counted = sample.mapInArrow(terms, "term string, in_toxic long, in_clean long").groupBy("term").agg(F.sum("in_toxic").alias("t"), F.sum("in_clean").alias("c"))
    counted = common.saved(counted.filter((F.col("term") == "") | (F.col("t") >= 4) & (F.col("t") > F.col("c"))), "toxic-terms")
    total = counted.filter("term = ''").collect()
    n_toxic, n_clean = (total[0]["t"], total[0]["c"]) if total else (0, 0)
    if not n_toxic or not n_clean:
        for t in (counted, sample):
            common.drop_saved(t)
        return Scorer(constant=n_toxic / max(1, n_toxic + n_clean))
    rate = (F.col("t") / n_toxic) / ((F.col("c") + 0.5) / n_clean)
    # chance that a term without meaning is as one-sided, times all terms that a sample can have, stays far below 1
    share = n_toxic / (n_toxic + n_clean)
    chance = F.col("t") * float(np.log(share)) + F.when(F.col("c") > 0, F.col("c") * (1 + F.log((F.col("t") + F.col("c")) / F.col("c")))).otherwise(0.0)
    found = counted.filter((F.col("term") != "") & (rate >= least_ratio) & (chance < -float(np.log(1e6)))).collect()
    chosen: dict[str, bool] = {}
    for t in sorted((r["term"] for r in found), key=lambda t: (not t.endswith("*"), t)):
        if t.endswith("*"):
            chosen[t[:-1]] = True
    full = {r["term"]: r["t"] for r in found if not r["term"].endswith("*")}
    most_of: Counter = Counter()  # texts of the most frequent word under each beginning
    for w, n in full.items():
        for k in stems:
            if len(w) >= k:
                most_of[w[:k]] = max(most_of[w[:k]], n)
    for r in found:  # a stem that only one whole word explains is that word
        t = r["term"]
        if t.endswith("*") and most_of[t[:-1]] >= max(1, 0.8 * r["t"]):
            chosen.pop(t[:-1], None)
    # nor does a stem add to a shorter one that is found misspelled as well
    chosen = {t: stem for t, stem in chosen.items() if not any(Lexicon.fuzzy_from <= k < len(t) and t[:k] in chosen for k in stems)}
    # a stem stands for the words under it where it is long enough to be found misspelled
    chosen |= {w: False for w in full if not any(k >= Lexicon.fuzzy_from and w[:k] in chosen for k in stems)}
    common.drop_saved(counted)
    bare = Lexicon(chosen)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words one edit away from a term, and how many toxic and clean texts have them."""
        found = {0: Counter(), 1: Counter()}
        for b in common.blocks(batches, text_col):
            for text, label in zip(b.column(text_col).to_pylist(), b.column("__label").to_pylist(), strict=True):
                found[int(bool(label))].update(w for w in set(_word.findall((text or "").lower())) if (m := bare.match(w)) is not None and m[1])
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[k][w] for w in names], pa.int64()) for k in (1, 0))], ["term", "in_toxic", "in_clean"])

    words = sample.mapInArrow(near, "term string, in_toxic long, in_clean long").groupBy("term").agg(F.sum("in_toxic").alias("t"), F.sum("in_clean").alias("c"))
    own = frozenset(r["term"] for r in words.filter((F.col("c") > 0) & (rate < least_ratio)).collect())
    beside = Counter(bare.match(w)[0] for w in own)
    strict = frozenset(t for t, k in beside.items() if k >= dense)
    lexicon = Lexicon(chosen, own, strict)

    @F.arrow_udf("array<double>")
    def seen(texts: pa.Array) -> pa.Array:
        return pa.array([r.tolist() for r in features(texts.to_pylist(), lexicon)], pa.list_(pa.float64()))

    rows = sample.select(seen(text_col).alias("x"), "__label").toPandas()
    common.drop_saved(sample)
    return Scorer(chosen, weighed(np.array(rows["x"].tolist()), rows["__label"].to_numpy(float)), None, own, strict)


def score(text: F.Column, model: Scorer) -> F.Column:
    """Column: the probability of label 1."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.scores(texts.slice(i, 2000).to_pylist()) for i in range(0, len(texts), 2000)] or [np.zeros(0)]), pa.float64())

    return run(text)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text. Null and empty texts are scored by the bias alone; texts of any length are scored whole;
    equal texts get equal scores, repeated rows one each; an empty table gives no row; labels, lang, source and doc_id
    never enter a score."""
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = common.crc_mod("doc_id", 5) == 0
    model = fit(docs, labels.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), score(F.col("text"), model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
