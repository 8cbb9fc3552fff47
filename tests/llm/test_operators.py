"""Each operator against brute force on small rows, with nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import chat, common, language, ngram_join, packing, prefix_counts, spiece, suffix_dedup, toxicity, vector_dedup, webp

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def texts(seed: int = 5) -> list[str | None]:
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."
    base = [say(r.randint(1, 80)) for _ in range(40)]
    long = say(6000)
    shared = say(60)
    out: list[str | None] = [None, "", "   ", "one", "Two words.", "a  b\n c", "naïve café 東京 🙂", "</s><|endoftext|> x", *base, *base[:6], long, long + " end", f"{base[3]} {shared} tail", f"{shared} {base[4]}", shared * 2]
    for b in base[6:16]:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", t) for i, t in enumerate(texts())]
    rows.append(rows[12])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_packing(docs, none):
    path = common.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    got = packing.pack(docs.coalesce(2), path, window=256).toPandas()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts())}
    covered = {}
    for p in got.itertuples():
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
    assert covered == {i: len(x) * (2 if i == 12 else 1) for i, x in ids.items()}
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 256 and (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()
    assert packing.pack(none, path).count() == 0


def test_packing_is_optimal():
    r = random.Random(1)
    for _ in range(60):
        place = np.array(sorted({0, *r.sample(range(1, 40), 9)}))
        pen = np.array([r.choice([0, 0, 3]) for _ in place], float)
        if np.diff(place).max() > 12:
            continue
        cost = lambda stops: sum(12 - (b - a) + pen[list(place).index(b)] for a, b in zip([0, *stops[:-1]], stops, strict=True))  # noqa: B023, E731
        best = [float("inf")] * len(place)
        best[0] = 0
        for j in range(1, len(place)):
            best[j] = min(best[i] + 12 - (place[j] - place[i]) + pen[j] for i in range(j) if place[j] - place[i] <= 12)
        assert cost(packing.cuts(place, pen, 12).tolist()) == best[-1]


def brute_links(rows: dict[int, str | None], n: int = 4, num: int = 85) -> dict[int, tuple[int, int]]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_ngram_join(docs, none):
    for n, num in ((4, 85), (5, 80), (2, 95)):
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.linked(docs, n, num).collect()}
        assert got == {(k, *v) for k, v in brute_links(dict(enumerate(texts())), n, num).items()}
    assert ngram_join.linked(none).count() == 0


def test_ngram_join_near_copies(spark):
    """A chain of copies with many edits: chunks and spanning forests lose no link."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = {}
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = f"x{r.randrange(1000)}"
        rows[k] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for n, num in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df, n, num, chunk=16).collect()}
        assert got == brute_links(rows, n, num)


def test_ngram_join_rounds(spark):
    """Clusters of which the centre is no typical member, null ids, and clashing columns."""
    r = random.Random(11)
    rows: list[tuple] = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(30):
            w = list(base)
            for _ in range(r.randint(0, 14)):
                w[r.randrange(120)] = f"y{r.randrange(60)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, node int, component_id int, `groups` string")
    for n, num in ((4, 85), (5, 80), (3, 90)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df, n, num, chunk=7).collect()}
        assert got == brute_links(dict(rows), n, num)
    nulls = spark.createDataFrame([(None, "a b c d e f g"), (None, "z y x w v u"), (3, "z y x w v u"), (5, "a b c d e f g"), (9, "one two three four five")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.linked(nulls).collect()), key=str) == [(3, 3), (5, 5), (9, 9), (None, 3), (None, 5)]


def test_sketches_bound_the_difference():
    r = np.random.default_rng(0)
    a, b = (np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64)) for _ in range(2))
    b = np.unique(np.concatenate([a[:280], b[:15]]))
    s = ngram_join.sketches([a, b], 1024)
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_sentencepiece(docs, none):
    path = common.tokenizer_path("piece_bpe_32k.model")
    rows = spiece.encoded(docs, path).collect()
    assert all(r["parity"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["decoded"] == (t or "").encode() for i, t in enumerate(texts()) if t != "   ")
    assert spiece.digest(spiece.encoded(docs, path)).count() == docs.count() and spiece.encoded(none, path).count() == 0


def test_toxicity(spark, none):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            w[r.randrange(30)] = r.choice(["grobbler", "snazzard"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"grobbler", "snazzard"} <= set(model.terms) or any(model.terms.values())
    lexicon = toxicity.Lexicon({"grobbler": False, "snazzard": False})
    assert lexicon.match("grobbler") == ("grobbler", 0)
    for w in ("grobler", "grobbbler", "grobblor", "gorbbler", "gr0bbler"):
        assert lexicon.match(w) == ("grobbler", 1), w
    assert lexicon.match("grable") is None
    f = toxicity.features(['He said "you grobbler" to them.', "you grobbler", None, ""], lexicon)
    assert f[0][0] > 0 and f[0][1] == 0 and f[1][1] > 0 and not f[2:].any()
    s = model.scores(["you grobbler", "kind alpha3 words", None, ""])
    assert s[0] > 0.5 > s[1] and ((0 <= s) & (s <= 1)).all()
    empty = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.scores(["x"]).tolist() == [0.0] and none.select(toxicity.score(F.col("text"), empty)).count() == 0


def test_automaton_against_brute_force():
    def distance(a: str, b: str) -> int:
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r = random.Random(4)
    terms = ["".join(r.choice("abc") for _ in range(r.randint(3, 6))) for _ in range(12)]
    trie = toxicity.Trie({t: False for t in terms})
    for _ in range(300):
        w = "".join(r.choice("abc") for _ in range(r.randint(2, 7)))
        best = min((distance(w, t), t) for t in terms)
        got = trie.search(w, 1)
        assert (got is None) == (best[0] > 1) and (got is None or (got[1], got[0]) == best)


def test_lexicon_against_brute_force():
    """What the quick test lets through: every word within one edit of a term, or with a beginning within one of a stem."""

    def edited(t: str, letters: str) -> set[str]:
        cuts = [(t[:i], t[i:]) for i in range(len(t) + 1)]
        return {t} | {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}

    r = random.Random(6)
    for letters, n in (("abcdefghij", 12), ("abc", 4)):
        terms = {"".join(r.choice(letters) for _ in range(r.randint(4, 9))): i % 2 == 0 for i in range(n)}
        lexicon = toxicity.Lexicon(terms)
        near = {t: edited(t, letters + "jabc") for t in terms}
        words = {w + rest for t in terms for w in near[t] for rest in ("", "jab", "c")} | {"".join(r.choice(letters) for _ in range(r.randint(3, 12))) for _ in range(2000)}
        for w in words:
            exact = any(w.startswith(t) if stem else w == t for t, stem in terms.items())
            close = any(not near[t].isdisjoint(w[:k] for k in range(1, len(w) + 1)) if stem and len(t) > 4 else w in near[t] for t, stem in terms.items())
            got = lexicon.match(w)
            assert (got and got[1]) == (0 if exact else 1 if close else None), w
    lexicon = toxicity.Lexicon({"trash": False, "idiot": False, "clown": True, "moron": True})
    assert [lexicon.match(w) for w in ("tarsh", "iidot", "colwnish", "mroons")] == [("trash", 1), ("idiot", 1), ("clown", 1), ("moron", 1)]


def test_toxicity_disguise_and_quotation(spark):
    """A disguised term scores above a clean text and above its quotation; every one-edit form of a learned term is
    found; repeated, null, empty and very long rows and clashing columns are scored."""
    r = random.Random(9)
    bad = ["grobbler", "snazzard", "vexmitch", "dolt"]
    rows = []
    for i in range(600):
        w = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(40)]
        if i % 4 == 0:
            w[r.randrange(40)] = r.choice(bad)
            if i % 3 == 0:
                w[r.randrange(40)] = r.choice(bad)
        elif i in (1, 2, 3, 5):
            w[20:21] = f'he said "{r.choice(bad[:2])}" to'.split(" ")
        rows.append((i, " ".join(w), int(i % 4 == 0), 0.5, "x"))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, toxic int, score double, `__label` string")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert (model.weights[1:-1] >= 0).all()
    plain = " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(80))
    for t in bad:
        clean, disguised, quoted, exact = model.scores([plain, f"{plain} {t[:2]}{t[3]}{t[2]}{t[4:]}", f'{plain} he said "you {t}" to them', f"{plain} {t}"])
        assert clean < disguised and quoted < disguised <= exact, t
    lexicon = toxicity.Lexicon(model.terms, model.own, model.strict)
    for t in model.terms:
        cuts = [(t[:i], t[i:]) for i in range(len(t) + 1)]
        forms = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + "q" + b for a, b in cuts} | {a + "q" + b[1:] for a, b in cuts if b}
        assert [w for w in forms if lexicon.match(w) is None] == [], t
    odd = spark.createDataFrame([(1, None), (2, ""), (3, plain * 400 + " grobbler"), (3, plain * 400 + " grobbler")], "doc_id long, text string")
    got = [r["s"] for r in odd.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).orderBy("doc_id").collect()]
    assert got[0] == got[1] < got[2] == got[3]


def test_lexicon_keeps_every_term(spark):
    """120 words of ten toxic texts each, with their stems six times as many entries."""
    r = random.Random(8)
    bad = sorted({"".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(120)})
    dealt = [b for _ in range(10) for b in r.sample(bad, len(bad))]
    rows = [(i, " ".join([r.choice(WORDS) + str(r.randrange(30)) for _ in range(12)] + dealt[5 * i : 5 * i + 5]), int(5 * i < len(dealt))) for i in range(1300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.Lexicon(toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")).terms)
    assert len(bad) == 120 and [b for b in bad if lexicon.match(b) is None] == []


def test_webp_known_files():
    # fixed values: two well-known one-pixel files
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[0]]
    assert webp.decode(base64.b64decode("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=")).tolist() == [[0xFFFFFFFF]]


def test_webp_symbols():
    """Palette, back-references, colour cache and every predictor, from streams written here."""
    out = webp.Writer()
    out.put(0x2F, 8)
    out.put(7, 14)
    out.put(0, 14)
    out.put(1, 1)
    out.put(0, 3)
    out.put(1, 1)
    out.put(webp.PALETTE, 2)
    out.put(1, 8)  # two colours, eight pixels in a byte
    out.put(0, 1)
    for s in (0x22, 0x11, 0x33, 0xFF, 0):  # both entries add the same colour
        out.single(s)
    out.put(0, 1)  # no further transform
    out.put(0, 1)  # no cache
    out.put(0, 1)  # one group
    for s in (0b10100110, 0, 0, 255, 0):
        out.single(s)
    p = webp.decode(webp.container(out.word.to_bytes(-(-out.n // 8) + 8, "little")))
    assert p.shape == (1, 8)
    first, second = 0xFF112233, 0xFE224466
    assert p[0].tolist() == [second if 0b10100110 >> i & 1 else first for i in range(8)]

    out = webp.Writer()  # main image: literal, then a back-reference of length 3 and distance 1, then the cache
    out.put(0x2F, 8)
    out.put(4, 14)
    out.put(0, 14)
    out.put(1, 1)
    out.put(0, 3)
    out.put(0, 1)
    out.put(1, 1)
    out.put(1, 4)  # cache of two
    out.put(0, 1)
    # green: symbols 5 (literal), 258 (length 3) and the cache entry, of lengths 1, 2, 2
    pixel = 0xFF000500
    entry = 280 + ((webp.CACHE_FACTOR * pixel & 0xFFFFFFFF) >> 31)
    lengths = [0] * 282
    lengths[5], lengths[258], lengths[entry] = 1, 2, 2
    out.put(0, 1)
    out.put(4, 4)
    for s in webp.LENGTH_ORDER[:8]:
        out.put({0: 2, 1: 2, 2: 1}.get(s, 0), 3)
    out.put(0, 1)
    code = {2: (0, 1), 0: (1, 2), 1: (3, 2)}  # canonical codes 0, 10, 11, written with their first bit first
    for n in lengths:
        out.put(*code[n])
    for s in (0, 0, 255):
        out.single(s)
    out.single(1)  # distance symbol 1: code 2, one pixel to the left
    out.put(0, 1)  # the literal
    order = sorted([258, entry])
    bits = {order[0]: (1, 2), order[1]: (3, 2)}
    out.put(*bits[258])
    out.put(*bits[entry])
    p = webp.decode(webp.container(out.word.to_bytes(-(-out.n // 8) + 8, "little")))
    assert p[0].tolist() == [pixel] * 5

    r = np.random.default_rng(1)
    image = r.integers(0, 1 << 32, (6, 7), dtype=np.uint64).astype(np.uint32)
    for mode in range(14):  # residuals by the predictors' own definition, then back
        flat, res = image.reshape(-1).tolist(), []
        for i, v in enumerate(flat):
            y, x = divmod(i, 7)
            guess = (flat[i - 1] if x else 0xFF000000) if not y else flat[i - 7] if not x else webp.predict(mode, flat[i - 1], flat[i - 7], flat[i - 6], flat[i - 8])
            res.append(sum(((v >> s & 255) - (guess >> s & 255) & 255) << s for s in (0, 8, 16, 24)))
        back = webp.invert_predictor(np.array(res, np.uint32), 7, 6, 2, np.full(4, mode << 8, np.uint32))
        assert back.tolist() == flat, mode
    with pytest.raises(ValueError):
        webp.decode(webp.encode(image)[:60])
    assert (webp.decode(webp.encode(image)) == image).all()


def test_webp_code_groups():
    """A meta image of two groups: each 4 x 4 tile is read with its own codes."""
    r = random.Random(5)
    bits = [r.randrange(2) for _ in range(64)]
    out = webp.Writer()
    for v, n in ((0x2F, 8), (7, 14), (7, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):  # no transform, no cache, meta in tiles of 4
        out.put(v, n)
    webp.put_image(out, np.array([0, 1 << 8, 1 << 8, 0], np.uint32) | np.uint32(0xFF000000), False)
    for first in (10, 30):
        out.code(np.isin(np.arange(280), (first, first + 10)).astype(int))
        for s in (1, 2, 255, 0):
            out.single(s)
    for b in bits:
        out.put(b, 1)
    got = webp.decode(webp.container(out.word.to_bytes(-(-out.n // 8), "little")))
    for i, b in enumerate(bits):
        y, x = divmod(i, 8)
        green = (10 if (y < 4) == (x < 4) else 30) + 10 * b
        assert got[y, x] == 0xFF000000 | 1 << 16 | green << 8 | 2


def test_webp_code_lengths():
    """Runs of equal lengths and of zeros (symbols 16, 17 and 18), and the longest codes."""
    r = random.Random(6)
    cases = [np.full(256, 8), np.where(np.arange(280) % 70 < 4, 4, 0)[:280]]
    for _ in range(40):
        counts = np.zeros(r.choice([40, 256, 280, 536]), int)
        for _ in range(r.randint(1, 60)):
            i = r.randrange(len(counts))
            counts[i : i + r.randint(1, 12)] = int(1.6 ** r.randint(0, 40)) + 1
        cases.append(webp.code_lengths(counts))
    for n in cases:
        if n.sum() and sum(2.0**-k for k in n.tolist() if k) != 1 and np.count_nonzero(n) > 1:
            n = webp.code_lengths((n > 0).astype(int))
        out = webp.Writer()
        out.code(n)
        bits = webp.Bits(out.word.to_bytes(-(-out.n // 8) + 1, "little"))
        assert webp.read_prefix(bits, len(n)).table == webp.Prefix(tuple(n.tolist())).table and bits.place == out.n


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256, 1000])
def test_webp_palettes(colours):
    r = np.random.default_rng(colours)
    table = r.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    for shape in ((64, 16), (1, 16), (5, 7), (40, 33)):
        image = table[r.integers(0, colours, shape)]
        image[-1, -8:] = image[0, :8] if shape[1] > 8 else image[-1, -8:]
        assert (webp.decode(webp.encode(image)) == image).all()


def test_webp_uses_what_fits():
    """Text repeats become back-references, recent colours cache entries, columns that change slowly the predictor."""
    r = random.Random(7)
    words = [f"{w}{i}" for w in WORDS for i in range(60)]
    text = " ".join(r.choice(words) for _ in range(3000)).encode()
    text += b"x" * (-len(text) % 64)
    assert len(webp.store(text * 2)) < 1.1 * len(webp.store(text)) < len(text)
    slow = np.cumsum(np.random.default_rng(3).integers(-1, 2, (300, 64)), 0).astype(np.uint8).tobytes()
    assert len(webp.store(slow)) < 0.35 * len(slow)
    few = b"".join(r.choice([b"abcd", b"efgh", b"ijkl"]) for _ in range(1600))
    assert len(webp.store(few)) < 0.12 * len(few)
    for x in (text * 2, slow, few, r.randbytes(64 * 300)):
        assert webp.load(webp.store(x)) == x


def test_webp_many_at_once(monkeypatch):
    """Files are worked on together, and each is what it is alone: few and many colours, one row, large ones, several files."""
    r = random.Random(11)
    payloads = [r.randbytes(64), bytes(64), b"abcd" * 16 * 20, " ".join(r.choice(WORDS) for _ in range(9000)).encode()[:40000], r.randbytes(webp.IMAGE_BYTES + 64)]
    payloads += [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 400))).encode() for _ in range(600)]
    payloads = [x + bytes(-len(x) % 64) for x in payloads]
    r.shuffle(payloads)
    alone = [webp.store(x) for x in payloads]
    calls = []
    whole = webp.put_images
    monkeypatch.setattr(webp, "put_images", lambda outs, *rest: (calls.append(len(outs)), whole(outs, *rest)))
    assert list(webp.store_all(iter(payloads))) == alone
    assert max(calls) > 50 and len([k for k in calls if k > 1]) < 20
    assert list(webp.load_all(iter(alone))) == payloads == [webp.load(x) for x in alone]
    assert list(webp.store_all([])) == list(webp.load_all([])) == []


def test_webp_entry_not_set():
    """A cache entry that no pixel has set is transparent black; such a file beside others."""
    out = webp.Writer()
    for v, n in ((0x2F, 8), (2, 14), (0, 14), (1, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)):  # no transform, a cache of two, one group
        out.put(v, n)
    pixel = 0xFF000500
    entry = 280 + ((webp.CACHE_FACTOR * pixel & 0xFFFFFFFF) >> 31)
    out.code(np.isin(np.arange(282), (5, entry)).astype(int))
    for s in (0, 0, 255, 0):
        out.single(s)
    for b in (1, 0, 1):
        out.put(b, 1)
    odd = webp.container(out.word.to_bytes(-(-out.n // 8), "little"))
    other = np.random.default_rng(2).integers(0, 9, (30, 16)).astype(np.uint32) * np.uint32(0x1234567)
    got = webp.decode_all([webp.encode(other), odd, webp.encode(other[:3])])
    assert got[1].tolist() == [[0, pixel, pixel]] and (got[0] == other).all() and (got[2] == other[:3]).all()


def test_webp_query(spark, docs, monkeypatch):
    """The query's columns against plain Python, for nulls, empty, long and repeated texts."""
    monkeypatch.setattr(webp.common, "table", lambda *_: docs)
    for row in webp.op5_webp(spark, "").collect():
        raw = (texts()[row["doc_id"]] or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        media = webp.store(want)
        lines = [want[i : i + 64] for i in range(0, len(want), 64)]
        steps = [abs(x - y) for a, b in zip(lines, lines[1:]) for x, y in zip(a, b, strict=True)]
        feature = f"rows={len(lines)};distinct={len(set(want))};mean={sum(want) / len(want):.6f};high={sum(b > 127 for b in want) / len(want):.6f};step={sum(steps) / len(steps) if steps else 0:.6f}"
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (row["media_bytes"], row["media_sha256"], row["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), feature)


def test_webp_round_trip(docs, none):
    rows = webp.stored(docs).collect()
    for r in rows:
        raw = (texts()[r["doc_id"]] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert webp.load(r["media"]) == want and r["n_bytes"] == len(raw)
    big = random.Random(0).randbytes(webp.IMAGE_BYTES + 64)
    assert webp.load(webp.store(big)) == big and len(list(webp.images(webp.store(big)))) == 2
    assert webp.stored(none).count() == 0


def test_prefix_counts(docs, none):
    path = common.tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    for limit in (3, 40):
        got = {r["doc_id"]: (r["n_tokens"], r["over_limit"], r["fit_chars"]) for r in prefix_counts.token_counts(docs, path, limit).collect()}
        for i, t in enumerate(texts()):
            t = t or ""
            fit = len(t) if n(t) <= limit else max(k for k in range(min(len(t), 12 * limit) + 1) if n(t[:k]) <= limit)
            assert got[i] == (n(t), n(t) > limit, fit), t
    counter = prefix_counts.loaded(path)
    odd = ["a  b\n c  ", "don't we'll 12345 ...", "naïve 🙂🙂 x<|endoftext|>y z", " \n\t x", "x   'll  '  's'd!!'re \u3000\u3000é", "\x1c\x1d a\x85\xa0b", " " * 70 + "a" * 300, "'", "''s'S"]
    r = random.Random(3)
    odd += ["".join(r.choice("ab'sltdre  \n.,1é東\u3000<|") for _ in range(60)) for _ in range(30)]
    for t in odd:
        assert counter.counts(t).tolist() == [n(t[:k]) for k in range(len(t) + 1)], t
        assert counter.fits(t, 3) == max(k for k in range(len(t) + 1) if n(t[:k]) <= 3)
    assert prefix_counts.token_counts(none, path, 1).count() == 0


def brute_repeats(rows: list[bytes], width: int) -> list[tuple[int, int, bytes]]:
    seen: dict[bytes, int] = {}
    for t in rows:
        for p in range(len(t) - width + 1):
            seen[t[p : p + width]] = seen.get(t[p : p + width], 0) + 1
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = True
        out.append((int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, none, seed):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    pool = [say(r.randint(150, 420)) for _ in range(6)]
    rows = [None, "", "short", *("".join(r.choice([*pool, say(r.randint(5, 300))]) for _ in range(r.randint(1, 5))) for _ in range(40)), "z" * 700, pool[0] * 3]
    rows += rows[5:9]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_removed int, dedup_text string").repartition(5)
    got = {r["doc_id"]: (r["dedup_removed"], r["dedup_spans"], bytes(r["dedup_kept"])) for r in suffix_dedup.deduplicated(df).collect()}
    want = brute_repeats([(t or "").encode() for t in rows], 200)
    assert got == dict(enumerate(want))
    assert suffix_dedup.deduplicated(none).count() == 0


def test_refinement_finds_buckets():
    r = np.random.default_rng(2)
    data = np.concatenate([x := r.integers(0, 4, 900).astype(np.uint8), r.integers(0, 4, 300).astype(np.uint8), x[100:500]])
    b = suffix_dedup.Block(data, np.array([0, len(data)]), 200)
    at = np.arange(len(data) - 199)
    group = b.refined(at)
    strings = [data[i : i + 200].tobytes() for i in at]
    assert len(set(zip(strings, group.tolist(), strict=True))) == len(set(strings)) == len(set(group.tolist()))


def test_language(spark, none):
    r = random.Random(1)
    words = {"xx": ["abba", "kade", "lomi", "raso"], "yy": ["wrzt", "plok", "ghunt", "skrv"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i in range(200) for k in ["xx" if i % 2 else "yy"]]
    rows += [(900, None, "xx"), (901, "", None), (902, "123 !!", None), (903, "lomi raso", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.filter("doc_id < 150 or doc_id >= 900"))
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", language.identified(F.col("text"), model).alias("p")).collect()}
    assert all(got[i]["lang_pred"] == k and not got[i]["rejected"] for i, _, k in rows[:200])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert all(0 <= p["score"] <= 1 for p in got.values())
    assert model(__import__("pyarrow").array(["0123456789 " * 40 + "Ω" * 400]))[2].all()
    nothing = language.fit(none)
    assert nothing(__import__("pyarrow").array(["abc"]))[0] == ["und"]


def test_vector_dedup(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(300, 16))
    near = centre[:40].repeat(3, 0) + r.normal(size=(120, 16)) * 0.05
    ball = centre[50] + r.normal(size=(150, 16)) * 0.04
    x = np.concatenate([centre, near, ball, centre[:5], centre[5:8] * 2])
    label = r.integers(0, 2, len(x))
    label[-8:] = label[:8]
    rows = [(i, v.tolist(), int(m)) for i, (v, m) in enumerate(zip(x, label, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    out = vector_dedup.near_duplicates(df, shard=64, chunk=48)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    u = vector_dedup.unit(x.astype(np.float32))
    hit = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], *root[hit[i]]) if hit[i].any() else root[i] for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    want = hit.sum(1)
    found = np.array([got[i][0] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    assert all(got[i] == (0, i) for i, *_ in odd)
    assert np.mean([got[i][1] == root[i] for i in range(len(x))]) > 0.97
    assert vector_dedup.audit(df.filter("vec_id < 900"), out) >= 0.9
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_chat(spark):
    r = random.Random(6)
    said = ["</s>[INST] ok [/INST]", None, "", "<|turn|>x<|end|>\n", "<\\|end|>", "word " * 900, "plain", "[\\INST]", "a\nb"]
    rows = []
    for c in range(30):
        for t in range(r.randint(1, 14)):
            rows.append((c, t, "system" if t == 0 and c % 2 else r.choice(["user", "assistant", None, "to\nol"]), r.choice(said)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    path = common.tokenizer_path("byte_bpe_50k.json")
    windows = chat.formatted(df, path, budget=200, history=60)
    got = {r["conv_id"]: r for r in chat.digest(windows).collect()}
    for c in range(30):
        own = [(a or "", t or "") for k, _, a, t in sorted(rows, key=lambda x: x[:2]) if k == c]
        targets = "".join(t for a, t in own if a == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(targets), hashlib.sha256(targets.encode()).hexdigest())
    count = prefix_counts.loaded(path).count
    for w in windows.collect():
        turns = chat.read(w["text"])
        assert count(w["text"]) <= 210 or sum(not again for *_, again in turns) == 1
        if w["window"] and w["conv_id"] % 2:
            assert turns[0][0] == "system" and turns[0][2]
    assert chat.digest(chat.formatted(df.limit(0), path)).count() == 0


def test_language_rejects_by_distance(spark):
    """One garbage text with a language lowers the bar for no other."""
    r = random.Random(12)
    known = {"a": "the house stands near a river and many people walk there every morning".split(), "b": "das haus steht am fluss und viele leute gehen dort jeden morgen vorbei".split()}
    garbage = ["".join(r.choice("bcdfghjklmnpqrstvwxz    ") for _ in range(300)) for _ in range(41)]
    rows = [(i, " ".join(r.choice(known["ab"[i % 2]]) for _ in range(55)), "ab"[i % 2]) for i in range(300)]
    fitted = language.fit(spark.createDataFrame(rows + [(300, garbage[0], "a")], "doc_id long, text string, lang string"), clusters=1)
    assert all(fitted(pa.array(garbage[1:]))[2]) and not any(fitted(pa.array([t for _, t, _ in rows]))[2])


def test_suffix_dedup_keeps_clashing_columns(spark):
    """Names that the operator uses inside or gives as results, and a text longer than one block."""
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh ") for _ in range(300))
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(1_500_000))
    rows = [(1, f"x{shared}y", 7, 8, "k", "t"), (2, shared, 7, 8, None, None), (3, long + shared, 1, 1, "k", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dedup_row int, dedup_segments int, row string, dedup_text string")
    got = {x.doc_id: x for x in suffix_dedup.deduplicated(df).collect()}
    assert {k: (x.dedup_row, x.dedup_segments, x.row, x.dedup_text, x.dedup_removed) for k, x in got.items()} == {1: (7, 8, "k", "xy", 300), 2: (7, 8, None, "", 300), 3: (1, 1, "k", long, 300)}
    import corpus_pipeline

    out = {x.doc_id: x for x in corpus_pipeline.repeats_stage(spark, df, "").collect()}
    assert {k: (x.text, x.dedup_text) for k, x in out.items()} == {1: ("xy", "t"), 2: ("", None), 3: (long, "t")}
