"""Validation and repair against a plain model that goes row by row and pass by pass, on made rows and on all lines of
the documents; the state scan against a loop."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vellum.operators import repair, statescan

ALLOWED = "H1 H2 H3 TXT TXT-FLUSH BL-FIRST BL-MID BL-LAST NL-FIRST NL-MID NL-LAST UL-MID KT-BL-FIRST KT-BL-MID T T1 T2 T4 TD TH1 TH2 TFN TSN TBL-FIRST TBL-MID FIG-LEG PMI REF-N REF-U REFH1 REFH2 SR SRH1 BIB BM-TTL CT CN NBX-TYPE NBX-TTL BX1-TXT APX-H1 APX-REF-N H10 H20".split()
ZONES = {"TABLE": "T T1 T2 T4 TD TH1 TH2 TFN TSN TBL-FIRST TBL-MID PMI".split(), "BACK_MATTER": "REF-N REF-U REFH1 REFH2 SR SRH1 BIB BM-TTL FIG-LEG T1 TFN TSN TXT TXT-FLUSH PMI H1 BL-MID".split(), "BOX_NBX": ["NBX-TXT", "NBX-TTL", "NBX-TYPE"]}
ALIASES = {"REF_N": "REF-N", "BULLET": "BL-MID"}
POSITIONS = ("FIRST", "MID", "LAST")


def canon(tag):
    return ALIASES.get(tag, tag)


def like_reference(text):
    t = re.sub(r"^\s*(?:<[^>]+>\s*)+", "", text).strip()
    if not t or re.search(repair.READING_LISTS, t.lower()):
        return False
    marks = sum(t.count(c) for c in ".;:,")
    cue = re.search(r"\b(19|20)\d{2}\b", t) or "doi" in t.lower() or "et al" in t.lower() or re.search(r"[A-Za-z].*,.+\.", t)
    return bool(re.match(repair.REFERENCE_NUMBER, t) or re.match(repair.REFERENCE_BULLET, t) or (cue and marks >= 2))


def like_heading(text):
    t = text.strip()
    if not t or len(t) > 60 or t[-1] in ".!?;:" or re.fullmatch(r"[\d\s,./%\-()+]+", t):
        return False
    w = t.split()
    caps = sum(re.sub("[^A-Za-z0-9]", "", x)[:1].isupper() for x in w)
    return bool(re.match(r"^[A-Z0-9][A-Z0-9\s/&\-]{1,59}$", t)) or (len(w) >= 2 and caps >= max(1, int(0.7 * len(w))))


def list_tag(m, zone, box, tag):
    kind, place = m.get("list_kind"), m.get("list_position")
    if not kind or not place:
        return None
    inside, marked = zone.startswith("BOX_"), m.get("has_bullet") or m.get("has_xml_list")
    stem = {"bullet": "BL", "numbered": "NL"}.get(kind) or ("UL" if inside or not marked else "BL")
    if zone == "TABLE":
        stem = "T" + stem
    if inside:
        stem = f"{box or 'NBX'}-{stem}"
    for x in ("-BL", "-NL", "-UL"):
        if x in tag:
            stem = tag.split(x)[0] + x
            break
    return f"{stem}-{place}"


def row_model(r, lists, markers):
    """(tag, confidence, reasons, whether it came from H4 or H5) of one row."""
    ok, text, zone, conf, why = set(ALLOWED), r["text"] or "", r.get("zone") or "BODY", 85.0 if r["confidence"] is None else r["confidence"], []
    tag = given = r["tag"] or "TXT"
    norm = canon(tag)
    lock = norm in ok and conf >= 0.9
    bare = text.strip()
    if markers and tag == "PMI" and bare.startswith("<"):
        lock = True
    if markers and bare.upper() == "<BL>":
        tag, lock = "PMI", True

    def put(new, reason, always=False):
        nonlocal tag
        if new is not None and (new != tag or always):
            tag = new
            why.append(reason)

    fits = lambda: zone not in ZONES or tag in ZONES[zone] or tag.rstrip("0123456789") in ZONES[zone]
    first = lambda names: next((n for n in names if n in ok), None)
    if not lock and re.search(r"[+/,|]", tag):
        parts = [p.strip() for p in re.split(r"[+/,|]", tag)]
        pick = next((p for p in parts if p and canon(p) in ok), None) or parts[0]
        if pick:
            put(pick, "composite-rejected", True)
            norm = canon(pick)
    if not lock and norm:
        put(norm, "style-canonicalize")
    if not lock and r.get("box_marker") in ("start", "end"):
        put("PMI", "box-marker")
    level = re.match(r"\s*<H([1-6])>\b", text, re.I)
    level = level and level[1]
    if re.fullmatch(r"<[^>]+>", bare) and not level and tag != "PMI":
        put("PMI", "marker-only")
        lock = True
    if not lock and zone == "METADATA":
        put("PMI", "metadata-zone")
    if not lock and zone != "TABLE" and level:
        v = {("1", "Heading 2"): "H10", ("2", "Heading 3"): "H20", ("2", "Heading 2"): "H21"}.get((level, r.get("style"))) if zone == "BODY" else None
        if v in ok:
            put(v, "inline-heading-variant")
        if not re.fullmatch(rf"H{level}\d*", canon(tag)):
            put(f"H{level}", "inline-heading-marker")
    if not lock:
        put({"table": "T1"}.get(r.get("caption_type")), "table-caption")
        put({"figure": "FIG-LEG"}.get(r.get("caption_type")), "figure-caption")
        put("TSN" if r.get("source_line") else None, "source-line")
    box = zone[4:] if zone.startswith("BOX_") and zone[4:] in repair.BOX_ZONES else repair.BOX_TYPES.get(r["box_type"], "NBX") if r.get("box_type") else None
    if not lock and zone.startswith("BOX_"):
        if r.get("box_label"):
            put(f"{box or 'NBX'}-TYPE", "box-type-label")
        elif r.get("box_title"):
            put(f"{box or 'NBX'}-TTL", "box-title")
    if r.get("in_reference") and lock and not norm.startswith("REF-"):
        lock = False
    inside = bool(r.get("in_reference")) or zone == "REFERENCE"
    low = bare.lower()
    if not lock and zone == "TABLE":
        m = re.fullmatch(r"(?:SK_H|TBL-H)([1-6])", given)
        if m:
            put(f"TH{m[1]}", "zone-table-heading-map", True) if f"TH{m[1]}" in ok else put("T", "zone-table-heading-fallback", True)
        source = low.startswith(repair.TABLE_SOURCES)
        note = not source and bool(low.startswith(("note", "*", "†")) or re.match(r"[a-z]\)", low))
        if source or note:
            put("TSN" if source else "TFN", "zone-table-source" if source else "zone-table-footnote", True)
        if tag == "TBL-TXT" and "TD" in ok:
            put("TD", "zone-table-txt-to-td")
        if tag.startswith(("BL-", "UL-", "NL-")):
            put("T", "zone-table-list", True)
        elif tag in ("TXT", "TXT-FLUSH", "T") and not note:
            if r.get("is_header_row") and "T2" in ok:
                put("T2", "zone-table-header-row", True)
            elif r.get("is_stub_col") and "T4" in ok and like_heading(text):
                put("T4", "zone-table-stub-col", True)
            elif conf < 0.9 and like_heading(text) and "T4" in ok:
                put("T4", "zone-table-t4-heuristic", True)
            else:
                put("T", "zone-table-text", True)
    if not lock and zone == "BACK_MATTER" and tag in repair.BACK_MATTER:
        put(first(repair.BACK_MATTER[tag]), "zone-backmatter-normalize")
    if not inside and not lock:
        m = re.fullmatch(r"(.*?)((?:BL|NL|UL|LL)\d*)-(FIRST|MID|LAST)", canon(tag))
        place = (r.get("list_position") or "").strip().upper()
        aligned = first([f"{m[1]}{m[2]}-{place}", f"{m[1]}{m[2]}-MID"]) if m and place in POSITIONS else None
        lt = list_tag(r, zone, box, tag)
        free = not (canon(tag).startswith("REF") or canon(tag) in ("BIB", "SR", "SRH1") or like_reference(text))
        if aligned and aligned != tag and free:
            put(aligned, "semantic-list-position")
        elif lt and not tag.endswith(tuple(f"-{p}" for p in POSITIONS)) and free:
            put(lt, "list-position")
        elif lt and tag.startswith(("BL", "NL", "UL", "TBL", "TNL", "TUL")) and not (tag.startswith("BL-") and (lists or lt.startswith("UL-"))):
            put(lt, "list-position")
    if not lock and zone == "TABLE" and not fits():
        put("BX4-TXT" if tag.startswith("BX4-") else "T", "table-inferred")
    if not lock and zone != "BODY" and not fits():
        lt = list_tag(r, zone, box, tag)
        put("T" if zone == "TABLE" else lt or first(repair.BACK_MATTER_TEXT) or tag if zone == "BACK_MATTER" else lt or "TXT", "zone-fallback")
    deep = not lock and tag in ("H4", "H5")
    if deep:
        put("H3", "heading-canonicalize")
    bullet = re.match(repair.REFERENCE_BULLET, re.sub(r"^\s*(?:<[^>]+>\s*)+", "", text))
    if inside:
        if low.startswith("<ref-h2>") or r.get("ref_heading"):
            put("REFH2", "ref-zone-heading")
        elif tag.startswith(("UL-", "BL-")):
            put("REF-U" if bullet else "REF-N", "ref-zone-list-override")
        elif not tag.startswith("APX-REF") and tag not in ("SR", "SRH1") and like_reference(text):
            put("REF-U" if bullet else "REF-N", "ref-zone-pre-allowed")
    put(canon(tag) if canon(tag) in ok else repair.stand_in(canon(tag), frozenset(ALLOWED)), "not-allowed")
    return tag, min(conf, 80.0) if why else conf, why, deep


def model(rows, lists=False, markers=False):
    """Rows of one document, in order."""
    ok = set(ALLOWED)
    done = [row_model(r, lists, markers) for r in rows]
    tag, conf, why = [d[0] for d in done], [d[1] for d in done], [list(d[2]) for d in done]
    early = bool(done) and done[-1][3]
    texts, zones = [r["text"] or "" for r in rows], [r.get("zone") or "BODY" for r in rows]
    on = False
    for i, r in enumerate(rows):
        on = on or canon(tag[i]) in ("SRH1", "REFH1") or texts[i].lstrip().upper().startswith("<REF>")
        was = r["tag"] or "TXT"
        if on and canon(was) in repair.SECTION_KEEPS and canon(was) in ok and tag[i] != was:
            tag[i] = was
            why[i].append("ref-section-preserve")
        on = on and canon(tag[i]) not in repair.SECTION_ENDS
    anchor = lambda t: t.startswith("FIG-") or t in repair.FLOAT_ANCHORS
    for i, r in enumerate(rows):
        if zones[i] == "BACK_MATTER" and (tag[i].startswith("FIG-") or tag[i] in repair.FLOATS) and not any(anchor(tag[j]) for j in range(max(0, i - 10), min(len(rows), i + 11)) if j != i):
            names = repair.FLOAT_IN_REFERENCES if r.get("in_reference") else repair.FLOAT_ELSEWHERE
            tag[i] = next((n for n in names if n in ok), "TXT-FLUSH")
            why[i].append("zone-backmatter-downgrade")
    for i in range(1, len(rows)):
        r = rows[i]
        if canon(tag[i - 1]) in ("H1", "H2", "H3", "APX-H1", "APX-H2", "APX-H3") and texts[i].strip() and zones[i] in ("BODY", "BACK_MATTER", "REFERENCE") and canon(tag[i]) == "TXT":
            if not (list_tag(r, zones[i], None, tag[i]) or r.get("caption_type") or r.get("source_line")):
                tag[i] = "TXT-FLUSH"
                why[i].append("heading-following-flush")
    last, one, two = 0, False, False
    for i in range(len(rows)):
        t, n = tag[i], int(tag[i][1]) if re.fullmatch("H[1-6]", tag[i]) else 0
        trusted = canon(t) in ok and conf[i] >= 0.9
        if not trusted and n:
            new = "H3" if n >= 4 else t
            if n == 2 and not one:
                new = "H1" if conf[i] >= 0.7 else "TXT"
            if n == 3 and not two and not early:
                new = "H2"
            if last and n > last + 1:
                new = f"H{min(last + 1, 2)}" if conf[i] >= 0.7 else "TXT"
            if new != t:
                tag[i], conf[i] = new, min(conf[i], 80.0)
                why[i].append("heading-hierarchy")
        if tag[i] == "H1":
            last, one, two = 1, True, False
        elif tag[i] == "H2":
            last, two = 2, True
        elif tag[i] == "H3":
            last = 3
    seen = None
    for i, r in enumerate(rows):
        x = re.sub(r"^\s*(?:<[^>]+>\s*)+", "", texts[i])
        ref = "REF-U" if re.match(repair.REFERENCE_BULLET, x) else "REF-N"
        low, x = texts[i].strip().lower(), x.strip()

        def put(new, reason, always=False):
            if new != tag[i] or always:  # noqa: B023
                tag[i], conf[i] = new, max(conf[i], 0.99)  # noqa: B023
                why[i].append(reason)  # noqa: B023

        if r.get("in_reference"):
            if low.startswith("<ref-h2>") or r.get("ref_heading"):
                put("REFH2", "ref-zone-heading", True)
            elif tag[i] not in ("SR", "SRH1") and not tag[i].startswith("APX-REF") and like_reference(texts[i]):
                put(ref, "ref-zone-final")
        if low.startswith("<ref>") and x.lower() in repair.REFERENCE_TITLES:
            put("REFH1", "ref-marker-heading")
            seen = 0
        elif seen is not None:
            t = canon(tag[i])
            if zones[i] == "TABLE" or (t in repair.MARKED_ENDS and not low.startswith("<ref>")) or (x.lower().startswith("table ") and t in ("T1", "BM-TTL", "TXT", "TXT-FLUSH")):
                seen = None
            elif tag[i] in ("SR", "SRH1") or tag[i].startswith("APX-REF") or not x:
                pass
            elif tag[i].startswith(("UL-", "BL-", "NL-")) or like_reference(texts[i]):
                put(ref, "ref-marker-section")
                seen += 1
            elif seen >= 3:
                seen = None
    return list(zip(tag, conf, [bool(w) for w in why], [",".join(w) or None for w in why], strict=True))


COLUMNS = {"doc": "long", "pos": "long", "text": "string", "tag": "string", "confidence": "double"} | repair.FACTS
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())


def canonical(c):
    out = c
    for a, b in ALIASES.items():
        out = F.when(c == a, b).otherwise(out)
    return out


def made(seed, n_docs=30):
    r = random.Random(seed)
    texts = ["", "  ", "Plain words.", "<H1>Aims", "<H2>Methods", " <h3>x", "<H1>", "</BL>", "<BL>", "<REF>References", "<REF>Smith, J. (2001).", "<ref-h2>More", "1. Smith, A., 2001; B.", "• Lee, K. 1999; C: D.", "[3] Next", "Smith, one. Two.", "SUGGESTED READINGS 2001, a. b.",
             "Note a", "Source: x", "From here", "a) note", "* star", "Mean Value", "MEAN SD", "12.5 (3)", "Table 3 shows", "Just Some Words Here", "References", "doi: 10.1, x"]
    tags = [*ALLOWED, "H4", "H5", "H6", "TBL-TXT", "SK_H1", "TBL-H5", "TXT/H1", "bad,H2", "/x", "REF_N", "BULLET", "XX-BL", "KT-BL-LAST", "BX4-X", "H21", "zzzzqqqq", "TXT1", "REF-N0", None, "BL2-MID", "FIG-SRC"]
    out = []
    for d in range(n_docs):
        body = r.random() < 0.5
        for i in range(r.randint(0, 60)):
            pick = lambda *v: r.choice(v)
            heading = r.random() < 0.3
            out.append((
                d, i, r.choice(texts + [None]), pick("H1", "H2", "H3", "H4", "H5") if heading else r.choice(tags), pick(95.0, 80.0, 0.95, 0.8, 0.6, 0.5, None), "BODY" if body else pick("BODY", "BACK_MATTER", "BACK_MATTER", "TABLE", "BOX_NBX", "BOX_BX1", "METADATA", "REFERENCE", None),
                pick("Heading 2", "Heading 3", None), pick("tip", "odd", None, None), pick("start", None, None, None, None), pick(True, False, None, False), pick(True, False, None, False), pick("table", "figure", "", None, None, None, None, None), r.random() < 0.03,
                pick("bullet", "numbered", "other", "", None, None), pick("FIRST", "MID", "LAST", "", None), r.random() < 0.5, r.random() < 0.2, r.random() < 0.2, r.random() < 0.2, r.random() < 0.03, not body and r.random() < 0.15,
            ))
    return out


@pytest.mark.parametrize("seed,lists,markers", [(1, False, False), (2, True, True)])
def test_against_model(spark, seed, lists, markers):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = repair.validated(df, "doc", "pos", ALLOWED, ZONES, canonical, lists, markers, chunk=F.floor(F.col("pos") / 7))
    got = {(x.doc, x.pos): (x.tag, x.confidence, x.repaired, x.repair_reason) for x in got.collect()}
    want = {}
    for d in {r[0] for r in rows}:
        mine = [dict(zip(COLUMNS, r, strict=True)) for r in rows if r[0] == d]
        want |= {(d, r["pos"]): w for r, w in zip(mine, model(mine, lists, markers), strict=True)}
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert got.keys() == want.keys() and not wrong, list(wrong.items())[:3]


def test_known_cases(spark):
    """Headings: clamped, promoted, demoted by confidence; an empty table."""
    def tags(*rows):
        df = spark.createDataFrame([(1, i, "words", t, c) for i, (t, c) in enumerate(rows)], "doc long, pos long, text string, tag string, confidence double")
        return [r.tag for r in repair.validated(df, "doc", "pos", ALLOWED, {}).orderBy("pos").collect()]

    assert tags(("H1", 0.8), ("H2", 0.8), ("H5", 0.8), ("H3", 0.8)) == ["H1", "H2", "H3", "H3"]
    assert tags(("H2", 0.8), ("H2", 0.6)) == ["H1", "H2"]
    assert tags(("H2", 0.6), ("TXT", 0.8)) == ["TXT", "TXT-FLUSH"]
    assert tags(("H1", 0.8), ("H3", 0.8), ("TXT", 0.8)) == ["H1", "H2", "TXT-FLUSH"]
    empty = spark.createDataFrame([], "doc long, pos long, text string, tag string, confidence double")
    assert repair.validated(empty, "doc", "pos", ALLOWED, {}).count() == 0


def test_reference_like_is_linear(spark):
    """The linear pattern agrees with the plain one, and a long line with many commas and no full stop costs no more."""
    r = random.Random(5)
    texts = ["".join(r.choice("aB1,,..\n\r\u2028 é") for _ in range(r.randrange(14))) for _ in range(3000)]
    got = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(F.col("t").rlike(repair.NAMED)).collect()]
    want = [re.search(r"[A-Za-z][^\n\r\u0085\u2028\u2029]*,[^\n\r\u0085\u2028\u2029]+\.", t) is not None for t in texts]
    assert got == want and True in want and False in want
    long = spark.createDataFrame([("ab, " * 2000,)], "t string")
    began = time.monotonic()
    assert not long.select(repair.reference_like(F.col("t"))).first()[0]
    assert time.monotonic() - began < 5


def test_scan_of_long_and_null_documents(spark):
    r = random.Random(1)
    rows = [(d, i, r.choice("abc")) for d in (1, 2, None, 3) for i in range(r.choice([5, 300]))]
    step = lambda q, x: ((q + 1) % 5 if x == "a" else 0 if x == "b" else max(q - 1, 0), f"{q}{x}")
    m = statescan.Machine(range(5), list("abc"), step)
    number = statescan.numbered([("a", F.col("x") == "a"), ("b", F.col("x") == "b")], list("abc"))
    df = spark.createDataFrame(rows, "doc long, pos int, x string").repartition(7)
    out = statescan.scanned(df, "doc", "pos", number, m, chunk=F.floor(F.col("pos") / 7)).withColumn("o", m.output(number, F.col("state"), "string"))
    want = {}
    for d in {x[0] for x in rows}:
        q = 0
        for _, p, x in sorted((y for y in rows if y[0] == d), key=lambda y: y[1]):
            want[d, p] = q, f"{q}{x}"
            q = step(q, x)[0]
    assert {(x.doc, x.pos): (x.state, x.o) for x in out.collect()} == want


def test_all_lines_of_the_documents(spark, monkeypatch):
    """The registered query over all of sf0.01."""
    from vellum.plans import catalogue_structure as c

    for name, value in (("ALLOWED", c.VOCABULARY), ("ZONES", c.ZONES), ("ALIASES", c.ALIASES)):
        monkeypatch.setitem(globals(), name, value)
    folder = "/root/testdata/sf0.01"
    docs: dict = {}
    for r in c.tagged_lines(spark, folder).orderBy("doc_id", "pos").collect():
        docs.setdefault(r.doc_id, []).append(r.asDict())
    want = {(d, r["pos"]): w for d, rows in docs.items() for r, w in zip(rows, model(rows), strict=True)}
    got = {(r.doc_id, r.pos): (r.tag, r.confidence, r.repaired, r.repair_reason) for r in c.validate_repair(spark, folder).collect()}
    wrong = {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert got.keys() == want.keys() and not wrong, list(wrong.items())[:3]
    assert {x for _, _, _, why in want.values() if why for x in why.split(",")} >= {"heading-hierarchy", "zone-backmatter-downgrade", "heading-following-flush", "ref-marker-section", "ref-section-preserve", "composite-rejected"}
