"""Technical edits against plain loops over runs of text, on all documents of sf0.01."""

import hashlib
import re

from pyspark.sql import functions as F

from vellum.functions import technical
from vellum.plans import catalogue_python as c


def plain_found(text):
    out = {}
    for name, (p, *_) in technical.RULES.items():
        if p is not None:
            hits = [m.group() for m in re.finditer(p, text, re.I)]
            if hits:
                out[name] = len(hits), "\u0001".join(sorted(set(hits), key=lambda s: s.encode()))
    wrong = []
    if text.count('"') % 2:
        wrong.append(f'Unpaired straight quotes (") found: {text.count(chr(34))}')
    if text.count("“") != text.count("”"):
        wrong.append(f"Unpaired smart quotes (open={text.count('“')}, close={text.count('”')})")
    if wrong:
        out["unpaired_quotes"] = len(wrong), "\u0001".join(sorted(wrong))
    if text.count("(") != text.count(")"):
        out["unpaired_parens"] = abs(text.count("(") - text.count(")")), f"Open: {text.count('(')}, Close: {text.count(')')}"
    return out


def plain_edited(text, choices):
    runs = [(text, False)]
    for name, choice in choices.items():
        p = technical.RULES[name][0]
        if p is None or choice in technical.NO_TEXT or "Small Caps" in choice or "Subscript" in choice:
            continue
        new = []
        for run, shut in runs:
            at = 0
            for m in () if shut else re.finditer(p, run, re.I):
                if m.group() != choice:
                    new += [(run[at : m.start()], False), (choice, True)]
                    at = m.end()
            new.append((run[at:], shut))
        runs = new
    return "".join(r for r, _ in runs), [r for r, shut in runs if shut]


def test_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in c._technical(spark, folder).collect() if r.text is not None}
    want = {(d, rule, *v) for d, t in texts.items() for rule, v in plain_found(t).items()}
    assert {tuple(r) for r in c.technical_scan(spark, folder).collect()} == want
    edits = {d: plain_edited(t, c.CHOICES) for d, t in texts.items()}
    got = {r.doc_id: (r.sha256, r.edits) for r in c.technical_edits(spark, folder).collect() if r.sha256 is not None}
    assert got == {d: (hashlib.sha256(t.encode()).hexdigest(), len(e)) for d, (t, e) in edits.items()} and sum(n for _, n in got.values()) > 1000


def test_cases(spark):
    texts = ["5 percent per cent", "X-ray x ray Xray", "vs. vs versus", "a<b is less than c=d", "naïve éper mL per mL", "$1 \\ 3 % x% 4%5", "", None, 'He said "no (', "“a” “b"]
    choices = {"percent_symbol": "%", "xray": "X-ray", "vs": "vs", "comparison": "=", "per_usage": "per unit", "unpaired_quotes": "Highlight"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.e.text, r.e.edits) if r.t is not None else None for r in df.select("i", "t", technical.edited(F.col("t"), choices).alias("e")).collect()}
    assert got == {i: None if t is None else plain_edited(t, choices) for i, t in enumerate(texts)}
    total = {r.rule: (r.matches, r.rows) for r in technical.totals(df, "t").collect()}
    counts = [plain_found(t) for t in texts if t is not None]
    assert total == {k: (sum(f[k][0] for f in counts if k in f), sum(k in f for f in counts)) for k in {k for f in counts for k in f}}


def test_each_rule_is_looked_for_once(spark):
    found = spark.createDataFrame([("5 percent",)], "t string").select(technical.found(F.col("t")).alias("r"))
    said = found._jdf.queryExecution().analyzed().toString().replace("...", "")
    assert found.first().r[0].matches == ["5"]
    assert said.count("regexp_extract_all(") == sum(p is not None for p, *_ in technical.RULES.values())


def test_letters_that_fold_to_others(spark):
    """Tests before a search, and of its first letters, leave no match out: against the bare patterns."""
    texts = [
        "VERſUS 5 verſus vſ V.", "mıcro MİCRO mıcron mcg MCM", "ſection 5 Section 6 ſectıon 7", "fıg. 3 FİG. 4 Fig.5 taB. 6 TABLE 7", "ı.e. İ.E. ıe İE eG E.G. i.e.", "dſm DſM cOvId-19 COVİD 19 covıd19", "mm Hg MMHG mm hG",
        "5 per cent PERCENT x%x", "x ray X-RAY xRay KX-ray", "12 degreeſ 3DEGREES ٣ degrees ٣°", "a/mL per MIN per mın 1/l", "co2 H2O o2 CO2", "d-glu N-ß l-x", "A.M. pm Am x p.m.x", "P-VALUE p value", "LEſS THAN Greater than EQUAL TO ≥ < leſſ than",
        "µ®™ Ω é", "¼ 12345 9 99 ٤٥٦٧", "", "plain words",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {(r.i, x.rule): (x["count"], x.matches) for r in df.select("i", technical.found(F.col("t")).alias("r")).collect() for x in r.r}
    bare = df.select("i", *(F.regexp_extract_all("t", F.lit(f"(?iU){p}"), F.lit(0)).alias(n) for n, (p, *_) in technical.RULES.items() if p is not None)).collect()
    want = {(r.i, n): (len(hits), sorted(set(hits), key=str.encode)) for r in bare for n, hits in r.asDict().items() if n != "i" and hits}
    assert got == want and len(want) > 30


def test_each_form_alone_in_its_text(spark):
    """A text is searched for a rule by whichever of its forms it has, in any case, without the rule's other forms."""
    forms = {
        "special_chars": ["é"], "trademark": ["®", "©", "™"], "greek": ["α", "Ω", "ϋ", "\u2126"], "thousand_separator": ["1000", "٤٥٦٧"], "spell_out_numbers": ["0", "42"], "degree_symbol": ["5 degree", "5degrees", "5 °c", "5 degreeſ"],
        "percent_symbol": ["percent", "per cent", "x%x"], "units_mmHg": ["mmHg", "mm  hg"], "micro_units": ["mcg", "mcm", "mcl", "micron", "micro", "mİcro"], "per_usage": [f"{a}{b}" for a in ("per ", "x/") for b in ("dL", "L", "min", "mL", "µL", "μL")],
        "latin_abbrev": ["e.g.x", "eg", "i.e.x", "ie", "ı.e.x"], "xray": ["xray", "x-ray", "X ray"], "vs": ["vs.x", "versus", "v.x", "vs", "vſ"], "chemical_prefixes": ["d-a", "l-é", "N-1"], "chemical_formulas": ["CO2", "O2", "H2O", "h2o"],
        "time_format": ["AM", "PM", "a.m.x", "p.m.x"], "dsm_covid": ["DSM", "dſm", "COVID19", "covid-19", "Covid 19", "COVİD 19"], "fig_table_cite": ["Figure 1", "fig.1", "fıg.1", "Table 1", "Tab. ٣"], "cross_ref": ["Section 1", "ſectıon 1", "chapter1"],
        "p_value": ["pvalue", "P-value", "p VALUE"], "comparison": [">", "<", "≥", "≤", "=", "less than", "leſſ than", "Greater than", "equal to"],
    }
    assert set(forms) == {n for n, (p, *_) in technical.RULES.items() if p is not None}
    asked = [(name, t) for name, ts in forms.items() for f in ts for t in {f, f.lower(), f.upper()}]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(asked)], "i int, t string")
    got = {(r.i, x.rule): (x["count"], x.matches) for r in df.select("i", technical.found(F.col("t")).alias("r")).collect() for x in r.r}
    bare = df.select("i", *(F.regexp_extract_all("t", F.lit(f"(?iU){p}"), F.lit(0)).alias(n) for n, (p, *_) in technical.RULES.items() if p is not None)).collect()
    want = {(r.i, n): (len(hits), sorted(set(hits), key=str.encode)) for r in bare for n, hits in r.asDict().items() if n != "i" and hits}
    assert got == want
    assert {asked[i] for i, n in want if n == asked[i][0]} >= {(name, f) for name, fs in forms.items() for f in fs}
