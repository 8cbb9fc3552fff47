"""Named queries of word files. The files are made by Spark from ``documents`` (one archive each, XML by expressions) and
read back by the sources; SQL says what must come out."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from ..sources import archive, docx_parts, pdf
from ..sources.shared import written
from ..sources.tables import table
from .catalogue import query

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_CLEAN = "[\\x00-\\x09\\x0B-\\x1F\\x7F￾￿]"
_STYLES = "".join(
    f'<w:style w:type="{kind}" w:styleId="{name}">{f"<w:basedOn w:val=\"{base}\"/>" if base else ""}{f"<w:rPr>{say}</w:rPr>" if say else ""}</w:style>'
    for kind, name, base, say in (("paragraph", "Normal", "", ""), ("paragraph", "Old", "Normal", "<w:strike/>"), ("paragraph", "Older", "Old", ""), ("paragraph", "Oldest", "Older", ""), ("paragraph", "New", "Old", '<w:strike w:val="0"/>'), ("character", "Gone", "", "<w:vanish/><w:strike/>"))
)
_LEVELS = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{i + 1}"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/><w:pPr><w:ind w:left="{720 * (i + 1)}"/></w:pPr></w:lvl>' for i, (f, t) in enumerate((("decimal", "%1."), ("lowerLetter", "%1.%2"), ("upperRoman", "(%3)"))))
_NUMBERING = (
    f'<w:abstractNum w:abstractNumId="0"><w:styleLink w:val="L"/>{_LEVELS}</w:abstractNum><w:abstractNum w:abstractNumId="1"><w:numStyleLink w:val="L"/></w:abstractNum><w:abstractNum w:abstractNumId="2"><w:lvl w:ilvl="0"/></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    '<w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride></w:num><w:num w:numId="4"><w:abstractNumId w:val="2"/></w:num>'
)


def files(spark, d):
    """(path, content): each document as a word file. A line is a paragraph, or a table where it has bars; numbers, styles,
    notes and section breaks follow from its length."""
    n, safe = "length(x)", "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    text = f"'<w:t xml:space=\"preserve\">', {safe}, '</w:t>'"
    props = f"""concat('<w:pPr><w:pStyle w:val="', elt({n} % 5 + 1, 'Normal', 'Old', 'Older', 'Oldest', 'New'), '"/>',
        if({n} % 4 = 0, concat('<w:numPr><w:ilvl w:val="', {n} % 3, '"/><w:numId w:val="', {n} % 4 + {n} % 3 + 1, '"/></w:numPr>'), ''), if({n} % 11 = 0, '<w:sectPr><w:type w:val="continuous"/></w:sectPr>', ''), '</w:pPr>')"""
    run = f"""concat('<w:r>', if({n} % 6 = 1, '<w:rPr><w:rStyle w:val="Gone"/></w:rPr>', if({n} % 7 = 2, '<w:rPr><w:strike/></w:rPr>', if({n} % 13 = 3, '<w:rPr><w:vanish w:val="0"/></w:rPr>', ''))), {text}, if({n} % 5 = 0, '<w:footnoteReference w:id="1"/>', ''), '</w:r>')"""
    cells = "array_join(transform(split(x, ' \\\\| '), x -> concat('<w:tc><w:p><w:r>', " + text + ", '</w:r></w:p></w:tc>')), '')"
    body = f"array_join(transform(lines, x -> if(contains(x, ' | '), concat('<w:tbl><w:tr>', {cells}, '</w:tr></w:tbl>'), concat('<w:p>', {props}, {run}, '</w:p>'))), '')"
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.split(F.regexp_replace("text", _CLEAN, ""), "\n").alias("lines"))
    say = lambda c: F.concat(F.lit(f"<w:hdr {_NS}><w:p><w:r><w:t>"), c, F.lit("</w:t></w:r></w:p></w:hdr>"))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
    parts = {
        "word/document.xml": F.concat(F.lit(f"<w:document {_NS}><w:body>"), F.expr(body), F.lit('<w:sectPr/></w:body></w:document>')),
        "word/header1.xml": say(F.col("source")), "word/footer1.xml": say(F.col("lang")), "word/styles.xml": F.lit(f"<w:styles {_NS}>{_STYLES}</w:styles>"), "word/numbering.xml": F.lit(f"<w:numbering {_NS}>{_NUMBERING}</w:numbering>"),
        "word/comments.xml": F.concat(F.lit(f"<w:comments {_NS}><w:comment w:author=\""), F.col("lang"), F.lit('"><w:p><w:r><w:t>'), F.size("lines").cast("string"), F.lit(" lines</w:t></w:r></w:p></w:comment></w:comments>")),
        "word/_rels/document.xml.rels": F.concat(F.lit("<Relationships>"), F.expr(f"repeat('<Relationship Type=\"{rel}\"/>', size(lines) % 3)"), F.lit("</Relationships>")),
    }
    packed = archive.packed(F.create_map(*(x for name, xml in parts.items() for x in (F.lit(name), xml))))
    return docs.filter(F.col("lines").isNotNull()).select(F.col("doc_id").cast("string").alias("path"), packed.alias("content"))


_LINES = f"""d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(regexp_replace(text, '{_CLEAN}', '', 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM x WHERE NOT contains(x, ' | ')), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM x WHERE contains(x, ' | '))"""


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, i, unnest(string_split(x, ' | ')) AS x, generate_subscripts(string_split(x, ' | '), 1) AS j FROM t),
a AS (SELECT doc_id, 'body' AS kind, x FROM b UNION ALL SELECT doc_id, 'table', x FROM c UNION ALL SELECT doc_id, 'header', source FROM d UNION ALL SELECT doc_id, 'footer', lang FROM d UNION ALL SELECT doc_id, 'comment', len(lines) || ' lines' FROM d)
SELECT doc_id, kind, count(*) AS paragraphs, sum(length(trim(x)))::BIGINT AS chars FROM a WHERE trim(x) <> '' GROUP BY doc_id, kind""")
def docx_texts(spark, d):
    """Paragraphs and characters of every part of every file."""
    return docx_parts.texts(files(spark, d)).groupBy(F.col("doc").cast("long").alias("doc_id"), "kind").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, count(*) FILTER (WHERE length(x) % 11 = 0) + 1 AS sections FROM b GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS tables, max(len(string_split(x, ' | '))) AS widest FROM t GROUP BY doc_id),
f AS (SELECT doc_id, count(*) FILTER (WHERE length(x) % 5 = 0) AS footnotes FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(sections, 1) AS sections, coalesce(tables, 0) AS tables, coalesce(widest, 0)::BIGINT AS widest, coalesce(footnotes, 0) AS footnotes, 0::BIGINT AS endnotes, (len(lines) % 3)::BIGINT AS images, lang AS author
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)""")
def docx_structure(spark, d):
    """Sections, tables, notes, images and comments' authors of every file, each from its own relation."""
    made = written(files(spark, d), "files")  # packed once, not for each relation
    sections = docx_parts.sections(made).groupBy("doc").agg(F.count("*").alias("sections"))
    tables = docx_parts.tables(made).groupBy("doc").agg(F.count("*").alias("tables"), F.max("columns").cast("long").alias("widest"))
    out = docx_parts.references(made).join(sections, "doc").join(tables, "doc", "left").join(docx_parts.comments(made).select("doc", "author"), "doc")
    return out.select(F.col("doc").cast("long").alias("doc_id"), "sections", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tables", "widest")), "footnotes", "endnotes", "images", "author")


_NUM = "length(x) % 4 + length(x) % 3 + 1"
_ROMAN = "repeat('M', n // 1000) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1]"


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, p, length(x) % 3 AS lv, {_NUM} AS num, CASE WHEN {_NUM} = 3 THEN 'n3' ELSE '0' END AS list FROM b WHERE length(x) % 4 = 0 AND {_NUM} < 4),
c AS (SELECT a.doc_id, a.p, a.lv, a.num, count(*) FILTER (WHERE z.lv = 0) AS c0, count(*) FILTER (WHERE z.lv = 1 AND z.p > coalesce((SELECT max(o.p) FROM r o WHERE o.doc_id = a.doc_id AND o.list = a.list AND o.p <= a.p AND o.lv < 1), -1)) AS c1,
count(*) FILTER (WHERE z.lv = 2 AND z.p > coalesce((SELECT max(o.p) FROM r o WHERE o.doc_id = a.doc_id AND o.list = a.list AND o.p <= a.p AND o.lv < 2), -1)) AS c2 FROM r a JOIN r z ON z.doc_id = a.doc_id AND z.list = a.list AND z.p <= a.p GROUP BY a.doc_id, a.p, a.lv, a.num, a.list),
s AS (SELECT *, CASE WHEN num = 3 THEN 6 ELSE 0 END + greatest(c0, 1) AS one, greatest(c1, 1) + 1 AS two, (greatest(c2, 1) + 2)::INTEGER AS n FROM c)
SELECT doc_id, p AS paragraph, num::INTEGER AS num_id, CASE lv WHEN 0 THEN one || '.' WHEN 1 THEN one || '.' || repeat(chr((97 + (two - 1) % 26)::INTEGER), ((two - 1) // 26 + 1)::BIGINT) ELSE '(' || {_ROMAN} || ')' END AS label FROM s""")
def numbering_labels(spark, d):
    """What a reader sees before each numbered paragraph: definitions by links and overrides, counters with restarts."""
    made = written(files(spark, d), "files")

    def numbered(_, root):
        for i, p in enumerate(root.find(f"{docx_parts.W}body").findall(f"{docx_parts.W}p")):
            pr = p.find(f"{docx_parts.W}pPr/{docx_parts.W}numPr")
            if pr is not None:
                yield i, int(pr.find(f"{docx_parts.W}numId").get(f"{docx_parts.W}val")), int(pr.find(f"{docx_parts.W}ilvl").get(f"{docx_parts.W}val"))

    rows = docx_parts.relation(made, r"word/document\.xml", numbered, "paragraph long, num_id int, list_level int")
    out = docx_parts.labels(rows, docx_parts.numbering(made), "doc", "paragraph")
    return out.filter("num_id < 4").select(F.col("doc").cast("long").alias("doc_id"), "paragraph", "num_id", "label")


@query("""SELECT doc_id, num::INTEGER AS num_id, level::INTEGER AS level, CASE WHEN num = 4 THEN 'bullet' ELSE (['decimal', 'lowerLetter', 'upperRoman'])[level + 1] END AS format, CASE WHEN num = 4 THEN 0 ELSE 720 * (level + 1) END::INTEGER AS indent,
CASE WHEN num = 3 AND level = 0 THEN 7 WHEN num = 4 THEN 1 ELSE level + 1 END::INTEGER AS start FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL), range(1, 5) a(num), range(0, 3) b(level) WHERE num < 4 OR level = 0""")
def numbering_definitions(spark, d):
    return docx_parts.numbering(files(spark, d)).select(F.col("doc").cast("long").alias("doc_id"), "num_id", "level", "format", "indent", "start")


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, p, length(x) AS n, length(x) % 5 IN (1, 2, 3) AS ps, length(x) % 6 = 1 AS gone FROM b),
f AS (SELECT doc_id, p, 'strike' AS format, CASE WHEN NOT gone AND n % 7 = 2 THEN 'direct' WHEN ps AND gone THEN 'toggled' WHEN ps OR gone THEN 'inherited' END AS origin FROM r
UNION ALL SELECT doc_id, p, 'hidden', CASE WHEN gone THEN 'inherited' END FROM r)
SELECT doc_id, format, origin, count(*) AS runs, min(p // 40 + 1) AS first_page FROM f WHERE origin IS NOT NULL GROUP BY ALL
UNION ALL SELECT doc_id, 'section_break', 'direct', coalesce(n, 0) + 1, NULL FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM b WHERE length(x) % 11 = 0 GROUP BY doc_id) USING (doc_id)""")
def format_inventory(spark, d):
    """Struck and hidden runs of every file by origin: direct, inherited through chains of styles, or toggled off."""
    out = docx_parts.formats(written(files(spark, d), "files"))
    return out.select(F.col("doc").cast("long").alias("doc_id"), "format", "origin", "runs", "first_page")


@query("""WITH d AS (SELECT source, doc_id, length(text) AS n, doc_id % 7 = 0 AS done FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
m AS (SELECT *, CASE WHEN done THEN 'processed/' ELSE 'raw/' END || lpad(doc_id::VARCHAR, 12, '0') || '.docx' AS member FROM d)
SELECT source, coalesce(min(member) FILTER (WHERE done), min(member)) AS member, count(*) AS members FROM m GROUP BY source""")
def zip_members(spark, d):
    """One archive a source, with a member for each document; which one counts, and how many there are."""
    docs = table(spark, d, "documents").filter("source is not null and text is not null")
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "processed/").otherwise("raw/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".docx"))
    zips = docs.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(name, F.col("lang")))).alias("m")).select(F.col("source").alias("path"), archive.packed("m").alias("content"))
    counts = archive.members(zips, r"\.docx$").groupBy("path").agg(F.count("*").alias("members"))
    return archive.first_documents(zips).join(counts, "path").select(F.col("path").alias("source"), "member", "members")


def pdf_files(spark, d):
    """(path, content): each document as a PDF of thirty lines a page, its text by UTF-16 codes and an identity map."""
    @F.pandas_udf("binary")
    def printed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            said = t.split("\n")
            pages = [said[i : i + 30] for i in range(0, len(said), 30)]
            objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{5 + 2 * i} 0 R' for i in range(len(pages)))}] >>", "<< /Type /Font /ToUnicode 4 0 R >>", "<< >>\nstream\n1 beginbfrange <0000> <FFFF> <0000> endbfrange\nendstream"]
            body = [o.encode() for o in objects]
            for i, page in enumerate(pages):
                code = "".join(f"BT /F1 9 Tf 40 {800 - 20 * k} Td <{x.encode('utf-16-be').hex()}> Tj ET\n" for k, x in enumerate(page))
                body.append(f"<< /Type /Page /Resources << /Font << /F1 3 0 R >> >> /Contents {6 + 2 * i} 0 R >>".encode())
                body.append(b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(code.encode()) + b"\nendstream")
            out.append(b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in enumerate(body, 1)) + b"trailer << /Root 1 0 R >>")
        return pd.Series(out, dtype=object)

    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.regexp_replace("text", _CLEAN, "").alias("text"))
    return docs.select(F.col("doc_id").cast("string").alias("path"), printed("text").alias("content"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, (i - 1) // 30 + 1 AS page, i, trim(x) AS t FROM x WHERE trim(x) <> '')
SELECT doc_id, page::INTEGER AS page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY i))::INTEGER AS line, t AS text FROM p""")
def pdf_lines(spark, d):
    """Lines of every document's PDF, read back."""
    return pdf.lines(pdf_files(spark, d)).filter("problem is null").select(F.col("doc").cast("long").alias("doc_id"), "page", "line", "text")
