"""Named queries on texts, pages and JSON, each with its DuckDB counterpart; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, quality, workflow
from ..operators import sequence as seq
from ..sources.tables import table
from .catalogue import DOC, POS, events, query

_TOK = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: NOT regexp_full_match(t, '[0-9]+'))"
_CLEAN = "regexp_replace(text, '[0-9]+|https?://[^ \\n]*', '', 'g')"
_LINES = "list_distinct(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''))"


@query(f"""WITH t AS (SELECT doc_id, {_TOK.format("text")} AS a, {_TOK.format(_CLEAN)} AS b, {_LINES.format("text")} AS la, {_LINES.format(_CLEAN)} AS lb FROM documents),
m AS (SELECT doc_id, len(a) AS tokens, len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS missing_tokens, len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS extra_tokens, len(list_filter(la, lambda x: NOT list_contains(lb, x))) AS missing_lines FROM t)
SELECT *, CASE WHEN tokens > 0 THEN round(missing_tokens / tokens * 100, 4) ELSE 0.0 END AS loss_percent FROM m""")
def token_loss(spark, d):
    clean = F.regexp_replace("text", r"[0-9]+|https?://[^ \n]*", "")
    return quality.token_loss(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), clean).drop("text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
o AS (SELECT line FROM l WHERE pos % 5 <> 0 UNION SELECT line || ' ' || nx FROM (SELECT line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM l WHERE pos % 5 <> 0) WHERE nx IS NOT NULL)
SELECT doc_id, pos, line FROM l ANTI JOIN o USING (line)""")
def coverage_check(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))
    out = seq.adjacent_pairs(lines.filter("pos % 5 <> 0"), "doc_id", "pos", "line")
    return joins.covered(lines, out, "line").select("doc_id", "pos", "line")


@query("""SELECT l_orderkey, sha256(string_agg(l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(l_quantity AS INT) || '|' || l_returnflag, chr(10)
ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) AS signature, count(*) AS rows FROM lineitem GROUP BY l_orderkey""")
def signature_hash(spark, d):
    li = table(spark, d, "lineitem").withColumn("qty", F.col("l_quantity").cast("int"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return quality.signature(li, ["l_orderkey"], order, ["l_linenumber", "l_partkey", "l_suppkey", "qty", "l_returnflag"])


@query("""SELECT doc_id, left(sha256(doc_id || ':' || source || ':' || lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')) || ':' || lang), 16) AS key FROM documents""")
def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.page_key(F.col("doc_id").cast("string"), F.col("source"), T.cache_text(F.col("text")), F.col("lang")).alias("key"))


#: Patterns of the scan; both engines' dialects agree on them.
PATTERNS = [
    ("double_space", "  +"), ("space_before_stop", " [.,;:]"), ("repeated_stop", r"\.\.+"), ("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+"), ("url", r"https?://[^ \n]+"),
    ("percent", "[0-9]+ ?%"), ("long_number", "[0-9]{6,}"), ("latin", "(et al|i\\.e|e\\.g)"), ("repeated_word", r"(the the|of of|and and|der der|le le)"),
]


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, unnest(regexp_extract_all(text, '{p}')) AS match FROM documents" for n, p in PATTERNS) + ") SELECT rule, count(*) AS matches, count(DISTINCT match) AS distinct_matches, count(DISTINCT doc_id) AS rows FROM m GROUP BY rule")
def pattern_scan(spark, d):
    return quality.pattern_counts(table(spark, d, "documents"), "text", PATTERNS)


def _count(c: str) -> str:
    return f"(length(text) - length(replace(text, '{c}', '')))"


@query(f"""SELECT doc_id, {_count('"')} % 2 = 1 AS odd_quotes, {_count("(")} - {_count(")")} AS round, {_count("[")} - {_count("]")} AS square, {_count("{")} - {_count("}")} AS curly FROM documents""")
def unbalanced_pairs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unbalanced(F.col("text")).alias("u")).select("doc_id", "u.*")


TERMS = [("the", "article"), ("idiot", "insult"), ("de la", "phrase"), ("THE", "shout"), ("und", "conjunction")]


@query("""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS sentence FROM documents),
t(term, category) AS (VALUES ('the', 'article'), ('idiot', 'insult'), ('de la', 'phrase'), ('THE', 'shout'), ('und', 'conjunction'))
SELECT doc_id, category, count(*) AS sentences FROM s JOIN t ON CASE WHEN term = upper(term) THEN contains(sentence, term) ELSE contains(lower(sentence), lower(term)) END GROUP BY ALL""")
def term_scan(spark, d):
    from ..sources.tables import upper_or_any_case

    s = table(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    # the term list is a fixed vocabulary of a few rows, so it travels in the plan
    terms = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(c).alias("category")) for t, c in TERMS)))
    return s.withColumn("t", terms).select("doc_id", "sentence", "t.*").filter(upper_or_any_case("term", "sentence")).groupBy("doc_id", "category").agg(F.count("*").alias("sentences"))


@query("""SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '[\\x{0370}-\\x{03FF}]') THEN 'greek' END, CASE WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'cyrillic' END, CASE WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'han' END], lambda x: x IS NOT NULL) AS scripts,
regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii FROM documents""")
def script_detection(spark, d):
    keep = F.array(*map(F.lit, ("greek", "cyrillic", "han")))
    return table(spark, d, "documents").select("doc_id", F.array_intersect(T.scripts(F.col("text")), keep).alias("scripts"), F.col("text").rlike(r"[^\x00-\x7F]").alias("non_ascii"))


@query("""SELECT page_id, lower(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')) AS body, len(regexp_extract_all(html, '<img ')) AS images FROM pages""")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", T.cache_text(F.col("html")).alias("body"), F.regexp_count("html", F.lit("<img ")).cast("long").alias("images"))


@query("""WITH n AS (SELECT source, avg((lang = 'en')::INT) AS english, avg((n_chars < 400)::INT) AS short FROM documents GROUP BY source)
SELECT source, round(english, 6) AS english, round(short, 6) AS short, CASE WHEN short >= 0.3 THEN 'fragments' WHEN english >= 0.6 THEN 'english' ELSE 'mixed' END AS profile FROM n""")
def profile_router(spark, d):
    run = quality.profile({"english": F.col("lang") == "en", "short": F.col("n_chars") < 400}, [("fragments", "short", 0.3), ("english", "english", 0.6)], "mixed")
    return run(table(spark, d, "documents"), ["source"]).withColumns({"english": F.round("english", 6), "short": F.round("short", 6)})


@query("""SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id) ORDER BY n_chars, quality, doc_id LIMIT 50""")
def suspicious_topk(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return docs.orderBy("n_chars", "quality", "doc_id").limit(50)


_PAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH t AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS lv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events),
u AS (SELECT *, max(CASE WHEN lv = 1 THEN o END) {_PAST} AS l1, max(CASE WHEN lv = 2 THEN o END) {_PAST} AS l2,
coalesce(bool_or(event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) OR coalesce(bool_or(event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS near FROM t),
n AS (SELECT user_id, count(*) AS rows, count(*) FILTER (event_type = 'error' AND value > 150) AS unknown, count(*) FILTER (value < 2) AS low, count(*) FILTER (coalesce((lv = 2 AND l1 IS NULL) OR (lv = 3 AND (l2 IS NULL OR l2 < coalesce(l1, 0))), false)) AS orphans, count(*) FILTER (event_type = 'purchase' AND NOT near) AS lonely FROM u GROUP BY user_id),
s AS (SELECT *, CAST(greatest(0, least(100, round_even(100 - least(40.0, unknown / rows * 100 * 40 / 40) - least(20.0, low / rows * 100 * 20 / 40) - least(20, orphans * 2) - least(20, lonely), 0))) AS INTEGER) AS score FROM n)
SELECT *, CASE WHEN score >= 85 AND unknown = 0 THEN 'PASS' WHEN score >= 70 AND unknown = 0 THEN 'RETRY' ELSE 'REVIEW' END AS action FROM s""")
def doc_quality_score(spark, d):
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3)
    known = ~((F.col("event_type") == "error") & (F.col("value") > 150))
    return quality.document_score(events(spark, d), DOC, POS, "event_type", known, "value", 2, level, F.col("event_type") == "view", F.col("event_type") == "purchase")


@query("""SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events WHERE ts <= TIMESTAMP '2024-01-25' AND ts > TIMESTAMP '2024-01-25' - INTERVAL 10 DAY GROUP BY ALL""")
def ttl_latest(spark, d):
    return workflow.valid_latest(events(spark, d).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", F.lit("2024-01-25").cast("timestamp"), 10)


@query("""WITH b AS (SELECT source, doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 75) AS BIGINT) AS batch FROM documents) SELECT source, batch, count(*) AS rows, min(doc_id) AS first FROM b GROUP BY ALL""")
def micro_batches(spark, d):
    return workflow.micro_batches(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 75).groupBy("source", "batch").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"))


@query("""WITH t AS (SELECT event_id, event_type AS tag, CASE WHEN value < 20 THEN '' WHEN event_type = 'error' THEN '<H1>' WHEN event_type = 'view' THEN 'Source: own' WHEN event_type = 'click' THEN 'a) see text' WHEN value > 80 THEN '12' ELSE 'Body text' END AS text, CASE WHEN user_id % 2 = 0 THEN 'TABLE' ELSE 'BODY' END AS zone FROM events)
SELECT event_id, CASE WHEN text = '' AND zone = 'TABLE' THEN 'empty-table' WHEN text = '' THEN 'empty' WHEN text = '<H1>' THEN 'marker-only' WHEN zone = 'TABLE' AND starts_with(text, 'Source') THEN 'table-source' WHEN zone = 'TABLE' AND starts_with(text, 'a)') THEN 'table-footnote' WHEN text = '12' THEN 'short-token' END AS rule FROM t""")
def gate_rules(spark, d):
    e = events(spark, d)
    text = F.when(F.col("value") < 20, "").when(F.col("event_type") == "error", "<H1>").when(F.col("event_type") == "view", "Source: own").when(F.col("event_type") == "click", "a) see text").when(F.col("value") > 80, "12").otherwise("Body text")
    none = {c: F.lit(None).cast(t) for c, t in {"lock_style": "boolean", "skip_llm": "boolean", "allowed_styles": "array<string>", "caption_type": "string", "source_line": "boolean", "box_marker": "string", "box_label": "string", "box_title": "boolean", "marker_style": "string"}.items()}
    rows = e.select("event_id", text.alias("text"), F.when(F.col("user_id") % 2 == 0, "TABLE").otherwise("BODY").alias("zone")).withColumns(none)
    return rows.select("event_id", quality.gate_rule()["rule"].alias("rule"))


@query("""WITH a AS (SELECT event_id, event_type AS text FROM events WHERE event_id % 11 <> 0), b AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE event_type END AS text FROM events WHERE event_id % 7 <> 0)
SELECT event_id, CASE WHEN b.text IS NULL THEN 'lost' WHEN a.text IS NULL THEN 'added' ELSE 'text changed' END AS violation FROM a FULL JOIN b USING (event_id) WHERE a.text IS DISTINCT FROM b.text""")
def stage_contract(spark, d):
    e = events(spark, d).select("event_id", F.col("event_type").alias("text"))
    after = e.filter("event_id % 7 <> 0").withColumn("text", F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("text")))
    return quality.contract(e.filter("event_id % 11 <> 0"), after, ["event_id"], "text")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '42') OR contains(lower(c_mktsegment), 'build')""")
def search_box(spark, d):
    return workflow.search(table(spark, d, "customer"), ["c_name", "c_mktsegment"], "BUILD").unionByName(workflow.search(table(spark, d, "customer"), ["c_name"], "42")).select("c_custkey", "c_name").distinct()


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS said, count(*) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def fused_turns(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), " ")
    return c.groupBy("conv_id").agg(said.alias("said"), F.count("*").alias("turns"))


@query("""WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS new_orders FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT c_custkey, coalesce(new_orders, c_nationkey::BIGINT) AS orders, CASE WHEN new_orders IS NOT NULL THEN 2 ELSE 1 END AS version FROM customer FULL JOIN n USING (c_custkey)""")
def versioned_upsert(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("orders"), F.lit(1).alias("version"))
    new = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return workflow.upsert(base, new, ["c_custkey"], "version")[0]


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) ON l_orderkey = o_orderkey""")
def cascade_delete(spark, d):
    dead = table(spark, d, "customer").filter("c_nationkey = 3").select("c_custkey")
    chain = [("customer", table(spark, d, "customer"), "c_custkey", None), ("orders", table(spark, d, "orders"), "o_orderkey", "o_custkey"), ("lineitem", table(spark, d, "lineitem"), "l_linenumber", "l_orderkey")]
    return workflow.cascade_delete(chain, dead)["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")
