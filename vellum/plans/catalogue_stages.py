"""Named queries of the row-rewrite stages and span operators, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as seq
from ..operators import spans, stages
from ..sources.tables import table
from .catalogue import DOC, POS, events, query

_ROWS = """e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'TXT' WHEN 'view' THEN 'T1' WHEN 'signup' THEN 'NBX-TXT' WHEN 'purchase' THEN 'NBX-H2' ELSE 'odd' END AS tag,
CASE event_id % 4 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'BODY' WHEN 2 THEN 'BOX_BX1' ELSE 'BACK_MATTER' END AS zone,
CASE event_id % 9 WHEN 0 THEN 'Source: own data' WHEN 1 THEN '* not shown' WHEN 2 THEN '<H1>References' WHEN 3 THEN '<CN>' WHEN 4 THEN 'Table 2.1 Counts' WHEN 5 THEN 'a) first' WHEN 6 THEN 'From the census' ELSE 'Plain words' END AS text FROM events)"""


def _rows(spark, d):
    tag = F.when(F.col("event_type") == "click", "TXT").when(F.col("event_type") == "view", "T1").when(F.col("event_type") == "signup", "NBX-TXT").when(F.col("event_type") == "purchase", "NBX-H2").otherwise("odd")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    texts = ["Source: own data", "* not shown", "<H1>References", "<CN>", "Table 2.1 Counts", "a) first", "From the census", "Plain words", "Plain words"]
    return events(spark, d).select("event_id", "user_id", "ts", tag.alias("tag"), pick(["TABLE", "BODY", "BOX_BX1", "BACK_MATTER"], 4).alias("zone"), pick(texts, 9).alias("text"))


@query("""WITH s AS (SELECT conv_id, turn * 10 AS s, turn * 10 + 15 AS e, role, turn AS p FROM conversations), b AS (SELECT conv_id, s AS a FROM s UNION SELECT conv_id, e FROM s),
q AS (SELECT conv_id, a AS x, lead(a) OVER (PARTITION BY conv_id ORDER BY a) AS y FROM b), c AS (SELECT q.conv_id, x, y, arg_max(role, (p, role)) AS role FROM q JOIN s ON s.conv_id = q.conv_id AND s <= x AND e >= y WHERE y IS NOT NULL GROUP BY ALL),
g AS (SELECT *, CASE WHEN lag(y) OVER w = x AND lag(role) OVER w = role THEN 0 ELSE 1 END AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY x)), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS r FROM g)
SELECT conv_id, role, min(x) AS s, max(y) AS e FROM r GROUP BY conv_id, r, role""")
def span_overlay(spark, d):
    s = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 10).alias("s"), (F.col("turn") * 10 + 15).alias("e"), "role", F.col("turn").alias("p"))
    return spans.overlay(s, ["conv_id"], "s", "e", "role", "p")


@query("""WITH f AS (SELECT l_orderkey, l_suppkey AS old, min(l_linenumber) AS p FROM lineitem GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, old) AS new FROM f),
r AS (SELECT l.l_orderkey, list_sort(list(m.new)) AS numbers FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l JOIN m ON m.l_orderkey = l.l_orderkey AND m.old = l.l_suppkey GROUP BY 1) SELECT l_orderkey, array_to_string(numbers, ',') AS numbers FROM r""")
def renumbered_lists(spark, d):
    li = table(spark, d, "lineitem")
    mapping = spans.renumber_map(li, ["l_orderkey"], ["l_linenumber"], "l_suppkey")
    rows = li.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("numbers"))
    return spans.renumbered_lists(rows, mapping, ["l_orderkey"], "numbers").withColumn("numbers", F.array_join("numbers", ","))


@query("""WITH i AS (SELECT l_orderkey, l_returnflag AS kind, l_linenumber AS number, l_quantity > 25 AS cap FROM lineitem), n AS (SELECT l_orderkey, kind, number, bool_or(cap) AS c, bool_or(NOT cap) AS q FROM i GROUP BY ALL)
SELECT l_orderkey, kind, number, CASE WHEN c AND q THEN 'ok' WHEN c THEN 'not cited' ELSE 'no caption' END AS status FROM n""")
def caption_status(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("number"), (F.col("l_quantity") > 25).alias("cap"))
    return spans.caption_status(i, ["l_orderkey"], "kind", "number", "cap")


@query("""WITH p AS (SELECT DISTINCT lang, CAST(floor(doc_id / 3) AS BIGINT) AS page FROM documents), g AS (SELECT *, page - row_number() OVER (PARTITION BY lang ORDER BY page) AS g FROM p),
r AS (SELECT lang, min(page) AS a, max(page) AS b FROM g GROUP BY lang, g) SELECT lang, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY lang""")
def script_pages(spark, d):
    return spans.page_runs(table(spark, d, "documents").select("lang", F.floor(F.col("doc_id") / 3).alias("page")), ["lang"], "page")


@query(f"""WITH {_ROWS} SELECT user_id, max_by(CASE WHEN tag = 'T1' THEN 'start' ELSE 'stop' END, event_id) AS last_event, count(*) FILTER (tag = 'odd') AS odd FROM e WHERE tag IN ('T1', 'odd') GROUP BY user_id""")
def last_block_event(spark, d):
    rows = _rows(spark, d).filter(F.col("tag").isin("T1", "odd"))
    return rows.groupBy("user_id").agg(F.max_by(F.when(F.col("tag") == "T1", "start").otherwise("stop"), "event_id").alias("last_event"), F.count_if(F.col("tag") == "odd").alias("odd"))


@query(f"""WITH {_ROWS}, s AS (SELECT *, last_value(CASE WHEN tag = 'T1' THEN 'in' WHEN tag = 'odd' THEN 'out' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM e) SELECT event_id, coalesce(state, 'none') AS state FROM s""")
def block_state(spark, d):
    event = F.when(F.col("tag") == "T1", "in").when(F.col("tag") == "odd", "out")
    return _rows(spark, d).select("event_id", F.coalesce(seq.last_event(event, DOC, POS), F.lit("none")).alias("state"))


@query("""SELECT event_id, CASE WHEN value <= 36 THEN 0 WHEN value <= 108 THEN 1 ELSE 2 END AS indent, least(2, event_id % 2 + CAST(floor(event_id % 9 / 4) AS INTEGER))::INTEGER AS white,
CASE WHEN event_type = 'view' THEN 1.0 ELSE round(least(0.95, 0.65 + CASE WHEN event_type = 'click' THEN 0.10 ELSE 0 END + least((event_id % 20) / 100, 0.10)), 4) END AS confidence FROM events""")
def levels_and_confidences(spark, d):
    e = events(spark, d)
    canonical = F.when(F.col("event_type") == "click", "BL-MID").otherwise("QQ")
    conf = stages.alias_confidence(F.lit("BL_MID_2"), canonical, F.col("event_id") % 20, F.col("event_type") == "view")
    return e.select("event_id", stages.indent_level(F.col("value") * 10).alias("indent"), stages.whitespace_level(F.col("event_id") % 2, F.col("event_id") % 9).alias("white"), conf.alias("confidence"))
