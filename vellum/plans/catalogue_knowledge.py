"""Named queries of corpus knowledge, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, knowledge
from ..operators import sequence as seq
from ..sources import sinks
from ..sources.tables import table
from .catalogue import DOC, POS, events, mapped, query

_TAG = "CASE event_id % 6 WHEN 0 THEN 'BL-FIRST' WHEN 1 THEN 'BL2-MID' WHEN 2 THEN 'KT-NL3-LAST' WHEN 3 THEN 'H1' WHEN 4 THEN 'H2' ELSE 'TXT' END"


def _tagged(spark, d):
    names = ["BL-FIRST", "BL2-MID", "KT-NL3-LAST", "H1", "H2", "TXT"]
    return events(spark, d).withColumn("tag", F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int")))


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r(role, tag) AS (VALUES ('seen', 'view'), ('seen', 'click'), ('bought', 'purchase'), ('none', 'refund')) SELECT role, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM r LEFT JOIN n ON tag = event_type GROUP BY role""")
def role_counts(spark, d):
    roles = spark.createDataFrame([("seen", "view"), ("seen", "click"), ("bought", "purchase"), ("none", "refund")], "role string, tag string")
    return knowledge.role_counts(events(spark, d), "event_type", roles).select("role", "n")


_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""WITH z AS (SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 4) AS freq FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type), zt AS (SELECT user_id, arg_max(event_type, (freq, event_type)) AS tag, max(freq) AS freq FROM z GROUP BY 1),
b AS (SELECT lag(event_type) {_OVER} AS src, event_type AS dst FROM events), t AS (SELECT src, dst, count(*) AS n FROM b WHERE src <> 'error' AND dst <> 'error' GROUP BY src, dst), p AS (SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 4) AS p FROM t), pt AS (SELECT src, arg_max(dst, (p, dst)) AS dst, max(p) AS p FROM p WHERE n >= 3 GROUP BY 1),
e AS (SELECT event_id, user_id, lag(event_type, 1, 'START') {_OVER} AS prev FROM events)
SELECT event_id, CASE WHEN zt.freq >= 0.3 THEN zt.tag WHEN pt.p >= 0.25 THEN pt.dst END AS predicted FROM e LEFT JOIN zt USING (user_id) LEFT JOIN pt ON pt.src = prev""")
def prior_prediction(spark, d):
    e = events(spark, d)
    zone = corpus.priors(e, "user_id", "event_type", mapped=mapped()).withColumnRenamed("event_type", "tag")
    moves = corpus.transition_priors(e, DOC, POS, "event_type", mapped(), 3)
    rows = seq.context_lag_lead(e, DOC, POS, "event_type").select("event_id", "user_id", F.col("prev_tag").alias("prev"))
    return knowledge.prior_prediction(rows, "user_id", "prev", zone, moves, 0.3, 0.25).select("event_id", "predicted")


@query("""WITH r AS (SELECT event_id, event_type AS tag, CAST(floor(value) AS INTEGER) AS confidence FROM events WHERE event_id % 5 <> 0) SELECT e.event_id, CASE WHEN r.tag IN ('view', 'click') THEN r.tag ELSE 'TXT' END AS tag, CASE WHEN r.tag IS NULL THEN 0 WHEN r.tag IN ('view', 'click') THEN confidence ELSE least(confidence, 50) END AS confidence FROM events e LEFT JOIN r USING (event_id)""")
def completed_results(spark, d):
    e = events(spark, d)
    results = e.filter("event_id % 5 <> 0").select("event_id", F.col("event_type").alias("tag"), F.floor("value").cast("int").alias("confidence"))
    return knowledge.complete(results, e, ["event_id"], spark.createDataFrame([("view",), ("click",)], "style string"))


@query("""WITH t AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS o, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM events) SELECT event_id FROM t WHERE o - c > 0""")
def between_marks(spark, d):
    return seq.between(events(spark, d), DOC, POS, F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id")


@query(f"""WITH t AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END AS lv FROM events)
SELECT event_id, CASE WHEN lv = 2 AND NOT coalesce(bool_or(lv = 1) OVER w, false) THEN 1 WHEN lv = 3 AND NOT coalesce(bool_or(lv = 2) OVER w, false) THEN 2 END AS missing FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def unexpected_levels(spark, d):
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3)
    return seq.unexpected_levels(events(spark, d).withColumn("level", level), DOC, POS, "level").select("event_id", "missing")


@query("""SELECT conv_id, 'Turns of ' || conv_id || chr(10) || string_agg(turn || ': ' || role, chr(10) ORDER BY turn) AS report FROM conversations GROUP BY conv_id""")
def text_reports(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return sinks.report_lines(c, "conv_id", ["turn"], F.concat(F.col("turn").cast("string"), F.lit(": "), F.col("role")), "Turns of")


@query("""SELECT conv_id, '{"rows":' || count(*) || ',"results":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']}' AS json FROM conversations GROUP BY conv_id""")
def json_results(spark, d):
    return sinks.result_documents(table(spark, d, "conversations"), "conv_id", ["turn"], ["turn", "role"])


@query("""WITH n AS (SELECT source, sum(len(regexp_extract_all(text, '[0-9]+'))) AS digits, sum(len(regexp_extract_all(text, '@'))) AS ats FROM documents GROUP BY source)
SELECT source, CAST(digits AS BIGINT) AS digits, CAST(ats AS BIGINT) AS ats, CASE WHEN digits >= ats AND digits > 0 THEN 'digits' WHEN ats > 0 THEN 'ats' ELSE 'plain' END AS style FROM n""")
def style_votes(spark, d):
    return knowledge.family_votes(table(spark, d, "documents"), "source", "text", {"digits": "[0-9]+", "ats": "@"}, "plain")
