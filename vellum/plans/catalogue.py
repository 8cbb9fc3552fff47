"""Named queries over the tables, each with its DuckDB counterpart.

The tables stand in for the workflow's: ``events`` per user are documents of tagged rows ('error' is the tag that maps
to nothing), ``orders`` and ``lineitem`` are jobs and uploads, ``documents`` are texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, joins, quality, workflow
from ..operators import sequence as seq
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DOC, POS = "user_id", ["ts", "event_id"]
MAPPED = F.col  # columns need an active session, so flags are made inside queries


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def mapped() -> F.Column:
    return F.col("event_type") != "error"


def level() -> F.Column:
    """Event types as heading levels."""
    return F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3)


_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_PAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LEVEL = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END"


@query(f"""WITH t AS (SELECT event_type AS dst, lag(event_type) {_OVER} AS src FROM events),
n AS (SELECT src, dst, count(*) AS n FROM t WHERE src IS NOT NULL AND src <> 'error' AND dst <> 'error' GROUP BY src, dst)
SELECT * FROM (SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 4) AS p FROM n) WHERE n >= 3""")
def transition_priors(spark, d):
    return corpus.transition_priors(events(spark, d), DOC, POS, "event_type", mapped(), 3)


@query(f"""SELECT event_id, event_type, coalesce(last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) {_PAST}, 'START') AS prev_tag FROM events""")
def context_carry(spark, d):
    return seq.context_carry(events(spark, d), DOC, POS, "event_type", mapped()).select("event_id", "event_type", "prev_tag")


@query(f"""SELECT event_id, lag(event_type, 1, 'START') {_OVER} AS prev_tag, lead(event_type, 1, 'END') {_OVER} AS next_tag FROM events""")
def context_lag_lead(spark, d):
    return seq.context_lag_lead(events(spark, d), DOC, POS, "event_type").select("event_id", "prev_tag", "next_tag")


@query(f"""WITH t AS (SELECT *, row_number() {_OVER} - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY ts, event_id) AS rk, count(*) OVER (PARTITION BY user_id, event_type, g) AS m FROM t)
SELECT event_id, CASE WHEN rk = 1 THEN 'FIRST' WHEN rk = m THEN 'LAST' ELSE 'MID' END AS list_position, m = 1 AS singleton FROM r""")
def run_positions(spark, d):
    return seq.run_positions(events(spark, d), DOC, POS, "event_type").select("event_id", "list_position", "singleton")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rk, count(*) OVER (PARTITION BY user_id, event_type) AS m FROM events)
SELECT event_id, CASE WHEN rk = 1 THEN 'FIRST' WHEN rk = m THEN 'LAST' ELSE 'MID' END AS list_position FROM r""")
def partition_positions(spark, d):
    return seq.partition_positions(events(spark, d), DOC, POS, "event_type").select("event_id", "list_position")


def _near(k: int) -> str:
    return f"""(coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), false)
OR coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING), false))"""


@query(f"SELECT event_id, {_near(3)} AS near3, {_near(10)} AS near10 FROM events")
def neighbour_exists(spark, d):
    flag = F.col("event_type") == "purchase"
    return events(spark, d).select("event_id", seq.neighbour_exists(flag, DOC, POS, 3).alias("near3"), seq.neighbour_exists(flag, DOC, POS, 10).alias("near10"))


@query(f"""WITH t AS (SELECT *, {_LEVEL} AS lv, row_number() {_OVER} AS o FROM events),
u AS (SELECT *, max(CASE WHEN lv = 1 THEN o END) {_PAST} AS l1, max(CASE WHEN lv = 2 THEN o END) {_PAST} AS l2, last_value(lv IGNORE NULLS) {_PAST} AS pv FROM t)
SELECT event_id, coalesce((lv = 2 AND l1 IS NULL) OR (lv = 3 AND (l2 IS NULL OR l2 < coalesce(l1, 0))), false) AS orphan, coalesce(lv > pv + 1, false) AS level_jump FROM u""")
def hierarchy_violations(spark, d):
    return seq.hierarchy_violations(events(spark, d).withColumn("level", level()), DOC, POS, "level").select("event_id", "orphan", "level_jump")


@query("""SELECT e.event_id, s.event_id AS purchase_id, s.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def forward_fill_asof(spark, d):
    e = events(spark, d)
    buy = e.filter("event_type = 'purchase'").withColumn("bought", F.struct("event_id", "value"))
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    return joins.as_of(clicks, buy, ["user_id"], "ts", "bought").select("event_id", F.col("bought.event_id").alias("purchase_id"), F.col("bought.value").alias("purchase_value"))


@query("""WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_pos FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_pos, l_partkey) AS appearance FROM f)
SELECT *, l_partkey <> appearance AS sequence_issue FROM r""")
def appearance_rank(spark, d):
    return seq.appearance_rank(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS k FROM x),
r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b, count(*) AS c FROM g GROUP BY l_orderkey, k)
SELECT l_orderkey, string_agg(CASE WHEN c >= 3 THEN a || '-' || b WHEN c = 2 THEN a || ',' || b ELSE a::VARCHAR END, ', ' ORDER BY a) AS ranges, CAST(sum(c) AS BIGINT) AS expanded FROM r GROUP BY l_orderkey""")
def number_ranges(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    n = n.select("l_orderkey", T.number_ranges(F.col("n")).alias("ranges"))
    return n.withColumn("expanded", F.size(T.numbers(F.col("ranges"))).cast("long"))


@query("""WITH w AS (SELECT doc_id, source, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS words FROM documents),
b AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)
SELECT doc_id, CAST(s AS BIGINT) AS words_before, CAST(greatest(1, ceil(s / 160)) AS BIGINT) AS page FROM b""")
def running_page_estimate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.size(T.words(F.col("text"))).cast("long").alias("words"))
    return seq.page_estimate(docs, "source", "doc_id", "words", 160).select("doc_id", "words_before", "page")


@query(f"""WITH t AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, section, event_type = 'click' ORDER BY ts, event_id) AS rk, count(*) OVER (PARTITION BY user_id, section, event_type = 'click') AS m FROM t)
SELECT event_id, section, CASE WHEN event_type <> 'click' THEN NULL WHEN rk = 1 THEN 'FIRST' WHEN rk = m THEN 'LAST' ELSE 'MID' END AS list_position,
coalesce(lag(event_type = 'signup') {_OVER}, false) AND event_type <> 'signup' AS after_heading FROM r""")
def section_positions(spark, d):
    e = events(spark, d).withColumn("after_heading", seq.after_heading(F.col("event_type") == "signup", DOC, POS))
    return seq.section_list_positions(e, DOC, POS, F.col("event_type") == "signup", F.col("event_type") == "click").select("event_id", "section", "list_position", "after_heading")


@query("""WITH t AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN event_id END AS label FROM events),
c AS (SELECT *, count(label) OVER (PARTITION BY user_id) AS k, CAST(sum(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS r FROM t)
SELECT event_id, coalesce(CASE WHEN label IS NOT NULL AND k >= 5 THEN r END, label) AS new_label, coalesce(CASE WHEN label IS NOT NULL AND k >= 5 THEN r END, label) IS DISTINCT FROM label AS changed FROM c""")
def relabelled(spark, d):
    e = events(spark, d).withColumn("label", F.when(F.col("event_type") == "click", F.col("event_id")))
    return seq.renumbered(e, DOC, POS, "label", 5).select("event_id", "new_label", "changed")


@query(f"""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS usage_number, coalesce(value < lag(value) {_OVER}, false) AS out_of_order FROM events""")
def usage_and_order(spark, d):
    e = seq.order_issues(events(spark, d), DOC, POS, "value")
    return e.select("event_id", seq.usage_number(DOC, "event_type", POS).alias("usage_number"), "out_of_order")


@query("""WITH t AS (SELECT *, event_type = 'purchase' AS hit FROM events), h AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hits FROM t),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, hits ORDER BY ts, event_id) - 1 AS misses FROM h),
e AS (SELECT *, bool_or(misses >= 4) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM m)
SELECT event_id, NOT ended AND hits > 0 AS in_zone FROM e""")
def reference_zone(spark, d):
    return seq.reference_zone_end(events(spark, d), DOC, POS, F.col("event_type") == "purchase", 4).select("event_id", "in_zone")


@query("""SELECT e.event_id, coalesce(first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), -1) AS credit FROM events e""")
def look_ahead_credit(spark, d):
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    return events(spark, d).select("event_id", F.coalesce(seq.forward_first(v, DOC, POS, 5), F.lit(-1.0)).alias("credit"))


@query("""WITH s AS (SELECT CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS day FROM range(35) t(i)), n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1)
SELECT s.day, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM s LEFT JOIN n ON s.day = n.day""")
def daily_series(spark, d):
    out = workflow.daily_series(events(spark, d), "ts", "2024-01-01", 35, {"total": F.sum("value")})
    return out.withColumn("total", F.round("total", 4))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs of customers' batches."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return table(spark, d, "orders").withColumns({"status": status, "tokens": F.floor("o_totalprice"), "seconds": F.col("o_totalprice") / 1000})


@query(f"""WITH j AS (SELECT {_STATUS} AS status FROM orders) SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status <> 'cancelled') AS total FROM j""")
def status_counts(spark, d):
    return workflow.status_counts(jobs(spark, d), "status")


@query(f"""WITH j AS (SELECT o_custkey, {_STATUS} AS status, CAST(floor(o_totalprice) AS BIGINT) AS tokens, o_totalprice / 1000 AS seconds FROM orders),
n AS (SELECT o_custkey, count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(tokens) FILTER (status = 'completed'), 0) AS BIGINT) AS tokens, round(sum(seconds), 2) AS seconds FROM j GROUP BY o_custkey)
SELECT *, CASE WHEN completed > 0 THEN round(tokens / completed, 4) ELSE 0.0 END AS mean_tokens, CAST(floor((completed + failed) * 100 / jobs) AS BIGINT) AS progress,
CASE WHEN completed + failed = jobs THEN CASE WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END ELSE 'running' END AS state FROM n""")
def batch_totals(spark, d):
    return workflow.batch_totals(jobs(spark, d), "o_custkey", "status", "seconds", "tokens")


_PRICES = [("click", 1.0, 2.0), ("view", 2.0, 6.0), ("purchase", 3.0, 15.0), ("signup", 1.0, 4.0)]


@query("""WITH p(event_type, price_in, price_out) AS (VALUES ('click', 1.0::DOUBLE, 2.0::DOUBLE), ('view', 2.0, 6.0), ('purchase', 3.0, 15.0), ('signup', 1.0, 4.0)),
e AS (SELECT user_id, event_type, sum(CAST(floor(value * 1000) AS BIGINT)) AS a, sum(CAST(floor(value * 100) AS BIGINT)) AS b FROM events GROUP BY ALL),
c AS (SELECT user_id, a, b, round(a / 1e6 * price_in + b / 1e6 * price_out, 6) AS c FROM e JOIN p USING (event_type))
SELECT user_id, CAST(sum(a) AS BIGINT) AS tokens_in, CAST(sum(b) AS BIGINT) AS tokens_out, round(sum(c), 6) AS cost FROM c GROUP BY user_id""")
def cost_by_user(spark, d):
    e = events(spark, d).withColumns({"tin": F.floor(F.col("value") * 1000), "tout": F.floor(F.col("value") * 100)})
    prices = spark.createDataFrame(_PRICES, "event_type string, price_in double, price_out double")
    return workflow.cost_by(e, ["user_id"], "event_type", "tin", "tout", prices)


@query("""WITH a AS (SELECT 'order' AS kind, o_orderkey AS key, o_orderdate AS "at", o_custkey AS cust FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50),
b AS (SELECT 'ship' AS kind, l_orderkey * 10 + l_linenumber AS key, max(l_shipdate) AS "at", NULL::BIGINT AS cust FROM lineitem GROUP BY ALL ORDER BY "at" DESC, key LIMIT 50)
SELECT kind, key, "at", coalesce(c_name, 'Unknown') AS name, coalesce(n_name, 'Unknown') AS nation FROM (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY "at" DESC, key LIMIT 50) u
LEFT JOIN customer ON cust = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def activity_feed(spark, d):
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("c_custkey"))
    s = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")).agg(F.max("l_shipdate").alias("at"))
    s = s.select(F.lit("ship").alias("kind"), "key", "at", F.lit(None).cast("long").alias("c_custkey"))
    top = workflow.feed([o, s], "at", "key", 50)
    c = joins.lookup(top, table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", {"c_name": "Unknown"})
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup(c, n, "c_nationkey", {"n_name": "Unknown"}).select("kind", "key", "at", F.col("c_name").alias("name"), F.col("n_name").alias("nation"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey""")
def latest_per_key(spark, d):
    return quality.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
def page_of_orders(spark, d):
    return workflow.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"], 100, 25)


@query("SELECT n_name, count(*) AS members FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def role_breakdown(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return workflow.breakdown(n, table(spark, d, "customer").filter("c_acctbal > 0"), "c_nationkey", "n_name")


@query("""SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING", count(*) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY",
count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS "Miscellaneous" FROM customer GROUP BY c_nationkey""")
def category_pivot(spark, d):
    return workflow.category_pivot(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "Miscellaneous")


@query("""WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS open, bool_or(l_quantity > 40) AS bulk FROM lineitem GROUP BY l_orderkey)
SELECT *, CAST(round((returned::INT + open::INT + bulk::INT) * 100 / 3, 0) AS BIGINT) AS complete_percent FROM f""")
def stage_flags(spark, d):
    return workflow.stage_flags(table(spark, d, "lineitem"), "l_orderkey", {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "bulk": F.col("l_quantity") > 40})


@query("""SELECT l_partkey AS part, 'missing' AS kind FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) ANTI JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey
UNION ALL SELECT p_partkey, 'unused' FROM (SELECT * FROM part WHERE p_size < 25) ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_partkey = p_partkey""")
def missing_and_unused(spark, d):
    cited = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("part"))
    return joins.missing_and_unused(cited, table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("part")), "part")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS segment FROM customer""")
def override_merge(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    over = table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey", F.lit("DEBT").alias("segment"))
    return joins.override_merge(base, over, "c_custkey")


@query("""WITH n AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS tag, max(o_totalprice) / 1000 AS conf FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, CASE WHEN n.tag IS NOT NULL AND (conf > 100 OR n.tag <> c_mktsegment) THEN n.tag ELSE c_mktsegment END AS tag,
round(CASE WHEN n.tag IS NOT NULL AND (conf > 100 OR n.tag <> c_mktsegment) THEN conf ELSE 100.0 END, 6) AS confidence, n.tag IS NOT NULL AND (conf > 100 OR n.tag <> c_mktsegment) AS changed FROM customer c LEFT JOIN n USING (c_custkey)""")
def conditional_update(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("tag"), F.lit(100.0).alias("confidence"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("tag"), (F.max("o_totalprice") / 1000).alias("confidence"))
    return joins.conditional_update(base, new, "c_custkey", "tag", "confidence").withColumn("confidence", F.round("confidence", 6))


@query("""SELECT c_custkey, CASE WHEN o IS NOT NULL THEN 'orders' WHEN s_name IS NOT NULL THEN 'suppliers' END AS matched_by, coalesce(o::VARCHAR, s_name) AS matched_value FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey""")
def cascade_match(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").cast("string").alias("v"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    m = joins.cascade(table(spark, d, "customer").select("c_custkey"), [("orders", o, "v"), ("suppliers", s, "s_name")], "c_custkey")
    return m.select("c_custkey", F.col("matched.by").alias("matched_by"), F.col("matched.value").alias("matched_value"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), b AS (
SELECT a.event_id, c.event_id AS near_id, abs(a.pos - c.pos) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY (c.value > 50)::INT DESC, abs(a.pos - c.pos), c.pos) AS r
FROM p a JOIN p c ON a.user_id = c.user_id AND a.event_type = 'purchase' AND c.event_type = 'view' AND abs(a.pos - c.pos) BETWEEN 1 AND 3) SELECT event_id, near_id, distance FROM b WHERE r = 1""")
def interval_nearest(spark, d):
    e = events(spark, d).withColumn("pos", F.row_number().over(seq.ordered(DOC, POS)).cast("long")).select("user_id", "pos", "event_id", "event_type", "value")
    near = joins.nearest_within(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "pos", 3, F.col("c_value") > 50)
    return near.select("event_id", F.col("c_event_id").alias("near_id"), "distance")


@query("""WITH a AS (SELECT conv_id, turn, role, length(text) > 200 AS long FROM conversations WHERE turn % 3 <> 0), b AS (SELECT conv_id, turn + 1 AS turn, role, length(text) > 200 AS long FROM conversations)
SELECT conv_id, turn, a.role AS a_role, b.role AS b_role, a.long AS a_long, b.long AS b_long, CASE WHEN a.role IS NULL THEN 'added' WHEN b.role IS NULL THEN 'removed' WHEN a.role IS DISTINCT FROM b.role THEN 'role differs' WHEN a.long IS DISTINCT FROM b.long THEN 'long differs' END AS status
FROM a FULL JOIN b USING (conv_id, turn) WHERE status IS NOT NULL""")
def positional_diff(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.length("text") > 200).alias("long"))
    return joins.positional_diff(c.filter("turn % 3 <> 0"), c.withColumn("turn", F.col("turn") + 1), ["conv_id", "turn"], ["role", "long"])


@query("""SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS freq FROM documents GROUP BY lang, source""")
def zone_priors(spark, d):
    return corpus.priors(table(spark, d, "documents"), "lang", "source")


@query("""SELECT regexp_extract(source, '[0-9]$') AS suffix, count(*) AS n, count(DISTINCT source) AS tags FROM documents GROUP BY 1""")
def suffix_stats(spark, d):
    return table(spark, d, "documents").groupBy(F.regexp_extract("source", "[0-9]$", 0).alias("suffix")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("tags"))


@query("""WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM n) SELECT * FROM r WHERE rank <= 8""")
def top_k_counts(spark, d):
    return corpus.top_k(table(spark, d, "documents"), ["lang"], "source", 8)


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", F.col("quality").cast("string").alias("tag"), (F.col("n_chars") > 1000).alias("long"), F.contains("text", F.lit("@")).alias("at"), F.col("text").rlike("[0-9]").alias("digit"))


_FLAGGED = "f AS (SELECT doc_id, CAST(quality AS VARCHAR) AS tag, n_chars > 1000 AS long, contains(text, '@') AS has_at, regexp_matches(text, '[0-9]') AS digit FROM documents JOIN labels USING (doc_id)), u AS (SELECT tag, 'long' AS feature, CAST(long AS VARCHAR) AS value FROM f UNION ALL SELECT tag, 'at', CAST(has_at AS VARCHAR) FROM f UNION ALL SELECT tag, 'digit', CAST(digit AS VARCHAR) FROM f)"


@query(f"""WITH {_FLAGGED}, n AS (SELECT feature, value, tag, count(*) AS support FROM u GROUP BY ALL), t AS (SELECT *, CAST(sum(support) OVER (PARTITION BY feature, value) AS BIGINT) AS total FROM n)
SELECT *, support / total AS confidence FROM t WHERE support >= 10 AND support / total >= 0.6""")
def assoc_rules(spark, d):
    return corpus.association_rules(_flagged(spark, d), "doc_id", ["long", "at", "digit"], "tag", 10, 0.6)


_PRED = "p AS (SELECT CAST(quality AS VARCHAR) AS gold, CASE WHEN n_chars > 300 THEN CAST(CAST(n_chars > 1500 AS INT) AS VARCHAR) END AS pred FROM documents JOIN labels USING (doc_id))"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(F.col("quality").cast("string").alias("gold"), F.when(F.col("n_chars") > 300, (F.col("n_chars") > 1500).cast("int").cast("string")).alias("pred"))


@query(f"""WITH {_PRED}, u AS (SELECT gold AS tag, 1 AS g, 0 AS p, CASE WHEN gold = pred THEN 1 ELSE 0 END AS t FROM p UNION ALL SELECT pred, 0, 1, 0 FROM p WHERE pred IS NOT NULL),
n AS (SELECT tag, CAST(sum(t) AS BIGINT) AS tp, CAST(sum(p) - sum(t) AS BIGINT) AS fp, CAST(sum(g) - sum(t) AS BIGINT) AS fn FROM u GROUP BY tag)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM n""")
def rule_metrics(spark, d):
    return corpus.tag_metrics(_predicted(spark, d), "gold", "pred")


@query(f"""WITH {_PRED} SELECT count(*) AS n, count(pred) AS predicted, count(*) FILTER (gold = pred) AS correct, count(pred) / count(*) AS coverage, count(*) FILTER (gold = pred) / count(*) AS accuracy, count(*) FILTER (gold = pred) / count(pred) AS precision FROM p""")
def eval_metrics(spark, d):
    return corpus.overall_metrics(_predicted(spark, d), "gold", "pred")


_TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: NOT regexp_full_match(t, '[0-9]+'))"
_TFIDF = f"""WITH c AS (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark), n AS (SELECT item_id, token, count(*) AS c FROM c GROUP BY ALL), s AS (SELECT item_id, sum(c) AS size FROM n GROUP BY 1),
i AS (SELECT token, (SELECT count(*) FROM benchmark) / count(*) AS idf FROM n GROUP BY 1), w AS (SELECT item_id, token, c / size * idf AS w FROM n JOIN s USING (item_id) JOIN i USING (token)),
q AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents WHERE doc_id % 20 = 0), qn AS (SELECT doc_id, token, count(*) AS c FROM q GROUP BY ALL), qs AS (SELECT doc_id, sum(c) AS size FROM qn GROUP BY 1),
qw AS (SELECT doc_id, token, c / size * idf AS w FROM qn JOIN qs USING (doc_id) JOIN i USING (token)), dot AS (SELECT doc_id, item_id, sum(qw.w * w.w) AS dot FROM qw JOIN w USING (token) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, dot / ((SELECT sqrt(sum(x.w * x.w)) FROM qw x WHERE x.doc_id = dot.doc_id) * (SELECT sqrt(sum(y.w * y.w)) FROM w y WHERE y.item_id = dot.item_id)) AS sim FROM dot),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, item_id DESC) AS rank FROM sim), top AS (SELECT * FROM r WHERE rank <= 5)"""


def _nearest_items(spark: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 20 against the benchmark: the queries of a search."""
    items = table(spark, d, "benchmark").withColumn("tokens", T.tokens(F.col("text")))
    docs = table(spark, d, "documents").filter("doc_id % 20 = 0").withColumn("tokens", T.tokens(F.col("text")))
    w = corpus.term_weights(items, "item_id", "tokens")
    idf = items.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).crossJoin(items.agg(F.count("*").alias("docs")))  # one row
    return corpus.cosine_top_k(corpus.query_weights(docs, "doc_id", "tokens", idf), w.select("item_id", "token", "w"), "doc_id", "item_id", 5)


@query(f"{_TFIDF} SELECT doc_id, item_id, round(sim, 4) AS sim, rank FROM top")
def tfidf_topk(spark, d):
    return _nearest_items(spark, d).withColumn("sim", F.round("sim", 4))


@query(f"""{_TFIDF}, t AS (SELECT *, CAST(item_id % 7 AS VARCHAR) AS tag FROM top), v AS (SELECT doc_id, tag, count(*) AS n, max(sim) AS s FROM t GROUP BY ALL),
b AS (SELECT doc_id, arg_max(struct_pack(tag := tag, n := n), (n, round(s, 9), tag)) AS b FROM v GROUP BY doc_id) SELECT b.doc_id, CASE WHEN b.b.n >= 2 THEN b.b.tag WHEN t.sim >= 0.5 THEN t.tag END AS suggested FROM b LEFT JOIN t ON t.doc_id = b.doc_id AND t.rank = 1""")
def majority_vote(spark, d):
    return corpus.majority(_nearest_items(spark, d).withColumn("tag", (F.col("item_id") % 7).cast("string")), "doc_id", "tag", 2, 0.5)


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS match, list_cosine_similarity(q, embedding::DOUBLE[]) AS sim FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, match DESC) AS rank FROM s) SELECT query, match, round(sim, 4) AS sim, rank FROM r WHERE rank <= 5""")
def embedding_topk(spark, d):
    return corpus.dense_top_k(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5).withColumn("sim", F.round("sim", 4))
