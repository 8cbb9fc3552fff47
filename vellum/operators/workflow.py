"""Workflow reporting: jobs and batches, feeds, costs, series, pages, latest rows, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "processing", "completed", "failed", "cancelled")


def status_counts(jobs: DataFrame, status: str) -> DataFrame:
    """One row: counts by state; cancelled jobs aren't in the total."""
    each = [F.count_if(F.col(status) == s).alias(s) for s in STATES]
    return jobs.agg(*each, F.count_if(F.col(status) != "cancelled").alias("total"))


def batch_totals(jobs: DataFrame, batch: str, status: str, seconds: str, tokens: str) -> DataFrame:
    """Counts, sums and guarded averages per batch."""
    n = jobs.groupBy(batch).agg(
        F.count("*").alias("jobs"), F.count_if(F.col(status) == "completed").alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col(status) == "completed", F.col(tokens))), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 2).alias("seconds"),
    )
    done = F.col("completed") + F.col("failed")
    return n.withColumns({
        "mean_tokens": F.when(F.col("completed") > 0, F.round(F.col("tokens") / F.col("completed"), 4)).otherwise(F.lit(0.0)),
        "progress": F.when(F.col("jobs") == 0, 0).otherwise(F.floor(done * 100 / F.col("jobs"))).cast("long"),
        "state": F.when(done == F.col("jobs"), F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")).otherwise("running"),
    })


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost from prices per million tokens, 6 decimals."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)


def cost_by(df: DataFrame, by: Sequence[str], model: str, tokens_in: str, tokens_out: str, prices: DataFrame) -> DataFrame:
    """Tokens and cost per group; prices: (model, price_in, price_out). Sums go before the price join, so the join sees
    a row for each group and model only."""
    n = df.groupBy(*by, model).agg(F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out")).join(prices, model)
    n = n.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))
    return n.groupBy(*by).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost"))


def daily_series(df: DataFrame, ts: str, first: str, days: int, sums: dict[str, Column]) -> DataFrame:
    """Sums for each day from ``first`` on, zeros for days without rows. The filter is a half-open range of the bare
    column, so it reaches the scan."""
    spine = df.sparkSession.range(days).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))
    inside = df.filter((F.col(ts) >= F.lit(first).cast("timestamp")) & (F.col(ts) < F.date_add(F.lit(first).cast("date"), days).cast("timestamp")))
    n = inside.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in sums.items()))
    out = spine.join(n, "day", "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), **{k: F.coalesce(F.col(k), F.lit(0.0)) for k in sums}})


def feed(events: Sequence[DataFrame], ts: str, key: str, limit: int) -> DataFrame:
    """The newest rows of several event tables. Each side is cut to the limit first: every plan node is a top-k."""
    parts = [e.orderBy(F.desc(ts), key).limit(limit) for e in events]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc(ts), key).limit(limit)


def relative_time(ts: Column, now: Column) -> Column:
    """``3d ago``, ``5h ago``, ``7m ago`` or ``just now``; bounds are strict."""
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    part = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(f"{u} ago"))
    return F.when(s > 86400, part(86400, "d")).when(s > 3600, part(3600, "h")).when(s > 60, part(60, "m")).otherwise("just now")


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def latest_per(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def breakdown(df: DataFrame, members: DataFrame, on: str, name: str, least: int = 1) -> DataFrame:
    """Members per group; groups with fewer than ``least`` don't appear."""
    return df.join(members, on).groupBy(name).agg(F.count("*").alias("members")).filter(F.col("members") >= least)


def category_pivot(df: DataFrame, by: str, category: str, fixed: Sequence[str], other: str) -> DataFrame:
    """Counts per fixed category, what isn't one of them in ``other``; fixed values spare the pass that finds them."""
    return df.withColumn("__c", F.when(F.col(category).isin(*fixed), F.col(category)).otherwise(other)).groupBy(by).pivot("__c", [*fixed, other]).agg(F.count(F.lit(1))).fillna(0)


def stage_flags(df: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Whether each flag occurs in a group, and the share of flags that do, in percent."""
    n = df.groupBy(by).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in flags.items()))
    total = sum((F.col(k).cast("int") for k in flags), F.lit(0))
    return n.withColumn("complete_percent", F.round(total * 100 / len(flags), 0).cast("long"))


def search(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return df.filter(hit)


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows younger than the retention cutoff."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def valid_latest(df: DataFrame, key: Sequence[str], ts: str, now: Column, days: int) -> DataFrame:
    """Cache view: the last entry of each key that is younger than its time to live."""
    from .quality import latest

    live = df.filter((F.col(ts) <= now) & (F.col(ts) > now - F.make_dt_interval(F.lit(days))))
    return latest(live, key, [ts])


def upsert(base: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the upsert, archived old versions); a replaced row's version goes up by one."""
    n = new.select(*key, *(F.col(c).alias(f"__{c}") for c in new.columns if c not in key), F.lit(True).alias("__hit"))
    both = base.join(n, list(key), "full")
    rest = [c for c in base.columns if c not in key and c != version]
    after = both.select(*key, *(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in rest), F.when(F.col("__hit"), F.coalesce(version, F.lit(0)) + 1).otherwise(F.col(version)).alias(version))
    return after.select(base.columns), base.join(new.select(*key), list(key), "left_semi")


def cascade_delete(tables: Sequence[tuple[str, DataFrame, str, str | None]], root_ids: DataFrame) -> dict[str, DataFrame]:
    """What is left of a chain of tables (name, rows, own key, key of the parent) after its root's rows go."""
    gone, out = root_ids, {}
    for name, df, own, parent in tables:
        on = own if parent is None else parent
        dead = gone.toDF(on)
        out[name] = df.join(dead, on, "left_anti")
        gone = df.join(dead, on, "left_semi").select(own)
    return out


def micro_batches(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Number of the count-based batch of each row within its group, from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
