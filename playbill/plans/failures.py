"""Queries on failure tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.operators import errors, frontier
from playbill.plans.registry import query
from playbill.plans.roles import FAILURES_SQL, SITE, failures, stamp, stamp_sql, text
from playbill.session import table

SEVERITY_SQL = """CASE {t} WHEN 'http_500' THEN 'medium' WHEN 'api_404_retry' THEN 'high' WHEN 'db_integrity_error' THEN 'critical'
    WHEN 'warning' THEN 'low' ELSE 'medium' END"""
LIMIT_SQL = """CASE error_type WHEN 'http_500' THEN 3 WHEN 'api_404_retry' THEN 1 WHEN 'db_integrity_error' THEN 1
    WHEN 'warning' THEN 6 ELSE 3 END"""
DAYS_SQL = """CASE error_type WHEN 'http_500' THEN 7 WHEN 'api_404_retry' THEN 14 WHEN 'db_integrity_error' THEN 30
    WHEN 'warning' THEN 3 ELSE 7 END"""

# The rule restated over all events: rank, threshold event, earliest of them per URL.
COUNTED_SQL = f"""{FAILURES_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url, error_type ORDER BY ts, event_id) AS nth, {LIMIT_SQL} AS lim FROM failures),
hits AS (SELECT url, min(event_id) AS hit FROM ranked WHERE nth = lim GROUP BY url),
counted AS (SELECT r.*, hit FROM ranked r LEFT JOIN hits h USING (url) WHERE hit IS NULL OR event_id <= hit)"""
TRACKED_SQL = f"""{COUNTED_SQL}, tracked AS (
  SELECT url, error_type, count(*) AS n, max(ts) AS last_ts FROM counted GROUP BY ALL)"""
COUNTS_SQL = f"""{FAILURES_SQL}, counts AS (
  SELECT url, error_type, count(*) AS n, max(ts) AS last_ts FROM failures GROUP BY ALL)"""


@query(f"WITH {COUNTS_SQL} SELECT url, error_type, n, {stamp_sql('last_ts')} AS last_ts FROM counts")
def error_counts(spark, sf):
    return errors.error_counts(failures(spark, sf)).withColumn("last_ts", stamp("last_ts"))


@query(f"""WITH {FAILURES_SQL} SELECT error_type, {SEVERITY_SQL.format(t='error_type')} AS severity, {LIMIT_SQL} AS threshold,
  {DAYS_SQL} AS days, count(*) AS n FROM failures GROUP BY ALL""")
def error_severity(spark, sf):
    kind = F.col("error_type")
    return failures(spark, sf).groupBy("error_type").agg(F.count("*").alias("n")).select(
        "error_type",
        errors.severity(kind).alias("severity"),
        errors.threshold(kind).alias("threshold"),
        errors.expiry_days(kind).alias("days"),
        "n",
    )


@query(f"""WITH {TRACKED_SQL} SELECT t.url, error_type, n, {stamp_sql('last_ts')} AS last_ts, hit AS blacklisted_by
  FROM tracked t LEFT JOIN hits USING (url)""")
def blacklist_crossing(spark, sf):
    counted = errors.counted_events(failures(spark, sf))
    rows = counted.groupBy("url", "error_type").agg(
        F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.first("hit.event_id").alias("blacklisted_by")
    )
    return rows.withColumn("last_ts", stamp("last_ts"))


@query(f"""WITH {TRACKED_SQL}, live AS (SELECT *, {DAYS_SQL} AS days FROM tracked
  WHERE TIMESTAMP '2024-01-20' - last_ts <= to_days({DAYS_SQL}::INT))
SELECT url, 'error' AS what, error_type, n FROM live
UNION ALL SELECT url, 'blacklisted', NULL, NULL FROM hits WHERE url IN (SELECT url FROM live)""")
def error_expiry(spark, sf):
    counted = errors.counted_events(failures(spark, sf))
    asof = F.lit("2024-01-20").cast("timestamp")
    live, listed = errors.expire(errors.tracked(counted), errors.blacklist(counted), asof)
    return live.select("url", F.lit("error").alias("what"), "error_type", "n").unionByName(
        listed.select(
            "url",
            F.lit("blacklisted").alias("what"),
            F.lit(None).cast("string").alias("error_type"),
            F.lit(None).cast("bigint").alias("n"),
        )
    )


@query(f"""WITH {COUNTS_SQL} SELECT url, CAST(sum(n) AS BIGINT) AS error_count,
  arg_min(error_type, (-n, error_type)) AS main_type FROM counts GROUP BY url HAVING sum(n) >= 60""")
def problem_ranking(spark, sf):
    return errors.problem_ranking(errors.error_counts(failures(spark, sf)), min_errors=60)


@query(f"""WITH {COUNTS_SQL} SELECT url, CAST(sum(n) AS BIGINT) AS error_count, arg_min(error_type, (-n, error_type)) AS main_type
  FROM counts WHERE {SEVERITY_SQL.format(t='error_type')} = 'medium' GROUP BY url HAVING sum(n) >= 1""")
def problem_ranking_medium(spark, sf):
    return errors.problem_ranking(errors.error_counts(failures(spark, sf)), level="medium")


@query(f"""WITH {COUNTS_SQL}, t AS (SELECT url, CAST(sum(n) AS BIGINT) AS error_count,
    arg_min(error_type, (-n, error_type)) AS main_type FROM counts GROUP BY url HAVING sum(n) >= 2)
SELECT *, {SEVERITY_SQL.format(t='main_type')} AS severity FROM t ORDER BY error_count DESC, url LIMIT 10""")
def top_problem_urls(spark, sf):
    return errors.top_problems(errors.error_counts(failures(spark, sf)))


@query(f"""WITH {TRACKED_SQL} SELECT 'error_type' AS section, error_type AS name, count(*) AS value FROM tracked GROUP BY ALL
UNION ALL SELECT 'severity', {SEVERITY_SQL.format(t='error_type')}, count(*) FROM tracked GROUP BY ALL
UNION ALL SELECT 'total', 'error_count', count(*) FROM tracked
UNION ALL SELECT 'total', 'blacklist_count', count(*) FROM hits""")
def error_stats(spark, sf):
    counted = errors.counted_events(failures(spark, sf))
    return errors.error_stats(errors.tracked(counted), errors.blacklist(counted))


@query(f"WITH {COUNTED_SQL} SELECT url FROM hits ORDER BY url LIMIT 10")
def blacklist_sample(spark, sf):
    return errors.blacklist_sample(errors.blacklist(errors.counted_events(failures(spark, sf))))


@query(f"WITH {FAILURES_SQL} SELECT category, error_type, count(*) AS n FROM failures GROUP BY ROLLUP (category, error_type)")
def error_rollup(spark, sf):
    return errors.error_rollup(failures(spark, sf))


def _customer_pages(spark, sf):
    return table(spark, sf, "customer").select(text(f"{SITE}/u/", F.col("c_custkey")).alias("url"), "c_name")


@query(f"""WITH {COUNTED_SQL}, c AS (SELECT '{SITE}/u/' || c_custkey AS url, c_name FROM customer)
SELECT * FROM c WHERE url NOT IN (SELECT url FROM hits)""")
def blacklist_exclusion(spark, sf):
    listed = errors.blacklist(errors.counted_events(failures(spark, sf)))
    return frontier.exclude(_customer_pages(spark, sf), listed, ["url"])


@query(f"""WITH {COUNTS_SQL}, c AS (SELECT '{SITE}/u/' || c_custkey AS url, c_name FROM customer)
SELECT * FROM c WHERE url NOT IN (SELECT url FROM counts GROUP BY url HAVING sum(n) >= 65)""")
def failure_skip(spark, sf):
    failing = errors.failing_urls(errors.error_counts(failures(spark, sf)), least=65)
    return frontier.exclude(_customer_pages(spark, sf), failing, ["url"])


@query("""SELECT event_id, user_id AS id FROM events WHERE user_id NOT IN (
  SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 12)""")
def failing_ids_excluded(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("id"), "event_type")
    fails = events.filter(F.col("event_type") == "error").groupBy("id").agg(F.count("*").alias("n"))
    return frontier.exclude(events.drop("event_type"), fails.filter("n > 12"), ["id"])


@query(f"""WITH {TRACKED_SQL}, t AS (SELECT error_type, count(*) AS n FROM tracked GROUP BY 1),
u AS (SELECT url, sum(n)::BIGINT AS n, arg_min(error_type, (-n, error_type)) AS k FROM tracked GROUP BY 1 HAVING sum(n) >= 2 ORDER BY 2 DESC, 1 LIMIT 10),
b AS (SELECT url FROM hits ORDER BY url LIMIT 5)
SELECT 'types' AS section, (row_number() OVER (ORDER BY n DESC, error_type))::INT AS place, error_type || ': ' || n || ' (' || {SEVERITY_SQL.format(t='error_type')} || ' severity)' AS line FROM t
UNION ALL SELECT 'urls', (row_number() OVER (ORDER BY n DESC, url))::INT, url || ': ' || n || ' errors (' || k || ', ' || {SEVERITY_SQL.format(t='k')} || ' severity)' FROM u
UNION ALL SELECT 'blacklist', (row_number() OVER (ORDER BY url))::INT, url FROM b""")
def error_report(spark, sf):
    counted = errors.counted_events(failures(spark, sf))
    return errors.error_report(errors.tracked(counted), errors.blacklist(counted))
