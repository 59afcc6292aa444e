from pyspark.sql import functions as F

from ..bindings import as_of
from ..plans import periods as P, runs as R
from .base import day, half_even, num, query, stamp

TOK = "coalesce(CAST(json_extract_string(token_usage, '$.totalTokens') AS BIGINT), 0)"


@query("prj_1_recent_runs", f"""
SELECT id, agent_id, status, {stamp('started_at')} AS started_at, {stamp('completed_at')} AS completed_at,
  {stamp('created_at')} AS created_at, error, {TOK} AS total_tokens,
  {half_even("date_diff('microsecond', started_at, completed_at)", '1000000', 1)} AS duration_s
FROM runs ORDER BY runs.started_at DESC, id DESC LIMIT 200""", "runs")
def _(t):
    return R.recent_runs(t.runs)


@query("lim_1_newest_runs", "SELECT id FROM runs ORDER BY started_at DESC, id DESC LIMIT 50", "runs")
def _(t):
    return R.recent_runs(t.runs, 50).select("id")


@query("ag_1_runs_by_status", "SELECT status, count(*) AS count FROM runs GROUP BY 1", "runs")
def _(t):
    return R.runs_by_status(t.runs)


@query("ag_2_tokens_by_day", f"""
SELECT {day('started_at')} AS date, CAST(sum({TOK}) AS BIGINT) AS total_tokens FROM runs
WHERE started_at >= (SELECT max(created_at) FROM runs) - INTERVAL 30 DAY GROUP BY 1""", "runs")
def _(t):
    return R.tokens_by_day(t.runs, as_of(t.runs))


@query("prj_2_pending_gates", f"""
SELECT id, agent_id, step_name, reason, {stamp('created_at')} AS created_at FROM gates WHERE status = 'pending'""", "gates")
def _(t):
    return R.pending_gates(t.gates)


DONE = "count(*) FILTER (status = 'completed')"
COUNTS = (f"count(*) AS total_runs, {DONE} AS completed, count(*) FILTER (status = 'failed') AS failed, "
          f"{half_even(f'100 * {DONE}', 'count(*)', 1)} AS success_rate")


@query("ag_3_run_summary", f"""
SELECT {COUNTS}, CAST(sum({TOK}) AS BIGINT) AS total_tokens,
  (SELECT count(*) FROM gates WHERE status = 'pending') AS pending_approvals FROM runs""", "runs gates")
def _(t):
    return R.run_summary(t.runs, t.gates)


@query("ag_4_portfolio_kpis", f"SELECT {COUNTS} FROM runs", "runs")
def _(t):
    return R.portfolio_kpis(t.runs)


@query("ag_30_tokens_by_run", "SELECT run_id, " + ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("prompt_tokens", "completion_tokens", "total_tokens"))
    + " FROM steps GROUP BY 1", "steps")
def _(t):
    return R.tokens_by_run(t.steps)


@query("jn_6_client_summary", """
SELECT c.id, c.slug, c.name, c.status, count(p.id) AS project_count
FROM portfolio c LEFT JOIN projects p ON p.client_id = c.id GROUP BY ALL""", "portfolio projects")
def _(t):
    return R.client_summary(t.portfolio, t.projects)


@query("ag_8_phase_counts", "SELECT current_phase, count(*) AS projects FROM projects WHERE current_phase IS NOT NULL "
       "GROUP BY 1", "projects")
def _(t):
    return R.phase_counts(t.projects)


@query("src_14_projects_of_client", "SELECT id, client_id, name, current_phase, status, owner FROM projects "
       "WHERE client_id = 3", "projects")
def _(t):
    return R.projects_of(t.projects, 3)


@query("prj_5_project_table", "SELECT name, current_phase, status, owner, client_id FROM projects", "projects")
def _(t):
    return R.project_table(t.projects)


CHECKLIST = """(SELECT event_id // 4 AS run_id, CASE user_id % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'style'
  ELSE 'error-handling' END AS category, event_type <> 'error' AS passed FROM events)"""


def checklist(t):
    return t.raw("events").select(
        F.expr("event_id div 4").alias("run_id"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'style' ELSE 'error-handling' END").alias("category"),
        (F.col("event_type") != "error").alias("passed"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("notes"))


@query("val_8_checklist_verdict", f"""
SELECT run_id, CASE WHEN bool_or(NOT passed AND category <> 'style') THEN 'no-go' WHEN bool_or(NOT passed)
  THEN 'needs-review' ELSE 'go' END AS recommendation, count(*) FILTER (NOT passed) AS issues, bool_and(passed) AS passed
FROM {CHECKLIST} GROUP BY 1""")
def _(t):
    return R.checklist_verdict(checklist(t))


@query("val_8_checklist_issues", "SELECT event_id // 4 AS run_id, 'note ' || event_id AS notes FROM events WHERE event_type = 'error'")
def _(t):
    return R.checklist_issues(checklist(t))


# --- periods -------------------------------------------------------------------

ENDS = {"W": "CAST(date_trunc('week', created_at) AS DATE) + 6",
        "ME": "last_day(CAST(created_at AS DATE))",
        "QE": "last_day(CAST(date_trunc('quarter', created_at) + INTERVAL 2 MONTH AS DATE))"}
STEPS = {"W": "7 DAY", "ME": "1 MONTH", "QE": "3 MONTH"}


def _resample(period, table, value):
    first = "date_trunc('month', {})" if period != "W" else "{}"
    shown = "last_day(CAST(g AS DATE))" if period != "W" else "CAST(g AS DATE)"
    return f"""
WITH agg AS (SELECT {ENDS[period]} AS period, CAST(sum({value}) AS BIGINT) AS s, count(*) AS n FROM {table} GROUP BY 1),
cal AS (SELECT {shown} AS period FROM (SELECT unnest(generate_series(CAST((SELECT {first.format('min(period)')} FROM agg) AS TIMESTAMP),
  CAST((SELECT {first.format('max(period)')} FROM agg) AS TIMESTAMP), INTERVAL {STEPS[period]})) AS g))
SELECT {day('cal.period')} AS period, coalesce(s, 0) / 100.0::DOUBLE AS sum,
  CASE WHEN n > 0 THEN {half_even('s', '(100 * n)', 2)} END AS mean, coalesce(n, 0) AS count
FROM cal LEFT JOIN agg USING (period)"""


EVENTS = "(SELECT CAST(ts AS TIMESTAMP) AS created_at, CAST(round(value * 100) AS BIGINT) AS c FROM events)"


@query("ag_29_weekly_metric", _resample("W", EVENTS, "c"))
def _(t):
    return P.metric_by_period(t.raw("events").withColumn("created_at", F.col("ts").cast("timestamp")), period="W")


@query("ag_29_monthly_metric", _resample("ME", "invoices", "CAST(total_with_vat * 100 AS BIGINT)").replace("count(*) AS n", "count(total_with_vat) AS n"), "invoices")
def _(t):
    return P.metric_by_period(t.invoices, value_col="total_with_vat", period="ME")


@query("ag_29_quarterly_metric", _resample("QE", "invoices", "CAST(total_with_vat * 100 AS BIGINT)").replace("count(*) AS n", "count(total_with_vat) AS n"), "invoices")
def _(t):
    return P.metric_by_period(t.invoices, value_col="total_with_vat", period="QE")


@query("prj_7_hours_saved", f"""
SELECT id, manual_minutes, automated_minutes, (manual_minutes - automated_minutes) / 60.0::DOUBLE AS hours_saved,
  CASE WHEN manual_minutes <> 0 THEN {half_even('100 * (manual_minutes - automated_minutes)', 'manual_minutes', 1)} END AS savings_pct
FROM (SELECT event_id AS id, event_id * 13 % 481 AS manual_minutes, event_id * 7 % 121 AS automated_minutes FROM events)""")
def _(t):
    return P.hours_saved(t.raw("events").selectExpr(
        "event_id AS id", "event_id * 13 % 481 AS manual_minutes", "event_id * 7 % 121 AS automated_minutes"))


BA = "count(*) FILTER (event_type = 'error' AND user_id % 9 <> 0)"


@query("prj_8_error_reduction", f"""
SELECT user_id, before, after, CASE WHEN before = 0 THEN 0.0::DOUBLE ELSE {half_even('100 * (before - after)', 'before', 1)} END AS reduction_pct,
  {num('before - after')} AS absolute_change
FROM (SELECT user_id, {BA} AS before, count(*) FILTER (event_type = 'click') AS after FROM events GROUP BY 1)""")
def _(t):
    e = t.raw("events").groupBy("user_id").agg(
        F.count_if((F.col("event_type") == "error") & (F.col("user_id") % 9 != 0)).alias("before"),
        F.count_if(F.col("event_type") == "click").alias("after"))
    return P.error_reduction(e)
