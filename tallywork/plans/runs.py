"""Automation runs, human approvals and the client portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ratios import share_pct_even
from .quality import since


def tokens(usage: str = "token_usage") -> Column:
    """Total tokens of a JSON usage object; 0 when it is absent or not an object."""
    return F.coalesce(F.get_json_object(usage, "$.totalTokens").cast("long"), F.lit(0))


def recent_runs(runs: DataFrame, limit: int = 200) -> DataFrame:
    """PRJ-1, LIM-1: the newest runs with tokens and seconds taken (one decimal, ties to even)."""
    micros = (F.unix_micros("completed_at") - F.unix_micros("started_at")).cast("decimal(20,0)")
    return (runs.select("id", "agent_id", "status", "started_at", "completed_at", "created_at", "error",
                        tokens().alias("total_tokens"),
                        F.bround(micros / F.lit(1_000_000).cast("decimal(7,0)"), 1).alias("duration_s"))
            .orderBy(F.desc("started_at"), F.desc("id")).limit(limit))


def runs_by_status(runs: DataFrame) -> DataFrame:
    """AG-1."""
    return runs.groupBy("status").agg(F.count("*").alias("count")).orderBy(F.desc("count"))


def tokens_by_day(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """AG-2: tokens per start date (UTC) over the window."""
    return (runs.where(since("started_at", days, as_of)).groupBy(F.to_date("started_at").alias("date"))
            .agg(F.sum(tokens()).alias("total_tokens")))


def pending_gates(gates: DataFrame) -> DataFrame:
    """PRJ-2: approvals still waiting for a person, newest first."""
    return (gates.where("status = 'pending'").select("id", "agent_id", "step_name", "reason", "created_at")
            .orderBy(F.desc("created_at")))


def _run_counts() -> list[Column]:
    done = F.count_if(F.col("status") == "completed")
    return [F.count("*").alias("total_runs"), done.alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.coalesce(share_pct_even(done, F.count("*"), 1), F.lit(0).cast("decimal(10,1)")).alias("success_rate")]


def run_summary(runs: DataFrame, gates: DataFrame) -> DataFrame:
    """AG-3: run counters, tokens and pending approvals; all zero when there are no runs."""
    pending = gates.where("status = 'pending'").agg(F.count("*").alias("pending_approvals"))
    s = runs.agg(*_run_counts(), F.coalesce(F.sum(tokens()), F.lit(0)).alias("total_tokens"))
    return s.withColumn("pending_approvals", F.when(F.col("total_runs") > 0, pending.scalar()).otherwise(0))


def portfolio_kpis(runs: DataFrame) -> DataFrame:
    """AG-4: run counters over all projects."""
    return runs.agg(*_run_counts())


def tokens_by_run(steps: DataFrame) -> DataFrame:
    """AG-30: tokens of a run as the sum over its steps; steps without usage add nothing."""
    kinds = ["prompt_tokens", "completion_tokens", "total_tokens"]
    return steps.groupBy("run_id").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds])


def client_summary(clients: DataFrame, projects: DataFrame) -> DataFrame:
    """JN-6: every client with its number of projects; counted before the join."""
    n = projects.groupBy(F.col("client_id").alias("id")).agg(F.count("*").alias("n"))
    return clients.join(n, "id", "left").select(
        "id", "slug", "name", "status", F.coalesce("n", F.lit(0)).alias("project_count"))


def phase_counts(projects: DataFrame) -> DataFrame:
    """AG-8: projects per phase; rows without a phase are left out."""
    return (projects.where(F.col("current_phase").isNotNull()).groupBy("current_phase")
            .agg(F.count("*").alias("projects")))


def projects_of(projects: DataFrame, client_id) -> DataFrame:
    """SRC-14: explicit columns, equality filter and order."""
    return (projects.select("id", "client_id", "name", "current_phase", "status", "owner")
            .where(F.col("client_id") == client_id).orderBy("name"))


def project_table(projects: DataFrame) -> DataFrame:
    """PRJ-5: the display columns that are present."""
    keep = ["name", "current_phase", "status", "owner", "client_id"]
    return projects.select(*[c for c in keep if c in projects.columns])


def checklist_verdict(items: DataFrame, run: str = "run_id") -> DataFrame:
    """VAL-8: verdict per run from (run, category, passed, notes) rows.

    Notes stay as rows of :func:`checklist_issues`, so that a run may have any number; here they are only counted.
    """
    failed = ~F.col("passed")
    critical = failed & F.col("category").isin("security", "error-handling")
    verdict = (F.when(F.bool_or(critical), "no-go").when(F.bool_or(failed), "needs-review").otherwise("go"))
    return items.groupBy(run).agg(verdict.alias("recommendation"), F.count_if(failed).alias("issues")).withColumn(
        "passed", F.col("recommendation") == "go")


def checklist_issues(items: DataFrame, run: str = "run_id") -> DataFrame:
    """VAL-8: notes of the failed items."""
    return items.where(~F.col("passed")).select(run, "notes")
