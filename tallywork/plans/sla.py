"""Approval timing, stage funnel and backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ratios import hours_between, mean, share_pct
from .quality import recent



def _timed(invoices: DataFrame, approvals: DataFrame) -> DataFrame:
    """JN-8: invoices with each of their approvals; an invoice without one keeps a row."""
    a = approvals.select("invoice_id", "decided_at")
    return (invoices.select("id", "created_at").join(a, F.col("id") == F.col("invoice_id"), "left")
            .withColumn("hours", hours_between(F.col("decided_at"), F.col("created_at"))))


def approval_hours(invoices: DataFrame, approvals: DataFrame, days: int, as_of: Column) -> DataFrame:
    """JN-8 as rows."""
    return _timed(recent(invoices, "created_at", days, as_of), approvals).select(
        F.col("id").alias("invoice_id"), "hours")


def sla_card(invoices: DataFrame, approvals: DataFrame, queue: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-20: one row; the 24-hour share is over all joined rows, as is the total."""
    n = F.count("*")
    card = _timed(recent(invoices, "created_at", days, as_of), approvals).agg(
        mean(F.sum("hours"), F.count("hours"), 1).alias("avg_approval_hours"),
        F.round(n.cast("decimal(20,0)") / F.nullif(F.lit(days), F.lit(0)).cast("decimal(10,0)"), 1).alias("daily_throughput"),
        share_pct(F.count_if(F.col("hours") <= 24), n, 1).alias("sla_24h_pct"),
        n.alias("total_processed"))
    backlog = queue.where("status = 'pending' AND priority = 1").agg(F.count("*").alias("critical_backlog"))
    return card.withColumn("critical_backlog", backlog.scalar())


def funnel(invoices: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-21: how many invoices reached each stage."""
    def at(s):
        return F.count_if(F.col("approval_status") == s).alias(s)
    return recent(invoices, "created_at", days, as_of).agg(
        F.count("*").alias("uploaded"), F.count("llm_confidence").alias("extracted"),
        F.count_if("review_required").alias("review"), at("approved"), at("edited"), at("rejected"), at("pending"))


def throughput(invoices: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-22: invoices per creation day, oldest first."""
    return (recent(invoices, "created_at", days, as_of).groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count("*").alias("count")).orderBy("day"))


def approvers(approvals: DataFrame, invoices: DataFrame, staff: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-23, JN-9: decisions and mean hours per staff member, busiest first.

    Summed per staff id before names are joined.
    """
    i = invoices.select(F.col("id").alias("invoice_id"), "created_at")
    per = (recent(approvals, "decided_at", days, as_of).join(i, "invoice_id")
           .withColumn("hours", hours_between(F.col("decided_at"), F.col("created_at")))
           .groupBy("decided_by").agg(F.count("id").alias("count"), F.sum("hours").alias("h"),
                                      F.count("hours").alias("n")))
    return (per.join(staff.select(F.col("id").alias("decided_by"), F.col("full_name").alias("name")), "decided_by")
            .select(F.col("decided_by").alias("staff_id"), "name", "count",
                    mean(F.col("h"), F.col("n"), 1).alias("avg_hours"))
            .orderBy(F.desc("count"), "staff_id"))


def critical_backlog(queue: DataFrame, as_of: Column) -> DataFrame:
    """LIM-3: pending priority-1 items, oldest first, with hours waited."""
    return (queue.where("status = 'pending' AND priority = 1")
            .select("invoice_id", "reason_code", "created_at",
                    F.round(hours_between(as_of, F.col("created_at")), 1).alias("hours_waiting"))
            .orderBy("created_at"))


def sla_document(invoices: DataFrame, approvals: DataFrame, queue: DataFrame, staff: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-24 as one nested row: ``kpis``, ``funnel``, ``throughput_by_day`` and ``approvers``.

    The two lists hold at most a day each of the window and a member of the staff each.  Backlog items, of which there
    may be any number, stay rows: :func:`critical_backlog`.
    """
    one = lambda df, name: df.select(F.struct("*").alias(name))
    daily = throughput(invoices, days, as_of).agg(F.array_sort(F.collect_list(F.struct("day", "count"))).alias("throughput_by_day"))
    people = approvers(approvals, invoices, staff, days, as_of).select((-F.col("count")).alias("order"), "staff_id", "name", "count", "avg_hours")
    people = people.agg(F.transform(F.array_sort(F.collect_list(F.struct("*"))), lambda p: F.struct(p["staff_id"].alias("staff_id"), p["name"].alias("name"), p["count"].alias("count"), p["avg_hours"].alias("avg_hours"))).alias("approvers"))
    out = one(sla_card(invoices, approvals, queue, days, as_of), "kpis")
    for part in (one(funnel(invoices, days, as_of), "funnel"), daily, people):   # a row each
        out = out.withColumn(part.columns[0], part.scalar())
    return out


def sla_bundle(invoices: DataFrame, approvals: DataFrame, queue: DataFrame, staff: DataFrame,
               days: int, as_of: Column) -> DataFrame:
    """AG-24: the five parts as rows ``(section, position key, body)`` with a JSON body.

    A row per entry keeps the backlog distributed; a reader that wants one
    document concatenates the rows of a section in key order.
    """
    def part(df: DataFrame, section: str, key: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("sort_key"),
                         F.to_json(F.struct("*")).alias("body"))
    parts = [
        part(sla_card(invoices, approvals, queue, days, as_of), "kpis", F.lit("")),
        part(funnel(invoices, days, as_of), "funnel", F.lit("")),
        part(throughput(invoices, days, as_of), "throughput_by_day", F.col("day")),
        part(approvers(approvals, invoices, staff, days, as_of), "approvers",
             F.lpad((F.lit(10 ** 12) - F.col("count")).cast("string"), 13, "0")),
        part(critical_backlog(queue, as_of), "critical_backlog_items", F.col("created_at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
