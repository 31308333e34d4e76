"""Deletion plans: one member of each group is kept, the others are to go.

A plan is a table ``(path, action, source, group_id, size)`` with action ``keep`` or
``delete``. It is a bag: a file in an exact and a near group appears twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.ordering import keeper
from twinsift.skew import with_aggregates
from twinsift.staging import stage_counted


def with_keeper(members: DataFrame, strategy: str | None = None, mtime: str = "mtime") -> DataFrame:
    """Members with their group's ``keeper`` path.

    Without a ``strategy`` members that carry a keeper retain it, and others get the oldest. A
    strategy that is asked for decides anew, whatever the members carry.
    """
    if "keeper" in members.columns and strategy is None:
        return members
    strategy = strategy or "oldest"
    members, total = stage_counted(members.drop("keeper"), "members")
    facts = {"keeper": keeper(members, strategy, mtime)}
    found = with_aggregates(members, ["group_id"], facts, total).drop("_rows")
    return found.withColumn("keeper", F.col("keeper.path"))


def plan_group_members(
    members: DataFrame, source: str, strategy: str | None = None, mtime: str = "mtime"
) -> DataFrame:
    """Plan for one kind of group: the keeper is kept, the rest deleted."""
    action = F.when(F.col("path") == F.col("keeper"), "keep").otherwise("delete")
    return with_keeper(members, strategy, mtime).select(
        "path", action.alias("action"), F.lit(source).alias("source"), "group_id", "size"
    )


def make_plan(
    exact: DataFrame,
    near: DataFrame | None = None,
    strategy: str | None = None,
    mtime: str = "mtime",
    resolve: bool = False,
) -> DataFrame:
    """Plan over exact and, if given, near groups.

    With ``resolve`` each path has one action and a delete in either kind wins.
    """
    plan = plan_group_members(exact, "exact", strategy, mtime)
    if near is not None:
        plan = plan.unionByName(plan_group_members(near, "near", strategy, mtime))
    return resolve_plan(plan) if resolve else plan


def resolve_plan(plan: DataFrame) -> DataFrame:
    """One row per path: the delete if there is one, from the exact group before the near one."""
    first = F.min(F.struct("action", "source", "group_id", "size"))
    return plan.groupBy("path").agg(first.alias("p")).select(
        "path", "p.action", "p.source", "p.group_id", "p.size"
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    """One row: entries to delete and to keep, and bytes to reclaim, counted as a bag."""
    deletes = F.col("action") == "delete"
    return plan.agg(
        F.count_if(deletes).alias("n_delete"),
        F.count_if(F.col("action") == "keep").alias("n_keep"),
        F.coalesce(F.sum(F.when(deletes, F.col("size"))), F.lit(0)).cast("bigint").alias("reclaim_bytes"),
    )


def dry_run(
    exact: DataFrame, near: DataFrame | None = None, strategy: str | None = None, mtime: str = "mtime"
) -> DataFrame:
    """The totals of the plan; changes nothing."""
    return plan_totals(make_plan(exact, near, strategy, mtime))


def initial_selection(plan: DataFrame) -> DataFrame:
    """``(path)``: the distinct paths that any part of the plan deletes."""
    return plan.where("action = 'delete'").select("path").distinct()


def selected_totals(selection: DataFrame, exact: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """One row: distinct selected paths, and their bytes once per group that contains them."""
    memberships = exact.select("path", "size")
    if near is not None:
        memberships = memberships.unionByName(near.select("path", "size"))
    chosen = selection.select("path").distinct().withColumn("_selected", F.lit(1))
    # One pass: the selected paths that are in no group still count as selected.
    both = chosen.join(memberships, "path", "left")
    return both.agg(
        F.count_distinct("path").alias("n_selected"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("selected_bytes"),
    )
