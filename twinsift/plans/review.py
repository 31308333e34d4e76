"""Review decisions given as a table ``(group_id, action[, attempt])``.

``a`` accepts the suggested keeper, ``s`` skips the group, ``kN`` keeps member N (1-based, by
path bytes). Answers are tried in order of ``attempt`` until one is valid; a group without a
valid answer is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.exact import rank_members
from twinsift.skew import join_groups
from twinsift.staging import stage, stage_counted

# Messages for answers that are not understood.
BAD_FORMAT = "Invalid input format."
BAD_INDEX = "Invalid file index: "
#: Member numbers are unsigned 64-bit: a negative one wraps around.
WRAP = "18446744073709551616"


def parse_answers(decisions: DataFrame) -> DataFrame:
    """Adds ``kind`` (accept, skip, keep, empty or bad) and ``keep_index`` (DECIMAL) to the answers."""
    answer = F.regexp_replace("action", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    # The number may follow white space and a sign, and anything may follow the number.
    number = r"^k\s*([+-]?)0*(\d+)"
    sign = F.regexp_extract(answer, number, 1)
    digits = F.regexp_extract(answer, number, 2)
    size = F.when(F.length(digits) <= 20, F.expr("try_cast(_digits as decimal(38,0))"))
    wrap = F.expr(f"cast('{WRAP}' as decimal(38,0))")
    in_range = (F.col("_size") < wrap) & F.col("_size").isNotNull()
    index = F.when((F.col("_sign") == "-") & (F.col("_size") > 0), wrap - F.col("_size")).otherwise(F.col("_size"))
    return (
        decisions.withColumn("_answer", F.coalesce(answer, F.lit("")))
        .withColumn("_sign", sign)
        .withColumn("_digits", digits)
        .withColumn("_size", size)
        .withColumn(
            "kind",
            F.when(F.col("_answer") == "", "empty")
            .when(F.col("_answer") == "s", "skip")
            .when(F.col("_answer") == "a", "accept")
            .when(F.col("_digits") == "", "bad")
            .when(in_range, "keep")
            .otherwise("bad"),
        )
        .withColumn("keep_index", F.when(F.col("kind") == "keep", index).cast("decimal(38,0)"))
        .drop("_answer", "_sign", "_digits", "_size")
    )


def judge_answers(members: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(settled, invalid)``: per group its first valid answer, and the answers refused before it.

    ``settled`` has ``group_id, kind, keep_index``; ``invalid`` has ``group_id, action, reason``.
    Answers for groups that do not exist are dropped.
    """
    if "attempt" not in decisions.columns:
        decisions = decisions.withColumn("attempt", F.lit(1))
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n_members"))
    answers = parse_answers(decisions).join(sizes, "group_id")
    known = (F.col("keep_index") >= 1) & (F.col("keep_index") <= F.col("n_members"))
    answers = stage(
        answers.withColumn(
            "reason",
            F.when(F.col("kind") == "bad", BAD_FORMAT).when(
                (F.col("kind") == "keep") & ~known, F.concat(F.lit(BAD_INDEX), F.col("keep_index").cast("string"))
            ),
        ),
        "answers",
    )
    valid = answers.where("reason is null and kind <> 'empty'")
    first = F.min(F.struct("attempt", "kind", "keep_index"))
    settled = valid.groupBy("group_id").agg(first.alias("f")).select(
        "group_id", F.col("f.attempt").alias("at"), "f.kind", "f.keep_index"
    )
    refused = answers.where("reason is not null").join(settled.select("group_id", "at"), "group_id", "left")
    invalid = refused.where("at is null or attempt < at").select("group_id", "action", "reason")
    return settled.drop("at"), invalid


def apply_decisions(members: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(plan, invalid)`` from members that carry their suggested ``keeper``.

    Members are numbered only in groups where an answer names a number.
    """
    members, total = stage_counted(members, "members")
    settled, invalid = judge_answers(members, decisions)
    settled = stage(settled.where("kind <> 'skip'"), "settled")
    named = settled.where("kind = 'keep'")
    n_members = members.groupBy("group_id").agg(F.count("*").alias("_n"))
    asked = join_groups(
        members, n_members.join(named.select("group_id", "keep_index"), "group_id"), ["group_id"], "_n", total
    ).drop("_n")
    picked = (
        rank_members(asked, total)
        .where("member_rank = keep_index")
        .select("group_id", F.col("path").alias("_named"))
    )
    chosen = (
        n_members.join(settled, "group_id")
        .join(picked, "group_id", "left")
        .select("group_id", "_n", "_named")
    )
    keep = F.col("path") == F.coalesce("_named", "keeper")
    plan = join_groups(members, chosen, ["group_id"], "_n", total).select(
        "path", F.when(keep, "keep").otherwise("delete").alias("action"),
        F.lit("review").alias("source"), "group_id", "size",
    )
    return plan, invalid
