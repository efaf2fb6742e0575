"""Submissions and review decisions as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.edges import is_directed, normalize_edges
from kinweave.operators.ranking import cap_per_group, first_per_key

EVIDENCE_LENGTH = 500
NOTE_MARK = "｜审核备注: "
KEY = ["_a", "_b", "type"]


def _keyed(edges: DataFrame) -> DataFrame:
    """Ends as given for directed types, sorted for the others."""
    directed = is_directed(F.col("type"))
    return edges.withColumns({
        "_a": F.when(directed, F.col("source_id")).otherwise(F.least("source_id", "target_id")),
        "_b": F.when(directed, F.col("target_id")).otherwise(F.greatest("source_id", "target_id")),
    })


def intake(submissions: DataFrame, existing: DataFrame) -> DataFrame:
    """Submitted edges that are new, as pending edges.

    ``submissions`` has source_id, target_id, type, evidence, contributor and submitted_at. Unknown
    types go; of repeated submissions the first stays. A known edge of an undirected type blocks
    both directions.
    """
    normal = _keyed(normalize_edges(submissions))
    firsts = first_per_key(normal, KEY, ["submitted_at", "contributor", "evidence", "source_id"])
    # Only the known edges that share a key with a submission matter; the few keys reach all tasks.
    known = _keyed(existing.select("source_id", "target_id", "type")).select(*KEY)
    known = known.join(firsts.select(*KEY), KEY, "left_semi").distinct()
    given = F.nullif("evidence", F.lit(""))
    return firsts.join(known, KEY, "left_anti").select(
        "source_id", "target_id", "type", is_directed(F.col("type")).alias("directed"),
        F.lit("medium").alias("confidence"),
        F.coalesce(given, F.concat(F.lit("用户 "), "contributor", F.lit(" 提交"))).alias("evidence"),
        F.lit("user").alias("origin"), F.lit("pending").alias("status"), "submitted_at",
    )


def _seq(decisions: DataFrame) -> Column:
    return F.col("seq") if "seq" in decisions.columns else F.lit(0)


def _turning_points(decisions: DataFrame) -> DataFrame:
    """Per edge the first approval and the first rejection.

    They settle any sequence of decisions: a rejection always holds, and an approval counts only on
    a pending edge, so only before the first rejection.
    """
    seq = _seq(decisions)
    return decisions.groupBy("id").agg(
        F.min(F.when(F.col("action") == "approve", seq)).alias("_approved_at"),
        F.min(F.when(F.col("action") == "reject", seq)).alias("_rejected_at"),
    )


def _approval_counts() -> Column:
    in_time = F.col("_rejected_at").isNull() | (F.col("_approved_at") < F.col("_rejected_at"))
    return F.coalesce((F.col("status") == "pending") & F.col("_approved_at").isNotNull() & in_time, F.lit(False))


def decision_outcomes(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """What became of each decision: approved, rejected or skipped."""
    state = edges.select("id", "status").join(_turning_points(decisions), "id")
    seq = _seq(decisions)
    # Of approvals with the same place, one counts.
    first = F.row_number().over(Window.partitionBy("id", "action").orderBy(seq, *sorted(decisions.columns))) == 1
    decisions = decisions.withColumn("_first", first)
    approves = (F.col("action") == "approve") & F.coalesce(_approval_counts(), F.lit(False)) & F.col("_first")
    rejects = (F.col("action") == "reject") & F.col("status").isNotNull()
    outcome = F.when(approves, "approved").when(rejects, "rejected").otherwise("skipped")
    return decisions.join(state, "id", "left").select(*(c for c in decisions.columns if c != "_first"), outcome.alias("outcome"))


def decision_counts(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    return decision_outcomes(edges, decisions).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def apply_decisions(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges after all decisions; approved edges become verified, notes join the evidence."""
    joined = edges.join(_turning_points(decisions), "id", "left")
    approved = _approval_counts()
    changed = {
        "confidence": F.when(approved, "verified").otherwise(F.col("confidence")),
        "status": F.when(F.col("_rejected_at").isNotNull(), "rejected").when(approved, "approved")
        .otherwise(F.col("status")),
    }
    if "note" in decisions.columns:
        joined = joined.join(_notes(edges, decisions), "id", "left")
        noted = F.substring(F.concat("evidence", "_notes"), 1, EVIDENCE_LENGTH)
        changed["evidence"] = F.when(F.col("_notes").isNotNull(), noted).otherwise(F.col("evidence"))
    return joined.withColumns(changed).select(*edges.columns)


def _notes(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Notes of the decisions that held, joined in order.

    The evidence is cut to a fixed length, which so many notes fill for sure; later ones cannot show.
    """
    held = decision_outcomes(edges, decisions).filter(
        (F.col("outcome") != "skipped") & F.nullif("note", F.lit("")).isNotNull())
    seq = _seq(decisions)
    enough = EVIDENCE_LENGTH // (len(NOTE_MARK) + 1) + 1
    first = cap_per_group(held.select("id", seq.alias("_seq"), "note"), ["id"], ["_seq", "note"], enough)
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_seq", "note"))).alias("_all")).select(
        "id", F.concat(F.lit(NOTE_MARK), F.array_join("_all.note", NOTE_MARK)).alias("_notes"))


def approve_confident(edges: DataFrame) -> DataFrame:
    """Decisions that approve every pending edge of high confidence."""
    ready = edges.filter((F.col("status") == "pending") & (F.col("confidence") == "high"))
    return ready.select("id", F.lit("approve").alias("action"))
