"""Frozen samples, and the runs of experiments on them: summaries, reviewed scores, costs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freeze(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(sample_id, outcome) of candidates (sample_id, input_sha256) under review decisions (sample_id, decision, input_sha256), one to one.

    frozen if it was approved as it is now; hash_changed if the decision was on another input; pending; rejected for any other decision; no_decision or
    no_candidate where one side lacks the sample; several_decisions where the review has more than one.
    """
    one = decisions.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("decision").alias("decision"), F.min("input_sha256").alias("reviewed"))
    met = candidates.select("sample_id", "input_sha256", F.lit(True).alias("known")).join(one, "sample_id", "full_outer")
    outcome = (
        F.when(F.col("n").isNull(), "no_decision").when(F.col("known").isNull(), "no_candidate").when(F.col("n") > 1, "several_decisions").when(~F.col("reviewed").eqNullSafe(F.col("input_sha256")), "hash_changed")
        .when(F.col("decision") == "PENDING", "pending").when(F.col("decision") == "APPROVED", "frozen").otherwise("rejected")
    )
    return met.select("sample_id", outcome.alias("outcome"))


def run_summaries(runs: DataFrame) -> DataFrame:
    """runs (variant, category, expected, actual) -> (variant, mean_of_categories, errors, n): the mean of categories' accuracies, so that none outweighs another."""
    by = runs.groupBy("variant", "category").agg(F.avg((F.col("expected") == F.col("actual")).cast("double")).alias("ok"), F.count_if(F.col("actual") == "ERROR").alias("errors"), F.count("*").alias("n"))
    return by.groupBy("variant").agg(F.round(F.avg("ok"), 6).alias("mean_of_categories"), F.sum("errors").alias("errors"), F.sum("n").alias("n"))


def review_scores(runs: DataFrame) -> DataFrame:
    """runs (variant, expected, actual, target_hit, repeats) -> accuracy over all rows of a variant and expectation; how often questions hit their target and are new, null where none was asked."""
    ask = F.col("actual") == "ASK"
    out = runs.groupBy("variant", "expected").agg(F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("actual")).alias("right"), F.count_if(ask).alias("asks"), F.count_if(ask & F.col("target_hit") & (F.col("expected") == "ASK")).alias("hits"), F.count_if(ask & ~F.col("repeats")).alias("fresh"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return out.select("variant", "expected", rate("right", "n").alias("accuracy"), rate("hits", "asks").alias("target_rate"), rate("fresh", "asks").alias("fresh_rate"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """runs (variant, calls, seconds, actual) -> mean calls and seconds and the number of errors of each variant."""
    return runs.groupBy("variant").agg(F.round(F.avg("calls"), 6).alias("calls"), F.round(F.avg("seconds"), 4).alias("seconds"), F.count_if(F.col("actual") == "ERROR").alias("errors"))


def run_log(turns: DataFrame, ends: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, last_role, turns, asked, stop_reason, known_states): how each session of turns (session_id, turn, role) went.

    ends (session_id, stop_reason); a session without one is still RUNNING. states (session_id, condition_id, status): those that are not UNKNOWN are known.
    """
    out = turns.groupBy("session_id").agg(F.max_by("role", "turn").alias("last_role"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"))
    known = states.where("status <> 'UNKNOWN'").groupBy("session_id").agg(F.countDistinct("condition_id").alias("known"))
    reasons = ends.groupBy("session_id").agg(F.min("stop_reason").alias("reason"))
    met = out.join(reasons, "session_id", "left").join(known, "session_id", "left")
    return met.select("session_id", "last_role", "turns", "asked", F.coalesce("reason", F.lit("RUNNING")).alias("stop_reason"), F.coalesce("known", F.lit(0)).cast("long").alias("known_states"))
