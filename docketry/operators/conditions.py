"""Three-valued conditions, comparison of users and cases on shared conditions, roles, and where cases disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators.joins import bounded, dealt
from docketry.sources.tables import written

YES, NO, CONFLICT, UNKNOWN = "SATISFIED", "NOT_SATISFIED", "CONFLICTING", "UNKNOWN"
ROLES = ("support", "limiting", "boundary")
#: Owners' states are dealt so that about so many rows of (owner, group, state) are made in a task.
GROUP_ROWS = 2_000_000


def truth(operator: Column, n: Column, n_yes: Column, n_no: Column) -> Column:
    """Truth of a group of n members: null if undecided, and for an empty group."""
    every = F.when(n_no > 0, False).when(n_yes == n, True)
    some = F.when(n_yes > 0, True).when(n_no == n, False)
    return F.when(n > 0, F.when(operator == "ALL", every).otherwise(some))


def group_truth(members: DataFrame, states: DataFrame, owner: str) -> DataFrame:
    """members (group_id, operator, condition_id), states (owner, condition_id, status) -> (owner, group_id, value) where a member has a state."""
    sizes = members.groupBy("group_id", "operator").agg(F.countDistinct("condition_id").alias("n"))
    own = states.join(members.select("group_id", "condition_id").distinct(), "condition_id")
    counted = own.groupBy(owner, "group_id").agg(F.count_if(F.col("status") == YES).alias("n_yes"), F.count_if(F.col("status") == NO).alias("n_no"))
    return counted.join(sizes, "group_id").select(owner, "group_id", truth(F.col("operator"), F.col("n"), F.col("n_yes"), F.col("n_no")).alias("value"))


def group_truth_at_scale(members: DataFrame, states: DataFrame, owner: str) -> DataFrame:
    """group_truth for many owners: a state is in as many groups as hold its condition, so that owners' states are dealt once and their groups counted where they lie.

    Groups go by numbers until the end. states should be a table, as it is counted.
    """
    codes = written(members.select("group_id").where("group_id is not null").distinct().withColumn("code", F.monotonically_increasing_id()))
    sizes = written(members.groupBy("group_id", "operator").agg(F.countDistinct("condition_id").alias("n")).join(codes, "group_id"))
    held = written(members.select("group_id", "condition_id").distinct().join(codes, "group_id").select("condition_id", "code"))
    met = held.count() / max(1, held.select("condition_id").distinct().count())
    own = dealt(states.select(owner, "condition_id", F.when(F.col("status") == YES, 1).when(F.col("status") == NO, -1).otherwise(0).cast("byte").alias("s")), [owner], int(GROUP_ROWS / max(1, met)))
    counted = own.join(bounded(held), "condition_id").groupBy(owner, "code").agg(F.count_if(F.col("s") > 0).alias("n_yes"), F.count_if(F.col("s") < 0).alias("n_no"))
    return counted.join(bounded(sizes), "code").select(owner, "group_id", truth(F.col("operator"), F.col("n"), F.col("n_yes"), F.col("n_no")).alias("value"))


def summarize(assessments: DataFrame) -> DataFrame:
    """(case_id, condition_id, status, evidence) -> one state per case and condition.

    Only assessments with evidence count, each piece once. Yes and no, or any conflict, make a conflict;
    other mixtures are unknown and not usable.
    """
    usable = assessments.where("evidence is not null").repartition("case_id", "condition_id").dropDuplicates(["case_id", "condition_id", "status", "evidence"])
    kinds = usable.groupBy("case_id", "condition_id").agg(F.collect_set("status").alias("kinds"), F.count_if(F.col("status") == YES).alias("support"), F.count_if(F.col("status") == NO).alias("oppose"))
    has = lambda s: F.array_contains("kinds", s)
    status = F.when(has(CONFLICT) | (has(YES) & has(NO)), CONFLICT).when(F.size("kinds") == 1, F.element_at("kinds", 1)).otherwise(UNKNOWN)
    return kinds.select("case_id", "condition_id", status.alias("status"), "support", "oppose").withColumn("usable", F.col("status").isin(YES, NO, CONFLICT))


def scoped(scope: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, condition_id, core, diagnostic) of the conditions of each query's rules."""
    return scope.join(members, "rule_id").groupBy("query_id", "condition_id").agg(F.bool_or(F.col("role") == "CORE").alias("core"), F.bool_or(F.col("role") == "DIAGNOSTIC").alias("diagnostic"))


def compatible_rules(scope: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """Rules of each query without a false core group."""
    core = members.where("role = 'CORE'")
    false = group_truth(core, known, "query_id").where("not value").join(core.select("group_id", "rule_id").distinct(), "group_id")
    return scope.join(false.select("query_id", "rule_id").distinct(), ["query_id", "rule_id"], "left_anti")


def compare(pairs: DataFrame, scope: DataFrame, members: DataFrame, known: DataFrame, summaries: DataFrame) -> DataFrame:
    """(query_id, case_id, same, different, unknown, coverage, core_agree, core_conflict) of each pair."""
    allowed = scoped(scope, members).select("query_id", "condition_id")
    sizes = allowed.groupBy("query_id").agg(F.count("*").alias("n"))
    user = allowed.join(known, ["query_id", "condition_id"]).where(F.col("status").isin(YES, NO)).withColumnRenamed("status", "user")
    states = written(pairs.join(summaries.where("usable").select("case_id", "condition_id", "status"), "case_id"))
    met = states.where(F.col("status").isin(YES, NO)).join(bounded(user), ["query_id", "condition_id"])
    counted = met.groupBy("query_id", "case_id").agg(F.count_if(F.col("user") == F.col("status")).alias("same"), F.count_if(F.col("user") != F.col("status")).alias("different"))

    # Only groups that are in a query's scope and that the user decides are looked up for its cases.
    core = members.where("role = 'CORE'")
    decided = group_truth(core, known, "query_id").where("value is not null").withColumnRenamed("value", "user")
    decided = decided.join(core.select("group_id", "rule_id").distinct(), "group_id").join(scope, ["query_id", "rule_id"])
    sides = decided.join(core.groupBy("group_id", "operator").agg(F.countDistinct("condition_id").alias("of"), F.collect_set("condition_id").alias("conditions")), "group_id")
    sides = sides.select("query_id", "rule_id", "group_id", "operator", "of", "user", F.explode("conditions").alias("condition_id"))
    asked = states.join(bounded(sides), ["query_id", "condition_id"])
    asked = asked.groupBy("query_id", "case_id", "rule_id", "group_id", "operator", "of", "user").agg(F.count_if(F.col("status") == YES).alias("n_yes"), F.count_if(F.col("status") == NO).alias("n_no"))
    groups = asked.withColumn("value", truth(F.col("operator"), F.col("of"), F.col("n_yes"), F.col("n_no")))
    groups = groups.groupBy("query_id", "case_id").agg(F.count_if(F.col("user") & F.col("value")).alias("core_agree"), F.count_if(F.col("user") != F.col("value")).alias("core_conflict"))

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = pairs.join(bounded(sizes), "query_id", "left").join(counted, ["query_id", "case_id"], "left").join(groups, ["query_id", "case_id"], "left")
    out = out.select("query_id", "case_id", zero("n"), zero("same"), zero("different"), zero("core_agree"), zero("core_conflict"))
    sure = F.col("same") + F.col("different")
    return out.withColumn("unknown", F.col("n") - sure).withColumn("coverage", F.when(F.col("n") > 0, F.round(sure / F.col("n"), 6)).otherwise(0.0)).drop("n")


def assign_roles(compared: DataFrame, scope: DataFrame, members: DataFrame, known: DataFrame, assessments: DataFrame, links: DataFrame, claims: DataFrame, user_claims: DataFrame) -> DataFrame:
    """Adds role and reason to compared pairs.

    links (case_id, rule_id, applied), claims (case_id, claim_type, rejected), user_claims (query_id, claim_type).
    """
    compared = written(compared)
    pairs = compared.select("query_id", "case_id")
    roles = bounded(scoped(scope, members))
    rows = pairs.join(assessments, "case_id").join(roles, ["query_id", "condition_id"], "left").join(bounded(known.withColumnRenamed("status", "user")), ["query_id", "condition_id"], "left")
    core, diagnostic = F.coalesce("core", F.lit(False)), F.coalesce("diagnostic", F.lit(False))
    evidence, sure_user = F.col("evidence").isNotNull(), F.coalesce(F.col("user").isin(YES, NO), F.lit(False))
    sure = F.col("status").isin(YES, NO)
    open_diff = sure & ~sure_user & diagnostic & (F.col("status") == NO) & evidence
    both = sure & sure_user & evidence
    differs = both & (F.col("user") != F.col("status"))
    flags = rows.groupBy("query_id", "case_id").agg(
        F.bool_or(evidence).alias("has_evidence"),
        F.bool_or(open_diff | (differs & diagnostic & ~core)).alias("diagnostic_diff"),
        F.bool_or(open_diff | (both & ((F.col("user") == F.col("status")) | core | diagnostic))).alias("spans"),
    )
    linked = pairs.join(links, "case_id").join(bounded(scope), ["query_id", "rule_id"]).groupBy("query_id", "case_id").agg(F.lit(True).alias("linked"), F.bool_or("applied").alias("applied"))
    mine = bounded(user_claims.withColumn("mine", F.lit(True)))
    asked = bounded(user_claims.groupBy("query_id").agg(F.lit(True).alias("has_claims")))
    claimed = pairs.join(claims, "case_id").join(mine, ["query_id", "claim_type"], "left").join(asked, "query_id", "left")
    own = F.coalesce("mine", ~F.coalesce("has_claims", F.lit(False)))
    claimed = claimed.groupBy("query_id", "case_id").agg(F.bool_or(own).alias("aligned"), F.bool_or(own & F.col("rejected")).alias("rejected"))
    x = compared.join(flags, ["query_id", "case_id"], "left").join(linked, ["query_id", "case_id"], "left").join(claimed, ["query_id", "case_id"], "left").join(asked, "query_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    aligned = F.coalesce("aligned", ~flag("has_claims"))
    related, agree, conflict = flag("linked") | aligned, F.col("core_agree") > 0, F.col("core_conflict") > 0
    role = (
        F.when(F.col("has_evidence").isNull(), None)
        .when(agree & conflict & related & flag("spans"), "boundary")
        .when(flag("linked") & aligned & agree & ~conflict & flag("applied") & ~flag("rejected") & flag("spans"), "support")
        .when(conflict & related & flag("spans"), "limiting")
        .when(flag("diagnostic_diff") & related, "boundary")
    )
    reason = F.when(F.col("has_evidence").isNull(), "NO_ASSESSMENT").when(~flag("has_evidence"), "INSUFFICIENT_EVIDENCE").when(~flag("linked"), "NO_REASONING_LINK").when(~aligned, "TARGET_MISMATCH").otherwise("INSUFFICIENT_EVIDENCE")
    out = x.withColumn("role", role)
    return out.select(*compared.columns, "role", F.when(F.col("role").isNull(), reason).alias("reason"))


def pool(rows: DataFrame, cap: int = 20) -> DataFrame:
    """Of rows (query_id, case_id, role, coverage, score) the `cap` of each query: roles in turn, then the undetermined by score."""
    order = F.lit(len(ROLES))
    for i, r in enumerate(ROLES):
        order = F.when(F.col("role") == r, i).otherwise(order)
    best = [F.desc("coverage"), F.desc("score"), F.asc("case_id")]
    turn = F.row_number().over(Window.partitionBy("query_id", "role").orderBy(*best))
    late = F.row_number().over(Window.partitionBy("query_id", "role").orderBy(F.desc("score"), F.asc("case_id")))
    rows = rows.withColumn("order", order).withColumn("turn", F.when(F.col("role").isNull(), late).otherwise(turn))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("role").isNull(), "turn", "order", "case_id")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= cap).drop("order", "turn")


def per_role(pooled: DataFrame, k: int = 3) -> DataFrame:
    """The k best of each role in a query's pool."""
    w = Window.partitionBy("query_id", "role").orderBy(F.desc("coverage"), F.desc("score"), F.asc("case_id"))
    return pooled.where("role is not null").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def status_counts(pairs: DataFrame, conditions: DataFrame, summaries: DataFrame) -> DataFrame:
    """(query_id, condition_id, n_yes, n_no, n_conflict, n_unknown): states of each query's cases on each of its conditions."""
    pairs = written(pairs)
    cases = pairs.groupBy("query_id").agg(F.count("*").alias("n"))
    met = pairs.join(summaries.where("usable"), "case_id").groupBy("query_id", "condition_id").agg(*(F.count_if(F.col("status") == s).alias(c) for s, c in ((YES, "n_yes"), (NO, "n_no"), (CONFLICT, "n_conflict"))))
    out = conditions.join(cases, "query_id").join(met, ["query_id", "condition_id"], "left").na.fill(0, ["n_yes", "n_no", "n_conflict"])
    return out.withColumn("n_unknown", F.col("n") - F.col("n_yes") - F.col("n_no") - F.col("n_conflict")).drop("n")


def disagreement(counts: DataFrame) -> DataFrame:
    """Adds entropy, disagreement, unknown_rate, heuristic, discriminativeness, availability and each query's rank."""
    parts = [F.col(c).cast("double") for c in ("n_yes", "n_no", "n_conflict")]
    known = parts[0] + parts[1] + parts[2]
    term = lambda x: F.when(x > 0, -x / known * F.log2(x / known)).otherwise(0.0)
    entropy = F.when(known > 0, term(parts[0]) + term(parts[1]) + term(parts[2])).otherwise(0.0)
    pairs, same = known * (known - 1) / 2, sum((x * (x - 1) / 2 for x in parts[1:]), parts[0] * (parts[0] - 1) / 2)
    total = known + F.col("n_unknown")
    out = counts.withColumn("entropy", F.round(entropy, 6)).withColumn("disagreement", F.round(F.when(known >= 2, (pairs - same) / pairs).otherwise(0.0), 6))
    out = out.withColumn("unknown_rate", F.round(F.col("n_unknown") / F.greatest(total, F.lit(1.0)), 6))
    out = out.withColumn("heuristic", F.round(F.col("entropy") * (1 - F.col("unknown_rate")), 6)).withColumn("discriminativeness", F.round(F.least(F.lit(1.0), F.col("entropy") / 2 * (1 - F.col("unknown_rate"))), 6))
    out = out.withColumn("availability", F.when(known == 0, "NO_EVIDENCE").when(known == 1, "SINGLE_CASE").otherwise("DESCRIPTIVE_COMPARISON"))
    w = Window.partitionBy("query_id").orderBy(F.desc("entropy"), F.desc("disagreement"), F.asc("condition_id"))
    return out.withColumn("rank", F.row_number().over(w).cast("long"))
