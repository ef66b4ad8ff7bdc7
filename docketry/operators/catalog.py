"""Catalogs over nested rules and cases: side tables, search texts, coverage, scopes, routing decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Lists of nested rules and the names of their side tables.
NESTED = {"conditions": "conditions", "condition_groups": "groups", "provisions": "provisions", "exceptions": "exceptions", "consequences": "consequences", "source_spans": "spans"}


def explode_rules(rules: DataFrame) -> dict[str, DataFrame]:
    """Side tables of nested rules (rule_id and any of the lists of NESTED): a row for each element with rule_id, pos and the element's fields; of groups also `members`, a row for each member."""
    out = {}
    for field, name in NESTED.items():
        if field in rules.columns:
            out[name] = rules.select("rule_id", F.posexplode(field).alias("pos", "x")).select("rule_id", "pos", "x.*")
    if "groups" in out:
        held = out["groups"]
        out["members"] = held.select("rule_id", "group_id", "role", "operator", F.posexplode("member_condition_ids").alias("pos", "condition_id"))
        out["groups"] = held.drop("member_condition_ids")
    return out


def first_definitions(conditions: DataFrame) -> DataFrame:
    """One row per condition id: its first definition by (rule order, place)."""
    w = Window.partitionBy("condition_id").orderBy("rule_id", "pos")
    return conditions.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def condition_owners(members: DataFrame) -> DataFrame:
    """condition_id -> its distinct rules, sorted and joined."""
    return members.groupBy("condition_id").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))


def role_lists(members: DataFrame) -> DataFrame:
    """rule_id -> distinct core and diagnostic condition ids in order."""
    pick = lambda role: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("condition_id")))), lambda x: x.cast("string")), ",")
    return members.groupBy("rule_id").agg(pick("CORE").alias("core"), pick("DIAGNOSTIC").alias("diagnostic"))


def search_text(rows: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """(ident, text): non-empty fields joined by line feeds. Fields of results and facts are left to the caller to withhold."""
    return rows.select(ident, F.concat_ws("\n", *[F.nullif(F.trim(f), F.lit("")) for f in fields]).alias("text"))


def index_version(texts: DataFrame, ident: str, *parts: str) -> DataFrame:
    """One row: a digest of release, model and all search texts, of the same value in any order."""
    row = F.sha2(F.concat_ws("|", F.col(ident).cast("string"), "text"), 256)
    sums = texts.select(F.substring(row, 1, 2).alias("b"), F.conv(F.substring(row, 3, 15), 16, 10).cast("decimal(38,0)").alias("v")).groupBy("b").agg(F.sum("v").alias("v"))
    return sums.agg(F.sha2(F.concat_ws("|", *map(F.lit, parts), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", F.col("v").cast("string")))), ",")), 256).alias("version"))


def union_evidence(owners: DataFrame) -> DataFrame:
    """owners (entity_id, definition, spans) -> (entity_id, definitions, spans): spans united over owners; several definitions are an error."""
    return owners.groupBy("entity_id").agg(F.countDistinct("definition").alias("definitions"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))), ",").alias("spans"))


def selector_coverage(referenced: DataFrame, selectors: DataFrame, last: int) -> DataFrame:
    """(issue, n): numbers 1..last neither referenced nor skipped, only skipped, or both. Selectors: n, a-b, n-def, n-ref."""
    text = F.regexp_replace("selector", "-(def|ref)$", "")
    first, second = F.regexp_extract(text, r"^(\d+)", 1).cast("long"), F.regexp_extract(text, r"^\d+-(\d+)$", 1)
    upper = F.when(second != "", second.cast("long")).otherwise(first)
    skipped = selectors.select(F.explode(F.sequence(first, upper)).alias("number")).distinct().withColumn("skipped", F.lit(True))
    every = referenced.sparkSession.range(1, last + 1).select(F.col("id").alias("number"))
    met = every.join(referenced.select("number").distinct().withColumn("used", F.lit(True)), "number", "left").join(skipped, "number", "left")
    issue = F.when(F.col("used").isNull() & F.col("skipped").isNull(), "uncovered").when(F.col("used").isNull(), "skip_only").when(F.col("skipped"), "both").otherwise("referenced")
    return met.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def scope_issues(scope: DataFrame, rules: DataFrame) -> DataFrame:
    """scope (session_id, rule_id, usage): rules in several usages, and unknown rules."""
    several = scope.groupBy("session_id", "rule_id").agg(F.countDistinct("usage").alias("n")).where("n > 1").select("session_id", "rule_id", F.lit("several_usages").alias("issue"))
    return several.union(scope.join(rules.select("rule_id").distinct(), "rule_id", "left_anti").select("session_id", "rule_id", F.lit("unknown_rule")))


def route(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Routing decisions applied to candidates (query_id, rule_id, score): unknown or repeated ids drop, missing ones are uncertain background.

    Order: usage, relevance, score descending. EXCLUDED ones go.
    """
    w = Window.partitionBy("query_id", "rule_id").orderBy("pos")
    first = decisions.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("query_id", "rule_id", "relevance", "usage")
    met = candidates.join(first, ["query_id", "rule_id"], "left").na.fill({"relevance": "UNCERTAIN", "usage": "BACKGROUND"})
    usage = F.when((F.col("relevance") == "IRRELEVANT") & (F.col("usage") != "EXCLUDED"), "EXCLUDED").otherwise(F.col("usage"))
    kept = met.withColumn("usage", usage).where("usage <> 'EXCLUDED'")
    order = [F.array_position(F.array(*map(F.lit, names)), F.col(c)) for c, names in (("usage", ("ACTIVE", "ALTERNATIVE", "BACKGROUND")), ("relevance", ("RELEVANT", "UNCERTAIN")))]
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, F.desc("score"), F.asc("rule_id"))).cast("long"))
