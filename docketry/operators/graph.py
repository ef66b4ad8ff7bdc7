"""Projection of record tables to a property graph, its checks, releases and fixed paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.joins import bounded, dealt
from docketry.sources.tables import written


def digest(*cols: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in cols])), 256)


def canonical(columns: dict[str, Column]) -> Column:
    """JSON of named columns with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def node_table(label: str, df: DataFrame, ident: str, properties: list[str]) -> DataFrame:
    """(key, label, object_id, properties) of one kind of record."""
    made = df.select(F.lit(label).alias("label"), F.col(ident).cast("string").alias("object_id"), canonical({p: F.col(p) for p in properties}).alias("properties"))
    return made.select(F.concat_ws("|", "label", "object_id").alias("key"), "label", "object_id", "properties")


def edge_table(kind: str, df: DataFrame, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """(key, source, type, target) of one kind of edge; source and target are (label, column)."""
    ends = [F.concat_ws("|", F.lit(label), F.col(c).cast("string")) for label, c in (source, target)]
    plain = df.where(F.col(source[1]).isNotNull() & F.col(target[1]).isNotNull()).select(*dict.fromkeys((source[1], target[1]))).distinct()  # ids are shorter than names and digests
    made = plain.select(ends[0].alias("source"), F.lit(kind).alias("type"), ends[1].alias("target"))
    return made.select(digest(F.col("source"), F.col("type"), F.col("target")).alias("key"), "source", "type", "target")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Labels of nodes, with the flat table and the id column of each.
NODES = {
    "LegalSource": ("sources", "source_id"), "Provision": ("provisions", "provision_id"), "LegalRule": ("rules", "rule_id"), "RuleCondition": ("conditions", "condition_id"), "ConditionGroup": ("groups", "group_id"),
    "RuleException": ("exceptions", "exception_id"), "LegalConsequence": ("consequences", "consequence_id"), "Case": ("cases", "case_id"), "Claim": ("claims", "claim_id"), "CourtFinding": ("findings", "finding_id"),
    "ConditionFinding": ("assessments", "assessment_id"), "ReasoningStep": ("reasoning", "reasoning_id"), "DecisionItem": ("decisions", "decision_id"), "SourceSpan": ("spans", "span_id"),
}
#: Types of edges: the flat tables that state them, with the labels and columns of both ends.
EDGES = [
    ("BELONGS_TO", "provisions", ("Provision", "provision_id"), ("LegalSource", "source_id")), ("BASED_ON", "rule_provisions", ("LegalRule", "rule_id"), ("Provision", "provision_id")),
    ("HAS_CONDITION", "conditions", ("LegalRule", "rule_id"), ("RuleCondition", "condition_id")), ("HAS_GROUP", "groups", ("LegalRule", "rule_id"), ("ConditionGroup", "group_id")),
    ("HAS_MEMBER", "members", ("ConditionGroup", "group_id"), ("RuleCondition", "condition_id")), ("HAS_EXCEPTION", "exceptions", ("LegalRule", "rule_id"), ("RuleException", "exception_id")),
    ("HAS_CONSEQUENCE", "consequences", ("LegalRule", "rule_id"), ("LegalConsequence", "consequence_id")), ("CITES_PROVISION", "case_provisions", ("Case", "case_id"), ("Provision", "provision_id")),
    ("HAS_CLAIM", "claims", ("Case", "case_id"), ("Claim", "claim_id")), ("HAS_FINDING", "findings", ("Case", "case_id"), ("CourtFinding", "finding_id")), ("HAS_ASSESSMENT", "assessments", ("Case", "case_id"), ("ConditionFinding", "assessment_id")),
    ("HAS_REASONING", "reasoning", ("Case", "case_id"), ("ReasoningStep", "reasoning_id")), ("HAS_DECISION", "decisions", ("Case", "case_id"), ("DecisionItem", "decision_id")), ("INVOKES", "claim_rules", ("Claim", "claim_id"), ("LegalRule", "rule_id")),
    ("ABOUT", "assessments", ("ConditionFinding", "assessment_id"), ("RuleCondition", "condition_id")), ("APPLIES", "reasoning_rules", ("ReasoningStep", "reasoning_id"), ("LegalRule", "rule_id")),
    ("USES_FINDING", "reasoning_findings", ("ReasoningStep", "reasoning_id"), ("CourtFinding", "finding_id")), ("USES_FINDING", "assessment_findings", ("ConditionFinding", "assessment_id"), ("CourtFinding", "finding_id")),
    ("DECIDES", "decisions", ("DecisionItem", "decision_id"), ("Claim", "claim_id")),
]


def project(tables: dict[str, DataFrame], evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all flat record tables that are given; equal nodes are one, the columns of a table are its nodes' properties.

    evidence (label, object_id, span_id): spans that an object is EVIDENCED_BY. Lists are side tables here, as explode_rules makes them.
    """
    made = [node_table(label, tables[name].distinct(), ident, sorted(set(tables[name].columns))) for label, (name, ident) in NODES.items() if name in tables]
    found = [edge_table(kind, tables[name], source, target) for kind, name, source, target in EDGES if name in tables]
    if evidence is not None:
        plain = evidence.select("label", "object_id", "span_id").distinct()
        ends = plain.select(F.concat_ws("|", "label", F.col("object_id").cast("string")).alias("source"), F.lit("EVIDENCED_BY").alias("type"), F.concat_ws("|", F.lit("SourceSpan"), F.col("span_id").cast("string")).alias("target"))
        found.append(ends.select(digest(F.col("source"), F.col("type"), F.col("target")).alias("key"), "source", "type", "target"))
    # A label has one table, and a type one for each pair of labels: what is distinct there is so among all.
    return union(made), union(found)


def lost_ends(tables: dict[str, DataFrame], evidence: DataFrame | None = None) -> DataFrame:
    """(type, n): ends of project's edges that are no node, by plain ids and a kind at a time; as counts of dangling_edges by type.

    An end that is the id of its own table's nodes is one of them and is not looked up.
    """
    held = {}

    def nodes(label: str) -> DataFrame | None:
        if label not in held:
            name, ident = NODES[label]
            held[label] = bounded(tables[name].select(F.col(ident).alias("node")).distinct()) if name in tables else None
        return held[label]

    def lost(edges: DataFrame, kind: str, label: str, end: str) -> DataFrame:
        known = nodes(label) if label in NODES else None
        if known is not None:
            same = known.schema["node"].dataType == edges.schema[end].dataType
            edges = edges.join(known, F.col(end) == F.col("node") if same else F.col(end).cast("string") == F.col("node").cast("string"), "left_anti")
        return edges.distinct().select(F.lit(kind).alias("type"))

    parts = []
    for kind, name, source, target in EDGES:
        if name in tables:
            edges = tables[name].select(F.col(source[1]).alias("source_end"), F.col(target[1]).alias("target_end")).where("source_end is not null and target_end is not null")
            parts += [lost(edges, kind, label, end) for (label, c), end in ((source, "source_end"), (target, "target_end")) if NODES[label] != (name, c)]
    if evidence is not None:
        edges = evidence.select("label", F.col("object_id").alias("source_end"), F.col("span_id").alias("target_end"))
        parts += [lost(edges.where(F.col("label") == x.label), "EVIDENCED_BY", x.label, "source_end") for x in edges.select("label").distinct().collect()]
        parts.append(lost(edges, "EVIDENCED_BY", "SourceSpan", "target_end"))
    return union(parts).groupBy("type").agg(F.count("*").alias("n"))


def node_conflicts(nodes: DataFrame) -> DataFrame:
    """Keys with several payloads."""
    return nodes.groupBy("key").agg(F.countDistinct("properties").alias("payloads")).where("payloads > 1")


def collapse(nodes: DataFrame) -> DataFrame:
    return nodes.dropDuplicates(["key", "properties"])


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    keys = nodes.select("key").distinct()
    no_source = edges.join(keys.withColumnRenamed("key", "source"), "source", "left_anti").select("key", F.lit("source").alias("end"))
    no_target = edges.join(keys.withColumnRenamed("key", "target"), "target", "left_anti").select("key", F.lit("target").alias("end"))
    return no_source.union(no_target)


def release_id(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a digest of all nodes and edges that depends on no order or partitioning.

    Row digests are summed per leading byte, and the 256 sums of each table are hashed together.
    """
    rows = nodes.select(digest(F.lit("n"), F.col("key"), F.col("properties")).alias("h")).union(edges.select(digest(F.lit("e"), F.col("key")).alias("h")))
    part = F.sum(F.conv(F.substring("h", 3, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy(F.substring("h", 1, 2).alias("b")).agg(part.alias("s"), F.count("*").alias("n"))
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", F.col("s").cast("string"), F.col("n").cast("string")))), ","), 256).alias("release_id"), F.sum("n").alias("rows"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n) of nodes by label and edges by type."""
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge"), "type").agg(F.count("*")))


def neighbour_rules(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """seeds (query_id, rule_id) -> other rules that share a grouped condition: (query_id, rule_id, first path)."""
    own = written(seeds.join(members.select("rule_id", "condition_id").distinct(), "rule_id").select("query_id", "condition_id").distinct())
    firsts = members.groupBy("rule_id", "condition_id").agg(F.min(F.struct("group_id")).alias("g")).select("rule_id", "condition_id", "g.group_id")  # of a rule's groups with a condition the first alone can be on the first path
    near = dealt(own, ["query_id"], 20_000).join(bounded(firsts), "condition_id").groupBy("query_id", "rule_id").agg(F.min(F.struct("condition_id", "group_id")).alias("p"))
    return near.join(seeds, ["query_id", "rule_id"], "left_anti").select("query_id", "rule_id", "p.condition_id", "p.group_id")


def cases_by_condition(seeds: DataFrame, assessments: DataFrame) -> DataFrame:
    """seeds (query_id, condition_id) -> (query_id, case_id, condition_id, status, evidence ids joined)."""
    met = seeds.join(assessments, "condition_id")
    return met.groupBy("query_id", "case_id", "condition_id", "status").agg(F.array_join(F.transform(F.array_sort(F.collect_set("evidence")), lambda x: x.cast("string")), ",").alias("evidence"))


def cases_applying(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """seeds (query_id, rule_id), links (case_id, rule_id, applied) -> cases that apply a seed rule."""
    return seeds.join(links.where("applied"), "rule_id").groupBy("query_id", "case_id").agg(F.min("rule_id").alias("rule_id"))


def cases_citing(seeds: DataFrame, based_on: DataFrame, cites: DataFrame) -> DataFrame:
    """Cases that cite a provision of a seed rule; the smallest such rule is named."""
    provisions = seeds.join(based_on, "rule_id").groupBy("query_id", "provision_id").agg(F.min("rule_id").alias("rule_id"))
    return provisions.join(cites.distinct(), "provision_id").groupBy("query_id", "case_id").agg(F.min("rule_id").alias("rule_id"), F.countDistinct("provision_id").alias("provisions"))


def bad_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """paths (path_id, nodes, types): those of wrong shape or with a hop that is no edge."""
    shape = (F.size("nodes") == F.size("types") + 1) & (F.size("types") > 0)
    wrong = paths.where(~F.coalesce(shape, F.lit(False))).select("path_id", F.lit("shape").alias("issue"))
    hops = paths.where(shape).select("path_id", F.explode(F.expr("transform(types, (t, i) -> struct(nodes[i] as source, t as type, nodes[i + 1] as target))")).alias("h")).select("path_id", "h.*")
    missing = hops.join(edges.select("source", "type", "target"), ["source", "type", "target"], "left_anti").select("path_id", F.lit("no_such_edge")).distinct()
    return wrong.union(missing)


def release_diff(published: DataFrame, expected: DataFrame) -> DataFrame:
    """(release_id, kind, name, published, expected) where counts differ."""
    by = ["release_id", "kind", "name"]
    met = published.withColumnRenamed("n", "published").join(expected.withColumnRenamed("n", "expected"), by, "full_outer").na.fill(0, ["published", "expected"])
    return met.where("published <> expected")
