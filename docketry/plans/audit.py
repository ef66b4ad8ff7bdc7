"""Queries of audit and graph, with their SQL. Stand-ins: see docketry.plans.conditions; spans quote documents, suppliers are provisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import audit as A
from docketry.operators import graph as G
from docketry.plans.conditions import cte, given
from docketry.sources.tables import from_sql, table


def duplicate_ids(s, d):
    return A.duplicate_ids(table(s, d, "lineitem"), "l_orderkey")


def sequence_gaps(s, d):
    return A.sequence_gaps(table(s, d, "orders"), "o_custkey", 1000)


def dangling_refs(s, d):
    return A.dangling(table(s, d, "labels").select("doc_id", "toxic"), table(s, d, "documents").where("lang = 'en'"), "doc_id", "doc_id")


SPANS = """SELECT 'span.' || CAST(doc_id AS VARCHAR(20)) || '.' || CAST(k AS VARCHAR(2)) AS span_id, doc_id AS source_id, CAST(k * 7 AS INTEGER) AS start_offset, CAST(k * 7 + 5 AS INTEGER) AS end_offset,
  CASE WHEN (doc_id + k) % 9 = 0 THEN 'wrong' ELSE substr(text, CAST(k * 7 + 1 AS INTEGER), 5) END AS quote FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2)"""


def bad_spans(s, d):
    texts = table(s, d, "documents").where("source <> 'src7'").select(F.col("doc_id").alias("source_id"), "text")
    return A.bad_spans(from_sql(s, d, SPANS, "documents"), texts)


def full_text_spans(s, d):
    """Documents without a span over their whole text (of the stand-in spans, none is that long unless the text is short)."""
    spans = from_sql(s, d, SPANS, "documents").select(F.col("source_id").alias("doc_id"), "start_offset", "end_offset")
    docs = table(s, d, "documents").select("doc_id", F.length("text").alias("n"))
    whole = docs.join(spans, "doc_id").where("start_offset = 0 and end_offset >= n").select("doc_id")
    return docs.join(whole, "doc_id", "left_anti").select("doc_id")


def embedded_spans(s, d):
    """Rows of two registers that differ: labels against documents' own ids."""
    left = table(s, d, "labels").select("doc_id", "quality")
    right = table(s, d, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("quality"))
    return A.mismatched(left, right, "doc_id", ["quality"])


def differing_definitions(s, d):
    return A.differing_definitions(table(s, d, "part").select("p_size", "p_brand", "p_partkey"), "p_size", F.col("p_brand"), ["p_partkey"]).groupBy("p_size").agg(F.count("*").alias("n"))


def shared_predicates(s, d):
    return A.shared_values(table(s, d, "part").select("p_type", "p_size"), "p_type", "p_size")


def duplicate_texts(s, d):
    return A.duplicate_texts(table(s, d, "documents"), "doc_id", "text")


def band_coverage(s, d):
    bands = from_sql(s, d, "SELECT r_name AS band, r_regionkey * 10 + 1 AS first, r_regionkey * 10 + 10 AS last FROM {region}", "region")
    present = table(s, d, "part").select(F.col("p_size").alias("number"))
    used = table(s, d, "part").where("p_brand = 'Brand#12'").select(F.col("p_size").alias("number"))
    return A.band_coverage(present, used, bands)


def reused_children(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("child_id"))
    return A.reused_children(rows.union(table(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))))


def reconcile(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    a = docs.where("id % 3 <> 0")
    b = docs.where("id % 3 <> 1").select("id", F.when(F.col("id") % 5 == 0, F.substring("text", 1, 50)).when(F.col("id") % 7 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")).alias("text"))
    return A.reconcile(a, b)


def unresolved_refs(s, d):
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("refs"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("string"))).alias("known"))
    return A.unresolved(rows, "l_orderkey", "refs", "known")


def maturity_profile(s, d):
    """Counts, distinct ids and a histogram of a table: documents by source and language."""
    return table(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("text") == "").alias("empty"))


def readiness(s, d):
    """Cases with any assessment, evidence or decision; and the histogram of states."""
    return given(s, d, "assessments").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"), F.count_if(F.col("evidence").isNotNull()).alias("with_evidence"))


def issue_report(s, d):
    return A.report({"ids": duplicate_ids(s, d), "sequence": sequence_gaps(s, d), "references": dangling_refs(s, d), "spans": bad_spans(s, d), "texts": duplicate_texts(s, d), "documents": A.duplicate_ids(table(s, d, "documents"), "doc_id")})


def required_evidence(s, d):
    """Conditions without evidence: core ones are errors, those that are only diagnostic are listed apart."""
    kinds = given(s, d, "members").groupBy("condition_id").agg(F.bool_or(F.col("role") == "CORE").alias("core"))
    has = given(s, d, "assessments").where("evidence is not null and status = 'UNKNOWN' and condition_id % 4 < 2").select("condition_id").distinct()
    return kinds.join(has, "condition_id", "left_anti").select("condition_id", F.when(F.col("core"), "required").otherwise("diagnostic_only").alias("issue"))


def group_membership(s, d):
    """Conditions of a rule that stand in several groups, and rules without a core group."""
    m = given(s, d, "members")
    many = m.groupBy("rule_id", F.col("condition_id").cast("string").alias("condition_id")).agg(F.countDistinct("group_id").alias("n")).where("n > 1").select("rule_id", "condition_id", F.lit("several_groups").alias("issue"))
    none = m.groupBy("rule_id").agg(F.bool_or(F.col("role") == "CORE").alias("core")).where("not core").select("rule_id", F.lit(None).cast("string"), F.lit("no_core_group"))
    return many.union(none)


def nodes(s, d):
    return G.union([
        G.node_table("Rule", given(s, d, "members").select("rule_id").distinct(), "rule_id", ["rule_id"]),
        G.node_table("Group", given(s, d, "members").select("group_id", "operator", "role").distinct(), "group_id", ["operator", "role"]),
        G.node_table("Condition", given(s, d, "members").select("condition_id").distinct(), "condition_id", ["condition_id"]),
        G.node_table("Case", table(s, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"]),
        G.node_table("Provision", table(s, d, "supplier"), "s_suppkey", ["s_name"]),
    ])


def edges(s, d):
    m, lines = given(s, d, "members"), table(s, d, "lineitem")
    return G.union([
        G.edge_table("HAS_GROUP", m, ("Rule", "rule_id"), ("Group", "group_id")),
        G.edge_table("HAS_MEMBER", m, ("Group", "group_id"), ("Condition", "condition_id")),
        G.edge_table("ASSESSES", given(s, d, "assessments"), ("Case", "case_id"), ("Condition", "condition_id")),
        G.edge_table("CITES", lines, ("Case", "l_orderkey"), ("Provision", "l_suppkey")),
    ])


def graph_nodes(s, d):
    return nodes(s, d).select("key", "label", "object_id", "properties")


def graph_edges(s, d):
    return edges(s, d).select("source", "type", "target")


def graph_counts(s, d):
    return G.counts(G.collapse(nodes(s, d)), edges(s, d))


def node_conflicts(s, d):
    return G.node_conflicts(G.node_table("Condition", table(s, d, "part"), "p_size", ["p_brand"]))


def dangling_edges(s, d):
    kept = nodes(s, d).where("label <> 'Provision' or cast(object_id as int) % 3 <> 0")
    return G.dangling_edges(edges(s, d), kept).groupBy("end").agg(F.count("*").alias("n"))


def release(s, d):
    return G.release_id(nodes(s, d), edges(s, d))


def seeds(s, d):
    return given(s, d, "scope")


def neighbour_rules(s, d):
    return G.neighbour_rules(seeds(s, d), given(s, d, "members"))


def cases_by_condition(s, d):
    return G.cases_by_condition(given(s, d, "known").where("status = 'SATISFIED'").select("query_id", "condition_id"), given(s, d, "assessments").where("status <> 'UNKNOWN'"))


def cases_applying(s, d):
    return G.cases_applying(seeds(s, d), given(s, d, "links"))


BASED_ON = "SELECT DISTINCT p_brand AS rule_id, CAST(p_partkey % 50 + 1 AS BIGINT) AS provision_id FROM {part}"
CITES = "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS case_id, CAST(l_suppkey AS BIGINT) AS provision_id FROM {lineitem}"


def cases_citing(s, d):
    return G.cases_citing(seeds(s, d), from_sql(s, d, BASED_ON, "part"), from_sql(s, d, CITES, "lineitem"))


def bad_paths(s, d):
    m = given(s, d, "members")
    key = lambda label, c: F.concat_ws("|", F.lit(label), F.col(c).cast("string"))
    paths = m.select(F.concat_ws("/", "group_id", F.col("condition_id").cast("string")).alias("path_id"), F.array(key("Rule", "rule_id"), key("Group", "group_id"), F.when(F.col("condition_id") % 10 == 0, F.lit("Condition|0")).otherwise(key("Condition", "condition_id"))).alias("nodes"), F.when(F.col("condition_id") % 7 == 0, F.array(F.lit("HAS_GROUP"))).otherwise(F.array(F.lit("HAS_GROUP"), F.lit("HAS_MEMBER"))).alias("types"))
    return G.bad_paths(paths, edges(s, d)).groupBy("issue").agg(F.count("*").alias("n"))


def release_diff(s, d):
    now = G.counts(nodes(s, d), edges(s, d)).withColumn("release_id", F.lit("r1"))
    then = G.counts(nodes(s, d).where("label <> 'Case' or object_id < '5'"), edges(s, d)).withColumn("release_id", F.lit("r1"))
    return G.release_diff(then, now)


MEMBERS, EDGE = cte("members"), """edges AS (SELECT DISTINCT 'Rule|' || rule_id AS source, 'HAS_GROUP' AS type, 'Group|' || group_id AS target FROM members UNION SELECT 'Group|' || group_id, 'HAS_MEMBER', 'Condition|' || condition_id FROM members
  UNION SELECT 'Case|' || case_id, 'ASSESSES', 'Condition|' || condition_id FROM assessments UNION SELECT 'Case|' || l_orderkey, 'CITES', 'Provision|' || l_suppkey FROM lineitem)"""
NODE = """nodes AS (SELECT DISTINCT 'Rule|' || rule_id AS key, 'Rule' AS label, rule_id AS object_id, '{"rule_id":"' || rule_id || '"}' AS properties FROM members
  UNION ALL SELECT DISTINCT 'Group|' || group_id, 'Group', group_id, '{"operator":"' || operator || '","role":"' || role || '"}' FROM members UNION ALL SELECT DISTINCT 'Condition|' || condition_id, 'Condition', CAST(condition_id AS VARCHAR), '{"condition_id":' || condition_id || '}' FROM members
  UNION ALL SELECT 'Case|' || o_orderkey, 'Case', CAST(o_orderkey AS VARCHAR), '{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' FROM orders UNION ALL SELECT 'Provision|' || s_suppkey, 'Provision', CAST(s_suppkey AS VARCHAR), '{"s_name":"' || s_name || '"}' FROM supplier)"""
GRAPH = f"{cte('members', 'assessments')}, {EDGE}, {NODE}"
SPAN_SQL = SPANS.format(documents="documents")
DUP = "SELECT sha256(CAST({c} AS VARCHAR)) AS digest, count(*) AS n FROM {t} GROUP BY {c} HAVING count(*) > 1"
GAPS = """SELECT 'missing' AS issue, x AS number FROM (SELECT unnest(range(1, 1001)) AS x) WHERE x NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'unexpected', o_custkey FROM orders WHERE o_custkey NOT BETWEEN 1 AND 1000
  UNION ALL SELECT 'duplicate', o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1"""
DANGLING = "SELECT doc_id, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"
BAD = f"""SELECT s.source_id, span_id, CASE WHEN t.doc_id IS NULL THEN 'unknown_source' ELSE 'quote_mismatch' END AS issue FROM ({SPAN_SQL}) s LEFT JOIN (SELECT * FROM documents WHERE source <> 'src7') t ON t.doc_id = s.source_id
  WHERE t.doc_id IS NULL OR substr(t.text, start_offset + 1, end_offset - start_offset) <> quote"""
TEXTS = "SELECT sha256(k) AS digest, doc_id, count(*) OVER (PARTITION BY k) AS n FROM (SELECT DISTINCT regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') AS k, doc_id FROM documents WHERE text IS NOT NULL) QUALIFY n > 1"

QUERIES = {
    "duplicate_ids": (duplicate_ids, DUP.format(c="l_orderkey", t="lineitem")),
    "sequence_gaps": (sequence_gaps, GAPS),
    "dangling_refs": (dangling_refs, DANGLING),
    "bad_spans": (bad_spans, BAD),
    "full_text_spans": (full_text_spans, f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT source_id FROM ({SPAN_SQL}) s JOIN documents t ON t.doc_id = s.source_id WHERE start_offset = 0 AND end_offset >= length(t.text))"),
    "register_mismatch": (embedded_spans, "SELECT doc_id, CASE WHEN l.q IS NULL AND l.i IS NULL THEN 'unexpected' WHEN r.i IS NULL THEN 'missing' ELSE 'different' END AS issue FROM (SELECT doc_id, quality AS q, 1 AS i FROM labels) l FULL JOIN (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS q, 1 AS i FROM documents) r USING (doc_id) WHERE l.i IS NULL OR r.i IS NULL OR l.q IS DISTINCT FROM r.q"),
    "differing_definitions": (differing_definitions, "SELECT p_size, count(*) AS n FROM (SELECT p_size, p_brand, first_value(p_brand) OVER (PARTITION BY p_size ORDER BY p_partkey) AS f FROM part) WHERE p_brand <> f GROUP BY 1"),
    "shared_predicates": (shared_predicates, "SELECT sha256(p_type) AS digest, p_size, count(*) OVER (PARTITION BY p_type) AS n FROM (SELECT DISTINCT p_type, p_size FROM part) QUALIFY n > 1"),
    "duplicate_texts": (duplicate_texts, TEXTS),
    "band_coverage": (band_coverage, "SELECT r_name AS band, CAST(10 AS BIGINT) AS expected, (SELECT count(DISTINCT p_size) FROM part WHERE p_size BETWEEN r_regionkey * 10 + 1 AND r_regionkey * 10 + 10) AS present, (SELECT count(DISTINCT p_size) FROM part WHERE p_brand = 'Brand#12' AND p_size BETWEEN r_regionkey * 10 + 1 AND r_regionkey * 10 + 10) AS referenced FROM region"),
    "reused_children": (reused_children, "SELECT child_id, count(DISTINCT o) AS owners FROM (SELECT l_orderkey AS o, 'p' || l_partkey AS child_id FROM lineitem UNION ALL SELECT l_orderkey, 's' || l_suppkey FROM lineitem) GROUP BY 1 HAVING count(DISTINCT o) > 1"),
    "reconcile": (reconcile, """WITH t AS (SELECT doc_id AS id, regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') AS l, regexp_replace(CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 50) WHEN doc_id % 7 = 0 THEN 'x' || text ELSE text END, '[ \\t\\r\\n]+', '', 'g') AS r FROM documents),
      a AS (SELECT id, l FROM t WHERE id % 3 <> 0), b AS (SELECT id, r FROM t WHERE id % 3 <> 1), m AS (SELECT l, r FROM a FULL JOIN b USING (id))
      SELECT count(l) AS n_a, count(r) AS n_b, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS same_id, count(*) FILTER (WHERE l = r) AS same_text, count(*) FILTER (WHERE l <> r AND (starts_with(l, r) OR starts_with(r, l))) AS prefix_text,
      count(*) FILTER (WHERE l <> r AND NOT (starts_with(l, r) OR starts_with(r, l))) AS other_text, count(*) AS union_ids, (SELECT count(*) FROM a JOIN b ON a.l = b.r AND a.id <> b.id) AS text_under_other_id FROM m"""),
    "unresolved_refs": (unresolved_refs, "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS missing FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING bool_and(l_returnflag = 'R')) GROUP BY 1"),
    "corpus_profile": (maturity_profile, "SELECT source, lang, count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE text = '') AS empty FROM documents GROUP BY 1, 2"),
    "readiness": (readiness, f"WITH {cte('assessments')} SELECT status, count(*) AS n, count(DISTINCT case_id) AS cases, count(evidence) AS with_evidence FROM assessments GROUP BY 1"),
    "issue_report": (issue_report, f"SELECT 'ids' AS check, count(*) = 0 AS passed, count(*) AS n FROM ({DUP.format(c='l_orderkey', t='lineitem')}) UNION ALL SELECT 'sequence', count(*) = 0, count(*) FROM ({GAPS}) UNION ALL SELECT 'references', count(*) = 0, count(*) FROM ({DANGLING}) UNION ALL SELECT 'spans', count(*) = 0, count(*) FROM ({BAD}) UNION ALL SELECT 'texts', count(*) = 0, count(*) FROM ({TEXTS}) UNION ALL SELECT 'documents', count(*) = 0, count(*) FROM ({DUP.format(c='doc_id', t='documents')})"),
    "required_evidence": (required_evidence, f"WITH {cte('members', 'assessments')} SELECT condition_id, CASE WHEN bool_or(role = 'CORE') THEN 'required' ELSE 'diagnostic_only' END AS issue FROM members WHERE condition_id NOT IN (SELECT condition_id FROM assessments WHERE evidence IS NOT NULL AND status = 'UNKNOWN' AND condition_id % 4 < 2) GROUP BY 1"),
    "group_membership": (group_membership, f"WITH {MEMBERS} SELECT rule_id, CAST(condition_id AS VARCHAR) AS condition_id, 'several_groups' AS issue FROM members GROUP BY 1, condition_id HAVING count(DISTINCT group_id) > 1 UNION ALL SELECT rule_id, NULL, 'no_core_group' FROM members GROUP BY 1 HAVING NOT bool_or(role = 'CORE')"),
    "graph_nodes": (graph_nodes, f"WITH {GRAPH} SELECT * FROM nodes"),
    "graph_edges": (graph_edges, f"WITH {GRAPH} SELECT * FROM edges"),
    "graph_counts": (graph_counts, f"WITH {GRAPH} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2"),
    "node_conflicts": (node_conflicts, "SELECT 'Condition|' || p_size AS key, count(DISTINCT p_brand) AS payloads FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) > 1"),
    "dangling_edges": (dangling_edges, f"WITH {GRAPH}, k AS (SELECT key FROM nodes WHERE label <> 'Provision' OR CAST(object_id AS INTEGER) % 3 <> 0) SELECT 'source' AS end, count(*) AS n FROM edges WHERE source NOT IN (SELECT key FROM k) HAVING count(*) > 0 UNION ALL SELECT 'target', count(*) FROM edges WHERE target NOT IN (SELECT key FROM k) HAVING count(*) > 0".replace(" AS end", ' AS "end"')),
    "graph_release": (release, None),
    "neighbour_rules": (neighbour_rules, f"WITH {cte('members', 'scope')}, o AS (SELECT DISTINCT query_id, condition_id FROM scope JOIN members USING (rule_id)), n AS (SELECT o.query_id, m.rule_id, o.condition_id, m.group_id FROM o JOIN members m ON m.condition_id = o.condition_id WHERE (o.query_id, m.rule_id) NOT IN (SELECT query_id, rule_id FROM scope)) SELECT query_id, rule_id, condition_id, group_id FROM n QUALIFY row_number() OVER (PARTITION BY query_id, rule_id ORDER BY condition_id, group_id) = 1"),
    "cases_by_condition": (cases_by_condition, f"WITH {cte('known', 'assessments')} SELECT k.query_id, a.case_id, a.condition_id, a.status, coalesce(array_to_string(list_sort(list(DISTINCT evidence) FILTER (WHERE evidence IS NOT NULL)), ','), '') AS evidence FROM known k JOIN assessments a ON a.condition_id = k.condition_id WHERE k.status = 'SATISFIED' AND a.status <> 'UNKNOWN' GROUP BY 1, 2, 3, 4"),
    "cases_applying": (cases_applying, f"WITH {cte('scope', 'links')} SELECT query_id, case_id, min(rule_id) AS rule_id FROM scope JOIN links USING (rule_id) WHERE applied GROUP BY 1, 2"),
    "cases_citing": (cases_citing, f"WITH {cte('scope')}, b AS ({BASED_ON.format(part='part')}), c AS ({CITES.format(lineitem='lineitem')}) SELECT query_id, case_id, min(rule_id) AS rule_id, count(DISTINCT provision_id) AS provisions FROM scope JOIN b USING (rule_id) JOIN c USING (provision_id) GROUP BY 1, 2"),
    "bad_paths": (bad_paths, f"WITH {MEMBERS} SELECT 'shape' AS issue, count(*) AS n FROM members WHERE condition_id % 7 = 0 UNION ALL SELECT 'no_such_edge', count(*) FROM members WHERE condition_id % 7 <> 0 AND condition_id % 10 = 0"),
    "release_diff": (release_diff, f"WITH {GRAPH} SELECT 'r1' AS release_id, 'node' AS kind, 'Case' AS name, count(*) FILTER (WHERE object_id < '5') AS published, count(*) AS expected FROM nodes WHERE label = 'Case'"),
}
