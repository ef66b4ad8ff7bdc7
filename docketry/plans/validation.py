"""Queries of validators, drafts, run scoring and record building, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import graph as G
from docketry.operators import validation as V
from docketry.operators.catalog import explode_rules
from docketry.operators.retrieval import peer_counts
from docketry.sources.tables import from_sql, table

PROVISIONS = "SELECT CASE WHEN s_suppkey % 11 = 3 THEN 'x' ELSE CAST(s_nationkey AS VARCHAR(9)) || '.article_' || lpad(CAST(s_suppkey AS VARCHAR(9)), CAST(greatest(length(CAST(s_suppkey AS VARCHAR(9))), 4) AS INTEGER), '0') END AS provision_id, CAST(s_nationkey AS VARCHAR(9)) AS source_id, CASE WHEN s_suppkey % 13 = 5 THEN 'n' ELSE '' END || CAST(s_suppkey AS VARCHAR(9)) AS article_no, CASE WHEN s_suppkey % 7 = 2 THEN '  ' ELSE s_name END AS text, s_suppkey FROM {supplier}"
SOURCES = "SELECT CAST(n_nationkey AS VARCHAR(9)) AS source_id FROM {nation} WHERE n_nationkey % 5 <> 1"
TEXTS = "SELECT doc_id AS case_id, CASE WHEN doc_id % 9 = 4 THEN '　' ELSE text END AS facts, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS reasoning FROM {documents}"


def record_issues(s, d):
    return V.record_issues(from_sql(s, d, PROVISIONS, "supplier"), from_sql(s, d, SOURCES, "nation"), from_sql(s, d, TEXTS, "documents")).groupBy("kind", "id", "issue").agg(F.count("*").alias("n"))


def premise_warnings(s, d):
    rows = table(s, d, "part").select(F.col("p_brand").alias("rule_id"), F.col("p_size").alias("condition_id"), F.when(F.col("p_size") % 3 == 0, "CORE").otherwise("DIAGNOSTIC").alias("role"), F.array(F.col("p_partkey").cast("string")).alias("span_ids"))
    spans = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("span_id"), F.when(F.col("p_partkey") % 5 == 0, "当事人另有约定的除外").when(F.col("p_partkey") % 5 == 1, "须经批准").otherwise("应当履行").alias("quote"))
    return V.premise_warnings(rows, spans)


LIGHT = "SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 31 = 0 THEN ' 　' WHEN o_orderkey % 17 = 0 THEN 'same  text' WHEN o_orderkey % 17 = 1 THEN 'sametext' ELSE CAST(o_orderkey AS VARCHAR(20)) END AS facts, o_orderkey % 5 = 0 AS twice FROM {orders} UNION ALL SELECT o_orderkey, 'again ' || CAST(o_orderkey AS VARCHAR(20)), FALSE FROM {orders} WHERE o_orderkey % 97 = 1"
DEEP = "SELECT o_orderkey + CASE WHEN o_orderkey % 101 = 0 THEN 1000000000 ELSE 0 END AS case_id, CASE WHEN o_orderkey % 4 = 0 THEN 'L2' ELSE 'L1' END AS maturity, o_orderkey % 3 = 0 AS reviewed, o_orderkey % 23 AS finding, o_orderkey % 7 = 0 AS verified, o_orderkey % 29 AS rule_id, o_orderkey % 6 AS claim_type, o_orderkey % 37 AS provision_id FROM {orders}"


def case_set_issues(s, d):
    light = from_sql(s, d, LIGHT, "orders").select("case_id", "facts", F.when(F.col("twice"), F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("keywords"))
    deep = from_sql(s, d, DEEP, "orders")
    n = table(s, d, "nation")
    return V.case_set_issues(
        light, deep.select("case_id", "maturity", "reviewed"), deep.select("case_id", "provision_id"), deep.select("case_id", F.col("finding").alias("condition_id"), "verified"), deep.select("case_id", "rule_id", "claim_type"),
        n.select(F.col("n_nationkey").cast("long").alias("provision_id")), n.where("n_nationkey < 22").select(F.col("n_nationkey").cast("long").alias("condition_id")), n.select(F.col("n_nationkey").cast("long").alias("rule_id"), F.when(F.col("n_nationkey") == 3, F.lit(2).cast("long")).alias("claim_type")),
    )


CASE_SET = f"""WITH l AS ({LIGHT.format(orders='orders')}), b AS (SELECT case_id, regexp_replace(facts, '[ 　]+', '', 'g') AS k, twice FROM l), d AS ({DEEP.format(orders='orders')}), x AS (
  SELECT case_id, 'duplicate_id' AS issue FROM l GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT case_id, 'empty_facts' FROM b WHERE k = '' UNION ALL SELECT case_id, 'duplicate_keywords' FROM b WHERE twice
  UNION ALL SELECT case_id, 'duplicate_facts' FROM (SELECT case_id, k, min(case_id) OVER (PARTITION BY k) AS o FROM b WHERE k <> '') WHERE case_id <> o
  UNION ALL SELECT case_id, 'missing_provision' FROM d WHERE provision_id NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT case_id, 'not_in_index' FROM d WHERE case_id NOT IN (SELECT case_id FROM l)
  UNION ALL SELECT case_id, 'unreviewed_not_l1' FROM d WHERE NOT reviewed AND maturity <> 'L1' UNION ALL SELECT case_id, 'reviewed_not_l2' FROM d WHERE reviewed AND maturity <> 'L2'
  UNION ALL SELECT case_id, 'unknown_condition' FROM d WHERE finding >= 22 UNION ALL SELECT case_id, 'machine_marked_verified' FROM d WHERE verified AND NOT reviewed
  UNION ALL SELECT case_id, 'unknown_rule' FROM d WHERE rule_id NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT case_id, 'claim_type_mismatch' FROM d WHERE rule_id = 3 AND claim_type <> 2)
SELECT case_id, issue, count(*) AS n FROM x GROUP BY 1, 2"""

CONDITIONS = "SELECT DISTINCT p_brand AS rule_id, p_size AS condition_id FROM {part} UNION ALL SELECT 'Brand#11', 999 UNION ALL SELECT 'Brand#11', 999"
MEMBERS = "SELECT DISTINCT p_brand AS rule_id, p_brand || CAST(p_size % 4 AS VARCHAR(1)) AS group_id, CASE WHEN p_size % 4 = 1 AND p_brand <> 'Brand#12' THEN 'CORE' ELSE 'DIAGNOSTIC' END AS role, p_size + CASE WHEN p_size = 7 THEN 500 ELSE 0 END AS condition_id FROM {part} UNION ALL SELECT DISTINCT p_brand, p_brand || 'x', 'DIAGNOSTIC', p_size FROM {part} WHERE p_size = 9 UNION ALL SELECT p_brand, p_brand || '2', 'DIAGNOSTIC', 10 FROM {part} WHERE p_size = 10"
SPANS = "SELECT p_brand AS rule_id, p_partkey AS span_id, p_size AS article_no, 2 AS first, 45 AS last FROM {part} WHERE p_brand <> 'Brand#13'"


def rule_set_issues(s, d):
    rules = table(s, d, "part").select(F.col("p_brand").alias("rule_id"), F.lit("L3").alias("maturity"), F.when(F.col("p_brand") == "Brand#14", 0).otherwise(1).alias("n_consequences"), F.lit(1).alias("n_provisions")).distinct()
    return V.rule_set_issues(from_sql(s, d, CONDITIONS, "part"), from_sql(s, d, MEMBERS, "part"), rules, from_sql(s, d, SPANS, "part"))


RULE_SET = f"""WITH c AS ({CONDITIONS.format(part='part')}), m AS ({MEMBERS.format(part='part')}), o AS (SELECT rule_id, condition_id, count(*) AS k FROM c GROUP BY 1, 2), h AS (SELECT rule_id, group_id, condition_id, count(*) AS k FROM m GROUP BY 1, 2, 3),
g AS (SELECT rule_id, condition_id, count(*) AS k FROM h GROUP BY 1, 2), x AS (SELECT rule_id, 'duplicate_condition' AS issue FROM o WHERE k > 1 UNION ALL SELECT rule_id, 'repeated_member' FROM h WHERE k > 1
  UNION ALL SELECT rule_id, 'unassigned_condition' FROM o WHERE (rule_id, condition_id) NOT IN (SELECT rule_id, condition_id FROM g) UNION ALL SELECT rule_id, 'unknown_member' FROM g WHERE (rule_id, condition_id) NOT IN (SELECT rule_id, condition_id FROM o)
  UNION ALL SELECT rule_id, 'several_groups' FROM g JOIN o USING (rule_id, condition_id) WHERE g.k > 1 UNION ALL SELECT DISTINCT rule_id, 'no_core_group' FROM o WHERE rule_id NOT IN (SELECT rule_id FROM m WHERE role = 'CORE')
  UNION ALL SELECT DISTINCT p_brand, 'incomplete_l3' FROM part WHERE p_brand IN ('Brand#13', 'Brand#14') UNION ALL SELECT p_brand, 'outside_book' FROM part WHERE p_brand <> 'Brand#13' AND p_size NOT BETWEEN 2 AND 45)
SELECT rule_id, issue, count(*) AS n FROM x GROUP BY 1, 2"""

SAMPLES = "SELECT CASE WHEN doc_id % 19 = 2 THEN 'X' ELSE '' END || '00000000-0000-4000-8000-' || lpad(CAST(doc_id - CASE WHEN doc_id % 23 = 5 THEN 1 ELSE 0 END AS VARCHAR(12)), 12, '0') AS id, text, doc_id % 8 AS kind FROM {documents}"


def samples(s, d):
    none = F.array().cast("array<struct<subject:string,object:string,content:string>>")
    one = F.array(F.struct(F.lit("甲").alias("subject"), F.when(F.col("kind") < 4, F.concat(F.lit("标的"), F.col("kind").cast("string"))).alias("object"), F.when(F.col("kind") < 2, "内容").alias("content")))
    return from_sql(s, d, SAMPLES, "documents").withColumn("relations", F.create_map(F.when(F.col("kind") == 3, "买卖").otherwise("服务"), F.when(F.col("kind") == 6, none).otherwise(one), F.lit("借款"), one))


def sample_issues(s, d):
    return V.sample_issues(samples(s, d)).groupBy("id", "issue").agg(F.count("*").alias("n"))


SAMPLE_SET = f"""WITH s AS (SELECT *, regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', '', 'g') AS k FROM ({SAMPLES.format(documents='documents')})), x AS (SELECT id, 'bad_uuid' AS issue FROM s WHERE id LIKE 'X%' UNION ALL SELECT id, 'empty_text' FROM s WHERE k = '' UNION ALL SELECT id, 'empty_arguments' FROM s WHERE kind = 6
  UNION ALL SELECT id, 'duplicate_id' FROM s GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'duplicate_text' FROM (SELECT id, min(id) OVER (PARTITION BY k) AS o FROM s WHERE k <> '') WHERE id <> o) SELECT id, issue, count(*) AS n FROM x GROUP BY 1, 2"""


def converted_samples(s, d):
    return V.converted_samples(samples(s, d), "服务", {"服务": "服务合同纠纷"}).select("case_id", "cause", F.array_join("keywords", ",").alias("keywords"), F.sha2("summary", 256).alias("summary"))


def corpus_counts(s, d):
    docs = table(s, d, "documents")
    raw = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), "source")).when(F.col("doc_id") % 5 == 1, F.lit("  ")).otherwise(F.col("source")).alias("label")).where("label is not null")
    clean = raw.select("id", F.trim("label").alias("label")).where("label <> ''")
    return V.corpus_counts(docs.select(F.col("doc_id").alias("id")), raw, table(s, d, "labels").select(F.col("doc_id").alias("id")), peer_counts(clean))


CORPUS = """WITH r AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN ' ' || source WHEN 1 THEN '  ' ELSE source END AS label FROM documents WHERE doc_id % 5 = 1 OR source IS NOT NULL), c AS (SELECT id, trim(label) AS label FROM r WHERE trim(label) <> ''),
p AS (SELECT id, count(*) OVER (PARTITION BY label) - 1 AS k FROM c) SELECT 'cases' AS name, count(*) AS n FROM documents UNION ALL SELECT 'known_overlap', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unlabeled', (SELECT count(*) FROM documents) - count(*) FROM c
UNION ALL SELECT 'labeled_without_peer', count(*) FROM p WHERE k = 0 UNION ALL SELECT 'evaluable', count(*) FROM p WHERE k > 0 UNION ALL SELECT 'directed_pairs', CAST(coalesce(sum(k), 0) AS BIGINT) FROM p UNION ALL SELECT 'raw_labels', count(DISTINCT label) FROM r UNION ALL SELECT 'labels', count(DISTINCT label) FROM c"""


def frozen_issues(s, d):
    o = table(s, d, "orders")
    gold = ["expected_action", "acceptable_missing_facts", "forbidden_reasks", "unable_or_declined_topics", "review_status"]
    rows = o.select((F.col("o_orderkey") - F.when(F.col("o_orderkey") % 50 == 3, 1).otherwise(0)).alias("sample_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderkey") % 40 == 1, "r0").otherwise("r1").alias("release_id"),
                    F.when(F.col("o_orderkey") % 30 == 2, "MAYBE").otherwise("ASK").alias("expected"), F.when(F.col("o_orderkey") % 60 == 4, F.array(*map(F.lit, gold[1:]))).otherwise(F.array(*map(F.lit, gold))).alias("gold_fields"))
    refs = o.select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 2 == 0, "rule").otherwise("case").alias("kind"), (F.col("o_orderkey") % 27).alias("id"))
    n = table(s, d, "nation").select(F.explode(F.array(F.lit("rule"), F.lit("case"))).alias("kind"), F.col("n_nationkey").cast("long").alias("id"))
    return V.frozen_issues(rows, refs, n, "r1", {"1-URGENT": 5, "6-NONE": 5})


FROZEN = """WITH s AS (SELECT o_orderkey - CASE WHEN o_orderkey % 50 = 3 THEN 1 ELSE 0 END AS sample_id, o_orderkey AS k, o_orderpriority AS category FROM orders), x AS (SELECT sample_id, 'duplicate_sample' AS issue FROM s GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT sample_id, 'other_release' FROM s WHERE k % 40 = 1
  UNION ALL SELECT sample_id, 'bad_action' FROM s WHERE k % 30 = 2 UNION ALL SELECT sample_id, 'missing_gold_field' FROM s WHERE k % 60 = 4 UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 'unknown_rule' ELSE 'unknown_case' END FROM s WHERE k % 27 > 24)
SELECT sample_id, issue, count(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT NULL, 'category_' || category, n FROM (SELECT category, count(*) AS n FROM s GROUP BY 1) WHERE category <> '1-URGENT' OR n <> 5 UNION ALL SELECT NULL, 'category_6-NONE', CAST(0 AS BIGINT)"""

RUNS = "SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'STOP' ELSE 'ASK' END AS decision, o_orderkey % 5 AS condition_id FROM {orders}"


def scored_runs(s, d):
    runs = from_sql(s, d, RUNS, "orders")
    gold = table(s, d, "orders").where("o_orderkey % 13 <> 1").select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 4 == 0, "STOP").otherwise("ASK").alias("expected"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("target"), F.array(F.lit(3)).cast("array<bigint>").alias("known"), F.array(F.lit(4)).cast("array<bigint>").alias("unable"))
    return V.scored_runs(runs, gold)


SCORED = f"""SELECT sample_id, decision, condition_id, CASE WHEN g THEN a = w END AS decision_correct, CASE WHEN g THEN (NOT a AND NOT w) OR (a AND w AND condition_id IN (1, 2)) END AS target_correct, CASE WHEN g THEN a AND condition_id = 3 END AS repeat_known, CASE WHEN g THEN a AND condition_id = 4 END AS reasks_unable
FROM (SELECT *, decision = 'ASK' AS a, sample_id % 4 <> 0 AS w, sample_id % 13 <> 1 AS g FROM ({RUNS.format(orders='orders')}))"""

DRAFTS = """SELECT conv_id AS session_id, turn AS pos, CASE turn % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'REFINE' WHEN 2 THEN 'DUPLICATE' WHEN 3 THEN 'OTHER' ELSE 'UNABLE' END AS status, CASE WHEN turn % 11 = 10 THEN ' ' ELSE ' missing ' || role END AS description,
  (conv_id + turn) % 6 AS c1, conv_id % 6 AS c2, turn - 1 AS f, CASE WHEN conv_id % 2 = 0 THEN 'finer' END AS refinement FROM {conversations}"""


def validated(s, d):
    ids = lambda *c: F.array(*[F.col(x).cast("long") for x in c])
    x = from_sql(s, d, DRAFTS, "conversations").withColumns({"condition_ids": ids("c1", "c2", "c1"), "fact_ids": F.when(F.col("pos") % 2 == 1, ids("f")).otherwise(F.array().cast("array<bigint>")), "question_ids": F.array().cast("array<bigint>")})
    sessions = table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    allowed = sessions.select("session_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>")).alias("condition_id")).distinct()
    return V.validated_drafts(x, allowed, sessions.where("turn % 4 = 0").select("session_id", F.col("turn").cast("long").alias("fact_id")), sessions.where("turn < 0").select("session_id", F.col("turn").cast("long").alias("question_id")))


def validated_drafts(s, d):
    return validated(s, d).select("session_id", "pos", "status", F.array_join(F.transform("condition_ids", lambda c: c.cast("string")), ",").alias("condition_ids"), "dropped", "reason")


def tiers(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct().select("session_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("condition_id")).withColumns({"tier": (F.col("session_id") + F.col("condition_id")).cast("int") % 3, "rule_rank": F.col("condition_id").cast("int") * 2})


def ranked_drafts(s, d):
    return V.ranked_drafts(validated(s, d).where("reason is null"), tiers(s, d))[0].select("session_id", "pos", "candidate_id", F.col("tier").cast("long").alias("tier"), F.col("rule_rank").cast("long").alias("rule_rank"), "rank")


def excluded_drafts(s, d):
    return V.ranked_drafts(validated(s, d).where("reason is null"), tiers(s, d))[1]


DRAFT = f"""x AS (SELECT *, list_filter([c1, c2], lambda c: c IN (1, 2, 3)) AS k, pos % 2 = 1 AND f >= 0 AND f % 4 = 0 AND EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = session_id AND t.turn = f) AS known FROM ({DRAFTS.format(conversations='conversations')})),
y AS (SELECT *, CASE WHEN len(k) = 2 AND k[1] = k[2] THEN [k[1]] ELSE k END AS ids, CASE WHEN status = 'OTHER' THEN 'invalid_status' WHEN trim(description) = '' THEN 'empty_description' WHEN len(k) = 0 THEN 'no_allowed_condition' WHEN status IN ('DUPLICATE', 'REFINE') AND NOT known THEN 'missing_history_reference' WHEN status = 'REFINE' AND refinement IS NULL THEN 'missing_refinement' END AS reason FROM x),
z AS (SELECT session_id, pos, status, 'mf.' || row_number() OVER (PARTITION BY session_id ORDER BY pos) AS candidate_id, coalesce(list_min(list_transform(list_filter(ids, lambda c: c < 3), lambda c: (session_id + c) % 3)), 3) AS tier, coalesce(list_min(list_transform(list_filter(ids, lambda c: c < 3), lambda c: 2 * c)), 99) AS rule_rank FROM y WHERE reason IS NULL)"""


def default_scope(s, d):
    candidates = table(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 10).alias("rule_id"), F.col("l_linenumber").alias("rank")).groupBy("query_id", "rule_id").agg(F.min("rank").alias("rank"))
    members = table(s, d, "supplier").select((F.col("s_suppkey") % 10).alias("rule_id"), F.col("s_nationkey").alias("condition_id"), F.col("s_suppkey").alias("pos"))
    out = V.default_scope(candidates, members)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("query_id", joined("rules").alias("rules"), joined("conditions").alias("conditions"))


SCOPE = """WITH c AS (SELECT l_orderkey AS query_id, l_suppkey % 10 AS rule_id, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2), m AS (SELECT s_suppkey % 10 AS rule_id, s_nationkey AS condition_id, min(s_suppkey) AS pos FROM supplier GROUP BY 1, 2),
f AS (SELECT query_id, condition_id, min((rank, pos)) AS place FROM c JOIN m USING (rule_id) GROUP BY 1, 2) SELECT query_id, rules, coalesce(conditions, '') AS conditions FROM (SELECT query_id, string_agg(rule_id::VARCHAR, ',' ORDER BY rank, rule_id) AS rules FROM c GROUP BY 1) LEFT JOIN (SELECT query_id, string_agg(condition_id::VARCHAR, ',' ORDER BY place, condition_id) AS conditions FROM f GROUP BY 1) USING (query_id)"""


def case_documents(s, d):
    o, l = table(s, d, "orders"), table(s, d, "lineitem")
    some = l.where("l_orderkey % 4 <> 0")
    x = V.case_documents(
        o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("title")), some.select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("claim_type"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).alias("rule_id")),
        some.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("condition_id"), F.col("l_linestatus").alias("status")), some.where("l_linenumber = 2").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("rule_id")), some.select(F.col("l_orderkey").alias("case_id"), F.col("l_linestatus").alias("status")),
    )
    return x.select("case_id", "title", F.array_join("claim_types", ",").alias("claim_types"), F.size("assessments").cast("long").alias("n_assessments"), F.array_join(F.transform("rules", lambda r: r.cast("string")), ",").alias("rules"), F.array_join("decisions", ",").alias("decisions"))


DOCUMENTS = """WITH s AS (SELECT * FROM lineitem WHERE l_orderkey % 4 <> 0) SELECT o_orderkey AS case_id, o_orderpriority AS title, coalesce((SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM s WHERE l_orderkey = o_orderkey), '') AS claim_types,
  (SELECT count(DISTINCT (l_linenumber, l_linestatus)) FROM s WHERE l_orderkey = o_orderkey) AS n_assessments, coalesce((SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT DISTINCT l_suppkey AS k FROM s WHERE l_orderkey = o_orderkey AND l_linenumber <= 2)), '') AS rules, coalesce((SELECT string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FROM s WHERE l_orderkey = o_orderkey), '') AS decisions FROM orders"""


def document_texts(s, d):
    docs = table(s, d, "documents")
    cases = docs.select(F.col("doc_id").alias("case_id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("full_document"), F.col("lang").alias("facts"), F.lit(" ").alias("reasoning"), F.col("source").alias("result"))
    markdown = docs.where("doc_id % 50 = 7").select(F.col("source").alias("title"), F.lit("# md").alias("text"))
    return V.document_text(cases, markdown).select("case_id", F.sha2("text", 256).alias("text"), "origin")


TEXT_SQL = """WITH m AS (SELECT DISTINCT source AS title FROM documents WHERE doc_id % 50 = 7 AND source IS NOT NULL) SELECT doc_id AS case_id, sha256(CASE origin WHEN 'markdown' THEN '# md' WHEN 'document' THEN trim(text, ' ') ELSE concat_ws(chr(10) || chr(10), CASE WHEN trim(lang) <> '' THEN '## 案件事实' || chr(10) || lang END, CASE WHEN trim(source) <> '' THEN '## 裁判结果' || chr(10) || source END) END) AS text, origin
  FROM (SELECT *, CASE WHEN source IN (SELECT title FROM m) THEN 'markdown' WHEN doc_id % 3 = 0 AND trim(text, ' ') <> '' THEN 'document' ELSE 'sections' END AS origin FROM documents)"""


def decision_rows(s, d):
    o = table(s, d, "orders")
    held = F.concat(F.lit("返还"), F.col("o_orderkey").cast("string"), F.lit("元。其余驳回。"))
    cases = o.select(F.concat(F.lit("case."), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(held).alias("holding"),
                     F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("查明。"), held)).otherwise("查明。").alias("facts"), F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("本院认为："), held)).otherwise("").alias("reasoning"))
    return V.decision_rows(cases).select("decision_id", "status", "amount", "section", F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"))


DECISION = "SELECT 'case.' || o_orderkey || '.decision.001' AS decision_id, o_orderstatus AS status, o_totalprice AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'facts' ELSE 'reasoning' END AS section, CAST(CASE o_orderkey % 3 WHEN 0 THEN 3 ELSE 5 END AS BIGINT) AS start_offset, CASE o_orderkey % 3 WHEN 0 THEN 3 ELSE 5 END + 4 + length(o_orderkey::VARCHAR) AS end_offset FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 < 2"

ANSWERS = "SELECT o_custkey AS session_id, o_orderkey AS question_id, o_orderkey % 3 AS condition_id, CASE WHEN o_orderkey % 10 = 0 THEN 'a' END AS option_id, CASE o_orderkey % 9 WHEN 0 THEN '是。' WHEN 1 THEN '没有' WHEN 2 THEN '对方已经履行' WHEN 3 THEN '想要对方履行' WHEN 4 THEN '尚未履行完毕' WHEN 5 THEN '退款；拒绝' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE '说不上来' END AS answer FROM {orders}"


def answer_statuses(s, d):
    options = table(s, d, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("question_id"), F.lit("a").alias("option_id"), F.lit("CHOSEN").alias("status"))
    phrases = from_sql(s, d, "SELECT CAST(r_regionkey AS BIGINT) AS condition_id, unnested AS phrase, CASE WHEN unnested IN ('履行', '退款') THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS status FROM {region} CROSS JOIN (SELECT '履行' AS unnested UNION ALL SELECT '未履行' UNION ALL SELECT '退款' UNION ALL SELECT '拒绝') p WHERE r_regionkey < 2", "region")
    return V.answer_statuses(from_sql(s, d, ANSWERS, "orders"), options, phrases)


ANSWERED = f"""SELECT session_id, question_id, condition_id, CASE WHEN question_id % 20 = 0 THEN 'CHOSEN' WHEN answer = '是。' THEN 'SATISFIED' WHEN answer = '没有' THEN 'NOT_SATISFIED' WHEN condition_id > 1 OR answer LIKE '想要%' THEN NULL WHEN answer LIKE '%未履行%' THEN 'NOT_SATISFIED' WHEN answer = '退款；拒绝' THEN 'CONFLICTING' WHEN answer LIKE '%履行%' THEN 'SATISFIED' END AS status FROM ({ANSWERS.format(orders='orders')})"""


def exploded_members(s, d):
    """Members of nested rules: a rule is a customer's nation, a group an order's priority."""
    x = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("rule_id"), F.col("o_orderpriority").alias("group_id")).agg(F.array_sort(F.collect_set("o_orderdate")).alias("days"))
    group = F.struct("group_id", F.when(F.substring("group_id", 1, 1) == "1", "CORE").otherwise("DIAGNOSTIC").alias("role"), F.lit("ALL").alias("operator"), F.transform("days", lambda x: F.date_format(x, "yyyy-MM-dd")).alias("member_condition_ids"))
    rules = x.groupBy("rule_id").agg(F.array_sort(F.collect_list(group)).alias("condition_groups"))
    return explode_rules(rules)["members"].select("rule_id", "group_id", "role", "condition_id", F.col("pos").cast("long").alias("pos"))


MEMBER_SQL = "SELECT rule_id, group_id, CASE WHEN group_id LIKE '1%' THEN 'CORE' ELSE 'DIAGNOSTIC' END AS role, strftime(o_orderdate, '%Y-%m-%d') AS condition_id, row_number() OVER (PARTITION BY rule_id, group_id ORDER BY o_orderdate) - 1 AS pos FROM (SELECT DISTINCT c_nationkey AS rule_id, o_orderpriority AS group_id, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey)"

#: Flat record tables of stand-ins: a source is a region, a provision a nation, a rule a brand, a case an order.
RECORDS = {
    "sources": "SELECT r_regionkey AS source_id, r_name AS title FROM {region}", "provisions": "SELECT n_nationkey AS provision_id, n_regionkey AS source_id FROM {nation}", "rules": "SELECT DISTINCT p_brand AS rule_id FROM {part}",
    "rule_provisions": "SELECT DISTINCT p_brand AS rule_id, p_size % 30 AS provision_id FROM {part}", "conditions": "SELECT DISTINCT p_brand AS rule_id, p_brand || '/' || CAST(p_size AS VARCHAR(9)) AS condition_id FROM {part}",
    "groups": "SELECT DISTINCT p_brand AS rule_id, p_brand || p_type AS group_id FROM {part}", "members": "SELECT DISTINCT p_brand || p_type AS group_id, p_brand || '/' || CAST(p_size AS VARCHAR(9)) AS condition_id FROM {part}",
    "exceptions": "SELECT p_brand AS rule_id, p_partkey AS exception_id FROM {part} WHERE p_size = 1", "consequences": "SELECT p_brand AS rule_id, p_partkey AS consequence_id FROM {part} WHERE p_size = 2",
    "cases": "SELECT o_orderkey AS case_id, o_orderpriority AS title FROM {orders}", "case_provisions": "SELECT l_orderkey AS case_id, l_suppkey % 25 AS provision_id FROM {lineitem}", "claims": "SELECT o_orderkey AS case_id, o_orderkey * 2 AS claim_id FROM {orders}",
    "claim_rules": "SELECT l_orderkey * 2 AS claim_id, p_brand AS rule_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey", "findings": "SELECT l_orderkey AS case_id, l_orderkey * 10 + l_linenumber AS finding_id FROM {lineitem}",
    "assessments": "SELECT l_orderkey AS case_id, l_orderkey * 10 + l_linenumber AS assessment_id, p_brand || '/' || CAST(p_size AS VARCHAR(9)) AS condition_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "assessment_findings": "SELECT l_orderkey * 10 + l_linenumber AS assessment_id, l_orderkey * 10 + l_linenumber AS finding_id FROM {lineitem}", "reasoning": "SELECT o_orderkey AS case_id, o_orderkey AS reasoning_id FROM {orders} WHERE o_orderkey % 2 = 0",
    "reasoning_rules": "SELECT l_orderkey AS reasoning_id, p_brand AS rule_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_orderkey % 2 = 0", "reasoning_findings": "SELECT l_orderkey AS reasoning_id, l_orderkey * 10 + l_linenumber AS finding_id FROM {lineitem} WHERE l_orderkey % 2 = 0",
    "decisions": "SELECT o_orderkey AS case_id, o_orderkey * 3 AS decision_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 2 END AS claim_id FROM {orders}", "spans": "SELECT l_orderkey * 10 + l_linenumber AS span_id FROM {lineitem}",
}
EVIDENCE = "SELECT 'CourtFinding' AS label, l_orderkey * 10 + l_linenumber AS object_id, l_orderkey * 10 + l_linenumber AS span_id FROM {lineitem} UNION ALL SELECT 'DecisionItem', l_orderkey * 3, l_orderkey * 10 + 1 FROM {lineitem} UNION ALL SELECT 'LegalRule', NULL, 1 FROM {lineitem} WHERE l_orderkey < 0"
NAMES = ("region", "nation", "part", "orders", "lineitem")


def record_graph(s, d):
    """Nodes of all labels and edges of all types, counted and with a digest of their keys; ends that are no node are counted by type as `dangling`."""
    tables = {name: from_sql(s, d, text, *[n for n in NAMES if f"{{{n}}}" in text]) for name, text in RECORDS.items()}
    evidence = from_sql(s, d, EVIDENCE, "lineitem").withColumn("object_id", F.col("object_id").cast("string"))
    evidence = evidence.where("object_id is not null")
    nodes, edges = G.project(tables, evidence)
    lost = G.lost_ends(tables, evidence).select(F.lit("dangling").alias("kind"), F.col("type").alias("name"), "n", F.lit(None).cast("string").alias("digest"))
    digest = lambda *of: F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *of)), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest")
    made = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"), digest("key"))
    return made.union(edges.groupBy(F.lit("edge"), "type").agg(F.count("*"), digest("source", "type", "target"))).union(lost)


def _graph_sql() -> str:
    flat = {k: v.format(**{n: n for n in NAMES}) for k, v in RECORDS.items()}
    digest = "CAST(sum(('0x' || substr(md5({}), 1, 15))::BIGINT) AS VARCHAR) AS digest"
    parts = [f"SELECT 'node' AS kind, '{label}' AS name, count(*) AS n, " + digest.format(f"'{label}|' || {ident}") + f" FROM (SELECT DISTINCT * FROM {name})" for label, (name, ident) in G.NODES.items()]
    ends = [f"SELECT '{kind}' AS name, '{source[0]}|' || {source[1]} AS s, '{target[0]}|' || {target[1]} AS t FROM {name} WHERE {source[1]} IS NOT NULL AND {target[1]} IS NOT NULL" for kind, name, source, target in G.EDGES]
    ends.append(f"SELECT 'EVIDENCED_BY', label || '|' || object_id, 'SourceSpan|' || span_id FROM ({EVIDENCE.format(lineitem='lineitem')}) WHERE object_id IS NOT NULL")
    keys = " UNION ".join(f"SELECT '{label}|' || {ident} AS k FROM {name}" for label, (name, ident) in G.NODES.items())
    tables = ", ".join(f"{k} AS ({v})" for k, v in flat.items())
    lost = "SELECT 'dangling', name, count(*), NULL FROM (SELECT name FROM e WHERE s NOT IN (SELECT k FROM k) UNION ALL SELECT name FROM e WHERE t NOT IN (SELECT k FROM k)) GROUP BY 2"
    return f"WITH {tables}, e AS ({' UNION '.join(ends)}), k AS ({keys}) {' UNION ALL '.join(parts)} UNION ALL SELECT 'edge', name, count(*), {digest.format("s || '|' || name || '|' || t")} FROM e GROUP BY 2 UNION ALL {lost}"


QUERIES = {
    "record_issues": (record_issues, f"""WITH p AS ({PROVISIONS.format(supplier='supplier')}), s AS ({SOURCES.format(nation='nation')}), c AS ({TEXTS.format(documents='documents')}), x AS (SELECT 'provision' AS kind, provision_id AS id, 'unknown_source' AS issue FROM p WHERE source_id NOT IN (SELECT source_id FROM s)
      UNION ALL SELECT 'provision', provision_id, 'noncanonical_id' FROM p WHERE s_suppkey % 13 <> 5 AND provision_id = 'x' UNION ALL SELECT 'provision', provision_id, 'empty_text' FROM p WHERE trim(text) = '' UNION ALL SELECT 'case', case_id::VARCHAR, 'empty_case_text' FROM c WHERE regexp_replace(coalesce(facts, ''), '[ 　\\t\\r\\n]+', '', 'g') = '' AND coalesce(reasoning, '') = '') SELECT kind, id, issue, count(*) AS n FROM x GROUP BY 1, 2, 3"""),
    "premise_warnings": (premise_warnings, "SELECT p_brand AS rule_id, p_size AS condition_id, string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS span_ids FROM part WHERE p_size % 3 <> 0 AND p_partkey % 5 < 2 GROUP BY 1, 2"),
    "case_set_issues": (case_set_issues, CASE_SET),
    "rule_set_issues": (rule_set_issues, RULE_SET),
    "sample_issues": (sample_issues, SAMPLE_SET),
    "converted_samples": (converted_samples, f"SELECT 'case.' || id AS case_id, '服务合同纠纷' AS cause, '服务,借款' AS keywords, sha256(CASE WHEN kind < 2 THEN '标的' || kind || '：内容' WHEN kind < 4 THEN '标的' || kind ELSE substr(trim(split_part(trim(coalesce(text, ''), ' '), chr(10), 1), ' '), 1, 400) END) AS summary FROM ({SAMPLES.format(documents='documents')}) WHERE kind <> 3"),
    "corpus_counts": (corpus_counts, CORPUS),
    "frozen_issues": (frozen_issues, FROZEN),
    "scored_runs": (scored_runs, SCORED),
    "validated_drafts": (validated_drafts, f"WITH {DRAFT} SELECT session_id, pos, status, array_to_string(ids, ',') AS condition_ids, len(list_filter([c1, c2, c1], lambda c: c NOT IN (1, 2, 3))) AS dropped, reason FROM y"),
    "ranked_drafts": (ranked_drafts, f"WITH {DRAFT} SELECT session_id, pos, candidate_id, tier, rule_rank, row_number() OVER (PARTITION BY session_id ORDER BY tier, rule_rank, candidate_id) AS rank FROM z WHERE status IN ('MISSING', 'REFINE')"),
    "excluded_drafts": (excluded_drafts, f"WITH {DRAFT} SELECT session_id, status, count(*) AS n FROM z WHERE status NOT IN ('MISSING', 'REFINE') GROUP BY 1, 2"),
    "default_scope": (default_scope, SCOPE),
    "case_documents": (case_documents, DOCUMENTS),
    "document_texts": (document_texts, TEXT_SQL),
    "decision_rows": (decision_rows, DECISION),
    "answer_statuses": (answer_statuses, ANSWERED),
    "exploded_members": (exploded_members, MEMBER_SQL),
    "record_graph": (record_graph, _graph_sql()),
}
