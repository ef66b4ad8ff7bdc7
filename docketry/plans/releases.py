"""Queries of releases, overlays, index upkeep, lexical evidence and corrections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import releases as R
from docketry.operators import sessions as S
from docketry.sources.tables import from_sql, table, written

RULES = ("SELECT s_suppkey AS rule_id, s_name AS definition FROM {supplier} WHERE s_suppkey % 10 <> 4", "SELECT s_suppkey AS rule_id, CASE WHEN s_suppkey % 5 = 0 THEN s_name || '!' ELSE s_name END AS definition FROM {supplier} WHERE s_suppkey % 10 <> 3")
REFERENCES = ("SELECT s_suppkey AS rule_id, s_nationkey AS provision_id FROM {supplier}", "SELECT s_suppkey AS rule_id, s_nationkey AS provision_id FROM {supplier} UNION ALL SELECT s_suppkey, s_nationkey + 100 FROM {supplier} WHERE s_suppkey % 7 = 0")
MEMBERS = ("SELECT s_suppkey AS rule_id, s_nationkey AS condition_id FROM {supplier}", "SELECT s_suppkey AS rule_id, s_nationkey % 20 AS condition_id FROM {supplier}")
NODES = "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'r0' ELSE 'r1' END AS release_id, 'n' || CAST(n_nationkey AS VARCHAR(3)) AS key FROM {nation} UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'r0' ELSE 'r1' END, 'n' || CAST(n_nationkey AS VARCHAR(3)) FROM {nation} WHERE n_nationkey % 7 = 0"
EDGES = "SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'r0' ELSE 'r1' END AS release_id, 'n' || CAST(c_nationkey AS VARCHAR(3)) AS source, CASE WHEN c_custkey % 3 = 0 THEN 'CITES' ELSE 'APPLIES' END AS type, 'n' || CAST(c_custkey % 30 AS VARCHAR(3)) AS target FROM {customer}"


def release_receipt(s, d):
    pairs = [tuple(from_sql(s, d, text, "supplier") for text in pair) for pair in (RULES, REFERENCES, MEMBERS)]
    return R.release_receipt(*pairs)


def release_issues(s, d):
    return R.release_issues(from_sql(s, d, NODES, "nation"), from_sql(s, d, EDGES, "customer"))


SPANS = """SELECT CAST(l_orderkey AS BIGINT) AS case_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS span_id, CASE WHEN l_linenumber % 2 = 0 THEN 'facts' ELSE 'reasons' END AS section,
  l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR(2)) AS quote, l_partkey AS p FROM {lineitem}"""
USES = "SELECT case_id, span_id FROM ({spans}) x WHERE p % 3 = 0"
TEXTS = "SELECT case_id, section, string_agg(quote, ';') AS text FROM ({spans}) x GROUP BY 1, 2"
CURATED = """SELECT case_id, 'c1' AS condition_id, 'SATISFIED' AS status, CAST(0.7 AS DOUBLE) AS confidence, section, quote FROM ({spans}) x WHERE span_id = 1 AND case_id % 4 = 0
  UNION ALL SELECT case_id, 'c2', 'NOT_SATISFIED', CAST(0.65 AS DOUBLE), section, substr(quote, 1, 2) FROM ({spans}) x WHERE span_id = 1 AND case_id % 4 = 0
  UNION ALL SELECT case_id, 'c3', 'SATISFIED', CAST(0.7 AS DOUBLE), 'facts', '不在' FROM ({spans}) x WHERE span_id = 1 AND case_id % 8 = 0
  UNION ALL SELECT case_id, 'c4', 'UNKNOWN', CAST(0.3 AS DOUBLE), NULL, NULL FROM ({spans}) x WHERE span_id = 1 AND case_id % 4 = 0"""


def overlaid(s, d):
    spans, uses, curated, texts = (from_sql(s, d, x.replace("{spans}", SPANS), "lineitem") for x in (SPANS, USES, CURATED, TEXTS))
    return R.overlay_spans(spans, uses, curated, texts)


def overlay_findings(s, d):
    return overlaid(s, d)[0]


def overlay_spans(s, d):
    return overlaid(s, d)[1]


def overlay_refused(s, d):
    return overlaid(s, d)[2]


def index_upkeep(s, d):
    """Two runs of upkeep over the documents: between them some are gone, some new and some have another text. A vector is what stands in for a model's: the text's length."""
    docs = table(s, d, "documents").select(F.lit("case").alias("target"), F.col("doc_id").alias("object_id"), "text")
    after = docs.where("object_id % 11 <> 0").withColumn("text", F.when(F.col("object_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))

    def embed(rows):
        return rows.select("target", "object_id", F.array(F.length("text").cast("double")).alias("vector"))

    empty = s.createDataFrame([], "target string, object_id long, text_sha256 string, vector array<double>, state string")
    first = written(R.upkeep(empty, docs.where("object_id % 10 <> 0"), embed))
    return R.upkeep(first, after, embed).select("object_id", "text_sha256", "state", F.get("vector", F.lit(0)).alias("length"))


# What a user says, from the numbers of conversations, in front of their own words.
SAID = """SELECT CAST(conv_id AS BIGINT) AS session_id, CAST(turn AS BIGINT) AS fact_id, CASE (conv_id * 3 + turn) % 12 WHEN 0 THEN '我已经付款。' WHEN 1 THEN '我没有付款。' WHEN 2 THEN '如果付了款就好；卡还在。' WHEN 3 THEN '钱不是我付了款的。' WHEN 4 THEN '没有付款！后来付了款。'
  WHEN 5 THEN '还有余额，没有余额了。' WHEN 6 THEN '没有余额。' WHEN 7 THEN '我想付了款再说。办了卡。' WHEN 8 THEN '还没付款；还有未消费余额' WHEN 9 THEN '并非 办了卡。' WHEN 10 THEN '签了合同，付了款。' ELSE '' END || '|' || substr(text, 1, 20) AS text FROM {conversations}"""
PHRASES = [
    ("contract", "SUPPORTS", ["办了卡", "签了合同"]), ("contract", "OPPOSES", ["没有合同"]), ("payment", "SUPPORTS", ["已经付款", "付了款", "付款"]), ("payment", "OPPOSES", ["没有付款", "还没付款", "没付款"]),
    ("balance", "SUPPORTS", ["还有余额", "未消费余额", "未消费"]), ("balance", "OPPOSES", ["没有余额", "消费完了"]),
]


def lexical_evidence(s, d):
    phrases = s.createDataFrame([(c, r, i, p) for c, r, ps in PHRASES for i, p in enumerate(ps)], "condition_id string, relation string, pos int, phrase string")
    return S.lexical_evidence(from_sql(s, d, SAID, "conversations"), phrases)


TOLD = """SELECT CAST(o_custkey AS BIGINT) AS session_id, CAST(o_orderkey AS BIGINT) AS fact_id, CASE o_orderkey % 4 WHEN 0 THEN '付了' || CAST(o_orderkey % 900 AS VARCHAR(9)) || '元' WHEN 1 THEN '剩余' || CAST(o_orderkey % 900 AS VARCHAR(9)) || '元余额' WHEN 2 THEN '上了' || CAST(o_orderkey % 50 AS VARCHAR(9)) || '次课' ELSE '签了合同' END AS text FROM {orders}"""
LINKED = "SELECT CAST(o_custkey AS BIGINT) AS session_id, CASE o_orderkey % 3 WHEN 0 THEN 'cond.payment_made' WHEN 1 THEN 'cond.unperformed_balance' ELSE 'cond.contract_exists' END AS condition_id, CAST(o_orderkey AS BIGINT) AS fact_id FROM {orders} WHERE o_orderkey % 5 = 0"
CORRECTED = """SELECT CAST(c_custkey AS BIGINT) AS session_id, CASE c_custkey % 3 WHEN 0 THEN 'cond.payment_made' ELSE 'cond.contract_exists' END AS condition_id, CASE c_custkey % 7 WHEN 0 THEN '更正：金额是100元' WHEN 1 THEN '说错了，余额是7元' WHEN 2 THEN '更正，已退款3元' WHEN 3 THEN '应该是别的'
  WHEN 4 THEN '没有了' WHEN 5 THEN '其实是付了 40.5 元' ELSE '更正：100次' END AS answer FROM {customer}"""


def correction_targets(s, d):
    return S.correction_targets(from_sql(s, d, CORRECTED, "customer"), from_sql(s, d, TOLD, "orders"), from_sql(s, d, LINKED, "orders"))


def sql(text: str) -> str:
    """A stand-in over DuckDB's views."""
    text = text.replace("{spans}", SPANS)
    for t in ("supplier", "nation", "customer", "lineitem", "orders", "conversations"):
        text = text.replace(f"{{{t}}}", t)
    return text


RECEIPT_SQL = """SELECT CASE WHEN s_suppkey % 10 = 4 THEN 'added_rule' WHEN s_suppkey % 10 = 3 THEN 'removed_rule' ELSE 'changed_rule' END AS kind, CAST(s_suppkey AS VARCHAR) AS rule_id, NULL AS detail, CAST(1 AS BIGINT) AS n FROM supplier WHERE s_suppkey % 10 IN (3, 4) OR s_suppkey % 5 = 0
UNION ALL SELECT 'added_reference', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey + 100 AS VARCHAR), 1 FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT 'rules', NULL, 'before', count(*) FROM supplier WHERE s_suppkey % 10 <> 4 UNION ALL SELECT 'rules', NULL, 'after', count(*) FROM supplier WHERE s_suppkey % 10 <> 3
UNION ALL SELECT 'conditions', NULL, 'before', count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'conditions', NULL, 'after', count(DISTINCT s_nationkey % 20) FROM supplier"""
RELEASE_SQL = f"""WITH n AS ({sql(NODES)}), e AS ({sql(EDGES)}), x AS (SELECT release_id, type, unnest([source, target]) AS key FROM e)
SELECT release_id, 'duplicate_key' AS issue, key AS detail, count(*) AS n FROM n GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT release_id, CASE WHEN key IN (SELECT key FROM n) THEN 'crossing' ELSE 'missing_end' END, type, count(*) FROM x WHERE (release_id, key) NOT IN (SELECT release_id, key FROM n) GROUP BY 1, 2, 3"""
OVERLAY_SQL = f"""sp AS ({sql(SPANS)}), us AS ({sql(USES)}), cu AS ({sql(CURATED)}), te AS ({sql(TEXTS)}), cs AS (SELECT DISTINCT case_id FROM cu),
ma AS (SELECT sp.* FROM sp JOIN us USING (case_id, span_id) WHERE case_id IN (SELECT case_id FROM cs)), ok AS (SELECT cu.* FROM cu LEFT JOIN te USING (case_id, section) WHERE quote IS NULL OR contains(text, quote)),
fi AS (SELECT case_id, section, quote, min(span_id) AS span_id FROM ma GROUP BY 1, 2, 3), wa AS (SELECT case_id, section, quote, min(condition_id) AS condition_id FROM ok WHERE quote IS NOT NULL GROUP BY 1, 2, 3),
la AS (SELECT case_id, max(span_id) AS last FROM sp GROUP BY 1), ne AS (SELECT case_id, last + row_number() OVER (PARTITION BY case_id ORDER BY condition_id, section, quote) AS span_id, section, quote FROM wa JOIN la USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.case_id = wa.case_id AND fi.section = wa.section AND fi.quote = wa.quote)),
ta AS (SELECT case_id, section, quote, span_id FROM fi UNION ALL SELECT case_id, section, quote, span_id FROM ne)"""
INTENT, SUPPOSED = "|".join(S.INTENT), "|".join(S.SUPPOSED)
WORDS = ", ".join(f"('{c}', '{r}', {i}, '{p}')" for c, r, ps in PHRASES for i, p in enumerate(ps))
LEXICAL_SQL = f"""WITH f AS (SELECT session_id, fact_id, array_to_string(list_filter(string_split_regex(text, '[。！？!?；;\\n]+'), lambda x: NOT regexp_matches(x, '{INTENT}|{SUPPOSED}')), '。') AS t FROM ({sql(SAID)})),
p(condition_id, relation, pos, phrase) AS (VALUES {WORDS}), h AS (SELECT session_id, fact_id, t, condition_id, relation, phrase FROM f JOIN p ON contains(t, phrase) QUALIFY row_number() OVER (PARTITION BY session_id, fact_id, condition_id, relation ORDER BY length(phrase) DESC, pos) = 1),
w AS (SELECT session_id, fact_id, t, condition_id, max(phrase) FILTER (WHERE relation = 'SUPPORTS') AS s, max(phrase) FILTER (WHERE relation = 'OPPOSES') AS o FROM h GROUP BY 1, 2, 3, 4),
v AS (SELECT *, s IS NOT NULL AND o IS NOT NULL AS two, contains(o, s) AND NOT contains(replace(t, o, ''), s) AS nested FROM w)
SELECT session_id, fact_id, condition_id, CASE WHEN o IS NOT NULL THEN 'OPPOSES' ELSE 'SUPPORTS' END AS relation, 0.58::DOUBLE AS confidence, coalesce(o, s) AS phrase FROM v WHERE (NOT two OR nested) AND (o IS NOT NULL OR NOT regexp_matches(t, '(没有|并非|不是|未|不曾|没)\\s*' || s))"""
CORRECT_SQL = f"""WITH a AS (SELECT *, regexp_matches(answer, '余额|剩余|未消费') AS bal, regexp_extract_all(answer, '(\\d+(?:\\.\\d+)?)\\s*元?', 1) AS am FROM ({sql(CORRECTED)}) WHERE regexp_matches(answer, '说错了|更正|纠正|改成|应为|其实是|应该是') AND NOT regexp_matches(answer, '已退款|已退|退了|退还了')),
b AS (SELECT session_id, CASE WHEN bal THEN 'cond.unperformed_balance' ELSE condition_id END AS condition_id, bal, am, len(am) > 0 AND regexp_matches(answer, '金额|元|交了|付了|付的|费用') AS money FROM a),
f AS (SELECT *, regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)\\s*元?', 1) AS fm FROM ({sql(TOLD)})), l AS (SELECT * FROM ({sql(LINKED)})),
x AS (SELECT b.*, f.fact_id, f.text, len(fm) > 0 AND len(list_filter(fm, lambda z: NOT list_contains(am, z))) > 0 AS differs, EXISTS (SELECT 1 FROM l WHERE l.session_id = b.session_id AND l.fact_id = f.fact_id AND l.condition_id = b.condition_id) AS linked,
  EXISTS (SELECT 1 FROM l WHERE l.session_id = b.session_id AND l.fact_id = f.fact_id AND l.condition_id = CASE WHEN bal THEN 'cond.unperformed_balance' ELSE 'cond.payment_made' END) AS paid FROM b JOIN f USING (session_id)),
y AS (SELECT *, bool_or(paid) OVER (PARTITION BY session_id) AS anypaid FROM x), z AS (SELECT *, CASE WHEN NOT money THEN linked ELSE differs AND CASE WHEN anypaid THEN paid ELSE linked END END AS t1 FROM y),
u AS (SELECT *, bool_or(t1) OVER (PARTITION BY session_id) AS any1 FROM z)
SELECT session_id, min(fact_id) AS fact_id, CASE WHEN bool_or(money) AND NOT bool_or(bal) THEN 'cond.payment_made' ELSE min(condition_id) END AS condition_id FROM u WHERE t1 OR (NOT any1 AND money AND NOT bal AND differs AND regexp_matches(text, '元|交了|付了|付的|支付|付款|充了|金额|费用')) GROUP BY session_id HAVING count(*) = 1"""

QUERIES = {
    "release_receipt": (release_receipt, RECEIPT_SQL),
    "release_issues": (release_issues, RELEASE_SQL),
    "overlay_findings": (overlay_findings, f"WITH {OVERLAY_SQL} SELECT ok.case_id, condition_id, status, confidence, span_id FROM ok LEFT JOIN ta ON ta.case_id = ok.case_id AND ta.section = ok.section AND ta.quote = ok.quote"),
    "overlay_spans": (overlay_spans, f"WITH {OVERLAY_SQL} SELECT case_id, span_id, section, quote FROM sp WHERE case_id NOT IN (SELECT case_id FROM cs) UNION ALL SELECT case_id, span_id, section, quote FROM ma UNION ALL SELECT case_id, span_id, section, quote FROM ne"),
    "overlay_refused": (overlay_refused, f"WITH {OVERLAY_SQL} SELECT cu.case_id, condition_id, section, quote FROM cu LEFT JOIN te USING (case_id, section) WHERE quote IS NOT NULL AND NOT coalesce(contains(text, quote), FALSE)"),
    "index_upkeep": (index_upkeep, """WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id % 11 <> 0)
      SELECT coalesce(a.doc_id, b.doc_id) AS object_id, sha256(coalesce(b.t, a.t)) AS text_sha256, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.t = b.t THEN 'kept' ELSE 'embedded' END AS state, CAST(length(b.t) AS DOUBLE) AS length FROM a FULL JOIN b ON a.doc_id = b.doc_id"""),
    "lexical_evidence": (lexical_evidence, LEXICAL_SQL),
    "correction_targets": (correction_targets, CORRECT_SQL),
}
