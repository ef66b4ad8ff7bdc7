"""Queries of conditions, comparison and roles, with their SQL.

Stand-ins: a rule is a brand, a condition a part size, a group a brand's first type word and role; a case
is an order, its assessments are its lines; a query is a nation with states on sizes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import conditions as C
from docketry.sources.tables import from_sql, written

INPUTS = {
    "members": ("""SELECT DISTINCT p_brand AS rule_id, p_brand || '/' || split_part(p_type, ' ', 1) || '/' || CASE WHEN p_size % 2 = 0 THEN 'CORE' ELSE 'DIAGNOSTIC' END AS group_id,
        CASE WHEN length(split_part(p_type, ' ', 1)) % 2 = 0 THEN 'ALL' ELSE 'ANY' END AS operator, CAST(p_size AS BIGINT) AS condition_id, CASE WHEN p_size % 2 = 0 THEN 'CORE' ELSE 'DIAGNOSTIC' END AS role FROM {part}""", "part"),
    "assessments": ("""SELECT CAST(l_orderkey AS BIGINT) AS case_id, CAST(p_size AS BIGINT) AS condition_id, CASE l_returnflag WHEN 'A' THEN 'SATISFIED' WHEN 'R' THEN 'NOT_SATISFIED' ELSE 'UNKNOWN' END AS status,
        CASE WHEN l_discount > 0 THEN CAST(l_linenumber AS BIGINT) END AS evidence FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""", "lineitem", "part"),
    "known": ("""SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(c AS BIGINT) AS condition_id, CASE (n_nationkey * 7 + c) % 4 WHEN 0 THEN 'SATISFIED' WHEN 1 THEN 'NOT_SATISFIED' ELSE 'UNKNOWN' END AS status
        FROM {nation} CROSS JOIN (SELECT DISTINCT p_size AS c FROM {part}) WHERE (n_nationkey * 7 + c) % 4 <> 3""", "nation", "part"),
    "scope": ("SELECT CAST(n_nationkey AS BIGINT) AS query_id, rule_id FROM {nation} CROSS JOIN (SELECT DISTINCT p_brand AS rule_id FROM {part}) WHERE CAST(substr(rule_id, 7) AS INTEGER) % 5 = n_nationkey % 5", "nation", "part"),
    "pairs": ("SELECT CAST(c_nationkey AS BIGINT) AS query_id, CAST(o_orderkey AS BIGINT) AS case_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey", "orders", "customer"),
    "links": ("SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS case_id, p_brand AS rule_id, l_linenumber % 2 = 1 AS applied FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_linenumber <= 2", "lineitem", "part"),
    "claims": ("SELECT CAST(o_orderkey AS BIGINT) AS case_id, substr(o_orderpriority, 1, 1) AS claim_type, o_orderstatus = 'F' AS rejected FROM {orders}", "orders"),
    "user_claims": ("SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(n_nationkey % 5 + 1 AS VARCHAR(1)) AS claim_type FROM {nation} WHERE n_nationkey % 6 <> 0", "nation"),
}


def given(s, d, name):
    text, *names = INPUTS[name]
    return from_sql(s, d, text, *names)


def cte(*names: str) -> str:
    return ", ".join(f"{n} AS ({INPUTS[n][0].format(**{t: t for t in INPUTS[n][1:]})})" for n in names)


def case_states(s, d):
    return C.summarize(given(s, d, "assessments"))


def group_values(s, d):
    return C.group_truth_at_scale(given(s, d, "members"), written(case_states(s, d).where("usable").select("case_id", "condition_id", "status")), "case_id")


def compatible(s, d):
    return C.compatible_rules(given(s, d, "scope"), given(s, d, "members"), given(s, d, "known"))


def compared(s, d):
    return C.compare(given(s, d, "pairs"), given(s, d, "scope"), given(s, d, "members"), given(s, d, "known"), case_states(s, d))


def roles(s, d):
    return C.assign_roles(compared(s, d), *(given(s, d, x) for x in ("scope", "members", "known", "assessments", "links", "claims", "user_claims")))


def pooled(s, d):
    return C.pool(roles(s, d).withColumn("score", F.round(1 / (60 + F.col("case_id") % 97), 9)))


def role_pool(s, d):
    return pooled(s, d).select("query_id", "case_id", "role", "coverage", "score", "place")


def role_top(s, d):
    return C.per_role(pooled(s, d)).select("query_id", "role", "case_id", "rank")


def counts(s, d):
    cases = roles(s, d).where("role is not null or reason = 'NO_REASONING_LINK'").select("query_id", "case_id")
    conditions = C.scoped(given(s, d, "scope"), given(s, d, "members")).select("query_id", "condition_id")
    return C.status_counts(cases, conditions, case_states(s, d))


def condition_ranks(s, d):
    return C.disagreement(counts(s, d))


STATES = """states AS (SELECT case_id, condition_id, CASE WHEN bool_or(status = 'SATISFIED') AND bool_or(status = 'NOT_SATISFIED') THEN 'CONFLICTING' WHEN count(DISTINCT status) = 1 THEN max(status) ELSE 'UNKNOWN' END AS status,
  sum(CASE WHEN status = 'SATISFIED' THEN 1 ELSE 0 END)::BIGINT AS support, sum(CASE WHEN status = 'NOT_SATISFIED' THEN 1 ELSE 0 END)::BIGINT AS oppose
  FROM (SELECT DISTINCT * FROM assessments WHERE evidence IS NOT NULL) GROUP BY 1, 2)"""
TRUTH = """CASE WHEN operator = 'ALL' THEN CASE WHEN n_no > 0 THEN FALSE WHEN n_yes = n THEN TRUE END ELSE CASE WHEN n_yes > 0 THEN TRUE WHEN n_no = n THEN FALSE END END"""


def truth_sql(states: str, owner: str, core: str = "TRUE") -> str:
    return f"""SELECT {owner}, x.group_id, {TRUTH} AS value FROM (SELECT s.{owner}, m.group_id, count(*) FILTER (WHERE status = 'SATISFIED') AS n_yes, count(*) FILTER (WHERE status = 'NOT_SATISFIED') AS n_no
      FROM ({states}) s JOIN (SELECT DISTINCT group_id, condition_id FROM members WHERE {core}) m ON m.condition_id = s.condition_id GROUP BY 1, 2) x
      JOIN (SELECT group_id, operator, count(DISTINCT condition_id) AS n FROM members GROUP BY 1, 2) g ON g.group_id = x.group_id"""


USABLE = "SELECT case_id, condition_id, status FROM states WHERE status IN ('SATISFIED', 'NOT_SATISFIED', 'CONFLICTING')"
COMPARED = f"""{cte('members', 'assessments', 'known', 'scope', 'pairs')}, {STATES},
sc AS (SELECT query_id, condition_id, bool_or(role = 'CORE') AS core, bool_or(role = 'DIAGNOSTIC') AS diagnostic FROM scope JOIN members USING (rule_id) GROUP BY 1, 2),
sz AS (SELECT query_id, count(*) AS n FROM sc GROUP BY 1),
met AS (SELECT p.query_id, p.case_id, count(*) FILTER (WHERE k.status = s.status) AS same, count(*) FILTER (WHERE k.status <> s.status) AS different
  FROM pairs p JOIN states s ON s.case_id = p.case_id AND s.status IN ('SATISFIED', 'NOT_SATISFIED') JOIN sc ON sc.query_id = p.query_id AND sc.condition_id = s.condition_id
  JOIN known k ON k.query_id = p.query_id AND k.condition_id = s.condition_id AND k.status IN ('SATISFIED', 'NOT_SATISFIED') GROUP BY 1, 2),
cg AS ({truth_sql(USABLE, 'case_id', "role = 'CORE'")}), ug AS ({truth_sql('SELECT * FROM known', 'query_id', "role = 'CORE'")}),
us AS (SELECT ug.query_id, ug.group_id, ug.value FROM ug JOIN (SELECT DISTINCT group_id, rule_id FROM members) m USING (group_id) JOIN scope s ON s.query_id = ug.query_id AND s.rule_id = m.rule_id WHERE ug.value IS NOT NULL),
gr AS (SELECT p.query_id, p.case_id, count(*) FILTER (WHERE us.value AND cg.value) AS agree, count(*) FILTER (WHERE us.value <> cg.value) AS conflict
  FROM pairs p JOIN cg ON cg.case_id = p.case_id AND cg.value IS NOT NULL JOIN us ON us.query_id = p.query_id AND us.group_id = cg.group_id GROUP BY 1, 2),
compared AS (SELECT p.query_id, p.case_id, coalesce(same, 0) AS same, coalesce(different, 0) AS different, coalesce(agree, 0) AS core_agree, coalesce(conflict, 0) AS core_conflict,
  coalesce(n, 0) - coalesce(same, 0) - coalesce(different, 0) AS unknown, CASE WHEN n > 0 THEN round((coalesce(same, 0) + coalesce(different, 0)) / n, 6) ELSE 0 END AS coverage
  FROM pairs p LEFT JOIN sz USING (query_id) LEFT JOIN met USING (query_id, case_id) LEFT JOIN gr USING (query_id, case_id))"""
ROLES = f"""{COMPARED}, {cte('links', 'claims', 'user_claims')},
aa AS (SELECT p.query_id, p.case_id, a.status, a.evidence IS NOT NULL AS ev, coalesce(sc.core, FALSE) AS core, coalesce(sc.diagnostic, FALSE) AS diagnostic, coalesce(k.status IN ('SATISFIED', 'NOT_SATISFIED'), FALSE) AS su, k.status AS us
  FROM pairs p JOIN assessments a ON a.case_id = p.case_id LEFT JOIN sc ON sc.query_id = p.query_id AND sc.condition_id = a.condition_id LEFT JOIN known k ON k.query_id = p.query_id AND k.condition_id = a.condition_id),
fl AS (SELECT query_id, case_id, bool_or(ev) AS ev,
  bool_or(ev AND ((NOT su AND diagnostic AND status = 'NOT_SATISFIED') OR (su AND status IN ('SATISFIED', 'NOT_SATISFIED') AND us <> status AND diagnostic AND NOT core))) AS dd,
  bool_or(ev AND ((NOT su AND diagnostic AND status = 'NOT_SATISFIED') OR (su AND status IN ('SATISFIED', 'NOT_SATISFIED') AND (us = status OR core OR diagnostic)))) AS sp FROM aa GROUP BY 1, 2),
li AS (SELECT p.query_id, p.case_id, TRUE AS linked, bool_or(applied) AS applied FROM pairs p JOIN links l ON l.case_id = p.case_id JOIN scope s ON s.query_id = p.query_id AND s.rule_id = l.rule_id GROUP BY 1, 2),
cl AS (SELECT p.query_id, p.case_id, CASE WHEN u.claim_type IS NULL THEN TRUE ELSE c.claim_type = u.claim_type END AS al, rejected FROM pairs p JOIN claims c ON c.case_id = p.case_id LEFT JOIN user_claims u ON u.query_id = p.query_id),
ro AS (SELECT c.*, ev, coalesce(linked, FALSE) AS linked, al, CASE WHEN ev IS NULL THEN NULL WHEN core_agree > 0 AND core_conflict > 0 AND (coalesce(linked, FALSE) OR al) AND sp THEN 'boundary'
   WHEN linked AND al AND core_agree > 0 AND core_conflict = 0 AND applied AND NOT rejected AND sp THEN 'support' WHEN core_conflict > 0 AND (coalesce(linked, FALSE) OR al) AND sp THEN 'limiting' WHEN dd AND (coalesce(linked, FALSE) OR al) THEN 'boundary' END AS role
  FROM compared c LEFT JOIN fl USING (query_id, case_id) LEFT JOIN li USING (query_id, case_id) LEFT JOIN cl USING (query_id, case_id)),
roles AS (SELECT *, CASE WHEN role IS NOT NULL THEN NULL WHEN ev IS NULL THEN 'NO_ASSESSMENT' WHEN NOT ev THEN 'INSUFFICIENT_EVIDENCE' WHEN NOT linked THEN 'NO_REASONING_LINK' WHEN NOT al THEN 'TARGET_MISMATCH' ELSE 'INSUFFICIENT_EVIDENCE' END AS reason FROM ro)"""
POOL = f"""{ROLES}, rs AS (SELECT *, round(1 / (60 + case_id % 97), 9) AS score, CASE role WHEN 'support' THEN 0 WHEN 'limiting' THEN 1 WHEN 'boundary' THEN 2 ELSE 3 END AS o FROM roles),
rt AS (SELECT *, CASE WHEN role IS NULL THEN row_number() OVER (PARTITION BY query_id, role ORDER BY score DESC, case_id) ELSE row_number() OVER (PARTITION BY query_id, role ORDER BY coverage DESC, score DESC, case_id) END AS turn FROM rs),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY role IS NULL, turn, o, case_id) AS place FROM rt) WHERE place <= 20)"""
COUNTS = f"""{ROLES}, pc AS (SELECT query_id, case_id FROM roles WHERE role IS NOT NULL OR reason = 'NO_REASONING_LINK'), nc AS (SELECT query_id, count(*) AS n FROM pc GROUP BY 1),
mt AS (SELECT query_id, condition_id, count(*) FILTER (WHERE status = 'SATISFIED') AS y, count(*) FILTER (WHERE status = 'NOT_SATISFIED') AS o, count(*) FILTER (WHERE status = 'CONFLICTING') AS c FROM pc JOIN states USING (case_id) GROUP BY 1, 2),
counts AS (SELECT sc.query_id, sc.condition_id, coalesce(y, 0) AS n_yes, coalesce(o, 0) AS n_no, coalesce(c, 0) AS n_conflict, n - coalesce(y, 0) - coalesce(o, 0) - coalesce(c, 0) AS n_unknown FROM sc JOIN nc USING (query_id) LEFT JOIN mt USING (query_id, condition_id))"""
RANKS = f"""{COUNTS}, e1 AS (SELECT *, (n_yes + n_no + n_conflict)::DOUBLE AS k FROM counts),
e2 AS (SELECT *, round(CASE WHEN k > 0 THEN CASE WHEN n_yes > 0 THEN -n_yes / k * log2(n_yes / k) ELSE 0 END + CASE WHEN n_no > 0 THEN -n_no / k * log2(n_no / k) ELSE 0 END + CASE WHEN n_conflict > 0 THEN -n_conflict / k * log2(n_conflict / k) ELSE 0 END ELSE 0 END, 6) AS entropy,
  round(CASE WHEN k >= 2 THEN (k * (k - 1) / 2 - n_yes * (n_yes - 1) / 2 - n_no * (n_no - 1) / 2 - n_conflict * (n_conflict - 1) / 2) / (k * (k - 1) / 2) ELSE 0 END, 6) AS disagreement, round(n_unknown / greatest(1, k + n_unknown), 6) AS unknown_rate FROM e1)
SELECT query_id, condition_id, n_yes, n_no, n_conflict, n_unknown, entropy, disagreement, unknown_rate, round(entropy * (1 - unknown_rate), 6) AS heuristic, round(least(1, entropy / 2 * (1 - unknown_rate)), 6) AS discriminativeness,
  CASE WHEN k = 0 THEN 'NO_EVIDENCE' WHEN k = 1 THEN 'SINGLE_CASE' ELSE 'DESCRIPTIVE_COMPARISON' END AS availability, row_number() OVER (PARTITION BY query_id ORDER BY entropy DESC, disagreement DESC, condition_id) AS rank FROM e2"""

QUERIES = {
    "case_states": (case_states, f"WITH {cte('assessments')}, {STATES} SELECT *, status IN ('SATISFIED', 'NOT_SATISFIED', 'CONFLICTING') AS usable FROM states"),
    "group_truth": (group_values, f"WITH {cte('members', 'assessments')}, {STATES} {truth_sql(USABLE, 'case_id')}"),
    "compatible_rules": (compatible, f"WITH {cte('members', 'known', 'scope')}, ug AS ({truth_sql('SELECT * FROM known', 'query_id', chr(39).join(('role = ', 'CORE', '')))}) SELECT * FROM scope WHERE (query_id, rule_id) NOT IN (SELECT ug.query_id, m.rule_id FROM ug JOIN members m USING (group_id) WHERE NOT ug.value)"),
    "compare_conditions": (compared, f"WITH {COMPARED} SELECT * FROM compared"),
    "case_roles": (roles, f"WITH {ROLES} SELECT query_id, case_id, same, different, core_agree, core_conflict, unknown, coverage, role, reason FROM roles"),
    "role_pool": (role_pool, f"WITH {POOL} SELECT query_id, case_id, role, coverage, score, place FROM pool"),
    "role_top": (role_top, f"WITH {POOL} SELECT query_id, role, case_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY coverage DESC, score DESC, case_id) AS rank FROM pool WHERE role IS NOT NULL) WHERE rank <= 3"),
    "condition_counts": (counts, f"WITH {COUNTS} SELECT * FROM counts"),
    "condition_ranks": (condition_ranks, f"WITH {RANKS}"),
}
