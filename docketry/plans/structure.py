"""Queries of pages and articles, condition states from judgments, and the audit and history of sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import bridges as B
from docketry.operators import cases as C
from docketry.operators import pages as P
from docketry.operators import sessions as S
from docketry.sources.tables import from_sql, table

# A page is an order; its lines are articles, what follows them, headings, and articles numbered one again; some pages count backwards.
LINES = """SELECT page_id, line, n, k, words, CASE WHEN k < 6 THEN '第' || substr('一二三四五六七', n, 1) || '条 ' || words WHEN k < 8 THEN words WHEN k = 8 THEN '第一章 总则' ELSE '第一条 ' END AS text FROM
  (SELECT CAST(l_orderkey AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS line, CAST(CASE WHEN l_orderkey % 9 = 0 THEN 8 - l_linenumber ELSE l_linenumber END AS INTEGER) AS n, l_partkey % 10 AS k, l_linestatus || ' ' || l_returnflag AS words FROM {lineitem}) x"""
EXPECTED = "SELECT CAST(l_orderkey AS BIGINT) AS page_id, count(*) AS last FROM {lineitem} GROUP BY 1"
STORED = "SELECT page_id, CAST(n AS BIGINT) AS number, min(CASE WHEN k = 3 THEN words || ' 改' ELSE words END) AS stored FROM ({lines}) y WHERE k < 6 GROUP BY 1, 2"


def page_lines(s, d):
    return P.page_lines(table(s, d, "pages"))


def page_compare(s, d):
    """Every line of a page as an article; of every third the stored text is missing, of every fourth it differs."""
    lines = page_lines(s, d).where("line is not null")
    stored = lines.where("line % 3 <> 0").select("page_id", F.col("line").alias("number"), F.when(F.col("line") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("stored"))
    return P.compare_articles(lines.select("page_id", F.col("line").alias("first_line"), F.col("line").alias("number"), P.compact(F.col("text")).alias("text")), stored)


def lines(s, d):
    return from_sql(s, d, LINES, "lineitem")


def article_texts(s, d):
    return P.articles(lines(s, d))


def article_issues(s, d):
    return P.article_issues(article_texts(s, d), from_sql(s, d, EXPECTED, "lineitem"))


def article_compare(s, d):
    return P.compare_articles(article_texts(s, d), from_sql(s, d, STORED.replace("{lines}", LINES), "lineitem"))


SAID = ["双方签订服务合同。", "原告支付课程费用若干元。", "被告收取维修费。", "门店已经关闭。", "被告称正常营业。", "尚有12次课未上。", "被告提出转让会籍。", "新店距离较远。", "未经原告同意。", "原告购买课程。"]


def said(place: str) -> str:
    return f"CASE {place} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SAID)) + " END"


JUDGMENTS = f"""SELECT CAST(o_orderkey AS BIGINT) AS case_id, {said('o_orderkey % 10')} || '|' || {said('o_custkey % 10')} || '|' || {said('(o_orderkey + o_custkey) % 7 + 3')} AS said,
  CASE o_custkey % 4 WHEN 0 THEN '本院认为，合同有效。原告交纳的课程费用应予返还。' WHEN 1 THEN '剩余课程应当退费；其他不论。' WHEN 2 THEN '费用已支付。' END AS reasoning,
  CASE o_orderkey % 3 WHEN 0 THEN ' 解除双方签订的服务合同；退还费用。' WHEN 1 THEN '驳回诉讼请求。' END AS holding FROM {{orders}}"""


def condition_bridges(s, d):
    return B.condition_states(from_sql(s, d, JUDGMENTS, "orders").withColumn("sentences", F.split("said", "\\|")))


RAW = """SELECT CASE WHEN o_orderkey % 5 > 0 THEN 'case.' || CAST(o_orderkey AS VARCHAR(12)) END AS case_id, CASE WHEN o_orderkey % 7 > 0 THEN '甲诉乙案' || CAST(o_orderkey AS VARCHAR(12)) ELSE 't' || CAST(o_orderkey AS VARCHAR(12)) END AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '民初1号' END AS case_no,
  CASE WHEN o_orderkey % 4 = 0 THEN '刑事' ELSE '民事' END AS case_category, CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE '一院' END AS court_name, '二院' AS court, '2020年' || CAST(o_orderkey % 12 + 1 AS VARCHAR(2)) || '月5日' AS judgment_date, CASE WHEN o_orderkey % 2 = 0 THEN '服务合同' END AS case_cause,
  '自述事实。' AS case_facts, '自述理由，依照《中华人民共和国民法典》第五百六十三条。' AS judgment_reasoning, CASE WHEN o_orderkey % 2 = 1 THEN '概要' END AS judgment_summary,
  CASE o_custkey % 3 WHEN 0 THEN '# 案' || chr(10) || '## 基本案情' || chr(10) || '查明甲。' || chr(10) || '## 裁判理由' || chr(10) || '理由乙。' || chr(10) || '## 裁判结果' || chr(10) || '结果丙。' WHEN 1 THEN '## 基本案情' || chr(10) || '查明丁。结果戊。' || chr(10) || '## 裁判结果' || chr(10) || '结果戊。' END AS full_document, o_custkey % 3 AS shape FROM {orders}"""


def light_records(s, d):
    raw = from_sql(s, d, RAW, "orders").withColumn("keywords", F.when(F.col("shape") == 0, F.array(F.lit("a"), F.lit("b"))))
    out = C.light_records(raw)
    return out.withColumn("keywords", F.array_join("keywords", ",")).withColumn("related_provision_ids", F.array_join("related_provision_ids", ",")).withColumn("judgment_date", F.col("judgment_date").cast("string"))


# A session is a conversation, its answers are the turns after the first, and a snapshot is kept after each turn.
TURNS = "SELECT CAST(conv_id AS BIGINT) AS session_id, CAST(turn AS BIGINT) AS turn, text AS answer, role FROM {conversations}"
SHOTS = """SELECT session_id, turn, CASE WHEN (session_id * 3 + turn) % 19 = 0 THEN 'x' ELSE q END AS initial_query, history FROM (SELECT session_id, turn, first_value(answer) OVER (PARTITION BY session_id ORDER BY turn) AS q,
  array_agg(md5(CASE WHEN (session_id + turn) % 23 = 0 THEN 'x' ELSE answer END)) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history FROM ({turns}) t) u"""
HELD = """SELECT b.session_id, b.turn, a.turn AS fact_id, a.turn AS source_turn, CASE WHEN (a.session_id + a.turn) % 17 = 0 THEN 'zz' ELSE '' END || substr(a.answer, 1, 12) || CASE WHEN (a.session_id * 7 + a.turn) % 11 = 0 AND b.turn = a.turn + 2 THEN '!' ELSE '' END AS text
  FROM ({turns}) a JOIN ({turns}) b ON a.session_id = b.session_id AND a.turn <= b.turn WHERE NOT ((a.session_id + a.turn) % 13 = 0 AND b.turn > a.turn + 1)"""
STATES = "SELECT session_id, turn, role AS condition_id, CASE (session_id + turn) % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS status, (session_id * 5 + turn) % 4 AS n_facts FROM ({turns}) t"


def turn_audit(s, d):
    turns, given = from_sql(s, d, TURNS, "conversations"), lambda text: from_sql(s, d, text.replace("{turns}", TURNS), "conversations")
    first = turns.groupBy("session_id").agg(F.min_by("answer", "turn").alias("initial_query"))
    return S.turn_audit(first, turns.where("turn > 0"), given(REWRITTEN), given(HELD), given(STATES))


REWRITTEN = """SELECT session_id, turn, initial_query, CASE WHEN (session_id + turn) % 7 = 0 THEN array_agg(md5('x')) OVER (PARTITION BY session_id, turn) ELSE history END AS history FROM (""" + SHOTS + ") v"
ASKED = "SELECT CAST(user_id AS BIGINT) AS session_id, event_type AS condition_id, CAST(event_id AS BIGINT) AS turn FROM {events} WHERE event_id % 4 = 0"
ANSWERS = "SELECT CAST(user_id AS BIGINT) AS session_id, event_type AS condition_id, CAST(event_id AS BIGINT) AS turn, CASE event_id % 7 WHEN 0 THEN '不知道' WHEN 1 THEN ' ' WHEN 2 THEN ' 不清楚' WHEN 3 THEN '已经付款' WHEN 4 THEN '说不清' ELSE '不确定' END AS answer FROM {events} WHERE event_id % 4 IN (1, 2)"
REFUSALS = "SELECT CAST(user_id AS BIGINT) AS session_id, event_type AS condition_id, CAST(event_id AS BIGINT) AS turn, CASE WHEN event_id % 3 = 0 THEN 'UNABLE' ELSE 'DECLINED' END AS kind FROM {events} WHERE event_id % 4 = 3 AND event_id % 5 = 0"
DECIDED = "SELECT CAST(user_id AS BIGINT) AS session_id, event_type AS condition_id, CASE user_id % 3 WHEN 0 THEN 'SATISFIED' WHEN 1 THEN 'UNKNOWN' ELSE 'NOT_SATISFIED' END AS status, count(*) % 2 AS n_evidence FROM {events} GROUP BY 1, 2, user_id % 3"


def history_guard(s, d):
    return S.history_guard(*(from_sql(s, d, text, "events") for text in (ASKED, ANSWERS, REFUSALS, DECIDED)))


def sql(text: str) -> str:
    """A stand-in over DuckDB's views."""
    for name, filled in (("turns", TURNS), ("lines", LINES), *((t, t) for t in ("lineitem", "orders", "events", "conversations"))):
        text = text.replace(f"{{{name}}}", filled)
    return text


HAN = "零一二三四五六七八九十百千"
ARTICLES_SQL = f"""x AS ({sql(LINES)}), mk AS (SELECT *, regexp_matches(text, '^第[{HAN}]+条') AS b, regexp_matches(text, '^第[{HAN}]+(?:分?编|章|节)|^附\\s*则$') AS h FROM x),
gr AS (SELECT *, sum(CASE WHEN b OR h THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line) AS g FROM mk),
ar AS (SELECT page_id, min(line) AS first_line, max(CASE WHEN b THEN strpos('一二三四五六七', substr(text, 2, 1)) END) AS number, string_agg(regexp_replace(regexp_replace(text, '^第[{HAN}]+条', ''), '\\s', '', 'g'), '' ORDER BY line) AS text FROM gr GROUP BY page_id, g HAVING bool_or(b))"""
ISSUES_SQL = f"""WITH {ARTICLES_SQL}, ex AS ({sql(EXPECTED)}), co AS (SELECT page_id, last, count(number) - count(DISTINCT number) AS duplicate, last - count(DISTINCT CASE WHEN number BETWEEN 1 AND last THEN number END) AS missing, count(CASE WHEN number > last THEN 1 END) AS unexpected,
  (SELECT count(*) FROM ar p WHERE p.page_id = ex.page_id AND EXISTS (SELECT 1 FROM ar q WHERE q.page_id = p.page_id AND q.first_line < p.first_line AND q.number > p.number)) AS out_of_order, count(CASE WHEN text = '' THEN 1 END) AS empty FROM ex LEFT JOIN ar USING (page_id) GROUP BY page_id, last)
SELECT * FROM (UNPIVOT (SELECT page_id, duplicate, missing, unexpected, out_of_order, empty FROM co) ON duplicate, missing, unexpected, out_of_order, empty INTO NAME issue VALUE n) WHERE n > 0"""
COMPARE_SQL = f"""WITH {ARTICLES_SQL}, st AS (SELECT page_id, number, regexp_replace(stored, '\\s', '', 'g') AS stored FROM ({sql(STORED)})), ow AS (SELECT page_id, number, arg_min(text, first_line) AS text FROM ar GROUP BY 1, 2),
me AS (SELECT coalesce(ow.page_id, st.page_id) AS page_id, coalesce(ow.number, st.number) AS number, text, coalesce(text = stored, FALSE) AS ok FROM ow FULL JOIN st ON ow.page_id = st.page_id AND ow.number = st.number)
SELECT page_id, count(text) AS compared, coalesce(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (WHERE NOT ok), '') AS mismatched, sha256(coalesce(string_agg(CAST(number AS VARCHAR) || chr(9) || text, chr(10) ORDER BY number) FILTER (WHERE text IS NOT NULL), '')) AS digest,
CASE WHEN bool_and(ok) THEN 'passed' ELSE 'failed' END AS status FROM me GROUP BY page_id"""


def pick(of: str, cue: str) -> str:
    return f"list_filter({of}, lambda z: regexp_matches(z, '{cue}'))[1]"


BRIDGES_SQL = f"""WITH j AS (SELECT case_id, string_split(said, '|') AS f, list_transform(regexp_extract_all(coalesce(reasoning, ''), '[^。；\\n]+[。；]?'), lambda z: trim(z)) AS r, trim(coalesce(holding, '')) AS h FROM ({sql(JUDGMENTS)})),
q AS (SELECT case_id, {pick('f', B.CONTRACT)} AS c, {pick('f', B.PAYMENT)} AS p, {pick('f', B.OTHER_FEE)} AS o, {pick('r', B.PAYMENT + '|' + B.RECOGNISED)} AS pr, {pick('f', B.IMPOSSIBLE)} AS i, {pick('f', B.STILL_OPEN)} AS s, {pick('f', B.UNPERFORMED)} AS u, {pick('r', B.UNPERFORMED)} AS ur,
  coalesce({pick('f', B.TOO_FAR)}, {pick('f', B.REFUSED)}) AS n, {pick('f', B.ALTERNATIVE)} AS a, CASE WHEN regexp_matches(h, '{B.TERMINATED}') THEN h END AS t FROM j),
w AS (SELECT case_id, unnest([
  CASE WHEN c IS NOT NULL THEN row('contract_exists', 'SATISFIED', 0.7::DOUBLE, '{B.FACTS}', c) ELSE row('contract_exists', 'UNKNOWN', 0.3::DOUBLE, NULL, NULL) END,
  CASE WHEN p IS NOT NULL THEN row('payment_made', 'SATISFIED', 0.7::DOUBLE, '{B.FACTS}', p) WHEN o IS NULL AND pr IS NOT NULL THEN row('payment_made', 'SATISFIED', 0.55::DOUBLE, '{B.REASONS}', pr) ELSE row('payment_made', 'UNKNOWN', 0.3::DOUBLE, NULL, NULL) END,
  CASE WHEN i IS NOT NULL THEN row('performance_impossible', 'SATISFIED', 0.7::DOUBLE, '{B.FACTS}', i) WHEN s IS NOT NULL THEN row('performance_impossible', 'NOT_SATISFIED', 0.65::DOUBLE, '{B.FACTS}', s) ELSE row('performance_impossible', 'UNKNOWN', 0.3::DOUBLE, NULL, NULL) END,
  CASE WHEN u IS NOT NULL THEN row('unperformed_balance', 'SATISFIED', 0.65::DOUBLE, '{B.FACTS}', u) WHEN ur IS NOT NULL THEN row('unperformed_balance', 'SATISFIED', 0.55::DOUBLE, '{B.REASONS}', ur) ELSE row('unperformed_balance', 'UNKNOWN', 0.3::DOUBLE, NULL, NULL) END,
  CASE WHEN n IS NOT NULL THEN row('alternative_performance', 'NOT_SATISFIED', 0.65::DOUBLE, '{B.FACTS}', n) WHEN a IS NOT NULL THEN row('alternative_performance', 'UNKNOWN', 0.4::DOUBLE, '{B.FACTS}', a) ELSE row('alternative_performance', 'UNKNOWN', 0.3::DOUBLE, NULL, NULL) END,
  CASE WHEN t IS NOT NULL THEN row('contract_terminated', 'SATISFIED', 0.6::DOUBLE, '{B.RESULT}', t) ELSE row('contract_terminated', 'UNKNOWN', 0.3::DOUBLE, NULL, NULL) END]) AS z FROM q)
SELECT case_id, z[1] AS condition, z[2] AS status, z[3] AS confidence, z[4] AS section, z[5] AS quote FROM w"""
AUDIT_SQL = f"""WITH tu AS ({sql(TURNS)}), sh AS ({sql(REWRITTEN)}), fa AS ({sql(HELD)}), st AS ({sql(STATES)}), fi AS (SELECT session_id, arg_min(answer, turn) AS q FROM tu GROUP BY 1), pr AS (SELECT session_id, turn, lag(turn) OVER (PARTITION BY session_id ORDER BY turn) AS prior FROM sh),
ol AS (SELECT p.session_id, p.turn, f.fact_id, f.text, f.source_turn FROM pr p JOIN fa f ON f.session_id = p.session_id AND f.turn = p.prior),
al AS (SELECT s.session_id, s.turn, 'protected_changed' AS issue FROM sh s JOIN pr USING (session_id, turn) JOIN fi USING (session_id) LEFT JOIN sh o ON o.session_id = s.session_id AND o.turn = pr.prior WHERE s.initial_query <> fi.q OR (o.history IS NOT NULL AND s.history[1:len(o.history)] <> o.history)
 UNION ALL SELECT ol.session_id, ol.turn, 'fact_changed' FROM ol LEFT JOIN fa f ON f.session_id = ol.session_id AND f.turn = ol.turn AND f.fact_id = ol.fact_id WHERE f.fact_id IS NULL OR f.text <> ol.text OR f.source_turn <> ol.source_turn
 UNION ALL SELECT f.session_id, f.turn, 'fact_unquoted' FROM fa f JOIN fi USING (session_id) LEFT JOIN tu t ON t.session_id = f.session_id AND t.turn = f.source_turn AND t.turn > 0 WHERE (f.session_id, f.turn, f.fact_id) NOT IN (SELECT session_id, turn, fact_id FROM ol) AND NOT coalesce(contains(CASE WHEN f.source_turn = 0 THEN fi.q ELSE t.answer END, f.text), FALSE)
 UNION ALL SELECT session_id, turn, 'state_unreferenced' FROM st WHERE status <> 'UNKNOWN' AND n_facts = 0)
SELECT session_id, turn, issue, count(*) AS n FROM al GROUP BY 1, 2, 3"""
GUARD_SQL = f"""WITH q AS ({sql(ASKED)}), an AS ({sql(ANSWERS)}), re AS ({sql(REFUSALS)}), st AS ({sql(DECIDED)}),
l AS (SELECT q.session_id, q.condition_id, q.turn, arg_max(trim(answer), an.turn) AS last FROM q LEFT JOIN an ON an.session_id = q.session_id AND an.condition_id = q.condition_id AND an.turn <= q.turn GROUP BY 1, 2, 3),
k AS (SELECT q.session_id, q.condition_id, q.turn, bool_or(kind = 'UNABLE') AS u, bool_or(kind = 'DECLINED') AS d FROM q LEFT JOIN re ON re.session_id = q.session_id AND re.condition_id = q.condition_id AND re.turn <= q.turn GROUP BY 1, 2, 3)
SELECT session_id, condition_id, turn, CASE WHEN u THEN 'USER_UNABLE' WHEN d THEN 'USER_DECLINED' WHEN last NOT IN ('', '不清楚', '不知道', '不了解', '不确定', '说不清', '暂不回答') THEN 'ALREADY_ANSWERED' WHEN status IN ('SATISFIED', 'NOT_SATISFIED') AND n_evidence > 0 THEN 'ALREADY_EVIDENCED' ELSE 'MISSING' END AS outcome
FROM l JOIN k USING (session_id, condition_id, turn) LEFT JOIN st USING (session_id, condition_id)"""

LIGHT_SQL = f"""SELECT coalesce(case_id, 'case.' || substr(sha1(title), 1, 12)) AS case_id, title, nullif(case_no, '') AS case_no, coalesce(nullif(court_name, ''), court) AS court, strftime(make_date(2020, regexp_extract(judgment_date, '年(\\d+)月', 1)::BIGINT, 5), '%Y-%m-%d') AS judgment_date, case_cause AS cause,
CASE shape WHEN 0 THEN 'a,b' ELSE '' END AS keywords, CASE shape WHEN 0 THEN '查明甲。' || chr(10) || '结果丙。' WHEN 1 THEN '查明丁。结果戊。' ELSE case_facts END AS facts_text, CASE shape WHEN 0 THEN '理由乙。' ELSE judgment_reasoning END AS reasoning_text, coalesce(judgment_summary, '') AS summary,
CASE shape WHEN 0 THEN '' ELSE 'provision.0563' END AS related_provision_ids, 'L1' AS maturity FROM ({sql(RAW)}) WHERE case_category = '民事'"""

QUERIES = {
    "page_lines": (page_lines, None),
    "page_compare": (page_compare, None),
    "article_texts": (article_texts, f"WITH {ARTICLES_SQL} SELECT * FROM ar"),
    "article_issues": (article_issues, ISSUES_SQL),
    "article_compare": (article_compare, COMPARE_SQL),
    "light_records": (light_records, LIGHT_SQL),
    "condition_bridges": (condition_bridges, BRIDGES_SQL),
    "turn_audit": (turn_audit, AUDIT_SQL),
    "history_guard": (history_guard, GUARD_SQL),
}
