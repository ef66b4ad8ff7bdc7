"""Queries of sessions, streams and experiments. A session is an event's user, a condition its type, a fact the event, a turn its day."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import experiments as X
from docketry.operators import sessions as S
from docketry.sources.tables import from_sql, table

EVIDENCE = """SELECT user_id AS session_id, event_type AS condition_id, event_id AS fact_id, CASE WHEN value >= 20 THEN 'SUPPORTS' WHEN value >= 8 THEN 'OPPOSES' ELSE 'QUALIFIES' END AS relation,
  CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, CAST(day(ts) AS BIGINT) AS turn FROM {events}"""
CORRECTED = "SELECT DISTINCT user_id AS session_id, event_id AS fact_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS condition_id FROM {events} WHERE event_id % 11 = 0"


def evidence(s, d):
    return from_sql(s, d, EVIDENCE, "events")


def corrections(s, d):
    return from_sql(s, d, CORRECTED, "events")


def evidence_states(s, d):
    return S.states(evidence(s, d))


def merged_evidence(s, d):
    e = evidence(s, d)
    new = e.where("fact_id % 3 = 0").withColumn("confidence", F.lit(0.99))
    return S.merge_evidence(e, new, corrections(s, d)).select("session_id", "condition_id", "fact_id", "confidence")


def ledger(s, d):
    rows = evidence(s, d).where("fact_id % 2 = 0").select("session_id", "fact_id", "condition_id")
    return rows.withColumns({"definition_version": F.lit("1"), "mapper_version": F.when(F.col("fact_id") % 4 == 0, "1").otherwise("0"), "text_version": F.lit("1")})


def delta(s, d):
    facts = evidence(s, d).select("session_id", "fact_id", F.lit("1").alias("text_version"))
    conditions = evidence(s, d).select("session_id", "condition_id").distinct().withColumns({"definition_version": F.lit("1"), "mapper_version": F.lit("1")})
    return S.delta_pairs(facts, conditions, ledger(s, d), corrections(s, d))


def delta_pairs(s, d):
    return delta(s, d).select("session_id", "fact_id", "condition_id")


def ledger_rows(s, d):
    hit = evidence(s, d).where("relation <> 'QUALIFIES'")
    return S.ledger_rows(delta(s, d), hit).groupBy("outcome").agg(F.count("*").alias("n"))


def cleaned_ledger(s, d):
    return S.drop_corrected(ledger(s, d), corrections(s, d)).select("session_id", "fact_id", "condition_id")


def effective_facts(s, d):
    return S.effective_facts(evidence(s, d).select("session_id", "fact_id"), corrections(s, d))


def first_facts(s, d):
    sessions = table(s, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("initial_query"))
    facts = table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("fact_id"), F.col("event_type").alias("text"), F.lit(1).cast("long").alias("turn"))
    return S.initial_facts(sessions, facts).groupBy("turn").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


def links(s, d):
    """Evidence links quote the type of their event; a quote that stands in several facts of a session is refused."""
    rows = table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("condition_id"), F.concat(F.lit("#"), F.col("event_id").cast("string"), F.lit(".")).alias("quote"), F.when(F.col("event_id") % 5 == 0, "MAYBE").otherwise("SUPPORTS").alias("relation"), (F.col("value") / 10).alias("confidence"), F.col("event_id").alias("pos"))
    facts = table(s, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("fact_id"), F.concat(F.lit("fact #"), F.col("event_id").cast("string"), F.lit(".")).alias("text"), F.lit(1).cast("long").alias("turn"))
    due = evidence(s, d).where("fact_id % 7 <> 0").select("session_id", "fact_id", "condition_id")
    return S.accept_links(rows, facts, due).select("session_id", "condition_id", "fact_id", F.round("confidence", 6).alias("confidence"))


def dispositions(s, d):
    text = F.when(F.col("turn") % 3 == 0, F.lit("don't know")).when(F.col("turn") % 3 == 1, F.concat(F.lit("rather not, "), F.substring("text", 1, 30))).otherwise(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", S.disposition(text).alias("disposition"))


def drafts(s, d):
    rows = from_sql(s, d, "SELECT user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE substr(event_type, 1, 2) || ' ' || substr(event_type, 3) END AS description, array(CAST(event_id % 5 AS STRING)) AS condition_ids, CAST(event_id % 3 AS BIGINT) AS strictness FROM {events}", "events")
    return S.merge_drafts(rows)


CANDIDATES = """SELECT user_id AS session_id, event_type AS condition_id, CAST(event_id % 9 AS BIGINT) AS rule_rank, CASE event_id % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'CONFLICTING' WHEN 2 THEN 'SATISFIED' ELSE 'UNKNOWN' END AS status,
  event_id % 2 = 0 AS core, event_id % 2 = 1 AS diagnostic, event_id % 6 = 0 AS core_open, event_id % 5 = 0 AS split, event_id % 8 = 0 AS asked, event_id % 13 <> 0 AS answerable FROM {events}"""


def question_candidates(s, d):
    return S.candidates(from_sql(s, d, CANDIDATES, "events")).select("session_id", "condition_id", F.col("tier").cast("long").alias("tier"), "rule_rank")


def next_questions(s, d):
    cards = table(s, d, "events").where("event_type <> 'error'").select(F.col("event_type").alias("condition_id"))
    return S.next_questions(question_candidates(s, d), cards)


def evidence_pack(s, d):
    items = table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.length("text").cast("long").alias("size"))
    return S.pack(items, 1500)


def calibration(s, d):
    samples = table(s, d, "lineitem").select(F.col("l_linestatus").alias("dataset"), F.round("l_discount", 2).alias("score"), (F.col("l_quantity") < 25 + 100 * F.col("l_discount")).alias("hit"))
    return S.calibrate(samples).select("dataset", "score", F.round("value", 9).alias("value"))


RUNS = """SELECT o_orderkey AS sample_id, 'v' || CAST(o_orderkey % 3 AS VARCHAR(1)) AS variant, o_orderpriority AS category, CASE WHEN o_orderkey % 4 = 0 THEN 'STOP' ELSE 'ASK' END AS expected,
  CASE WHEN o_orderkey % 17 = 0 THEN 'ERROR' WHEN o_orderkey % 5 = 0 THEN 'STOP' ELSE 'ASK' END AS actual, o_orderstatus = 'F' AS target_hit, o_custkey % 10 = 0 AS repeats, CAST(o_orderkey % 6 AS BIGINT) AS calls, o_totalprice AS seconds FROM {orders}"""


def run_summaries(s, d):
    return X.run_summaries(from_sql(s, d, RUNS, "orders"))


def review_scores(s, d):
    return X.review_scores(from_sql(s, d, RUNS, "orders"))


def run_metrics(s, d):
    return X.run_metrics(from_sql(s, d, RUNS, "orders"))


CANDIDATE = "SELECT doc_id AS sample_id, CAST(length(text) AS VARCHAR(9)) AS input_sha256 FROM {documents}"
REVIEWED = "SELECT l.doc_id AS sample_id, CASE WHEN toxic = 1 THEN 'PENDING' WHEN quality = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS decision, CASE WHEN l.doc_id % 9 = 0 THEN 'x' ELSE CAST(length(text) AS VARCHAR(9)) END AS input_sha256 FROM {labels} l LEFT JOIN {documents} d ON d.doc_id = l.doc_id"


def frozen_dataset(s, d):
    return X.freeze(from_sql(s, d, CANDIDATE, "documents"), from_sql(s, d, REVIEWED, "labels", "documents"))


SPOKEN = "SELECT CAST(conv_id AS BIGINT) AS session_id, CAST(turn AS BIGINT) AS turn, role FROM {conversations}"
ENDS = "SELECT DISTINCT CAST(conv_id AS BIGINT) AS session_id, CASE conv_id % 3 WHEN 0 THEN 'NO_CANDIDATE' ELSE 'BUDGET' END AS stop_reason FROM {conversations} WHERE conv_id % 5 > 0"
REACHED = "SELECT CAST(conv_id AS BIGINT) AS session_id, CAST(turn AS BIGINT) AS condition_id, CASE WHEN length(text) % 3 = 0 THEN 'UNKNOWN' ELSE 'SATISFIED' END AS status FROM {conversations}"


def run_log(s, d):
    return X.run_log(*(from_sql(s, d, x, "conversations") for x in (SPOKEN, ENDS, REACHED)))


E_SQL, C_SQL = EVIDENCE.format(events="events"), CORRECTED.format(events="events")
R_SQL = RUNS.format(orders="orders")
LEDGER_SQL = "SELECT session_id, fact_id, condition_id, CASE WHEN fact_id % 4 = 0 THEN '1' ELSE '0' END AS m FROM e WHERE fact_id % 2 = 0"
DELTA_SQL = f"""e AS ({E_SQL}), c AS ({C_SQL}), l AS ({LEDGER_SQL}), dl AS (SELECT f.session_id, f.fact_id, k.condition_id FROM (SELECT session_id, fact_id FROM e) f JOIN (SELECT DISTINCT session_id, condition_id FROM e) k USING (session_id)
  WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.session_id = f.session_id AND l.fact_id = f.fact_id AND l.condition_id = k.condition_id AND l.m = '1') AND NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = f.session_id AND c.fact_id = f.fact_id AND (c.condition_id IS NULL OR c.condition_id = k.condition_id)))"""
CAND_SQL = f"""ca AS (SELECT session_id, condition_id, tier, rule_rank FROM (SELECT *, CASE WHEN status = 'CONFLICTING' OR (core AND core_open) THEN 0 WHEN split THEN 1 WHEN diagnostic THEN 2 END AS tier FROM ({CANDIDATES.format(events='events')})
  WHERE NOT asked AND answerable AND status IN ('UNKNOWN', 'CONFLICTING')) WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, condition_id ORDER BY tier, rule_rank) = 1)"""

QUERIES = {
    "evidence_states": (evidence_states, f"""WITH e AS ({E_SQL}), x AS (SELECT *, max(turn) FILTER (WHERE relation <> 'QUALIFIES') OVER (PARTITION BY session_id, condition_id) AS last FROM e)
      SELECT session_id, condition_id, CASE WHEN y AND n THEN 'CONFLICTING' WHEN y THEN 'SATISFIED' WHEN n THEN 'NOT_SATISFIED' ELSE 'UNKNOWN' END AS status, CASE WHEN y AND n THEN least(0.7, c) ELSE c END AS confidence, t AS last_updated_turn FROM
      (SELECT session_id, condition_id, bool_or(turn = last AND relation = 'SUPPORTS') AS y, bool_or(turn = last AND relation = 'OPPOSES') AS n, max(CASE WHEN turn = last AND relation <> 'QUALIFIES' THEN confidence END) AS c, max(last) AS t FROM x GROUP BY 1, 2)"""),
    "merged_evidence": (merged_evidence, f"WITH e AS ({E_SQL}), c AS ({C_SQL}) SELECT session_id, condition_id, fact_id, CASE WHEN fact_id % 3 = 0 THEN 0.99 ELSE confidence END AS confidence FROM e WHERE fact_id % 3 = 0 OR (session_id, fact_id) NOT IN (SELECT session_id, fact_id FROM c)"),
    "delta_pairs": (delta_pairs, f"WITH {DELTA_SQL} SELECT * FROM dl"),
    "ledger_rows": (ledger_rows, f"WITH {DELTA_SQL} SELECT CASE WHEN h.fact_id IS NULL THEN 'NO_RELEVANT_EVIDENCE' ELSE 'MAPPED' END AS outcome, count(*) AS n FROM dl LEFT JOIN (SELECT DISTINCT session_id, fact_id, condition_id FROM e WHERE relation <> 'QUALIFIES') h USING (session_id, fact_id, condition_id) GROUP BY 1"),
    "cleaned_ledger": (cleaned_ledger, f"WITH e AS ({E_SQL}), c AS ({C_SQL}), l AS ({LEDGER_SQL}) SELECT session_id, fact_id, condition_id FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = l.session_id AND c.fact_id = l.fact_id AND (c.condition_id IS NULL OR c.condition_id = l.condition_id))"),
    "effective_facts": (effective_facts, f"WITH e AS ({E_SQL}), c AS ({C_SQL}) SELECT e.session_id, e.fact_id, coalesce(c.condition_id, '') AS inactive FROM e LEFT JOIN c USING (session_id, fact_id) WHERE c.fact_id IS NULL OR c.condition_id IS NOT NULL"),
    "initial_facts": (first_facts, "SELECT CAST(1 AS BIGINT) AS turn, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events UNION ALL SELECT 0, count(*), count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"),
    "accepted_links": (links, "SELECT user_id AS session_id, event_type AS condition_id, event_id AS fact_id, round(greatest(0, least(1, value / 10)), 6) AS confidence FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0"),
    "answer_dispositions": (dispositions, "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'UNABLE' WHEN turn % 3 = 1 THEN CASE WHEN length(regexp_replace(substr(text, 1, 30), '[ \\t\\r\\n,.，。、!！?？]', '', 'g')) > 6 THEN 'MIXED' ELSE 'DECLINED' END ELSE 'FACTS_PROVIDED' END AS disposition FROM conversations"),
    "merged_drafts": (drafts, "SELECT user_id AS session_id, event_type AS key, string_agg(DISTINCT (event_id % 5)::VARCHAR, ',' ORDER BY (event_id % 5)::VARCHAR) AS condition_ids, min(event_id % 3) AS strictness, count(*) AS n FROM events GROUP BY 1, 2"),
    "question_candidates": (question_candidates, f"WITH {CAND_SQL} SELECT * FROM ca"),
    "next_questions": (next_questions, f"WITH {CAND_SQL} SELECT session_id, condition_id, tier, round(1 / (tier + 1), 6) AS utility FROM ca WHERE condition_id <> 'error' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY tier, rule_rank, condition_id) = 1"),
    "evidence_pack": (evidence_pack, """WITH RECURSIVE c AS (SELECT conv_id AS session_id, turn AS pos, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      r AS (SELECT *, size <= 1500 AS taken, CASE WHEN size <= 1500 THEN size ELSE 0 END AS used FROM c WHERE i = 1 UNION ALL SELECT c.*, r.used + c.size <= 1500, CASE WHEN r.used + c.size <= 1500 THEN r.used + c.size ELSE r.used END FROM r JOIN c ON c.session_id = r.session_id AND c.i = r.i + 1)
      SELECT session_id, pos, size, taken FROM r"""),
    "calibration": (calibration, """WITH s AS (SELECT l_linestatus AS dataset, round(l_discount, 2) AS score, count(*) + 2 AS w, count(*) FILTER (WHERE l_quantity < 25 + 100 * l_discount) + 1 AS h FROM lineitem GROUP BY 1, 2),
      a AS (SELECT j.dataset, j.score, i.score AS lo, k.score AS hi, (SELECT sum(h) / sum(w) FROM s x WHERE x.dataset = j.dataset AND x.score BETWEEN i.score AND k.score) AS v FROM s j JOIN s i ON i.dataset = j.dataset AND i.score <= j.score JOIN s k ON k.dataset = j.dataset AND k.score >= j.score),
      m AS (SELECT dataset, score, lo, min(v) AS v FROM a GROUP BY 1, 2, 3), iso AS (SELECT dataset, score, max(v) AS v FROM m GROUP BY 1, 2) SELECT dataset, max(score) AS score, round(v, 9) AS value FROM iso GROUP BY dataset, round(v, 9)"""),
    "run_summaries": (run_summaries, f"SELECT variant, round(avg(ok), 6) AS mean_of_categories, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS n FROM (SELECT variant, category, avg(CASE WHEN expected = actual THEN 1.0 ELSE 0.0 END) AS ok, count(*) FILTER (WHERE actual = 'ERROR') AS errors, count(*) AS n FROM ({R_SQL}) GROUP BY 1, 2) GROUP BY 1"),
    "review_scores": (review_scores, f"SELECT variant, expected, round(count(*) FILTER (WHERE expected = actual) / count(*), 6) AS accuracy, round(count(*) FILTER (WHERE actual = 'ASK' AND target_hit AND expected = 'ASK') / nullif(count(*) FILTER (WHERE actual = 'ASK'), 0), 6) AS target_rate, round(count(*) FILTER (WHERE actual = 'ASK' AND NOT repeats) / nullif(count(*) FILTER (WHERE actual = 'ASK'), 0), 6) AS fresh_rate FROM ({R_SQL}) GROUP BY 1, 2"),
    "run_metrics": (run_metrics, f"SELECT variant, round(avg(calls), 6) AS calls, round(avg(seconds), 4) AS seconds, count(*) FILTER (WHERE actual = 'ERROR') AS errors FROM ({R_SQL}) GROUP BY 1"),
    "frozen_dataset": (frozen_dataset, f"""WITH c AS ({CANDIDATE.format(documents='documents')}), r AS (SELECT sample_id, count(*) AS n, min(decision) AS decision, min(input_sha256) AS h FROM ({REVIEWED.format(documents='documents', labels='labels')}) GROUP BY 1)
      SELECT coalesce(c.sample_id, r.sample_id) AS sample_id, CASE WHEN n IS NULL THEN 'no_decision' WHEN c.sample_id IS NULL THEN 'no_candidate' WHEN n > 1 THEN 'several_decisions' WHEN h IS DISTINCT FROM input_sha256 THEN 'hash_changed' WHEN decision = 'PENDING' THEN 'pending' WHEN decision = 'APPROVED' THEN 'frozen' ELSE 'rejected' END AS outcome
      FROM c FULL JOIN r ON c.sample_id = r.sample_id"""),
    "run_log": (run_log, """SELECT conv_id AS session_id, arg_max(role, turn) AS last_role, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, CASE WHEN conv_id % 5 = 0 THEN 'RUNNING' WHEN conv_id % 3 = 0 THEN 'NO_CANDIDATE' ELSE 'BUDGET' END AS stop_reason,
      count(DISTINCT turn) FILTER (WHERE length(text) % 3 <> 0) AS known_states FROM conversations GROUP BY conv_id"""),
}
