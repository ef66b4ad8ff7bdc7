"""Queries of leave-one-out evaluation and ablations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import evaluation as E
from docketry.operators import retrieval as R
from docketry.plans.more import ASKED, RULES_SQL, rule_channels, rule_texts, tables
from docketry.plans.retrieval import KS, LABELS, TOKENS, corpus, labels
from docketry.sources.tables import from_sql, written

#: Which channels count in a variant, and with what weight.
VARIANTS = {
    "bm25": {"bm25": 1.0}, "bm25+vector": {"bm25": 1.0, "vector": 1.0}, "bm25+vector+graph": {"bm25": 1.0, "vector": 1.0, "graph": 0.25},
    "bm25+vector+graph+expanded": {"bm25": 1.0, "vector": 1.0, "graph": 0.25, "expanded": 0.5}, "all but bm25": {"vector": 1.0, "claim": 0.8, "graph": 0.25, "expanded": 0.5},
}
EXPANDED = "SELECT query_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS text FROM asked"
RELEVANT = "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS query_id, b.p_brand AS id FROM {customer} JOIN {part} a ON a.p_partkey = c_custkey JOIN {part} b ON a.p_type = b.p_type WHERE c_custkey % 20 = 0"


def asked_documents(s, d):
    """Every document whose id is divisible by 20."""
    return corpus(s, d).where("id % 20 = 0").select("id")


def leave_one_out(s, d):
    return E.leave_one_out(corpus(s, d), asked_documents(s, d), 20)


def leave_one_out_metrics(s, d):
    return E.overlap_metrics(leave_one_out(s, d), asked_documents(s, d).withColumnRenamed("id", "query_id"), labels(s, d, with_lang=False), KS)


def channel_ablation(s, d):
    """Metrics of channel variants of rule retrieval; a rule is relevant to a customer if it has a part of the type of theirs."""
    texts = rule_texts(s, d)
    some = from_sql(s, d, ASKED, "customer", "part").select("query_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"))
    ranked = written(rule_channels(s, d, texts).union(R.channel(R.bm25(texts, some, 10), "expanded")))
    # RELEVANT, but brands are met once a type instead of once a part
    of_type = written(from_sql(s, d, "SELECT DISTINCT p_type AS type, p_brand AS id FROM {part}", "part"))
    own = from_sql(s, d, "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS query_id, p_type AS type FROM {customer} JOIN {part} ON p_partkey = c_custkey WHERE c_custkey % 20 = 0", "customer", "part")
    relevant = own.join(of_type, "type").select("query_id", "id").distinct()
    return E.variant_metrics(E.fuse_variants(ranked, VARIANTS, 20), written(relevant), [5, 10, 20])


ONE_OUT = f"""dt AS (SELECT doc_id AS id, {TOKENS} AS ts FROM documents), dl AS (SELECT id, greatest(len(ts), 1) AS dl FROM dt), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM dt) GROUP BY 1, 2), idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, st GROUP BY term, n),
w AS (SELECT tf.id, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf JOIN idf USING (term) JOIN dl ON dl.id = tf.id, st),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, w.id, round(sum(q.tf * w), 4) AS score FROM tf q JOIN w USING (term) WHERE q.id % 20 = 0 AND q.id <> w.id GROUP BY 1, 2) WHERE score > 0 QUALIFY rank <= 20)"""
CONTROL = LABELS.replace("UNION ALL SELECT doc_id, 'lang:' || lang FROM documents ", "")
METRICS = f"""WITH {ONE_OUT}, {CONTROL}, q AS (SELECT doc_id AS query_id FROM documents WHERE doc_id % 20 = 0), pe AS (SELECT a.id AS query_id, b.id FROM lab a JOIN lab b ON a.label = b.label AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2),
s AS (SELECT query_id, count(*) AS n FROM pe GROUP BY 1), c AS (SELECT query_id, k, coalesce(n, 0) AS n_relevant FROM q LEFT JOIN s USING (query_id), (SELECT unnest([5, 10, 20]) AS k)),
h AS (SELECT query_id, rank FROM bm JOIN pe USING (query_id, id)),
m AS (SELECT c.query_id, c.k, n_relevant, count(rank) AS n_hits, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM c LEFT JOIN h ON h.query_id = c.query_id AND h.rank <= c.k GROUP BY 1, 2, 3)
SELECT query_id, k, n_relevant, n_hits, CASE WHEN n_relevant > 0 THEN round(n_hits / n_relevant, 6) END AS recall, CASE WHEN n_relevant > 0 THEN round(dcg / list_sum(list_transform(range(1, least(k, n_relevant) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg,
CASE WHEN n_relevant > 0 THEN NULL WHEN query_id IN (SELECT id FROM lab WHERE label IS NOT NULL) THEN 'no_shared_relation_peer' ELSE 'no_valid_relation_label' END AS skip_reason FROM m"""
MASKS = ", ".join(f"('{v}', '{c}', {w}::DOUBLE)" for v, weights in VARIANTS.items() for c, w in weights.items())
ABLATION = f"""WITH {RULES_SQL}, xq AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({TOKENS}) AS term FROM ({EXPANDED})) GROUP BY 1, 2),
xb AS (SELECT query_id, f.id, round(sum(m * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM xq JOIN rf f USING (term) JOIN ri USING (term) JOIN rl l ON l.id = f.id, rs GROUP BY 1, 2),
every AS (SELECT query_id, channel, id, rank FROM ch UNION ALL SELECT query_id, 'expanded', id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM xb WHERE score > 0 QUALIFY rank <= 10),
masks(variant, channel, weight) AS (VALUES {MASKS}), fv AS (SELECT variant, query_id, id, round(sum(weight / (60 + rank)), 9) AS score FROM every JOIN masks USING (channel) GROUP BY 1, 2, 3),
fx AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, id) AS rank FROM fv QUALIFY rank <= 20), qr AS ({tables(RELEVANT)}),
cu AS (SELECT variant, query_id, k, count(*) AS n_relevant FROM qr, (SELECT unnest([5, 10, 20]) AS k), (SELECT DISTINCT variant FROM fx) GROUP BY 1, 2, 3),
me AS (SELECT c.variant, c.query_id, c.k, n_relevant, count(h.rank) AS n, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg FROM cu c LEFT JOIN (SELECT variant, fx.query_id, rank FROM fx JOIN qr USING (query_id, id)) h ON h.variant = c.variant AND h.query_id = c.query_id AND h.rank <= c.k GROUP BY 1, 2, 3, 4)
SELECT variant, k, count(*) AS queries, round(avg(n / n_relevant), 5) AS recall, round(avg(dcg / list_sum(list_transform(range(1, least(k, n_relevant) + 1), lambda i: 1 / log2(i + 1)))), 5) AS ndcg FROM me GROUP BY 1, 2"""

QUERIES = {
    "leave_one_out": (leave_one_out, f"WITH {ONE_OUT} SELECT query_id, id, score, rank FROM bm"),
    "leave_one_out_metrics": (leave_one_out_metrics, METRICS),
    "channel_ablation": (channel_ablation, ABLATION),
}
