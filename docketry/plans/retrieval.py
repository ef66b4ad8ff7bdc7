"""Queries of retrieval and its evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import tokens
from docketry.operators import retrieval as R
from docketry.sources.tables import table

KS = [5, 10, 20]


def corpus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def topics(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def topic_qrels(s: SparkSession, d: str) -> DataFrame:
    """Relevant documents of a topic: those of the source with its number."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return topics(s, d).withColumn("source", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).join(docs, "source").select("query_id", "id")


def labels(s: SparkSession, d: str, with_lang: bool = True) -> DataFrame:
    """(id, label): source, language, quality and toxicity of documents."""
    docs = table(s, d, "documents")
    own = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("src:"), "source").alias("label"))
    if with_lang:
        own = own.union(docs.select("doc_id", F.concat(F.lit("lang:"), "lang")))
    return own.union(table(s, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic")))


TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_]+|[\\x{4e00}-\\x{9fff}]')"
BM25 = f"""
dt AS (SELECT doc_id AS id, {TOKENS} AS ts FROM documents), dl AS (SELECT id, greatest(len(ts), 1) AS dl FROM dt),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), ex AS (SELECT id, unnest(ts) AS term FROM dt), tf AS (SELECT id, term, count(*) AS tf FROM ex GROUP BY 1, 2),
idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
qt AS (SELECT query_id, term, count(*) AS m FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, tf.id, round(sum(m * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, st GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0) WHERE rank <= 20)"""
QRELS = "qr AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN documents ON source = 'src' || CAST(item_id % 20 AS VARCHAR))"
RECALL = """
cuts AS (SELECT query_id, k, count(*) AS n_relevant FROM qr, (SELECT unnest([5, 10, 20]) AS k) GROUP BY 1, 2),
rec AS (SELECT c.query_id, c.k, c.n_relevant, count(h.rank) AS n_hits, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg
  FROM cuts c LEFT JOIN (SELECT {hits}.query_id, rank FROM {hits} JOIN qr ON qr.query_id = {hits}.query_id AND qr.id = {hits}.id) h ON h.query_id = c.query_id AND h.rank <= c.k GROUP BY 1, 2, 3),
m AS (SELECT query_id, k, n_relevant, n_hits, round(n_hits / n_relevant, 6) AS recall, round(dcg / list_sum(list_transform(range(1, least(k, n_relevant) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM rec)"""


def tokenized(s, d):
    return corpus(s, d).select("id", tokens(F.col("text")).alias("ts")).select("id", F.size("ts").cast("long").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("long").alias("n_terms"), F.sha2(F.array_join("ts", " "), 256).alias("digest"))


def term_statistics(s, d):
    postings, n, _ = R.counted(corpus(s, d))
    return postings.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", F.round(R.inverse(n, F.col("df")), 6).alias("idf"))


def bm25_top(s, d):
    return R.bm25(corpus(s, d), topics(s, d), 20)


def bm25_metrics(s, d):
    return R.recall(bm25_top(s, d), topic_qrels(s, d), KS)


def bm25_recall(s, d):
    return bm25_metrics(s, d).groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("ndcg"), 6).alias("macro_ndcg"))


def vector_rows(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(s, d):
    """Every vector whose id is divisible by 20."""
    return vector_rows(s, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def cosine_top(s, d):
    return R.cosine_top(vector_rows(s, d), vector_queries(s, d), 20)


def vector_qrels(s, d):
    rows = vector_rows(s, d).select("id", "label")
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "label").join(rows, "label").select("query_id", "id")


def vector_metrics(s, d):
    return R.recall(cosine_top(s, d), vector_qrels(s, d), KS)


COSINE = """
u AS (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
cs AS (SELECT q.id AS query_id, u.id, round(list_dot_product(q.v, u.v), 6) AS score FROM u q, u WHERE q.id % 20 = 0),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs) WHERE rank <= 20 AND score > 0)"""


def channels(s, d):
    """Ranked rows of two channels for the benchmark's topics: text and label match."""
    text = bm25_top(s, d).select("query_id", F.lit("bm25").alias("channel"), "id", "rank")
    label = topic_qrels(s, d).withColumn("score", F.lit(1))
    label = R.top(label, ["query_id"], [F.desc("score"), F.asc("id")], 20).select("query_id", F.lit("claim"), "id", "rank")
    return text.union(label)


def fused(s, d):
    return R.rrf(channels(s, d), {"bm25": 1.0, "claim": 0.8}, limit=10)


CHANNELS = "lb AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM qr), ch AS (SELECT query_id, 'bm25' AS channel, id, rank FROM bm UNION ALL SELECT query_id, 'claim', id, rank FROM lb WHERE rank <= 20)"


def rrf_sql(weights: str, where: str = "TRUE", limit: int = 10) -> str:
    return f"""SELECT * FROM (SELECT query_id, id, round(sum({weights} / (60 + rank)), 9) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM ch WHERE {where} GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {limit}"""


def query_variants(s, d):
    """A query and its expansion (the first half of its words), fused within the text channel."""
    docs = R.packed(corpus(s, d))
    whole = R.bm25(docs, topics(s, d), 20).select("query_id", F.lit("original").alias("channel"), "id", "rank")
    words = F.split("text", " ")
    half = topics(s, d).select("query_id", F.array_join(F.slice(words, 1, F.greatest(F.floor(F.size(words) / 2), F.lit(1)).cast("int")), " ").alias("text"))
    return R.rrf(whole.union(R.bm25(docs, half, 20).select("query_id", F.lit("expanded"), "id", "rank")), {"original": 1.0, "expanded": 0.5}, limit=20)


def peer_counts(s, d):
    """Relevant peers of every case by label sets, evaluable or why not."""
    docs = corpus(s, d).select("id")
    found = docs.join(R.peer_counts(labels(s, d)), "id", "left")
    n = F.coalesce("n_peers", F.lit(0)).cast("long")
    return found.select("id", n.alias("n_peers"), (n > 0).alias("evaluable"), F.when(n > 0, None).when(F.col("n_peers").isNull(), "no_valid_relation_label").otherwise("no_shared_relation_peer").alias("skip_reason"))


LABELS = "lab AS (SELECT doc_id AS id, 'src:' || source AS label FROM documents UNION ALL SELECT doc_id, 'lang:' || lang FROM documents UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"


def label_counts(s, d):
    return labels(s, d).groupBy("label").agg(F.countDistinct("id").alias("cases"))


def qrels_by_source(s, d):
    """Every pair of cases that share a source, a language or toxicity, as pairs of classes of equal labels with their sizes."""
    return R.class_peers(labels(s, d)).select(F.array_join("labels", ",").alias("labels"), F.array_join("peer", ",").alias("peer"), "n", "m", "pairs")


def external_ranking(s, d):
    """Checks of an outside ranking: topics' documents of the label channel, of which some are repeated, unknown or left out."""
    ranks = channels(s, d).where("channel = 'claim' and query_id % 7 <> 3")
    ranks = ranks.withColumn("id", F.when((F.col("rank") == 2) & (F.col("query_id") % 3 == 0), -F.col("id") - 1).otherwise(F.col("id")))
    again = ranks.where("rank = 1 and query_id % 5 = 1").withColumn("rank", F.lit(99).cast("long"))
    ranked = ranks.union(again).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return R.ranking_issues(ranked, corpus(s, d), topics(s, d))


QUERIES = {
    "tokenized": (tokenized, f"SELECT doc_id AS id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_terms, sha256(array_to_string(ts, ' ')) AS digest FROM (SELECT doc_id, {TOKENS} AS ts FROM documents)"),
    "term_statistics": (term_statistics, f"WITH {BM25} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st"),
    "bm25_top": (bm25_top, f"WITH {BM25} SELECT query_id, id, score, rank FROM bm"),
    "bm25_metrics": (bm25_metrics, f"WITH {BM25}, {QRELS}, {RECALL.format(hits='bm')} SELECT * FROM m"),
    "bm25_recall": (bm25_recall, f"WITH {BM25}, {QRELS}, {RECALL.format(hits='bm')} SELECT k, count(*) AS queries, round(avg(recall), 6) AS macro_recall, round(avg(ndcg), 6) AS macro_ndcg FROM m GROUP BY k"),
    "cosine_top": (cosine_top, f"WITH {COSINE} SELECT query_id, id, score, rank FROM ct"),
    "vector_metrics": (vector_metrics, f"WITH {COSINE}, qr AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0), {RECALL.format(hits='ct')} SELECT * FROM m"),
    "rank_fusion": (fused, f"WITH {BM25}, {QRELS}, {CHANNELS}, f AS ({rrf_sql('CASE channel WHEN $$bm25$$ THEN 1.0 ELSE 0.8 END')}) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f"),
    "query_variants": (query_variants, f"""WITH {BM25}, w AS (SELECT item_id AS query_id, string_split(text, ' ') AS w FROM benchmark), half AS (SELECT query_id, array_to_string(w[1 : greatest(len(w) // 2, 1)], ' ') AS text FROM w),
      hq AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({TOKENS}) AS term FROM half) GROUP BY 1, 2),
      hs AS (SELECT query_id, tf.id, round(sum(m * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM hq JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, st GROUP BY 1, 2),
      hb AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hs WHERE score > 0 QUALIFY rank <= 20),
      ch AS (SELECT query_id, 'original' AS channel, id, rank FROM bm UNION ALL SELECT query_id, 'expanded', id, rank FROM hb), f AS ({rrf_sql('CASE channel WHEN $$original$$ THEN 1.0 ELSE 0.5 END', limit=20)})
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f"""),
    "peer_counts": (peer_counts, f"WITH {LABELS}, pe AS (SELECT a.id, count(DISTINCT b.id) AS n FROM lab a JOIN lab b ON a.label = b.label AND a.id <> b.id GROUP BY 1) SELECT doc_id AS id, coalesce(n, 0) AS n_peers, coalesce(n, 0) > 0 AS evaluable, CASE WHEN n > 0 THEN NULL WHEN doc_id IN (SELECT id FROM lab) THEN 'no_shared_relation_peer' ELSE 'no_valid_relation_label' END AS skip_reason FROM documents LEFT JOIN pe ON pe.id = doc_id"),
    "label_counts": (label_counts, f"WITH {LABELS} SELECT label, count(DISTINCT id) AS cases FROM lab GROUP BY label"),
    "qrels_by_source": (qrels_by_source, f"WITH {LABELS}, c AS (SELECT id, list_sort(list(DISTINCT label)) AS s FROM lab WHERE label IS NOT NULL GROUP BY 1), z AS (SELECT s, count(*) AS n FROM c GROUP BY 1) SELECT array_to_string(a.s, ',') AS labels, array_to_string(b.s, ',') AS peer, a.n, b.n AS m, CASE WHEN a.s = b.s THEN a.n * (a.n - 1) ELSE a.n * b.n END AS pairs FROM z a JOIN z b ON list_has_any(a.s, b.s)"),
    "external_ranking": (external_ranking, f"""WITH {QRELS}, lb AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM qr) WHERE rank <= 20 AND query_id % 7 <> 3)
      SELECT item_id AS query_id, 'missing_query' AS issue, CAST(1 AS BIGINT) AS n FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM lb) UNION ALL SELECT query_id, 'duplicate', CAST(1 AS BIGINT) FROM lb WHERE rank = 1 AND query_id % 5 = 1 UNION ALL SELECT query_id, 'unknown_case', CAST(1 AS BIGINT) FROM lb WHERE rank = 2 AND query_id % 3 = 0"""),
}
