"""Evaluation over whole corpora: every case as a query against the others, and channels switched on and off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.joins import bounded
from docketry.operators.retrieval import RRF_K, best_by_terms, label_classes, packed, peer_counts, top
from docketry.sources.tables import written


def leave_one_out(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): for each asked id of docs (id, text) the k other documents that BM25 finds for its whole text; equal scores by id.

    Every asked document meets every other, in blocks (see best_by_terms). Ids should be distinct; a text without tokens finds nothing.
    """
    held = packed(docs)
    own = held.join(bounded(asked.select("id").distinct()), "id", "left_semi").select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return best_by_terms(held, written(own.select("query_id", F.col("x.terms").alias("term"), F.col("x.tfs").alias("m"))), k, others=True)


def overlap_metrics(hits: DataFrame, queries: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, n_relevant, n_hits, recall, ndcg, skip_reason) of ranked hits, a hit being relevant if it shares a label (id, label) with its query.

    Relevant cases are counted by classes of equal labels; only hits are compared by their labels, so that no pairs are made. Queries
    without relevant cases have a row for each k that says why, and no metrics.
    """
    own = label_classes(labels)
    said = queries.select("query_id").distinct().join(own.select(F.col("id").alias("query_id"), F.col("labels").alias("q")), "query_id", "left")
    said = said.join(peer_counts(labels).select(F.col("id").alias("query_id"), F.col("n_peers").alias("n_relevant")), "query_id", "left")
    good = hits.join(said.where("n_relevant > 0").select("query_id", "q"), "query_id").join(own, "id").where(F.arrays_overlap("q", "labels") & (F.col("query_id") != F.col("id"))).select("query_id", "rank")
    cuts = said.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside = F.col("rank") <= F.col("k")
    met = cuts.join(good, "query_id", "left").groupBy("query_id", "k", "n_relevant", F.col("q").isNull().alias("bare")).agg(F.count_if(inside).alias("n_hits"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", "n_relevant").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.coalesce(F.col("n_relevant") > 0, F.lit(False))
    return met.select(
        "query_id", "k", F.coalesce("n_relevant", F.lit(0)).cast("long").alias("n_relevant"), "n_hits", F.when(some, F.round(F.col("n_hits") / F.col("n_relevant"), 6)).alias("recall"), F.when(some, F.round(F.col("dcg") / ideal, 6)).alias("ndcg"),
        F.when(F.col("bare"), "no_valid_relation_label").when(~some, "no_shared_relation_peer").alias("skip_reason"),
    )


def fuse_variants(ranked: DataFrame, variants: dict[str, dict[str, float]], limit: int, k: int = RRF_K) -> DataFrame:
    """ranked (query_id, channel, id, rank) -> (variant, query_id, id, score, rank) for all variants at once, each a mask of channels with their weights.

    Every ranked row is dealt to the variants that count its channel, so that channels are ranked once however many variants there are.
    """
    masks = [(v, c, float(w)) for v, weights in variants.items() for c, w in weights.items() if w > 0]
    by_channel = F.create_map(*[x for c in sorted({c for _, c, _ in masks}) for x in (F.lit(c), F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(w).alias("weight")) for v, o, w in masks if o == c]))])
    first = ranked.groupBy("query_id", "channel", "id").agg(F.min("rank").alias("rank"))
    dealt = first.select("query_id", "id", "rank", F.explode(F.try_element_at(by_channel, F.col("channel"))).alias("m"))
    fused = dealt.groupBy("m.variant", "query_id", "id").agg(F.round(F.sum(F.col("m.weight") / (k + F.col("rank"))), 9).alias("score"))
    return top(fused, ["variant", "query_id"], [F.desc("score"), F.asc("id")], limit)


def variant_metrics(fused: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """(variant, k, queries, recall, ndcg): means over all queries with relevant ids (query_id, id); a query that a variant finds nothing for counts as 0."""
    sizes = qrels.groupBy("query_id").agg(F.count("*").alias("n_relevant")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    cuts = sizes.join(fused.select("variant").distinct(), how="cross")  # as many rows a query as there are variants
    good = fused.join(qrels, ["query_id", "id"]).select("variant", "query_id", "rank")
    inside = F.col("rank") <= F.col("k")
    met = cuts.join(good, ["variant", "query_id"], "left").groupBy("variant", "query_id", "k", "n_relevant").agg(F.count_if(inside).alias("n"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", "n_relevant").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return met.groupBy("variant", "k").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("n") / F.col("n_relevant")), 5).alias("recall"), F.round(F.avg(F.col("dcg") / ideal), 5).alias("ndcg"))
