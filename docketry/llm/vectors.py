"""Near-duplicate vectors by collision counting over random projections.

Unit vectors are projected onto PROJECTIONS Gaussian directions. Two vectors at the threshold's
distance d differ by N(0, d^2) on each of them, so that the window of half-width WIDTH * d around a
query holds its partner with a known probability, and the number of collisions is binomial. The count
from which a pair is verified is the largest that keeps the wanted recall at the threshold. A pair
that passes is verified by its cosine in double precision.

Equal vectors of a label form a class first; one row per class is compared, and its copies count
as links. A label's classes are dealt into blocks of about BLOCK rows by hash, and each pair of blocks
is one group: tile by tile it counts on how many projections each pair lies within the window, for all
pairs of the tile at once. A group returns one row per linked vector (its links and the root of its component
in the group), never all pairs. Every pair of a label is covered, so work grows with the square of a
label's distinct vectors, and each vector is sent to as many groups as its label has blocks.

Defined cases: null, empty or zero vectors, and those with null or non-finite components, link with
nothing, as do rows with null label or vec_id. Vectors of unequal length are not compared. Rows that
share a vec_id are each a vector; their id is one node of the components. Only vec_id, label and embedding are read, whatever
the other columns are called. Empty table: empty result.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import components, cut, join_dim, table

COSINE, PROJECTIONS, WIDTH, RECALL, BLOCK, TILE, SEED = 0.93, 48, 1.0, 0.9995, 1024, 128, 3


def least_count(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with the wanted probability."""
    p = math.erf(width / math.sqrt(2))
    tail = 0.0
    for count in range(projections, -1, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 0


@cache
def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, projections))


def linked(a: np.ndarray, b: np.ndarray, cosine: float, projections: int, width: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) of unit vectors that reach the cosine, among pairs with enough window collisions."""
    need = least_count(projections, width, recall)
    half = np.float32(width * math.sqrt(2 - 2 * cosine) * (1 + 1e-5) + 1e-6)  # wider than single precision errs: no collision is lost
    d = directions(a.shape[1], projections)
    pa_, pb = (np.ascontiguousarray((x @ d).T.astype(np.float32)) for x in (a, b))
    found = []
    for lo in range(0, len(a), TILE):
        counts = np.zeros((min(TILE, len(a) - lo), len(b)), np.uint8)
        gap, near = np.empty(counts.shape, np.float32), np.empty(counts.shape, bool)
        for p, q in zip(pa_[:, lo : lo + TILE, None], pb, strict=True):
            np.abs(np.subtract(p, q, out=gap), out=gap)
            counts += np.less_equal(gap, half, out=near).view(np.uint8)
        i, j = np.nonzero(counts >= need)
        found.append((i + lo, j))
    i, j = (np.concatenate([f[side] for f in found]) if found else np.zeros(0, np.int64) for side in (0, 1))
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        keep[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= cosine
    return i[keep], j[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, by repeated minima over links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def link_groups(cosine: float, projections: int, width: float, recall: float):
    """For applyInPandas: one group is a block, or two, of classes of a label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        own, copies, rep = pdf["own"].to_numpy(), pdf["copies"].to_numpy(), pdf["rep"].to_numpy()
        left = np.flatnonzero(own == pdf["low"].to_numpy())
        right = np.flatnonzero(own == pdf["high"].to_numpy())
        i, j = linked(x[left], x[right], cosine, projections, width, recall)
        i, j = left[i], right[j]
        if pdf["low"][0] == pdf["high"][0]:
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, copies[j], len(pdf)) + np.bincount(j, copies[i], len(pdf))
        at = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[at], "links": links[at].astype(np.int64), "root": rep[roots(len(pdf), i, j)[at]]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding")
    fine = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    usable = vectors.select("vec_id", "label", "embedding").where(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")))
    sizes = classes.groupBy(F.struct("label", "dim").alias("part")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = join_dim(classes.withColumn("part", F.struct("label", "dim")), cut(sizes), "part")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "part"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "copies", "embedding")
    found = cut(dealt.groupBy("part", "low", "high").applyInPandas(link_groups(cosine, projections, width, recall), "rep long, links long, root long"))
    merged = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = classes.join(links, "rep", "left").join(merged.withColumnRenamed("id", "rep"), "rep", "left")
    reps = cut(reps.select(F.col("label").alias("__l"), F.col("embedding").alias("__e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c")))
    rows = vectors.select("vec_id", "label", F.when(fine & F.col("vec_id").isNotNull(), e).alias("embedding"))
    out = rows.join(reps, (F.col("label") == F.col("__l")) & (F.col("embedding") == F.col("__e")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.expr("vec_id <=> coalesce(c, vec_id)").alias("kept"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS l FROM e WHERE list_dot_product(v, v) > 0 AND isfinite(list_dot_product(v, v))),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.v, y.v) / (x.l * y.l) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
d AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT m.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(c.c, m.vec_id) AS component_id, coalesce(c.c, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN d ON d.a = m.vec_id LEFT JOIN c ON c.a = m.vec_id
"""
