"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document first gets the whole copies that its source's rate
(target / size) is certain of; for the rest each document draws u, and documents are ranked by
random odds u / (1 - u) over inclusion odds. The sample of fixed size in words is the head of that
ranking, ended where the sum of words is nearest to what the target still lacks. Inclusion odds are
f / (1 - f) times `merit`, f being the rate's fraction; the default merit favours shorter documents.

The head is found without sorting a source in one task: ranks fall into RADIX bins and those of the
bin that holds the end into RADIX bins again; only the last bin, a millionth of a source, is sorted.

Defined cases: null text or no words: size 0, takes 0. Null source: a source of its own, last in order.
Sources of size 0 have target 0. Rows that agree in id and size are taken together. Empty table: empty
result. Clashing columns: plan() reads id, source and size only; apply() keeps all of a frame's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import cut, global_index, hash01, join_dim, table, word_count

WEIGHTS, CAP, SHARE, SEED, RADIX = (5.0, 2.0, 1.0), 3.0, 1.0, 20_241, 1024


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = SHARE) -> DataFrame:
    """sizes (source, source_size) -> with weight and target: share of all words by weight, none above cap times its size.

    One level L serves all: target = min(cap * size, L * weight). L rises until the excess is placed;
    each round is one aggregate over the sources.
    """
    ranked = global_index(sizes, [F.col("source").asc_nulls_last()], name="place")
    level = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", level))
    at = -1.0
    while True:
        full = F.col("source_size") * cap < F.col("weight") * at
        x = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size") * cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        raised = (share * (x["all"] or 0) - (x["full"] or 0.0)) / x["open"] if x["open"] else at
        if raised <= at:
            break
        at = raised
    return ranked.withColumn("target", F.least(F.col("source_size") * cap, F.col("weight") * F.lit(float(max(at, 0.0)))))


def rank_key(size: Column, ident: Column, merit: Column, fraction: Column, seed: int) -> Column:
    """Random odds over inclusion odds, as t = q / (1 + q) in (0, 1)."""
    u = hash01(F.lit(seed), ident.cast("string"), size)
    q = F.try_divide(u / (1 - u) * (1 - fraction), fraction * merit)  # null where no part of a copy is drawn
    return q / (1 + q)


def default_merit(size: Column) -> Column:
    return 1.0 / (1.0 + F.log2(1.0 + size / 1024.0))


def plan(items: DataFrame, seed: int = SEED, **target_options) -> DataFrame:
    """items (id, source, size) -> one row per source: target, whole copies, and where its ranking ends."""
    sums = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plans = targets(sums, **target_options).withColumn("whole", F.floor(rate + 1e-12).cast("long")).withColumn("fraction", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    plans = cut(plans.withColumn("lack", F.col("fraction") * F.col("source_size")).select("source", "source_size", "target", "whole", "fraction", "lack"))
    rows = join_dim(items, plans.where("fraction > 0"), "source")
    rows = rows.withColumn("t", rank_key(F.col("size"), F.col("id"), default_merit(F.col("size")), F.col("fraction"), seed)).select("source", "id", "size", "t", "lack")
    rows = rows.withColumn("b1", F.floor(F.col("t") * RADIX)).withColumn("b2", F.floor((F.col("t") * RADIX - F.col("b1")) * RADIX))

    def ending(rows: DataFrame, by: str, had: Column) -> DataFrame:
        """The bin of each source in which its sum of words reaches what it lacks, and the words before it."""
        up = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        bins = rows.groupBy("source", by, "lack", had.alias("had")).agg(F.sum("size").alias("words"))
        bins = bins.withColumn("up", F.col("had") + F.sum("words").over(up))
        bins = bins.where("up >= lack").groupBy("source").agg(F.min_by(F.struct(by, (F.col("up") - F.col("words")).alias("before")), by).alias("x"))
        return cut(bins.select("source", F.col(f"x.{by}").alias(f"end_{by}"), F.col("x.before").alias(f"before_{by}")))

    first = ending(rows, "b1", F.lit(0))
    inside = join_dim(rows, first, "source").where("b1 = end_b1")
    second = ending(inside, "b2", F.col("before_b1"))
    last = join_dim(inside, second, "source").where("b2 = end_b2")
    up = Window.partitionBy("source").orderBy("t", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("middle", F.col("before_b2") + F.coalesce(F.sum("size").over(up), F.lit(0)) + F.col("size") / 2)
    ends = last.where("middle <= lack").groupBy("source").agg(F.max(F.struct("t", "id", "size")).alias("end"))
    plans = join_dim(plans, cut(first.select("source", "end_b1")), "source", "left")
    plans = join_dim(plans, cut(second.select("source", "end_b2")), "source", "left")
    return cut(join_dim(plans, cut(ends), "source", "left"))


def apply(rows: DataFrame, plans: DataFrame, ident: str, source: str, size: str, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and copies to rows; no row moves unless there are too many sources to broadcast."""
    own = plans.select(F.col("source").alias("__source"), F.struct("source_size", "target", "whole", "fraction", "end_b1", "end_b2", "end").alias("__plan"))
    out = join_dim(rows.withColumn("__source", F.col(source)), own, "__source", "left")
    p = F.col("__plan")
    t = rank_key(F.col(size), F.col(ident), default_merit(F.col(size)), p["fraction"], seed)
    b1 = F.floor(t * RADIX)
    b2 = F.floor((t * RADIX - b1) * RADIX)
    at_end = (b2 < p["end_b2"]) | ((b2 == p["end_b2"]) & F.coalesce(F.struct(t.alias("t"), F.col(ident).alias("id"), F.col(size).alias("size")) <= p["end"], F.lit(False)))
    taken = (p["fraction"] > 0) & ((b1 < p["end_b1"]) | ((b1 == p["end_b1"]) & at_end))
    copies = p["whole"] + F.coalesce(taken, F.lit(False)).cast("long")
    return out.withColumns({"source_size": p["source_size"], "target": p["target"], "copies": copies}).drop("__plan", "__source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it has copies, with its own columns."""
    size = word_count(F.col("text"))
    plans = plan(cut(docs.select(F.col("doc_id").alias("id"), "source", size.alias("size"))), **options)
    named = docs.withColumn("__size", size)
    held = apply(named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("doc_id").alias("__id"), F.col("source").alias("__src"), "__size"), plans, "__id", "__src", "__size")
    return held.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")))
    out = apply(items, plan(items), "id", "source", "size")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
