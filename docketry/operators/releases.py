"""Releases: what changed between two of them, what a published one may not hold, curated overlays with their spans, and the upkeep of a vector index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of a digest tree; each level down parts a bucket into as many.
BUCKETS = 1024


def digests(rows: DataFrame, key: str, level: int) -> DataFrame:
    """(bucket, n, sum): of rows with their hash `h`, how many a bucket holds and the sum of their hashes, which no order changes."""
    return rows.groupBy(bucket(key, level).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("sum"))


def bucket(key: str, level: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS**level))


def hashed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("h", F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})))


def changed_rows(before: DataFrame, after: DataFrame, key: str, levels: int = 2) -> DataFrame:
    """(key, change) of rows added, removed or changed between two tables of the same columns, by a digest tree.

    Each level compares the buckets that differed on the level above, BUCKETS times as many and so much smaller; only rows of
    buckets that differ on the last are joined by key. Where little has changed, little moves. Keys should be distinct on each side; a key that stands twice counts as changed
    if its rows, taken together, differ.
    """
    sides = [hashed(before, key), hashed(after, key)]
    for level in range(1, levels + 1):
        own, theirs = (digests(x, key, level) for x in sides)
        met = own.join(theirs.withColumnsRenamed({"n": "m", "sum": "other"}), "bucket", "full_outer")
        differs = met.where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("sum").eqNullSafe(F.col("other")))).select("bucket")
        sides = [x.join(differs, bucket(key, level) == F.col("bucket"), "left_semi") for x in sides]
    own, theirs = (x.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("sum")) for x in sides)
    met = own.join(theirs.withColumnsRenamed({"n": "m", "sum": "other"}), key, "full_outer")
    same = (F.col("n") == F.col("m")) & (F.col("sum") == F.col("other"))
    change = F.when(F.col("n").isNull(), "added").when(F.col("m").isNull(), "removed").when(~same, "changed")
    return met.select(key, change.alias("change")).where("change is not null")


def release_receipt(rules: tuple[DataFrame, DataFrame], references: tuple[DataFrame, DataFrame], members: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, rule_id, detail, n) of a release against the one before: each rule added, removed or changed, each reference added to it, and counts of rules and conditions.

    Each pair is (before, after): rules (rule_id, and what defines them), references (rule_id, provision_id), members (rule_id, condition_id).
    """
    none = F.lit(None).cast("string")
    one = F.lit(1).cast("long")
    rows = changed_rows(*rules, "rule_id").select(F.concat("change", F.lit("_rule")).alias("kind"), F.col("rule_id").cast("string").alias("rule_id"), none.alias("detail"), one.alias("n"))
    pairs = [x.select("rule_id", "provision_id").distinct() for x in references]
    added = pairs[1].join(pairs[0], ["rule_id", "provision_id"], "left_anti").select(F.lit("added_reference"), F.col("rule_id").cast("string"), F.col("provision_id").cast("string"), one)
    rows = rows.union(added)
    for when, r, m in (("before", rules[0], members[0]), ("after", rules[1], members[1])):
        rows = rows.union(r.agg(F.countDistinct("rule_id").alias("n")).select(F.lit("rules"), none, F.lit(when), "n"))
        rows = rows.union(m.agg(F.countDistinct("condition_id").alias("n")).select(F.lit("conditions"), none, F.lit(when), "n"))
    return rows


def release_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(release_id, issue, detail, n): keys that stand twice in a release, and edges with an end outside their own release.

    nodes (release_id, key), edges (release_id, source, type, target); an end that no node of the release has is `missing_end`, one that another release alone has is `crossing`.
    """
    own = nodes.groupBy("release_id", "key").agg(F.count("*").alias("n"))
    twice = own.where("n > 1").select("release_id", F.lit("duplicate_key").alias("issue"), F.col("key").alias("detail"), "n")
    ends = edges.select("release_id", "type", F.explode(F.array("source", "target")).alias("key")).groupBy("release_id", "type", "key").agg(F.count("*").alias("n"))
    outside = ends.join(own.select("release_id", "key"), ["release_id", "key"], "left_anti")
    known = own.groupBy("key").agg(F.lit(True).alias("elsewhere"))
    issue = F.when(F.col("elsewhere"), "crossing").otherwise("missing_end")
    return twice.union(outside.join(known, "key", "left").groupBy("release_id", issue.alias("issue"), F.col("type").alias("detail")).agg(F.sum("n").alias("n")))


def overlay_spans(spans: DataFrame, uses: DataFrame, curated: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(condition findings, spans, refused) of cases under a curated overlay.

    spans (case_id, span_id, section, quote); uses (case_id, span_id): what findings, reasoning and decisions still refer to; curated (case_id, condition_id, status,
    confidence, section, quote): the overlay's rows, quote null or blank where there is none; texts (case_id, section, text).
    Of a curated case the spans that something refers to are marked and stay, all others are swept; each quote takes a span of its section that stays and
    has the same quote, or a new one, numbered after the greatest that the case ever had. A quote that its section does not hold is refused with its row. Cases without
    curated rows keep their spans and have no condition findings.
    """
    cases = curated.select("case_id").distinct()
    marked = spans.join(uses.select("case_id", "span_id").distinct(), ["case_id", "span_id"], "left_semi").join(cases, "case_id", "left_semi")
    blank = F.trim(F.coalesce("quote", F.lit(""))) == ""
    placed = curated.join(texts, ["case_id", "section"], "left")
    held = F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False))
    refused = placed.where(~blank & ~held).select("case_id", "condition_id", "section", "quote")
    good = placed.where(blank | held).select("case_id", "condition_id", "status", "confidence", "section", F.when(~blank, F.col("quote")).alias("quote"))
    first = marked.groupBy("case_id", "section", "quote").agg(F.min("span_id").alias("span_id"))
    wanted = good.where("quote is not null").groupBy("case_id", "section", "quote").agg(F.min("condition_id").alias("condition_id"))
    new = wanted.join(first.select("case_id", "section", "quote"), ["case_id", "section", "quote"], "left_anti")
    last = spans.groupBy("case_id").agg(F.max("span_id").alias("last"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("condition_id", "section", "quote"))
    new = new.join(last, "case_id", "left").select("case_id", (F.coalesce("last", F.lit(0)) + number).cast("long").alias("span_id"), "section", "quote")
    stay = spans.join(cases, "case_id", "left_anti").select("case_id", "span_id", "section", "quote").union(marked.select("case_id", "span_id", "section", "quote")).union(new)
    taken = first.unionByName(new)
    findings = good.join(taken, ["case_id", "section", "quote"], "left").select("case_id", "condition_id", "status", "confidence", "span_id")
    return findings, stay, refused


def upkeep(index: DataFrame, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next state of a vector index: (target, object_id, text_sha256, vector, state).

    index: its last state; texts (target, object_id, text). embed takes (target, object_id, text) rows and gives them a vector; only new and changed texts reach it. state is
    `kept`, `embedded` (new, changed, or back after a deletion) or `deleted`: an object without a text leaves its row as a tombstone, without a vector.
    """
    key = ["target", "object_id"]
    now = texts.select(*key, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    live = index.where("state <> 'deleted'").select(*key, F.col("text_sha256").alias("was"), "vector")
    met = now.join(live, key, "left")
    same = F.coalesce(F.col("was") == F.col("text_sha256"), F.lit(False))
    kept = met.where(same).select(*key, "text_sha256", "vector", F.lit("kept").alias("state"))
    due = met.where(~same).select(*key, "text", "text_sha256")
    vectors = embed(due.select(*key, "text")).select(*key, "vector")
    embedded = due.join(vectors, key).select(*key, "text_sha256", "vector", F.lit("embedded").alias("state"))
    gone = index.join(now.select(*key), key, "left_anti").select(*key, "text_sha256", F.lit(None).cast(index.schema["vector"].dataType).alias("vector"), F.lit("deleted").alias("state"))
    return kept.unionByName(embedded).unionByName(gone)
