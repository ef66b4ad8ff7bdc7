"""Quality audit: duplicates, gaps, dangling references, spans, coverage, reconciliation, one issue report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.text import compact
from docketry.operators.joins import bounded


def duplicate_ids(df: DataFrame, ident: str) -> DataFrame:
    """Ids that occur more than once, as a digest, with their number."""
    found = df.groupBy(ident).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.sha2(F.col(ident).cast("string"), 256).alias("digest"), "n")


def sequence_gaps(df: DataFrame, number: str, last: int) -> DataFrame:
    """(issue, number): numbers of 1..last that are missing, unexpected or repeated."""
    expected = df.sparkSession.range(1, last + 1).select(F.col("id").alias("number"))
    own = df.select(F.col(number).cast("long").alias("number")).where("number is not null")
    missing = expected.join(own.distinct(), "number", "left_anti").select(F.lit("missing").alias("issue"), "number")
    unexpected = own.where(~F.col("number").between(1, last)).distinct().select(F.lit("unexpected"), "number")
    repeated = own.groupBy("number").count().where("count > 1").select(F.lit("duplicate"), "number")
    return missing.union(unexpected).union(repeated)


def dangling(refs: DataFrame, targets: DataFrame, ref: str, target: str) -> DataFrame:
    """Rows of refs whose reference is in no target."""
    return refs.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias(ref)).distinct(), ref, "left_anti").select(refs.columns)


def bad_spans(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (span_id, source_id, start_offset, end_offset, quote) whose quote is not in their source's text at that place.

    Spans are gathered per source before they meet the text, so that a text is sent once and not once a span.
    """
    held = spans.groupBy("source_id").agg(F.collect_list(F.struct("span_id", "start_offset", "end_offset", "quote")).alias("spans"))
    met = held.join(texts, "source_id", "left")
    ok = lambda x: (F.col("text").substr(x["start_offset"] + 1, x["end_offset"] - x["start_offset"])) == x["quote"]
    wrong = F.filter("spans", lambda x: ~F.coalesce(ok(x), F.lit(False)))
    return met.select("source_id", F.col("text").isNull().alias("no_source"), F.explode(wrong).alias("x")).select("source_id", "x.span_id", F.when(F.col("no_source"), "unknown_source").otherwise("quote_mismatch").alias("issue"))


def mismatched(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows differ or are on one side only (null-safe on all columns)."""
    row = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    met = row(left, "l").join(row(right, "r"), key, "full_outer")
    issue = F.when(F.col("l").isNull(), "unexpected").when(F.col("r").isNull(), "missing").when(~F.col("l").eqNullSafe(F.col("r")), "different")
    return met.select(key, issue.alias("issue")).where("issue is not null")


def differing_definitions(df: DataFrame, ident: str, definition: Column, order: list[str]) -> DataFrame:
    """Every later owner of an id whose definition differs from the first owner's."""
    w = Window.partitionBy(ident).orderBy(*order)
    return df.withColumn("__d", definition).withColumn("__f", F.first("__d").over(w)).where(~F.col("__d").eqNullSafe(F.col("__f"))).drop("__d", "__f")


def shared_values(df: DataFrame, value: str, ident: str) -> DataFrame:
    """Members of values that stand under several ids: (digest of the value, ident, n ids). No group is gathered in one row."""
    rows = df.where(F.col(value).isNotNull()).select(F.sha2(F.col(value).cast("string"), 256).alias("digest"), ident).distinct()
    return rows.join(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "digest").select("digest", ident, "n")


def duplicate_texts(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Members of groups of texts that are equal without white space: (digest, ident, n). Only digests are shuffled."""
    return shared_values(df.select(ident, compact(F.col(text)).alias("__k")), "__k", ident)


def band_coverage(present: DataFrame, referenced: DataFrame, bands: DataFrame) -> DataFrame:
    """bands (band, first, last) -> expected, present and referenced numbers of each band: a range join on broadcast bands."""
    nums = present.select("number").distinct().join(referenced.select("number", F.lit(True).alias("ref")).distinct(), "number", "left")
    met = bounded(bands).join(nums, F.col("number").between(F.col("first"), F.col("last")), "left")
    return met.groupBy("band", "first", "last").agg(F.count("number").alias("present"), F.count_if("ref").alias("referenced")).select("band", (F.col("last") - F.col("first") + 1).cast("long").alias("expected"), "present", "referenced")


def reused_children(children: DataFrame) -> DataFrame:
    """Child ids (owner, child_id) that stand in several owners: one shuffle for all kinds of children."""
    return children.groupBy("child_id").agg(F.countDistinct("owner").alias("owners")).where("owners > 1")


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of counts for two corpora (id, text): overlaps, texts that disagree, prefixes, texts under other ids, distinct union.

    Pairs of equal texts under other ids are counted from the sizes of both sides' groups and never made.
    """
    left, right = (df.select("id", compact(F.col("text")).alias(n)) for df, n in ((a, "l"), (b, "r")))
    met = left.join(right, "id", "full_outer")
    prefix = F.col("l").startswith(F.col("r")) | F.col("r").startswith(F.col("l"))
    counts = met.agg(
        F.count("l").alias("n_a"), F.count("r").alias("n_b"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("same_id"),
        F.count_if(F.col("l") == F.col("r")).alias("same_text"), F.count_if((F.col("l") != F.col("r")) & prefix).alias("prefix_text"), F.count_if((F.col("l") != F.col("r")) & ~prefix).alias("other_text"), F.count("*").alias("union_ids"),
    )
    keyed = lambda df, text, n: df.where(F.col("id").isNotNull() & F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("k"), "id").agg(F.count("*").alias(n))
    x, y = keyed(left, "l", "n"), keyed(right, "r", "m")
    pairs = x.groupBy("k").agg(F.sum("n").alias("n")).join(y.groupBy("k").agg(F.sum("m").alias("m")), "k")
    own = x.join(y, ["k", "id"])
    total = lambda df, name: df.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias(name))
    return counts.crossJoin(total(pairs, "all").crossJoin(total(own, "same")).select((F.col("all") - F.col("same")).alias("text_under_other_id")))


def unresolved(df: DataFrame, ident: str, refs: str, known: str) -> DataFrame:
    """Rows whose array of references holds ids that the row's own array of ids lacks."""
    return df.select(ident, F.array_join(F.array_sort(F.array_except(refs, known)), ",").alias("missing")).where("missing <> ''")


def report(issues: dict[str, DataFrame]) -> DataFrame:
    """(check, passed, n) of named issue tables; a check without issues has passed."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), "n") for name, df in issues.items()]
    return reduce(DataFrame.unionByName, parts)
