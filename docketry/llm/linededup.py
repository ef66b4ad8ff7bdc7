"""Line dedup with a suffix array over line ids; DataFrame functions alone.

The lines of a text that hold a word form a sequence; a line's id is the rank of its digest. Only
lines that occur twice or more matter, and a suffix ends where its run of such lines ends. Suffixes
are ranked by prefix doubling: round k sorts the distinct pairs (rank of the suffix, rank of the suffix
2^k lines on) by range partitioning, and a pair's rank is the number of suffixes before it. After round
k suffixes of equal rank share 2^k lines: they are the longest-common-prefix interval of that depth,
and two overlapping ranks name the interval of any depth t, 2^k <= t < 2^(k+1).

A repeated run counts if it has at least `min_words` words. From each line the shortest run of so many
words forward, and the shortest backward, is looked up by its interval; if the interval holds an earlier
suffix, all lines of the run are copies. Every maximal repeated run of enough words is the union of such
runs, so that exactly the maximal runs' later copies are deleted. A run has at most min_words lines,
which bounds the rounds by log2(min_words), whatever the texts' length.

Order of copies: by doc_id (null first), then by place of the line; the first copy stays. Defined cases:
null text stays null and has no lines; lines without a word are never deleted and do not part a run; a
text whose every line with a word was deleted is a copy (n_deleted = n_lines). Rows that share a doc_id are
texts of their own, in the order of their hashes. Doc_ids that aren't whole numbers, repeated and null ones cost one
more copy of the table. Empty table: empty result. All other columns are kept, whatever their names; a figure
whose name is taken gets an underscore before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import WORD, cut, global_index, numbered, screened, table

MIN_WORDS = 50
#: From its first character that isn't white space on, a line with a word.
FULL_LINE = r"[^\x20\x09-\x0D][^\n]*"


def line_table(rows: DataFrame) -> DataFrame:
    """(row, at, words, digest) of rows (row, text): the lines with a word; at counts all lines."""
    lines = rows.where("text is not null").select("row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("words", F.regexp_count("line", F.lit(WORD))).where("words > 0")
    return lines.select("row", "at", "words", F.unhex(F.md5("line")).alias("digest"))


def runs_of(lines: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines (row, at, pos, words, digest, run): run numbers the unbroken stretches of repeated lines of a row."""
    repeated = cut(lines.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    some = lines.join(repeated, "digest")
    rows = cut(some.select("row").distinct())
    flagged = lines.join(rows, "row").join(repeated.withColumn("twice", F.lit(True)), "digest", "left")
    w = Window.partitionBy("row").orderBy("at")
    flagged = flagged.withColumn("pos", F.row_number().over(w)).withColumn("run", F.sum(F.when(F.col("twice"), 0).otherwise(1)).over(w)).where("twice")
    whole = Window.partitionBy("row", "run")
    return cut(flagged.withColumn("all", F.sum("words").over(whole)).where(F.col("all") >= min_words).drop("all", "twice"))


def renamed(suffixes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the rank of each suffix by keys: the number of suffixes whose keys are smaller. Only distinct keys are sorted."""
    sums = suffixes.groupBy(*keys).agg(F.count("*").alias("n"))
    ranks = cut(global_index(sums, keys, "n", name).select(*[F.col(k).alias(f"__{k}") for k in keys], name))
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k) == F.col(f"__{k}"))
    return suffixes.join(ranks, match).drop(*[f"__{k}" for k in keys])


def copied_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, at) of the lines of docs (row, text) to delete; rows are in the order of copies."""
    base = runs_of(cut(line_table(docs)), min_words)
    own = Window.partitionBy("row", "run").orderBy("pos")
    ahead = own.rowsBetween(0, Window.unboundedFollowing)
    behind = own.rowsBetween(Window.unboundedPreceding, 0)
    # Words up to each line make a rising line; the shortest run of enough words ends where it has risen by min_words.
    up = base.withColumn("upto", F.sum("words").over(behind))
    up = up.withColumn("ends", F.collect_list(F.struct("pos", "upto")).over(own.rowsBetween(0, min_words - 1)))
    up = up.withColumn("starts", F.collect_list(F.struct("pos", F.col("upto"), "words")).over(own.rowsBetween(-(min_words - 1), 0)))
    forward = F.try_element_at(F.filter("ends", lambda x: x["upto"] - F.col("upto") + F.col("words") >= min_words), F.lit(1))["pos"] - F.col("pos") + 1
    backward = F.col("pos") - F.try_element_at(F.filter("starts", lambda x: F.col("upto") - x["upto"] + x["words"] >= min_words), F.lit(-1))["pos"] + 1
    up = cut(up.select("row", "run", "at", "pos", "digest", F.when(F.size("ends") > 0, forward).alias("f"), F.when(F.size("starts") > 0, backward).alias("b")))
    longest = up.agg(F.greatest(F.max("f"), F.max("b"))).first()[0] or 0

    ranks = cut(renamed(up, ["digest"], "r0").drop("digest").withColumn("r0", F.col("r0") + 1))
    k = 0
    while 2 << k <= longest:
        step = ranks.withColumn("next", F.coalesce(F.lead(f"r{k}", 1 << k).over(own), F.lit(0)))
        following = renamed(step, [f"r{k}", "next"], f"r{k + 1}").drop("next")
        ranks = cut(following.withColumn(f"r{k + 1}", F.col(f"r{k + 1}") + 1))
        k += 1

    # The run of t lines that starts at a suffix lies in the interval named by two overlapping ranks of depth 2^level <= t.
    def asked(length: str, start: Column) -> DataFrame:
        level = F.floor(F.log2(F.col(length))).cast("int")
        return ranks.where(F.col(length).isNotNull()).select("row", "run", start.cast("int").alias("start"), F.col(length).cast("int").alias("t"), level.alias("level"))

    windows = asked("f", F.col("pos")).unionByName(asked("b", F.col("pos") - F.col("b") + 1)).distinct()
    at_level = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"r{i}").alias("r")) for i in range(k + 1)])
    names = ranks.select("row", "run", "pos", F.explode(at_level).alias("x")).select("row", "run", "pos", "x.level", "x.r")
    left = windows.join(names.withColumnRenamed("pos", "start").withColumnRenamed("r", "r1"), ["row", "run", "start", "level"])
    left = left.withColumn("pos", F.expr("start + t - shiftleft(1, level)"))
    both = cut(left.join(names.withColumnRenamed("r", "r2"), ["row", "run", "pos", "level"]).select("row", "run", "start", "t", "level", "r1", "r2"))
    firsts = cut(both.groupBy("level", "t", "r1", "r2").agg(F.min(F.struct("row", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = both.join(firsts, ["level", "t", "r1", "r2"]).where(F.struct("row", "start") != F.col("first"))
    covered = later.select("row", "run", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("t") - 1)).alias("pos")).distinct()
    return up.select("row", "run", "pos", "at").join(covered, ["row", "run", "pos"]).select("row", "at")


def deduped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text, n_lines, n_deleted) of every row of docs: doc is the row as it was, text is cleaned; lines are those with a word."""
    keyed, _ = numbered(docs, "doc_id", nulls_first=True)
    gone = copied_lines(keyed.select("row", F.col("doc.text").alias("text")), min_words).groupBy("row").agg(F.collect_set("at").alias("gone"))
    gone = cut(gone)
    marked = screened(keyed, "row", gone.select("row"))  # only texts that may lose lines move
    checked = marked.where("may").join(gone, "row", "left").select("doc", "gone")
    rows = marked.where("not may").select("doc", F.lit(None).cast("array<int>").alias("gone")).union(checked)
    kept = F.filter(F.transform(F.split("doc.text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("gone", s["i"]))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    n_lines = F.coalesce(F.regexp_count("doc.text", F.lit(FULL_LINE)), F.lit(0)).cast("long")
    return rows.select("doc", text.alias("text"), n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_deleted"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cleaned, and n_lines and n_deleted (lines with a word)."""
    names = {}
    for name in ("n_lines", "n_deleted"):
        names[name] = name
        while names[name].lower() in [c.lower() for c in docs.columns]:
            names[name] = "_" + names[name]
    own = [F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns]
    return deduped(docs, min_words).select(*own, *[F.col(k).alias(v) for k, v in names.items()])


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_deleted")


OP3_SQL = r"""
WITH l AS (SELECT doc_id, ln, list_extract(string_split(text, chr(10)), ln) AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ln FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, row_number() OVER o AS pos, CAST(sum(words) OVER o AS BIGINT) AS upto
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l) WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY ln)),
f AS (SELECT x.doc_id, x.pos AS i, min(y.pos) AS j FROM w x JOIN w y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.pos AND x.pos + 49 AND y.upto - x.upto + x.words >= 50 GROUP BY 1, 2),
b AS (SELECT y.doc_id, max(x.pos) AS i, y.pos AS j FROM w x JOIN w y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.pos AND x.pos + 49 AND y.upto - x.upto + x.words >= 50 GROUP BY 1, 3),
r AS (SELECT doc_id, i, j FROM f UNION SELECT doc_id, i, j FROM b),
c AS (SELECT r.doc_id, r.i, r.j, string_agg(w.line, chr(10) ORDER BY w.pos) AS content FROM r JOIN w ON w.doc_id = r.doc_id AND w.pos BETWEEN r.i AND r.j GROUP BY 1, 2, 3),
d AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS n FROM c) WHERE n > 1),
gone AS (SELECT DISTINCT w.doc_id, w.ln FROM w JOIN d ON w.doc_id = d.doc_id AND w.pos BETWEEN d.i AND d.j),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.ln = l.ln WHERE g.ln IS NULL GROUP BY 1)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  (SELECT count(*) FROM w WHERE w.doc_id = o.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = o.doc_id) AS n_deleted
FROM documents o LEFT JOIN kept k ON k.doc_id = o.doc_id
"""
