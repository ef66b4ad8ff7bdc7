"""Official pages: the text lines of one container, articles by islands of lines, their order check, and comparison with stored texts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.text import compact, han_integer

SKIPPED, BREAKS = {"script", "style"}, {"p", "br", "h1", "h2", "h3", "div", "li"}
# How an article and a heading begin.
ARTICLE = r"^第([零一二三四五六七八九十百千]+)条\s*(.*)$"
HEADING = r"^第[零一二三四五六七八九十百千]+(?:分?编|章|节)|^附\s*则$"


class Container(HTMLParser):
    """Collects the blocks of text inside one kind of element, or of those whose attribute has a word, without scripts and styles."""

    def __init__(self, element: str, attribute: str | None = None, word: str = ""):
        super().__init__(convert_charrefs=True)
        self.element, self.attribute, self.word = element, attribute, word
        self.depth, self.skip, self.found, self.blocks = 0, 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == self.element and (self.depth or self.attribute is None or self.word in (dict(attrs).get(self.attribute) or "").split()):
            self.depth += 1
            self.found += self.depth == 1
        self.skip += tag in SKIPPED
        if self.depth and tag in BREAKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in SKIPPED and self.skip > 0
        if self.depth and tag in BREAKS:
            self.blocks.append("")
        if tag == self.element and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data


def page_lines(pages: DataFrame, element: str = "article", attribute: str | None = None, word: str = "") -> DataFrame:
    """pages (page_id, html) -> (page_id, line, text, containers, closed): the non-blank lines of the container, numbered from 1.

    containers: how many such elements the page has; closed: whether the last one ends. A page without lines has one row, with a null line.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                parser = Container(element, attribute, word)
                parser.feed((html or "").removeprefix("﻿"))
                parser.close()
                texts = [t for b in parser.blocks for line in b.splitlines() if (t := line.strip())]
                rows += [(page_id, i, t, parser.found, not parser.depth) for i, t in enumerate(texts, 1)] or [(page_id, None, None, parser.found, not parser.depth)]
            yield pd.DataFrame(rows, columns=["page_id", "line", "text", "containers", "closed"]).astype({"line": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, line long, text string, containers long, closed boolean")


def articles(lines: DataFrame) -> DataFrame:
    """lines (page_id, line, text) -> (page_id, first_line, number, text): each article of a page without its white space.

    An article begins at a line such as 第五条 and takes the lines after it up to the next one or to a heading; lines outside articles are left out. A number that
    occurs twice makes two rows.
    """
    place = Window.partitionBy("page_id").orderBy("line")
    begins, heads = F.col("text").rlike(ARTICLE), F.col("text").rlike(HEADING)
    mark = F.when(begins, F.struct(F.col("line").alias("first_line"), han_integer(F.regexp_extract("text", ARTICLE, 1)).alias("number"))).when(heads, F.struct(F.lit(None).cast("long").alias("first_line"), F.lit(None).cast("int").alias("number")))
    carried = lines.where("line is not null").withColumn("at", F.last(mark, ignorenulls=True).over(place)).where("at.first_line is not null")
    body = F.when(F.col("line") == F.col("at.first_line"), F.regexp_extract("text", ARTICLE, 2)).otherwise(F.col("text"))
    held = carried.groupBy("page_id", "at.first_line", "at.number").agg(F.array_sort(F.collect_list(F.struct("line", compact(body).alias("t")))).alias("parts"))
    return held.select("page_id", "first_line", F.col("number").cast("long").alias("number"), F.array_join("parts.t", "").alias("text"))


def article_issues(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(page_id, issue, n) of articles against expected (page_id, last): numbers should be 1 to last, once each and in order, and have text.

    duplicate and empty count articles, missing numbers of 1 to last without one, unexpected articles of other numbers, out_of_order those that follow a greater number.
    """
    before = F.max("number").over(Window.partitionBy("page_id").orderBy("first_line").rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(Window.partitionBy("page_id", "number").orderBy("first_line"))
    rows = found.withColumn("late", F.coalesce(before > F.col("number"), F.lit(False))).withColumn("again", nth > 1).join(expected, "page_id", "right")
    inside = F.coalesce(F.col("number").between(1, F.col("last")), F.lit(False))
    counts = rows.groupBy("page_id", "last").agg(
        F.count_if("again").alias("duplicate"), F.count_if(inside & ~F.col("again")).alias("known"), F.count_if(F.col("first_line").isNotNull() & ~inside).alias("unexpected"),
        F.count_if("late").alias("out_of_order"), F.count_if(F.col("text") == "").alias("empty"),
    )
    counts = counts.withColumn("missing", F.col("last") - F.col("known"))
    kinds = F.array(*[F.struct(F.lit(x).alias("issue"), F.col(x).cast("long").alias("n")) for x in ("duplicate", "missing", "unexpected", "out_of_order", "empty")])
    return counts.select("page_id", F.explode(kinds).alias("x")).select("page_id", "x.issue", "x.n").where("n > 0")


def container_issues(lines: DataFrame) -> DataFrame:
    """(page_id, issue) of pages that don't have just one container, or don't close it."""
    by = lines.groupBy("page_id").agg(F.max("containers").alias("c"), F.bool_and("closed").alias("closed"))
    issue = F.when(F.col("c") == 0, "missing_container").when(F.col("c") > 1, "repeated_container").when(~F.col("closed"), "unclosed_container")
    return by.select("page_id", issue.alias("issue")).where("issue is not null")


def compare_articles(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(page_id, compared, mismatched, digest, status) of articles against stored (page_id, number, stored), white space aside.

    mismatched lists the numbers whose texts differ or that only one side has; digest is of the page's lines `number<tab>text` by number.
    """
    own = found.groupBy("page_id", "number").agg(F.min_by("text", "first_line").alias("text"))
    met = own.join(stored.select("page_id", "number", compact(F.col("stored")).alias("stored")), ["page_id", "number"], "full_outer")
    bad = ~F.coalesce(F.col("text") == F.col("stored"), F.lit(False))
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("number", "text"))))
    out = met.groupBy("page_id").agg(F.count("text").alias("compared"), F.array_sort(F.collect_list(F.when(bad, F.col("number")))).alias("m"), ordered.alias("o"))
    digest = F.sha2(F.array_join(F.transform("o", lambda x: F.concat_ws("\t", x["number"].cast("string"), x["text"])), "\n"), 256)
    return out.select("page_id", "compared", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("mismatched"), digest.alias("digest"), F.when(F.size("m") == 0, "passed").otherwise("failed").alias("status"))
