"""Every query of the library against its SQL on the smallest tables."""

import glob
import math
import os
import re
from html import unescape

import duckdb
import pytest

from docketry.plans.registry import oracle_sql, queries


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.item() if hasattr(v, "item") and not isinstance(v, str) else v

    df = df[sorted(df.columns)]
    out = [tuple(float(x) if isinstance(x := plain(v), (int, float)) and not isinstance(x, bool) else x for v in r) for r in df.itertuples(index=False)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, small, duck, name):
    got, want = queries()[name](spark, small).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_without_sql_is_tested_elsewhere():
    """Page parsing has no SQL and is held against another parser below; releases are tested by hand in test_operators."""
    assert set(queries()) - set(oracle_sql()) == {"page_lines", "page_compare", "graph_release"}


def test_page_queries(spark, small):
    """Against regular expressions over the pages, whose markup is regular."""
    lines = queries()["page_lines"](spark, small).toPandas()
    html = spark.read.parquet(f"{small}/pages.parquet").toPandas().set_index("page_id").html
    for page_id, own in lines.groupby("page_id"):
        inside = "".join(re.findall(r"<article\b[^>]*>(.*?)</article>", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", html[page_id] or ""), re.S))
        blocks = re.split(r"(?i)</?(?:p|br|h1|h2|h3|div|li)\b[^>]*>|[\r\n]", inside)
        want = [t for b in blocks if (t := unescape(re.sub(r"<[^>]*>", "", b)).strip())]
        assert own.sort_values("line").text.dropna().tolist() == want, page_id
    compared = queries()["page_compare"](spark, small).toPandas().set_index("page_id")
    for page_id, own in lines.dropna(subset=["line"]).groupby("page_id"):
        assert compared.mismatched[page_id] == ",".join(str(int(i)) for i in sorted(own.line) if i % 3 == 0 or i % 4 == 0)
