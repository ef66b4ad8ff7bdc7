"""Leave-one-out search, ablations, articles, bridges, audits, releases and overlays against brute force and hand examples."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.operators import bridges, cases, evaluation, pages, releases, retrieval, sessions


def brute_bm25(docs, asked, k):
    terms = {i: re.findall("[0-9a-z_]+", t.lower()) for i, t in docs.items()}
    n, avgdl = len(docs), sum(max(len(t), 1) for t in terms.values()) / len(docs)
    df = Counter(x for t in terms.values() for x in set(t))
    out = []
    for q in asked:
        scores = []
        for i in docs:
            tf = Counter(terms[i])
            s = sum(m * math.log((n - df[x] + 0.5) / (df[x] + 0.5) + 1) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * max(len(terms[i]), 1) / avgdl)) for x, m in Counter(terms[q]).items())
            if i != q and round(s, 4) > 0:
                scores.append((-round(s, 4), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_leave_one_out_is_exact_and_leaves_terms_out(spark):
    r = random.Random(1)
    docs = {i: " ".join(r.choices(["the", "of"], k=20) + r.choices([f"w{j}" for j in range(40)], k=r.randint(0, 12)) + [f"rare{i % 30}"] * (i % 3)) for i in range(200)} | {900: "", 901: "alone"}
    table = spark.createDataFrame(list(docs.items()), "id long, text string")
    asked = [*range(0, 200, 17), 900, 901]
    got = evaluation.leave_one_out(table, spark.createDataFrame([(i,) for i in asked], "id long"), 5)
    assert sorted(tuple(x) for x in got.collect()) == [tuple(x) for x in brute_bm25(docs, asked, 5)]
    few = evaluation.leave_one_out(table.limit(3), table.limit(3).select("id"), 5)  # fewer others than asked for: no bound
    assert few.count() == 6


def test_variants_are_fused_at_once(spark):
    ranked = spark.createDataFrame([(1, "bm25", "a", 1), (1, "bm25", "b", 2), (1, "vector", "b", 1), (1, "graph", "c", 1), (1, "other", "d", 1)], "query_id long, channel string, id string, rank long")
    variants = {"text": {"bm25": 1.0}, "both": {"bm25": 1.0, "vector": 1.0}, "graph": {"graph": 0.5, "bm25": 0.0}}
    got = {(x.variant, x.id): (x.score, x["rank"]) for x in evaluation.fuse_variants(ranked, variants, 10).collect()}
    assert got == {("text", "a"): (round(1 / 61, 9), 1), ("text", "b"): (round(1 / 62, 9), 2), ("both", "b"): (round(1 / 61 + 1 / 62, 9), 1), ("both", "a"): (round(1 / 61, 9), 2), ("graph", "c"): (round(0.5 / 61, 9), 1)}


def test_whole_claim_lists_are_fused(spark):
    """A rule that stands eleventh by its labels still counts."""
    labels = spark.createDataFrame([(f"r{i:02}", f"lab{j}") for i in range(12) for j in range(12 - i)], "id string, label string")
    queries = spark.createDataFrame([(1, " ".join(f"lab{j}" for j in range(12)))], "query_id long, text string")
    assert retrieval.label_rank(queries, labels).where("rank > 10").count() == 2


LINES = ["导言", "第一条 甲", "乙 丙", "第二章 总则", "不算", "第三条", "第二条 丁", "第三条 戊", "第十二条　己", "附 则", "尾"]


def brute_articles(lines):
    digits, units = "零一二三四五六七八九", {"十": 10, "百": 100, "千": 1000}

    def value(label):
        total = current = 0
        for c in label:
            if c in units:
                total, current = total + (current or 1) * units[c], 0
            else:
                current = digits.index(c)
        return total + current

    out, now = [], None
    for i, line in enumerate(lines, 1):
        if m := re.match(r"^第([零一二三四五六七八九十百千]+)条\s*(.*)$", line):
            now = [i, value(m[1]), [m[2]]]
            out.append(now)
        elif re.match(r"^第[零一二三四五六七八九十百千]+(?:分?编|章|节)|^附\s*则$", line):
            now = None
        elif now:
            now[2].append(line)
    return [(i, n, "".join("".join(parts).split())) for i, n, parts in out]


def test_articles_by_brute_force(spark):
    r = random.Random(3)
    alphabet = [*LINES, "第一百零五条 庚", "第二十条", "第一千二百六十条 末", "第三节 节", "x 第一条"]
    docs = {0: LINES} | {i: [r.choice(alphabet) for _ in range(r.randint(0, 12))] for i in range(1, 60)}
    rows = spark.createDataFrame([(i, n, t) for i, ls in docs.items() for n, t in enumerate(ls, 1)], "page_id long, line long, text string")
    found = pages.articles(rows)
    got = {}
    for x in found.collect():
        got.setdefault(x.page_id, []).append((x.first_line, x.number, x.text))
    assert {i: sorted(v) for i, v in got.items()} == {i: a for i, ls in docs.items() if (a := brute_articles(ls))}
    issues = {(x.issue): x.n for x in pages.article_issues(found.where("page_id = 0"), spark.createDataFrame([(0, 4)], "page_id long, last long")).collect()}
    assert issues == {"duplicate": 1, "missing": 1, "unexpected": 1, "out_of_order": 1, "empty": 1}
    good = spark.createDataFrame([(7, 1, "第一条 甲"), (7, 2, "第二条 乙")], "page_id long, line long, text string")
    assert pages.article_issues(pages.articles(good), spark.createDataFrame([(7, 2), (8, 2)], "page_id long, last long")).collect() == [(8, "missing", 2)]
    stored = spark.createDataFrame([(7, 1, "甲 "), (7, 2, "丙"), (7, 3, "丁")], "page_id long, number long, stored string")
    row = pages.compare_articles(pages.articles(good), stored).first()
    assert (row.compared, row.mismatched, row.status) == (2, "2,3", "failed")


def test_container_by_attribute(spark):
    html = "<div id='nav'>x</div><div class='a txt b'><p>第一条 甲<script>no</script></p>乙<div>丙</div></div><p>out</p>"
    rows = spark.createDataFrame([(1, html), (2, html * 2), (3, html[:60]), (4, None)], "page_id long, html string")
    lines = pages.page_lines(rows, "div", "class", "txt")
    assert [(x.line, x.text) for x in lines.where("page_id = 1").orderBy("line").collect()] == [(1, "第一条 甲"), (2, "乙"), (3, "丙")]
    assert sorted(tuple(x) for x in pages.container_issues(lines).collect()) == [(2, "repeated_container"), (3, "unclosed_container"), (4, "missing_container")]


@pytest.mark.parametrize(
    ("sentences", "reasoning", "holding", "condition", "want"),
    [
        (["双方签订健身服务合同。"], None, None, "contract_exists", ("SATISFIED", 0.7, "基本案情")),
        (["无关。", "原告交纳会籍费。", "收取维修费。"], "已支付。", None, "payment_made", ("SATISFIED", 0.7, "基本案情")),
        (["收取维修费。"], "费用已支付。", None, "payment_made", ("UNKNOWN", 0.3, None)),
        (["原告购买课程。"], "合同有效；费用已支付。", None, "payment_made", ("SATISFIED", 0.55, "裁判理由")),
        (["门店闭店。", "仍可提供服务。"], None, None, "performance_impossible", ("SATISFIED", 0.7, "基本案情")),
        (["仍可提供服务。"], None, None, "performance_impossible", ("NOT_SATISFIED", 0.65, "基本案情")),
        (["尚有12次课。"], "剩余若干。", None, "unperformed_balance", ("SATISFIED", 0.65, "基本案情")),
        ([], "剩余若干。", None, "unperformed_balance", ("SATISFIED", 0.55, "裁判理由")),
        (["可转让他人。", "未经原告同意。"], None, None, "alternative_performance", ("NOT_SATISFIED", 0.65, "基本案情")),
        (["可转让他人。"], None, None, "alternative_performance", ("UNKNOWN", 0.4, "基本案情")),
        (None, None, " 解除双方的服务协议。", "contract_terminated", ("SATISFIED", 0.6, "裁判结果")),
        (None, None, None, "contract_terminated", ("UNKNOWN", 0.3, None)),
    ],
)
def test_bridges(spark, sentences, reasoning, holding, condition, want):
    got = bridges.condition_states(spark.createDataFrame([(1, sentences, reasoning, holding)], "case_id long, sentences array<string>, reasoning string, holding string"))
    assert got.count() == 6
    row = got.where(F.col("condition") == condition).first()
    assert (row.status, row.confidence, row.section) == want


def test_partitions_keep_control_characters():
    assert cases.parts_of("原告诉称：甲付款。\x01被告辩称：未付\x02\x03c。")[:2] == ("甲付款。\x01", "未付\x02\x03c。")
    assert cases.parts_of(None) == ("", "", "", "")


def test_history_guard_looks_back_from_the_question(spark):
    key = "session_id long, condition_id string, turn long"
    asked = spark.createDataFrame([(1, "a", t) for t in (1, 3, 5, 7)] + [(1, "b", 9), (2, "a", 9), (3, "a", 9)], key)
    answers = spark.createDataFrame([(1, "a", 2, " 不知道 "), (1, "a", 4, "付了"), (1, "b", 10, "later"), (1, "a", 5, None)], f"{key}, answer string")
    refusals = spark.createDataFrame([(1, "a", 6, "UNABLE"), (2, "a", 3, "DECLINED")], f"{key}, kind string")
    states = spark.createDataFrame([(3, "a", "SATISFIED", 2), (1, "b", "SATISFIED", 0)], "session_id long, condition_id string, status string, n_evidence long")
    got = {(x.session_id, x.condition_id, x.turn): x.outcome for x in sessions.history_guard(asked, answers, refusals, states).collect()}
    assert got == {(1, "a", 1): "MISSING", (1, "a", 3): "MISSING", (1, "a", 5): "ALREADY_ANSWERED", (1, "a", 7): "USER_UNABLE", (1, "b", 9): "MISSING", (2, "a", 9): "USER_DECLINED", (3, "a", 9): "ALREADY_EVIDENCED"}


def test_changed_rows_by_digest_tree(spark):
    before = spark.range(3000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"), F.when(F.col("id") % 2 == 0, F.lit(1)).alias("w"))
    after = before.where("k <> 7").withColumn("v", F.when(F.col("k") == 9, F.lit(None)).otherwise(F.col("v"))).union(spark.createDataFrame([(5000, "x", None)], "k long, v string, w int"))
    assert sorted(tuple(x) for x in releases.changed_rows(before, after, "k").collect()) == [(7, "removed"), (9, "changed"), (5000, "added")]
    assert releases.changed_rows(before, before.orderBy(F.desc("k")), "k").count() == 0


def test_overlay_sweeps_orphans(spark):
    spans = spark.createDataFrame([(1, 1, "f", "aa"), (1, 2, "f", "orphan"), (1, 3, "r", "rr"), (2, 1, "f", "kept")], "case_id long, span_id long, section string, quote string")
    uses = spark.createDataFrame([(1, 1), (1, 3)], "case_id long, span_id long")
    curated = spark.createDataFrame([(1, "c1", "S", 0.7, "f", "aa"), (1, "c2", "S", 0.6, "f", "new"), (1, "c3", "U", 0.3, None, None), (1, "c4", "S", 0.7, "f", "absent")], "case_id long, condition_id string, status string, confidence double, section string, quote string")
    texts = spark.createDataFrame([(1, "f", "aa and new orphan")], "case_id long, section string, text string")
    findings, stay, refused = releases.overlay_spans(spans, uses, curated, texts)
    assert {x.condition_id: x.span_id for x in findings.collect()} == {"c1": 1, "c2": 4, "c3": None}
    assert sorted((x.case_id, x.span_id) for x in stay.collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    assert [x.condition_id for x in refused.collect()] == ["c4"]


def test_index_upkeep_embeds_only_what_changed(spark):
    seen = []

    def embed(rows):
        seen.append(sorted(x.object_id for x in rows.collect()))
        return rows.select("target", "object_id", F.array(F.length("text").cast("double")).alias("vector"))

    empty = spark.createDataFrame([], "target string, object_id string, text_sha256 string, vector array<double>, state string")
    texts = lambda rows: spark.createDataFrame([("rule", i, t) for i, t in rows], "target string, object_id string, text string")
    first = releases.upkeep(empty, texts([("a", "x"), ("b", "y"), ("c", "z")]), embed)
    second = releases.upkeep(first, texts([("a", "x"), ("b", "yy"), ("d", "w")]), embed)
    third = releases.upkeep(second, texts([("a", "x"), ("b", "yy"), ("d", "w"), ("c", "z")]), embed)
    assert seen == [["a", "b", "c"], ["b", "d"], ["c"]]
    assert {x.object_id: x.state for x in second.collect()} == {"a": "kept", "b": "embedded", "c": "deleted", "d": "embedded"}
    assert {x.object_id: x.state for x in third.collect()}["c"] == "embedded"


def test_texts_are_cut_once_and_rankings_are_tables(spark, small):
    """Plans read what earlier steps have written, and no input more than once or twice."""
    from docketry.plans.registry import queries

    def scans(name):
        return queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert scans("bm25_top") <= 4 and scans("case_retrieval") < 40 and scans("condition_ranks") < 15
