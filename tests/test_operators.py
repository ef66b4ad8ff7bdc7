"""Golden cases and brute-force models of operators."""

import os
import shutil
import subprocess
import sys
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import audit, cases, conditions, graph, retrieval, sessions
from docketry.streaming import sessions as streams

ROOT = Path(__file__).parents[1]


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_amounts(spark):
    texts = ["人民币14789.03元", "5，062元", "6万元", "0.125万元", "2万余元", "3，62元", "", "共1,234,567.5元"]
    assert one(spark, T.amount, *texts) == [14789.03, 5062, 60000, 1250, None, None, None, 1234567.5]
    asked = {
        "请求判令被告支付租金6万元、损失5万元，共计11万元": 110000, "请求判令被告每月支付500元": None, "请求判令返还1万元，赔偿2万元": None, "请求判令返还3万元；诉讼费1000元由被告承担": 30000,
        "要求被告按日支付违约金20元": None, "原告付款300元。诉请返还。": None, "诉请被告返还5，062元。另付100元": 5062, "主张合计8万元，其中本金5万元": None, "请求返还本金5万元，利息合计6万元": None,
        "请求判令支付2万元、共计3万元、总计4万元": None, "请求判令退还0.125万元": 1250, "": None,
    }
    assert one(spark, cases.requested_amount, *asked) == list(asked.values())
    awarded = {
        "被告返还原告300元；驳回其他诉讼请求。": 300, "驳回原告返还300元的诉讼请求。": None, "被告支付10元。宣判后，被告支付了7元。": 10, "被告返还100元。案件受理费50元由被告负担。": 100,
        "确认合同价款500元。": None, "被告赔偿1万元，支付2万元，合计3万元。": 30000, "被告每年支付100元。": None, "被告返还甲5元，返还乙6元。": None, "原告无需支付9元；被告支付8元。": 8,
    }
    assert one(spark, cases.granted_amount, *awarded) == list(awarded.values())


def test_partitions(spark):
    shapes = {
        "原告诉称：甲付款。被告辩称：未付。经审理查明：付款属实。法院作出一审判决：返还。后二审法院作出判决：维持原判并返还5元。": ("甲付款。", "未付。", "付款属实。", "维持原判并返还5元。"),
        "原告请求法院判决：被告付款": ("", "", "", ""),
        "原告张三诉称：请求依法判决：退款。法院认定：属实。判决如下：驳回。": ("请求依法", "", "属实。", "驳回。"),
        "诉称，欠款。诉称，再欠。被告李四在庭审中辩称：已还。": ("欠款。诉称，再欠。", "已还。", "", ""),
        "被告辩称：无。原告诉称：有。": ("有。", "无。", "", ""),
        "法院经审理查明：甲。原告要求人民法院作出判决：付款。人民法院据此做出判决：付5元。": ("", "", "甲。原告要求人民法院作出判决：付款。", "付5元。"),
        "诉请解除，判决：解除。": ("", "", "", ""),
        "诉请解除。判决：解除。": ("", "", "", "解除。"),
        "经审理查明：乙。": ("", "", "乙。", ""),
        "": ("", "", "", ""),
        None: ("", "", "", ""),
    }
    assert [tuple(x) for x in one(spark, cases.partitions, *shapes)] == list(shapes.values())


def test_numerals(spark):
    assert one(spark, T.article_number, "第九条", "二十六", "第五百零九条", "一千二百六十", "1261", "0", "十", "二百五", "两百", "abc", None) == [9, 26, 509, 1260, None, None, 10, 205, 200, None, None]
    assert one(spark, T.cited_provisions, "《中华人民共和国民法典》第五百零九条与民法典第509条", "第一条", None) == [["provision.0509"], [], []]


def test_text(spark):
    assert one(spark, T.tokens, "甲，乙 AB_1 丙")[0] == ["甲", "乙", "ab_1", "丙", "甲乙", "乙丙"]
    assert one(spark, T.compact, "a　 b\n") == ["ab"]
    assert one(spark, T.heading, "第一章 总 则", "附则", " ") == ["第一章 总则", "附则", None]
    assert one(spark, T.sections, "x\n## A\n1\n## B\n2\n## A\n3")[0] == {"B": "2", "A": "3"}
    assert one(spark, T.numbered_items, "1. 第一项事实很长的\n2. 短\n3. 第三项事实也很长")[0] == ["1. 第一项事实很长的", "3. 第三项事实也很长"]
    assert [str(x) for x in one(spark, T.date, "于2021年3月4日", "2021-13-40", "无")] == ["2021-03-04", "None", "None"]


def brute_truth(operator, states):
    if not states:
        return None
    if operator == "ALL":
        return False if "NOT_SATISFIED" in states else True if set(states) == {"SATISFIED"} else None
    return True if "SATISFIED" in states else False if set(states) == {"NOT_SATISFIED"} else None


def test_group_truth(spark):
    kinds = ["SATISFIED", "NOT_SATISFIED", "UNKNOWN", "CONFLICTING", "NOT_APPLICABLE"]
    combos = [c for n in (1, 2, 3) for c in product(kinds, repeat=n)]
    members = [(f"{op}{i}", op, f"{op}{i}.{j}") for op in ("ALL", "ANY") for i, c in enumerate(combos) for j in range(len(c))]
    states = [("q", f"{op}{i}.{j}", s) for op in ("ALL", "ANY") for i, c in enumerate(combos) for j, s in enumerate(c)]
    out = conditions.group_truth(spark.createDataFrame(members, "group_id string, operator string, condition_id string"), spark.createDataFrame(states, "owner string, condition_id string, status string"), "owner")
    got = {r.group_id: r.value for r in out.collect()}
    assert all(got[f"{op}{i}"] == brute_truth(op, c) for op in ("ALL", "ANY") for i, c in enumerate(combos))


def test_case_states(spark):
    rows = [("c", 1, "SATISFIED", 1), ("c", 1, "UNKNOWN", 2), ("c", 2, "SATISFIED", 1), ("c", 2, "NOT_SATISFIED", 2), ("c", 3, "SATISFIED", None), ("c", 4, "SATISFIED", 5), ("c", 4, "SATISFIED", 5)]
    got = {r.condition_id: (r.status, r.usable, r.support) for r in conditions.summarize(spark.createDataFrame(rows, "case_id string, condition_id int, status string, evidence int")).collect()}
    assert got == {1: ("UNKNOWN", False, 1), 2: ("CONFLICTING", True, 1), 4: ("SATISFIED", True, 1)}


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c"), (3, "")], "id long, text string")
    queries = spark.createDataFrame([(7, "b b x")], "query_id long, text string")
    got = {r.id: r.score for r in retrieval.bm25(docs, queries, 5).collect()}
    avg, idf = 7 / 3, np.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    want = {i: round(2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)), 4) for i, tf, dl in ((1, 2, 4), (2, 1, 2))}
    assert got == want
    assert retrieval.bm25(docs.repartition(7), queries, 5).orderBy("id").collect() == retrieval.bm25(docs, queries, 5).orderBy("id").collect()
    ranked = spark.createDataFrame([(1, "x", 10, 1), (1, "x", 10, 2), (1, "x", 11, 3), (1, "y", 11, 1), (1, "z", 12, 1)], "query_id long, channel string, id long, rank int")
    fused = {r.id: (r.score, r.channels) for r in retrieval.rrf(ranked, {"x": 1.0, "y": 0.5, "z": 0.0}).collect()}
    assert fused == {10: (round(1 / 61, 9), "x"), 11: (round(1 / 63 + 0.5 / 61, 9), "x,y")}


def test_recall_and_ndcg(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id long, id long, rank int")
    qrels = spark.createDataFrame([(1, 6), (1, 7), (1, 99), (2, 1)], "query_id long, id long")
    got = {(r.query_id, r.k): (r.recall, r.ndcg) for r in retrieval.recall(hits, qrels, [1, 3]).collect()}
    ideal = 1 + 1 / np.log2(3) + 0.5
    assert got[1, 3] == (round(2 / 3, 6), round((1 / np.log2(3) + 0.5) / ideal, 6)) and got[1, 1] == (0, 0) and got[2, 3] == (0, 0)


def test_pool_takes_roles_in_turn(spark):
    rows = [(1, i, r, 0.1 * i, 0.5) for i, r in enumerate(["support", "support", "limiting", "boundary", None, "limiting"])]
    out = conditions.pool(spark.createDataFrame(rows, "query_id long, case_id long, role string, coverage double, score double"), 5).orderBy("place").collect()
    assert [r.case_id for r in out] == [1, 5, 3, 0, 2]


def test_audit(spark):
    rows = spark.createDataFrame([("s1", "a", 0, 2, "AB"), ("s2", "a", 1, 3, "AB"), ("s3", "z", 0, 1, "A")], "span_id string, source_id string, start_offset int, end_offset int, quote string")
    got = {r.span_id: r.issue for r in audit.bad_spans(rows, spark.createDataFrame([("a", "ABC")], "source_id string, text string")).collect()}
    assert got == {"s2": "quote_mismatch", "s3": "unknown_source"}
    same = audit.duplicate_texts(spark.createDataFrame([(1, "a　b"), (2, "ab"), (3, "c"), (4, None), (5, None)], "id long, t string"), "id", "t")
    assert sorted((r.id, r.n) for r in same.collect()) == [(1, 2), (2, 2)]
    gaps = {(r.issue, r.number) for r in audit.sequence_gaps(spark.createDataFrame([(1,), (1,), (5,)], "n long"), "n", 3).collect()}
    assert gaps == {("missing", 2), ("missing", 3), ("unexpected", 5), ("duplicate", 1)}


def test_reconcile_makes_no_pairs_of_copies(spark):
    a = spark.createDataFrame([(1, "x y"), (1, "xy"), (2, "xy"), (3, None), (None, "xy"), (4, "z")], "id long, text string")
    b = spark.createDataFrame([(1, "xy"), (5, "x y"), (3, None), (None, "xy"), (4, "z")], "id long, text string")
    assert audit.reconcile(a, b).first()["text_under_other_id"] == 4
    n = 200_000
    copies = spark.range(n).withColumn("text", F.lit("a"))
    assert audit.reconcile(copies, copies).first()["text_under_other_id"] == n * n - n


def test_graph_release_depends_on_no_order(spark):
    nodes = graph.node_table("A", spark.range(50), "id", ["id"])
    edges = graph.edge_table("E", spark.range(50).withColumn("t", F.col("id") + 1), ("A", "id"), ("A", "t"))
    first = graph.release_id(nodes, edges).first()
    assert graph.release_id(nodes.repartition(7), edges.repartition(3)).first() == first
    assert graph.release_id(nodes.where("object_id <> '3'"), edges).first()["release_id"] != first["release_id"]
    assert graph.dangling_edges(edges, nodes).count() == 1 and graph.node_conflicts(nodes).count() == 0


def test_calibration(spark):
    samples = spark.createDataFrame([("d", 0.5, False), ("d", 0.9, False), ("d", 0.9, True)], "dataset string, score double, hit boolean")
    bins = sessions.calibrate(samples)
    got = {r.id: r.value for r in sessions.calibrated(spark.createDataFrame([("d", 1, 0.5), ("d", 2, 0.9), ("d", 3, 1.0)], "dataset string, id long, score double"), bins).collect()}
    assert 0 < got[1] <= got[2] < 0.9 and got[3] == got[2]


def test_pack_takes_later_smaller_items(spark):
    items = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 4)], "session_id long, pos long, size long")
    assert [r.taken for r in sessions.pack(items, 10).orderBy("pos").collect()] == [True, False, True]


EVIDENCE = "session_id long, condition_id string, fact_id long, relation string, turn long"


def stream_of(spark, tmp_path, name, frames, schema):
    folder = tmp_path / name
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def drained(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_streamed_fold_equals_batch(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(int(r.integers(5)), f"c{r.integers(3)}", i, str(r.choice(["SUPPORTS", "OPPOSES", "QUALIFIES"])), int(r.integers(6))) for i in range(120)]
    stream = stream_of(spark, tmp_path, "e", [rows[:40], rows[40:80], rows[80:]], EVIDENCE)
    got = {(x.session_id, x.condition_id): x.status for x in streams.newest(drained(spark, streams.fold_states(stream), "folded", tmp_path)).collect()}
    batch = sessions.states(spark.createDataFrame(rows, EVIDENCE).withColumn("confidence", F.lit(0.5)))
    want = {(x.session_id, x.condition_id): x.status for x in batch.collect()}
    assert got == want


def test_answers_once(spark, tmp_path):
    schema = "session_id long, question_id string, answer string, seq long"
    stream = stream_of(spark, tmp_path, "a", [[(1, "q", "yes", 2), (1, "q", "alas", 3)], [(1, "q", "yes", 4), (1, "r", "x", 5)], [(1, "q", "no", 6)]], schema)
    out = drained(spark, streams.answers(stream), "answered", tmp_path)
    got = sorted((x.question_id, x.outcome, x.revision) for x in out.collect())  # the first to arrive counts, not the first by alphabet
    assert got == [("q", "ACCEPTED", 1), ("q", "CONFLICT", 1), ("q", "CONFLICT", 2), ("q", "REPLAY", 1), ("r", "ACCEPTED", 2)]


def test_incremental_mapping(spark, tmp_path):
    conditions_ = spark.createDataFrame([(1, "a"), (1, "b")], "session_id long, condition_id string")
    stream = stream_of(spark, tmp_path, "m", [[(1, 10)], [(1, 10), (1, 11)]], "session_id long, fact_id long")
    ledger = str(tmp_path / "ledger")
    q = streams.map_new(stream, conditions_, ledger, str(tmp_path / "map-cp"))
    assert q.awaitTermination(120)
    assert sorted((x.fact_id, x.condition_id) for x in spark.read.parquet(ledger).collect()) == [(10, "a"), (10, "b"), (11, "a"), (11, "b")]
    for n, version in enumerate(("1", "2", "2")):  # a new mapper maps all pairs again, and once
        again = stream_of(spark, tmp_path, f"v{n}", [[(1, 10)]], "session_id long, fact_id long")
        assert streams.map_new(again, conditions_.withColumn("mapper_version", F.lit(version)), ledger + "-v", str(tmp_path / f"map-v{n}")).awaitTermination(120)
    assert sorted((x.condition_id, x.mapper_version) for x in spark.read.parquet(ledger + "-v").collect()) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]


@pytest.mark.parametrize("gone", [["docketry/llm", "corpus_pipeline.py", "tests/llm"], ["corpus_pipeline.py"]])
def test_entry_without_llm(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'bm25_recall' in q; e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr[-800:]


def test_files(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    from docketry.sources import files

    schema = StructType([StructField("id", LongType())])
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_bytes(b'{"id": 1}\r\n\r\n{"id": "x"}\r\n')
    good, bad = files.read_jsonl(spark, str(folder), schema)
    assert [r.id for r in good.collect()] == [1] and bad.count() == 1
    stated = files.manifest(spark, str(folder))
    row = stated.first()
    import hashlib

    assert row.records == 2 and row.sha256 == hashlib.sha256(b'{"id": 1}\n\n{"id": "x"}\n').hexdigest()
    assert files.verify_manifest(spark, str(folder), stated).count() == 0
    assert files.verify_manifest(spark, str(folder), stated.withColumn("records", F.lit(9).cast("long"))).first()["issue"] == "records"
    files.publish({"nodes": spark.range(3)}, str(tmp_path / "g"), "r1")
    files.publish({"nodes": spark.range(5)}, str(tmp_path / "g"), "r2")
    assert files.read_release(spark, str(tmp_path / "g"), "nodes").count() == 5
    files.write_jsonl(spark.range(4), str(tmp_path / "out"), "id")
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    files.save_vectors(vectors, str(tmp_path / "v"), "m", "1", 2)
    assert files.load_vectors(spark, str(tmp_path / "v"), "m", "1", 2).count() == 1
    with pytest.raises(Exception, match="specification"):
        files.load_vectors(spark, str(tmp_path / "v"), "m", "2", 2).collect()
