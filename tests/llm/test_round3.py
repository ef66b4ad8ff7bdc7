"""Phrases, packing and periodic runs against SQL, exact solvers and brute force, and the odd rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import packing, phrases, repeats
from docketry.llm.bpe import default_path
from docketry.llm.common import table
from tests.llm.test_operators import ODD, SCHEMA, words


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collocations(docs, path, tmp_path, **kw):
    """Rows of the operator and of the SQL over the same documents."""
    docs.select("lang", "text").write.mode("overwrite").parquet(f"{tmp_path}/documents")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = c.execute(phrases.OP11_SQL).df()
    got = phrases.phrases(docs, **kw).toPandas()[list(want.columns)]
    return [sorted(map(tuple, x.astype(str).values)) for x in (got, want)]


def test_phrases(spark, small, odd, none, tmp_path):
    docs = table(spark, small, "documents")
    got, want = collocations(docs, small, tmp_path)
    assert got == want and len(want) > 100
    got, _ = collocations(docs, small, tmp_path, hot=15)  # nearly all stripes are split
    assert got == want
    repeated = odd.withColumn("text", F.concat("text", F.lit(". A b, C d\ta B "))).crossJoin(spark.range(12)).drop("id")
    got, want = collocations(repeated, small, tmp_path)
    assert got == want and any(r[0] == "und" for r in want)
    with pytest.MonkeyPatch.context() as m:  # many buckets
        m.setattr(phrases, "GROUP_BYTES", 1000)
        got, want = collocations(docs, small, tmp_path)
        assert got == want
    assert phrases.phrases(none).count() == 0
    assert phrases.phrases(odd.withColumn("n", F.lit(1)).withColumn("key", F.lit(2))).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_hot_prefixes_split_alike_whatever_languages_a_batch_holds(spark, small, tmp_path, monkeypatch):
    """Words that several languages share, over buckets of few bytes: a batch's other languages must not move a stripe's entries."""
    monkeypatch.setattr(phrases, "GROUP_BYTES", 1000)
    r = np.random.default_rng(4)
    rows = [(("en", "fr", "de")[i % 3] if i % 7 else None, " ".join(f"w{x}" for x in r.integers(0, r.choice([3, 30]), 40))) for i in range(600)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got, want = collocations(docs, small, tmp_path, hot=15)
    assert len(want) > 100 and got == want


def test_phrase_scores_are_exact(spark):
    big = 3 * 10**12
    row = spark.range(1).select(phrases.cohesion(F.lit(big), F.lit(big + 1), F.lit(big + 7)).alias("s")).first()
    assert row["s"] == 1_000_000 * big * big // ((big + 1) * (big + 7))


def optimum(counts):
    room = len(counts) - 1
    sizes = [s for s in range(room, 0, -1) for _ in range(counts[s])]
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for left in {b for b in bins if b >= sizes[i]}:
            at = bins.index(left)
            go(i + 1, bins[:at] + [left - sizes[i]] + bins[at + 1 :])
        go(i + 1, [*bins, room - sizes[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    r, fixed, triples = np.random.default_rng(1), 0, 0
    for _ in range(400):
        room = int(r.integers(6, 40))
        counts = np.bincount(r.integers(r.integers(1, max(2, room // 3)), room + 1, r.integers(1, 11)), minlength=room + 1)
        sets, rest = packing.reduced(counts)
        n = sum(times for _, times in sets)
        assert n + optimum(rest.tolist()) == optimum(counts.tolist())
        patterns = packing.solved(counts)
        used = np.zeros_like(counts)
        for parts, times in patterns:
            assert sum(s * m for s, m in parts) <= room
            for s, m in parts:
                used[s] += m * times
        assert (used == counts).all()
        fixed, triples = fixed + n, triples + sum(t for p, t in sets if sum(m for _, m in p) == 3)
    assert fixed > 1000 and triples > 10


def test_packing(spark, small, odd, none):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(default_path())
    coder.no_truncation()
    coder.no_padding()
    got = packing.op12_packing(spark, small).toPandas()
    rows = table(spark, small, "documents").toPandas().set_index("doc_id")
    for doc_id, own in got.sort_values("piece").groupby("doc_id"):
        ids = np.array(coder.encode(rows.text[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        assert (own.start.to_numpy() == np.cumsum(own.length) - own.length).all() and (own.length.iloc[1:] == 1024).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert set(got.doc_id) == set(rows.index)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.cumsum(own.length) - own.length).all() and own.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 1024) + 1
    whole = packing.sequences(odd, capacity=64).toPandas()
    assert whole.ids.map(len).max() <= 64 and whole.ids.map(len).sum() == packing.pieces(odd).agg(F.sum("length")).first()[0]
    parts = packing.pieces(odd).where("doc_id in (2, 3)").collect()
    assert [(p["length"], p["ids_crc32"]) for p in parts] == [(1, zlib.crc32(b"\2\0\0\0"))] * 2
    assert packing.packed(packing.pieces(none)).count() == 0 and packing.sequences(none).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b", "x\n\n y", "x\ny\n z", "  \t z", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "it's 's ' s", "a  b", "a　  c", "\x00 \x1c a \x85 b", "", "\n", " é à ç", "日本 語 あ", "word!!! (x)", "x \n", "x\n "])
def test_units_keep_tokens(text):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(default_path())
    ids, offsets = packing.Coder(None).encode(pa.array([text, "solid", text]))
    want = [coder.encode(t, add_special_tokens=False).ids for t in (text, "solid", text)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want


def brute_runs(x):
    w, n, out = np.unique(np.array(x, str), return_inverse=True)[1], len(x), []
    for q in range(1, n // 3 + 1):
        same = np.r_[0, (w[:-q] == w[q:]).astype(int), 0]
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if e - s + q >= max(24, 3 * q) and not any((w[s : e + q - p] == w[s + p : e + q]).all() for p in range(1, q)):
                out.append((int(s), int(e - s + q), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    r = np.random.default_rng(0)
    for _ in range(150):
        texts = []
        for _ in range(r.integers(1, 5)):
            w = list(r.integers(0, r.choice([1, 2, 3, 5, 30]), r.integers(0, 120)))
            for _ in range(r.integers(0, 4)):
                w += (list(r.integers(0, 9, r.integers(1, 40))) * int(r.integers(2, 12)))[: r.integers(1, 400)]
            texts.append(w)
        offsets = np.cumsum([0, *map(len, texts)])
        text, start, length, period = repeats.find_runs(np.array(sum(texts, []), np.int64), offsets)
        for i, w in enumerate(texts):
            at = text == i
            assert list(zip(start[at], length[at], period[at], strict=True)) == (brute_runs(w) if w else [])


def test_repeats(spark, small, odd, none):
    got = repeats.op13_repeats(spark, small).toPandas().set_index("doc_id")
    rows = table(spark, small, "documents").toPandas().set_index("doc_id")
    for doc_id, text in rows.text.items():
        w, h = words(text), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, row = brute_runs(w) if w else [], got.loc[doc_id]
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda r: (-1000 * r[1] / r[2], r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()
    assert (got.n_runs > 0).sum() > 10
    rows = repeats.periodic(odd.withColumn("runs", F.lit(1)).withColumn("id", F.lit(1))).collect()
    assert len(rows) == len(ODD) and sum(r["n_words"] for r in rows) == sum(len(words(t[1])) for t in ODD)
    assert sorted(r["runs"][0]["period"] for r in rows if r["runs"]) == [977] * 3
    assert repeats.periodic(none).count() == 0
    ties = spark.createDataFrame([([(0, 30, 10), (40, 30, 10), (90, 15, 4), (120, 60, 16)],)], "runs array<struct<start: long, length: long, period: long>>")
    assert ties.select(repeats.strongest(F.col("runs")).alias("r")).first()["r"]["start"] == 90
