"""The pipeline's stages on odd rows, clashing columns and empty tables, and the whole of it against brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from docketry.llm import bpe, quality
from docketry.llm.common import table
from tests.llm.test_operators import LINE, ODD, SCHEMA, lower, words

STAGES = dict(pipeline.STAGES)
EXTRA = SCHEMA + ", n_deleted string, `__doc` int, gone int, root int, may int"
PROSE = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*ODD, (11, f"{PROSE}\n{LINE}", "en", "a", 7, "y", 2), (11, f"{PROSE}\n{LINE}", "en", "a", 7, "y", 2), (None, PROSE, "en", None, 8, "z", 3), (12, PROSE + " end", "en", "b", 9, "w", 4)]
    return spark.createDataFrame([(*r, "kept", 1, 2, 3, 4) for r in rows], EXTRA)


def plain(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage(spark, odd, small, name):
    got = STAGES[name](spark, odd, small)
    assert got.columns == odd.columns and [t for _, t in got.dtypes] == [t for _, t in odd.dtypes]
    assert STAGES[name](spark, odd.limit(0), small).count() == 0
    before, after = plain(odd), plain(got)
    if name == "quality rules":
        assert after and not after - before and all(len(words(r[1])) >= quality.MIN_WORDS for r in after)
    if name == "line dedup":  # the later copies of LINE go, by doc_id; a text that is a copy in whole goes
        texts = Counter((r[0], r[1], r[5]) for r in after.elements())
        assert texts[7, f"start\n{LINE}\nend", "x"] == 1 and texts[8, "other\n\nlast", "x"] == 1 and texts[11, PROSE, "y"] == 1 and texts[2, None, "x"] == 1
        assert all(r[4] == len(r[1]) for r in after if r[5] == "y") and all(r[7:] == ("kept", 1, 2, 3, 4) for r in after)
    if name == "near dedup":  # one row of each group; what has no words links with nothing
        assert not after - before
        found = Counter((r[0], r[5]) for r in after.elements())
        assert found[5, "x"] == 1 and not found[6, "x"] and found[9, "x"] == 1 and not found[10, "x"] and found[11, "y"] == 1 and found[12, "w"] + found[None, "z"] == 1 and all(found[k, "x"] == 1 for k in (2, 3, 4))
    if name == "mix sources":
        assert not set(after) - set(before) and all(n <= 3 * before[r] for r, n in after.items())


def test_codec(spark, odd, small):
    got = STAGES["bpe"](spark, odd, small)
    assert got.count() == odd.count() and STAGES["bpe"](spark, odd.limit(0), small).count() == 0
    texts = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in got.collect()) == texts


def brute_near_dedup(rows):
    """Rows (doc_id, text) but for all except the smallest of each group of J >= 0.8 over five words."""
    sets = []
    for _, text in rows:
        own = words(lower(text))
        sets.append({tuple(own[i : i + 5]) for i in range(len(own) - 4)} or ({tuple(own)} if own else set()))
    root = list(range(len(rows)))
    holders = {}
    for i, x in enumerate(sets):
        met = Counter(j for s in x for j in holders.get(s, []))
        for j, n in met.items():
            if 100 * n >= 80 * (len(x) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
        for s in x:
            holders.setdefault(s, []).append(i)
    return [r for i, r in enumerate(rows) if root[i] == i]


def test_run(spark, small):
    """Each stage works on what the one before has kept: counts and texts against brute force where the stage allows it."""
    docs = table(spark, small, "documents")
    kept = pipeline.quality_rules(spark, docs, small)
    judged = {r.doc_id for r in quality.op7_quality(spark, small).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == judged
    deduped = pipeline.line_dedup(spark, kept, small).select("doc_id", "text").orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text) for r in deduped]
    near = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), small)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == brute_near_dedup(rows)
    out = pipeline.run(spark, small)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = {r.doc_id for r in out.collect()}
    assert ids and ids <= {k for k, _ in brute_near_dedup(rows)}
    texts = dict(rows)
    one = out.orderBy("doc_id").first()
    codec = bpe.Bpe(bpe.default_path())
    assert one.ids_sha256 == hashlib.sha256(codec.encode(texts[one.doc_id])).hexdigest()
    assert out.where(F.col("n_tokens") == 0).count() == 0
