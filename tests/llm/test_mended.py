"""Names and types of columns in all stages, archives with several records a member, memory of many languages, windows of all texts."""

import gzip
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import langid, lm, neardup, vectors, warc
from docketry.llm.common import shared_dir
from tests.llm.test_operators import ODD, SCHEMA


@pytest.mark.parametrize("ident", ["long", "string"])
def test_stages_keep_odd_columns(spark, tmp_path, ident):
    """A column whose name has a dot, one named like an operator's own, and ids that are no numbers."""
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("kept", F.lit("k"))
    if ident == "string":
        docs = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        assert out.select("`a.b`", "kept").distinct().count() <= 1
    assert corpus_pipeline.bpe_codec(spark, docs, str(tmp_path)).count() == len(ODD)


def one(kind, ident, block):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def archive(spark, name, content):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, root = warc.open_fs(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(content)
    return warc.list_warc(spark, folder)


def test_members_with_several_records(spark):
    files = archive(spark, "x.warc.gz", gzip.compress(one("warcinfo", "a", b"i") + one("response", "<urn:page:1>", b"one\r\n\r\nWARC/1.0") + one("response", "<urn:page:2>", b"")) + gzip.compress(one("response", "<urn:page:3>", b"three")))
    for payload in (True, False):
        got = warc.read_warc(files, 50, payload).select("record_type", "page_id", "payload_bytes").collect()
        assert sorted((r[0], r[1] or 0, r[2]) for r in got) == [("response", 1, 15), ("response", 2, 0), ("response", 3, 5), ("warcinfo", 0, 1)]
    with pytest.raises(ValueError, match="follow its last record"):
        list(warc.records_of(one("warcinfo", "a", b"i") + b"junk"))


def test_plain_archives(spark):
    inner = one("response", "<urn:page:9>", b"phantom")
    rows = [one("response", f"<urn:page:{i}>", np.random.default_rng(i).bytes(997 * i)) for i in range(1, 6)] + [one("response", "<urn:page:6>", b"x\r\n\r\n" + inner + b"y" * 4000)]
    files = archive(spark, "x.warc", b"".join(rows))
    for split in (1000, 8 << 20):
        got = sorted((r.page_id, len(r.payload)) for r in warc.read_warc(files, split).collect())
        assert got == [(i, 997 * i) for i in range(1, 6)] + [(6, 4005 + len(inner))]


def test_many_languages(monkeypatch):
    """However few languages are held at once, the counts are the same."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"l{i % 40}" for i in range(120)]), pa.array([f"some words of {i % 40} here {'abcdefgh'[i % 8] * 5}" for i in range(120)])], names=["lang", "text"])

    def counted():
        total = {}
        for b in langid.profile_counts([batch]):
            for lang, gram, n in zip(*(b.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
                total[lang, gram] = total.get((lang, gram), 0) + n
        return total

    whole = counted()
    monkeypatch.setattr(langid, "HELD_LANGS", 1)
    assert counted() == whole and len({k for k, _ in whole}) == 40


def test_tiles_go_by_bytes(spark):
    """Long texts of few shingles make many tiles, and are still one component."""
    base = [f"w{i % 50}" for i in range(4000)]
    texts = [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(40)] + [(100, "quite another text of a few words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = neardup.sketch(docs.withColumnRenamed("doc_id", "row"), 4).where("row < 100").collect()
    assert all(r["size"] > 10_000 and r["n_shingles"] < 100 for r in sizes)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, tile_bytes=60_000).collect()}
    assert got == {i: 0 for i in range(40)} | {100: 100}


def test_every_training_text_gives_a_window():
    texts = ["", "one", *(" ".join(f"w{j}" for j in range(n)) for n in (3, 40, 500))]
    ids, offsets, *_ = lm.text_ids(pa.array(texts), None)
    packed = pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), packed], names=["key", "ids"])
    model = lm.Attention(np.ones(lm.vocabulary_size(None)))
    few = list(lm.training_windows(model, 1 << 40)([batch]))
    assert sum(b.num_rows for b in few) == len(texts)
    every = lm.unpacked(w for b in lm.training_windows(model, 1)([batch]) for w in b.column("window").to_pylist())
    want, begins, pads = [], model.head + 1, model.head + 2
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        laid = [pads] * lm.BLOCK + [begins] + model.bucket[ids[a:b]].tolist() + [pads] * lm.BLOCK
        want += [laid[i : i + 2 * lm.BLOCK + 1] for i in range(0, b - a, lm.BLOCK)]
    assert sorted(every.tolist()) == sorted(want)


def test_shards_train_on_every_window():
    """What a shard unpacks from stretches, of any length and in any order, is every window of every text."""
    texts = ["", "one", *(" ".join(f"w{j}" for j in range(n)) for n in (3, 40, 500))]
    ids, offsets, *_ = lm.text_ids(pa.array(texts), None)
    packed = pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), packed], names=["key", "ids"])
    model = lm.Attention(np.ones(lm.vocabulary_size(None)))
    want = lm.unpacked(w for b in lm.training_windows(model, 1)([batch]) for w in b.column("window").to_pylist())
    for most in (1, 2, lm.STRETCH):
        held = [x for b in lm.stretches(model, most)([batch]) for x in b.column("stretch").to_pylist()]
        assert sorted(lm.windows_of(held[::-1], model.head + 2).tolist()) == sorted(want.tolist())


def test_collisions_are_counted_for_every_pair():
    """Links of two blocks, over several tiles and an incomplete one, are those of the definition."""
    r = np.random.default_rng(6)
    base = r.standard_normal((30, 64))
    x = np.concatenate([base[r.integers(0, 30, 700)] + 0.2 * r.standard_normal((700, 64)), r.standard_normal((300, 64))])
    x = r.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    a, b = x[:300], x[300:]
    p, q = a @ vectors.directions(64), b @ vectors.directions(64)
    counts = (np.abs(p[:, None] - q[None]) <= vectors.WIDTH * np.sqrt(2 - 2 * vectors.COSINE)).sum(axis=2)
    want = np.argwhere((counts >= vectors.least_count()) & (a @ b.T >= vectors.COSINE))
    got = np.stack(vectors.linked(a, b, vectors.COSINE, vectors.PROJECTIONS, vectors.WIDTH, vectors.RECALL), axis=1)
    assert got.tolist() == want.tolist() and len(want) > 1000
    assert [len(k) for k in vectors.linked(a[:0], b, vectors.COSINE, vectors.PROJECTIONS, vectors.WIDTH, vectors.RECALL)] == [0, 0]


def test_known_words_are_cut_once(monkeypatch):
    """Words that were cut beforehand are not cut again, and texts get the same ids."""
    texts = pa.array([None, "", "The one of the", "oneé of\n\nmany, of 中文 \U0001f600"])
    want = lm.text_ids(texts, None)
    known, cut, plain = lm.Known({"of": 9, "the": 5, lm.END: 4, "中文": 1}, None), [], lm.subwords
    monkeypatch.setattr(lm, "subwords", lambda words, path: cut.extend(words.to_pylist()) or plain(words, path))
    got = lm.text_ids(texts, None, known)
    assert all(np.array_equal(a, b) for a, b in zip(got[:4], want[:4], strict=True))
    assert sorted(cut) == sorted(["one", "oneé", "many,", "\U0001f600"])


def test_rows_are_added_at_their_places():
    r = np.random.default_rng(8)
    for kind in (np.float32, np.float64):
        to, at, rows = r.standard_normal((9, 6)).astype(kind), r.integers(0, 9, 200), r.standard_normal((200, 6)).astype(kind)
        want = to.copy()
        for i, row in zip(at, rows, strict=True):
            want[i] += row
        lm.add_rows(to, at, rows)
        assert np.allclose(to, want, atol=1e-4)
