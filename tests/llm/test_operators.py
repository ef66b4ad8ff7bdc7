"""Brute-force versions, exact round trips, held-out accuracy, and the odd rows that every operator must take."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import bpe, langid, licences, linededup, lm, mixing, neardup, quality, vectors, warc
from docketry.llm.common import components, shared_dir, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, pos int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
LINE = " ".join(f"passage{i}" for i in range(60))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1, "x", 1),
    (2, None, "en", "a", 1, "x", 1),
    (3, "", None, "b", 0, "x", 1),
    (4, " \n\t ", "fr", None, 3, "x", 1),
    (5, LONG, "en", "b", 1, "x", 1),
    (6, LONG, "en", "b", 1, "x", 1),
    (6, LONG, "en", "b", 1, "x", 1),
    (7, f"start\n{LINE}\nend", "en", "a", 1, "x", 1),
    (8, f"other\n\n{LINE}\nlast", "de", None, 1, "x", 1),
    (None, "ein kleines Stück Text", "de", "c", 1, "x", 1),
    (9, "a b c", "en", "c", 1, "x", 1),
    (10, "a b c", "en", "c", 1, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_mixing(spark, odd, none, small):
    docs = table(spark, small, "documents")
    got = mixing.op1_mix(spark, small).toPandas().set_index("doc_id")
    rows = docs.toPandas().set_index("doc_id")
    sizes = rows.text.map(lambda t: len(words(t)))
    assert (got["size"] == sizes.loc[got.index]).all()
    by = sizes.groupby(rows.source).sum()
    weights, total, fixed = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by.index))}, by.sum(), {}
    while True:  # brute force: cap, reshare, repeat
        free = [s for s in by.index if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > 3 * by[s]]
        if not over:
            break
        fixed |= {s: 3 * by[s] for s in over}
    want = {s: fixed.get(s, weights[s] * level) for s in by.index}
    assert np.allclose(got.target, [want[s] for s in rows.source.loc[got.index]])
    assert (got.taken <= 3 * got["size"]).all()
    taken = got.taken.groupby(rows.source).sum()
    for s in by.index:
        assert abs(taken[s] - want[s]) <= sizes[rows.source == s].max()
    again = mixing.op1_mix(spark, small).toPandas().set_index("doc_id").loc[got.index]
    assert (again.taken == got.taken).all()
    assert mixing.mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.where("text is null").count() <= 3


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(bpe.default_path())
    texts = ["", "a", "ab" * 5000, "x  y \n z ", "it's 'S  a　b c\x1c d\ttab", "é漢字 😀<|endoftext|>tail<|endof", "  lead", "t \n b", "\r\n\r\n", LONG, "won't've 12345 ___ ##"]
    got = ours.encode_many(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids
        assert ours.decode(ids) == theirs.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == t
        assert [x for p in ours.split(t) for x in ours.merge(p.encode())] == np.frombuffer(ours.encode(t), "<u4").tolist() or "<|endoftext|>" in t
    rows = {r.doc_id: r for r in bpe.encode_digests(odd).collect()}
    assert len(rows) == 11 and rows[2].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.encode_digests(none).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd)).collect()}
    assert back[1] == ODD[0][1] and back[2] == ""


def brute_line_dedup(rows, least=50):
    seen, gone = set(), set()
    lines = {k: [(i, x) for i, x in enumerate((t or "").split("\n")) if words(x)] for k, t in rows}
    found = []
    for k in sorted(lines):
        own = lines[k]
        for i in range(len(own)):
            for j in range(i, len(own)):
                if sum(len(words(x)) for _, x in own[i : j + 1]) >= least:
                    found.append((k, i, j))
    for k, i, j in found:
        content = tuple(x for _, x in lines[k][i : j + 1])
        if content in seen:
            gone |= {(k, lines[k][p][0]) for p in range(i, j + 1)}
        seen.add(content)
    return gone


def test_line_dedup(spark, odd, none):
    out = {r.doc_id: r for r in linededup.dedup_lines(odd).collect()}
    assert out[7].text == f"start\n{LINE}\nend" and out[8].text == "other\n\nlast" and out[8].n_deleted == 1
    assert out[2].text is None and out[3].text == "" and linededup.dedup_lines(odd).columns[: len(odd.columns)] == odd.columns
    assert linededup.dedup_lines(none).count() == 0
    r = np.random.default_rng(4)
    pool = [" ".join(f"t{r.integers(9)}" for _ in range(n)) for n in (1, 2, 5, 9, 20, 30, 55)]
    rows = [(k, "\n".join(pool[i] for i in r.integers(0, len(pool), r.integers(1, 12)))) for k in range(25)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    gone = brute_line_dedup(rows)
    for x in got:
        want = [line for i, line in enumerate(dict(rows)[x.doc_id].split("\n")) if (x.doc_id, i) not in gone]
        assert x.text == "\n".join(want), x.doc_id


def test_line_dedup_of_odd_rows(spark):
    """Users' columns of any name keep their values; shared, null and string ids make rows of their own."""
    rows = [(7, f"a\n{LINE}", "x", "g", 5, 6, 1), (7, f"{LINE}\nb", "y", "h", 7, 8, 2), (None, LINE, "z", "i", 9, 10, 3), (9, None, "w", "j", 11, 12, 4)]
    schema = "doc_id long, text string, row string, gone string, n_lines int, n_deleted int, at int"
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema).withColumn("doc_id", F.col("doc_id").cast("string"))):
        got = {r.row: r for r in linededup.dedup_lines(frame).collect()}
        assert [got[r[2]][2:7] for r in rows] == [r[2:] for r in rows] and got["w"].text is None
        assert got["z"].text == LINE and got["z"]._n_deleted == 0 and {got["x"].text, got["y"].text} == {"a", "b"} and got["x"]._n_lines == 2
    unique = spark.createDataFrame([r for r in rows if r[2] != "y"], schema)
    assert {r.row: r.text for r in linededup.dedup_lines(unique.where("doc_id is not null")).collect()} == {"x": f"a\n{LINE}", "w": None}


def test_licences(spark, odd, none):
    texts = ["Released under the MIT License.", "x APACHE-License, version 2 y apache license version 2", "cc-by-nc CC BY NC", "licensed under the GNU General Public License, version 3", "under the mit licence", None, ""]
    rows = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (rows[0].base_labels, rows[0].n_base, rows[0].first_word) == ("mit", 1, 1)
    assert (rows[1].base_labels, rows[1].n_base, rows[1].first_word, rows[1].last_word) == ("apache-2", 2, 1, 6)
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word) == (2, 0, 3)
    assert (rows[3].base_labels, rows[3].labels, rows[3].n_base) == ("", "gpl-3", 0)
    assert rows[4].n_base == 0 and rows[5].n_words == 0 and rows[6].score == 0 and rows[5].first_word is None
    body = next(t for t, label in licences.TEMPLATES if label == "mit" and len(t.split()) > 100).split()
    worn = [w if i % 40 else "other" for i, w in enumerate(body)]
    cases = ["intro. " + " ".join(body).upper() + " outro", " ".join(worn), " ".join(body[:60]), " ".join(x for i, x in enumerate(body) if i % 3)]
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert [found[i].labels for i in range(4)] == ["mit", "mit", "mit", ""] and found[0].score == 1 and 0.8 <= found[1].score < 1 and found[3].score < 0.5
    assert licences.scan(odd).count() == len(ODD) and licences.scan(none).count() == 0


def test_licences_by_brute_force(spark, small):
    """Every place of a base phrase, word by word; every template that stands in a text in whole gives its label."""
    rows = {r.doc_id: r for r in licences.op4_licences(spark, small).collect()}
    for r in table(spark, small, "documents").collect():
        own = [w for w in re.split(licences.WORDS, lower(r.text)) if w]
        places = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        x, starts = rows[r.doc_id], [i for i, _ in places]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(own), len(places), min(starts, default=None), max(starts, default=None))
        base = {label for _, label in places}
        assert x.base_labels == ",".join(sorted(base)) and base <= set(x.labels.split(",")) and 0 <= x.score <= 1 and (not places or x.score == 1)
        line = f" {' '.join(own)} "
        whole = {label for text, label in licences.TEMPLATES if f" {text} " in line}
        assert whole <= set(x.labels.split(",")), (r.doc_id, whole, x.labels)


def test_language_model(spark, odd, none):
    rows = {r.doc_id: r for r in lm.score(odd).collect()}
    held = {k: (__import__("zlib").crc32(str(k).encode()) % 5 == 1) if k is not None else False for k in [r[0] for r in ODD]}
    train = Counter()
    for r in ODD:
        if not held[r[0]]:
            train.update([*words(lower(r[1])), "\n"])
    n, v = sum(train.values()), len(train)
    for r in ODD:
        tokens = [*words(lower(r[1])), "\n"]
        x = rows[r[0]]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[r[0]], len(tokens), sum(train[t] > 0 for t in tokens), n)
        want = sum(np.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert abs(x.base_score - want) < 1e-6 * max(1, abs(want)) and x.score <= 0
    assert lm.score(none).count() == 0


def test_attention_is_causal_and_normal():
    r = np.random.default_rng(0)
    model = lm.Attention(r.integers(1, 50, 300).astype(float), head=100)
    tables = model.tables()
    ids = r.integers(0, 300, 40)
    blocks, _, first = lm.blocks_of(ids, np.array([0, 40]), 301)
    before = model.log10(blocks, first, tables)
    changed = blocks.copy()
    changed[1, 5:] = (changed[1, 5:] + 7) % 300
    after = model.log10(changed, first, tables)
    assert np.allclose(before.ravel()[:21], after.ravel()[:21])  # earlier subwords don't see later ones
    assert np.allclose(before, model.log10(blocks, first, tables, rows=1))
    total = sum(10 ** model.log10(np.where(np.arange(lm.BLOCK) == 3, x, blocks[:1]), first[:1], tables)[0, 3] for x in range(300))
    assert abs(total - 1) < 1e-4
    windows = r.integers(0, 20, (256, 2 * lm.BLOCK + 1))
    windows[:, 1::2] = windows[:, ::2][:, : lm.BLOCK] + 20  # each second subword follows from the one before
    losses = model.fit(windows, 120, 0.05)
    assert np.mean(losses[-5:]) < losses[0] - 0.5
    model = lm.Attention(r.integers(1, 50, 300).astype(float), head=100)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, grads = model.step(windows)
    for name, at in {"e": (3, 1), "q": (0, 1), "k": (2, 2), "v": (1, 0), "g": (4, 5), "b": (3,), "d": (2,), "x": (1, 30)}.items():
        model.w[name][at] += 1e-3
        up = model.step(windows)[0]
        model.w[name][at] -= 2e-3
        down = model.step(windows)[0]
        model.w[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 1e-4 + 0.02 * abs(grads[name][at]), name


def test_language_model_learns(spark, small):
    """On held-out text the model beats its own subwords' frequencies; partitioning changes no score."""
    docs = table(spark, small, "documents")
    got = lm.op5_lm(spark, small).toPandas().set_index("doc_id")
    rows = docs.toPandas().set_index("doc_id").loc[got.index]
    ids, offsets, *_ = lm.text_ids(pa.array(rows.text), None)
    own, held = np.repeat(np.arange(len(rows)), np.diff(offsets)), got.held_out.to_numpy()
    counts = np.bincount(ids[~held[own]], minlength=lm.vocabulary_size(None))
    log_p = np.log10((counts + 0.5) / (counts.sum() + 0.5 * len(counts)))
    assert got.score[held].sum() > 0.95 * log_p[ids[held[own]]].sum()
    again = lm.score(docs.repartition(5)).toPandas().set_index("doc_id").loc[got.index]
    assert np.allclose(got.score, again.score, rtol=1e-5) and np.allclose(got.base_score, again.base_score)


def brute_components(n, links):
    root = list(range(n))
    for a, b in links:
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    return root


def test_near_duplicates(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[5][0].component_id == 5 and len(by[6]) == 2 and all(r.component_id == 5 and not r.kept for r in by[6])
    assert by[2][0].n_shingles == by[3][0].n_shingles == 0 and by[9][0].n_shingles == 1 and by[10][0].component_id == 9 and by[3][0].component_id == 3
    assert (by[None][0].component_id, by[None][0].kept) == (None, True)
    assert neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0
    r = np.random.default_rng(2)
    base = [[f"w{x}" for x in r.integers(0, 5000, 60)] for _ in range(6)]
    texts = []
    for _ in range(150):
        own = list(base[r.integers(6)])
        for p in r.integers(0, 60, r.integers(0, 3)):
            own[p] = f"n{r.integers(10**6)}"
        texts.append(" ".join(own))
    sets = [{tuple(words(t)[i : i + 4]) for i in range(len(words(t)) - 3)} for t in texts]
    links = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = brute_components(150, links)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"whole": 40, "tile_bytes": 20_000}):  # one task a family; nodes that branch on, and families in blocks
        out = neardup.near_duplicates(frame, **options)
        assert {x.doc_id: x.component_id for x in out.collect()} == dict(enumerate(want)), options
    plain = neardup.near_duplicates(frame.select(F.col("doc_id").cast("string"), "text").repartition(5))
    assert len({(want[int(x.doc_id)], x.component_id) for x in plain.collect()}) == len(set(want))


@pytest.mark.parametrize("most", [neardup.MOST, 64])
def test_candidates_hold_all_near_pairs(spark, most):
    """A node that branching doesn't part, with a pair far from its medoid, and one with a side within FAMILY_DIFFERENT and one beyond."""
    r = np.random.default_rng(4)
    bits = r.integers(0, 4, (200, neardup.COORDINATES))
    bits[2:60] = bits[2]
    bits[100, :40] = bits[2, :40]  # 24 from the many equal ones at most
    bits[101] = bits[100]
    bits[101, :20] = (bits[100, :20] + 1) % 4
    bits[151] = bits[150]
    bits[151, :8] = (bits[150, :8] + 1) % 4
    s = neardup.two_bits(bits)
    off = (bits[:, None] != bits[None]).sum(axis=2)
    assert off[100, 2] <= neardup.FAMILY_DIFFERENT < off[101, 2] and off[100, 101] == 20 and off[150, 2] > neardup.FAMILY_DIFFERENT
    minima = np.zeros(neardup.COORDINATES, "<u4").tobytes()
    classes = spark.createDataFrame([(i, *map(int, s[i]), bytearray(minima)) for i in range(200)], "rep long, s1 long, s2 long, minima binary")
    got = {x.id: x.component for x in components(neardup.candidates(classes, 1, most, most)).collect()}
    near = [(i, j) for i in range(200) for j in range(i) if off[i, j] <= neardup.MOST_DIFFERENT]
    assert (101, 100) in near and (151, 150) in near and all(got.get(i, -1) == got.get(j, -2) for i, j in near)


def test_near_duplicates_of_shared_ids(spark):
    """Rows are documents of their own: neither their order nor the ids they share changes what links."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, b + " end"), (None, a), (None, a), (7, a), (7, a), (3, "c d")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame([(*x, i, "k", 1) for i, x in enumerate(order)], "doc_id long, text string, row int, key string, may int")
        got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()), key=str)
        assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, 1, False), (7, 1, False), (7, 1, False), (3, 3, True)], key=str)
        kept = neardup.drop_near_duplicates(frame)
        assert kept.columns == frame.columns and sorted((r.doc_id, r.text, order[r.row] == (r.doc_id, r.text), r.key, r.may) for r in kept.collect()) == sorted([(1, a, True, "k", 1), (1, b, True, "k", 1), (3, "c d", True, "k", 1)])
    nulls = spark.createDataFrame([(None, a), (None, a), (5, a)], "doc_id long, text string")
    assert [r.doc_id for r in neardup.drop_near_duplicates(nulls).collect()] == [5]


def test_quality(spark, odd, none, small):
    def brute(text):
        own = words(text)
        spots = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        cover = {p for i in range(len(own) - 7) if spots[tuple(own[i : i + 8])] > 1 for p in range(i, i + 8)}
        full = [x for x in (text or "").split("\n") if words(x)]
        return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(cover)

    docs = table(spark, small, "documents").toPandas()
    got = quality.op7_quality(spark, small).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        assert tuple(got.loc[d, list(quality.COUNTS)]) == brute(t)
    failed = (got.n_words < 20) | (100 * got.n_repeat_words > 30 * got.n_words)
    assert (got.base_failed == failed).all() and not (got.kept & failed).any()
    labels = table(spark, small, "labels").toPandas().merge(got.reset_index(), on="doc_id")
    assert ((labels.quality == 1) == labels.kept)[~labels.base_failed].mean() > 0.95
    blank = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(odd, blank).count() == len(ODD) and quality.judge(none, blank).count() == 0
    x = np.random.default_rng(0).random((400, 2))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1])) > 0.5).astype(float)
    model = quality.fit(x, y, [1, 0])
    line = np.stack([np.linspace(0, 1, 50), np.full(50, 0.4)], axis=1)
    assert (np.diff(model.margin(line)) >= -1e-9).all() and ((model.probability(x) > 0.5) == y).mean() > 0.9


def test_warc(spark, small):
    rows = [(1, "u", "<p>a"), (2, "u\r\nx", "<p>a"), (3, None, None), (4, "u", ""), (5, "u", "\x1f\x8b\x08" * 9), (6, "u", LONG), (None, "u", "<p>b"), (7, "u", "<p>b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    files = warc.write_warc(pages, f"{shared_dir(spark)}/warc-test-{np.random.default_rng().integers(1 << 40)}")
    for split in (100, 1000, 8 << 20):
        got = {r.page_id: r for r in warc.read_warc(files, split).collect()}
        assert len(got) == 8 and (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[2].record_type == "response"
        assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes) == ("revisit", 4, 0) and got[None].refers_to == 7
        assert got[6].payload.decode() == LONG and got[5].payload_bytes == 36 and got[5].payload.decode() == "\x1f\x8b\x08" * 9
    folder = files.first()["path"].rpartition("/")[0]
    assert warc.read_warc(warc.list_warc(spark, folder)).count() == 8
    assert warc.read_warc(warc.write_warc(pages.limit(0), folder + "-none")).count() == 0
    large = warc.write_warc(pages, folder + "-large", min_bytes=5)
    assert {r.page_id for r in warc.read_warc(large).where("record_type = 'revisit'").collect()} == set()


def test_warc_of_others(spark):
    """Records without our fields, and a record that a payload holds, wherever ranges begin."""
    import gzip
    import random

    def member(kind, ident, block, more=""):
        return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    inner = member("response", "<urn:page:99>", b"phantom")
    noise = random.Random(1).randbytes(60_000)
    parts = [member("warcinfo", "<urn:uuid:a>", b"software: x"), warc.record(1, "u", b"one", None), member("response", "<urn:uuid:b>", noise + inner + noise, "WARC-Payload-Digest: sha1:OTHER\r\n"), member("metadata", "<urn:uuid:c>", b""), warc.record(2, "u", b"one", 1)]
    folder = f"{shared_dir(spark)}/warc-others-{np.random.default_rng().integers(1 << 40)}"
    store, root = warc.open_fs(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/x.warc.gz", compression=None) as out:
        out.write(b"".join(parts))
    for split in (20_000, 1 << 30):
        got = sorted((r.record_type, r.page_id if r.page_id is not None else -1, r.payload_bytes) for r in warc.read_warc(warc.list_warc(spark, folder), split).collect())
        assert got == sorted([("warcinfo", -1, 11), ("response", 1, 3), ("response", -1, len(noise) * 2 + len(inner)), ("metadata", -1, 0), ("revisit", 2, 3)])


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((12, 64))
    x = [base[i % 12] + r.standard_normal(64) * r.choice([0.0, 0.15, 0.3, 0.4]) for i in range(240)]
    rows = [(i, [float(v) for v in np.float32(e)], int(i % 12) % 3) for i, e in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] + [1.0] * 63, 1), (303, [None] + [1.0] * 63, 1), (304, rows[0][1], None), (305, rows[0][1], rows[0][2]), (306, [1.0], 1), (307, [], 1)]
    got = {g.vec_id: g for g in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=40).collect()}
    good = [(i, np.array(e, float), lab) for i, e, lab in rows if i < 240 or i == 305]
    unit = np.array([e / np.linalg.norm(e) for _, e, _ in good])
    links = [(i, j) for i in range(len(good)) for j in range(i) if good[i][2] == good[j][2] and unit[i] @ unit[j] >= 0.93]
    degree = Counter(k for p in links for k in p)
    root = brute_components(len(good), links)
    found = sum(got[good[i][0]].n_links for i in range(len(good)))
    assert found >= 0.99 * sum(degree.values())
    assert all(got[good[i][0]].n_links <= degree[i] for i in range(len(good)))
    assert np.mean([got[good[i][0]].component_id == good[root[i]][0] for i in range(len(good))]) > 0.98
    for k in (300, 301, 302, 303, 304, 307):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_language_id(spark, odd, none, small):
    got = langid.op10_langid(spark, small).toPandas().merge(table(spark, small, "documents").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    learned = langid.learn(odd.where("doc_id < 9"))
    rows = {r.doc_id: r for r in langid.predict(odd.withColumn("held_out", F.lit(False)), *learned).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == "und" and rows[1].lang_pred in ("en", "de")
    assert langid.predict(none.withColumn("held_out", F.lit(False)), *langid.learn(none)).count() == 0
    docs = table(spark, small, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    rows = {r.doc_id: r for r in docs.collect()}
    letters, sums = langid.letter_vectors().astype(float), defaultdict(lambda: np.zeros(langid.DIM))

    def vector(text):  # brute force: trigrams around each letter, word by word
        total = np.zeros(langid.DIM)
        for word in re.findall(r"[^\W\d_]+", text or ""):
            own = [0, *langid.symbol_table()[[ord(c) for c in word]].tolist(), 0]
            for a, b, c in zip(own, own[1:], own[2:]):
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    for x in rows.values():
        if not x.held_out and x.lang is not None and x.text is not None:
            sums[x.lang] += vector(x.text)
    langs = sorted(sums)
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs])
    unit -= unit.mean(axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for x in got.itertuples():
        v = vector(rows[x.doc_id].text)
        cosine = unit @ v / max(np.linalg.norm(v), 1e-9)
        assert not v.any() or abs(x.score - (1 + cosine.max()) / 2) < 1e-4 and (x.lang_pred == langs[cosine.argmax()] or np.ptp(np.sort(cosine)[-2:]) < 1e-5)
    few, many = langid.Grams(50), langid.Grams()
    ids, offsets = langid.trigrams([rows[k].text or "" for k in sorted(rows)[:20]])
    assert np.allclose(few.sums(ids, offsets), many.sums(ids, offsets)) and len(few.vectors) == 50
    assert list(langid.pieces("ab cd" * 500_000)) != [] and "".join(langid.pieces("ab cd" * 500_000)) == "ab cd" * 500_000
    grams, offsets = langid.trigrams(["ab", "", "a-b"])
    assert np.diff(offsets).tolist() == [2, 0, 2] and grams[0] == 1 * 128 + 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (3, 9), *[(20, i) for i in range(21, 60)], *[(i, i + 1) for i in range(100, 140)]]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[9] == 1 and got[5] == 4 and got[59] == 20 and got[140] == 100 and 7 not in got


def test_slices_are_read_right():
    texts = pa.array(["One two " * 300, "Three four five six " * 200, "x"])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    from docketry.llm.common import by_bytes

    whole = neardup.shingle_sets(texts, 4)
    parts = [s for b in by_bytes([batch], "text", 2000) for s in neardup.shingle_sets(b.column("text"), 4)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
