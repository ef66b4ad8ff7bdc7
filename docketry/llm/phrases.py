"""Collocations of two and three words, by stripes.

A stripe is a prefix (one word, or two) with a counter of the words that come next; "" counts the occurrences after which no word of
interest comes. Tasks make the stripes of each batch of texts, a shuffle brings the stripes of a prefix together, and they are merged elementwise. A merged stripe
yields the counts of the prefix's extensions, their sum (the prefix's own count), and the greatest extension, which is what subsumption on the
right asks for; on the left it is the maximum of the same entries by their last two words.

Only what may still count is put into stripes: a first pass counts words, those of LEAST occurrences or more go into stripes of one word, and pairs of LEAST
or more into those of two. Either set is known to the tasks by a bitmap of BITS hashed bits, at every size; it never leaves out a member. Prefixes of more than HOT
occurrences, known by another bitmap, have their stripes split by hash of the next word, so that no group holds more than about GROUP_BYTES. All counts are exact.

Products of counts are decimals of 38 digits, exact for counts up to 10^16. Phrases never cross a piece's end. Defined cases: null and empty texts
have no words; null lang is `und`; very long texts are whole; repeated rows count as often as they occur; only text and lang are read, whatever the other columns
are called; empty table: empty result. Ties go by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.llm.common import by_bytes, cut, gather, join_dim, mix64, table

LEAST, TOP, BITS, HOT, GROUP_BYTES, SALTS = 10, 2000, 1 << 26, 1 << 18, 8 << 20, 256
#: What ends a piece of text, and what parts its words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


def letters() -> np.ndarray:
    """A byte -> itself with A-Z lowered, 10 where it ends a piece, 32 where it parts words."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    to[list(PIECE_ENDS)], to[list(BLANKS)] = 10, 32
    return to


LETTERS = letters()


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(code of each word, distinct words, text of each, whether the next word follows it in its piece)."""
    texts = pa.array(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
    _, at, data = texts.buffers()
    begin = np.frombuffer(at, np.int64)[texts.offset]
    data = LETTERS[np.frombuffer(data or b"", np.uint8)[begin : begin + ends[-1]]]
    full = (data != 32) & (data != 10)
    starts = full.copy()
    starts[1:] &= ~full[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    starts[edges] = full[edges]
    at = np.flatnonzero(starts)
    place = np.append((np.cumsum(full) - full)[at], full.sum())
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data[full])).dictionary_encode()
    text = np.searchsorted(ends, at, "right") - 1
    piece = np.cumsum(data == 10)[at] if len(at) else at
    follows = np.zeros(len(at), bool)
    follows[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return words.indices.to_numpy().astype(np.int64), words.dictionary, text, follows


def langs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    coded = pc.fill_null(batch.column("lang").cast(pa.string()), "und").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(language and word of each distinct term, their words and languages, term of each word of the texts, whether the next follows)."""
    word, distinct, text, follows = words_of(batch.column("text"))
    lang, langs = langs_of(batch)
    terms, term = np.unique(lang[text] * max(len(distinct), 1) + word, return_inverse=True)
    return terms // max(len(distinct), 1), terms % max(len(distinct), 1), distinct, langs, term, follows


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 8 << 20):
        lang, word, distinct, langs, term, _ = coded(batch)
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), distinct.take(pa.array(word)).cast(pa.string()), pa.array(np.bincount(term, minlength=len(lang)), pa.int64())], names=["lang", "word", "c"])


def text_hashes(texts: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.as_buffer()) for x in texts], np.uint64)


def hashes(lang: np.ndarray, word: np.ndarray, by_word: np.ndarray, langs: pa.Array) -> np.ndarray:
    """A 64-bit hash of each term, from those of its word and language."""
    return mix64(by_word[word] + mix64(text_hashes(langs)[lang]))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)


def hash_rows(names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (lang, *names): the hash of each row's word or pair of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, langs = langs_of(batch)
            own = []
            for name in names:
                words = batch.column(name).dictionary_encode()
                own.append(hashes(lang, words.indices.to_numpy().astype(np.int64), text_hashes(words.dictionary), langs))
            h = own[0] if len(own) == 1 else paired(*own)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(BITS)).astype(np.int64))], names=["h"])

    return run


def bitmap(rows: DataFrame, names: list[str]) -> np.ndarray:
    """BITS bits, packed: those of the hashes of rows (lang, *names) are set."""
    found = rows.select("lang", *names).mapInArrow(hash_rows(names), "h long")
    maps = found.groupBy(F.expr("h div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits")).collect()  # BITS / 32768 rows at most
    out = np.zeros(BITS // 8, np.uint8)
    for r in maps:
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def packed_stripes(prefix: np.ndarray, following: np.ndarray, next_hash: np.ndarray, prefix_hash: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Counts of (prefix, following word or -1), as stripes: (bounds of each, its prefix, its bucket; following and count of each entry).

    next_hash is by word, prefix_hash and hot by prefix; stripes of hot prefixes are split by hash of the next word.
    """
    wide = len(next_hash) + 1
    entries, times = np.unique(prefix * wide + following + 1, return_counts=True)
    prefix, following = entries // wide, entries % wide - 1
    piece = np.where(hot[prefix] & (following >= 0), next_hash[following] % np.uint64(buckets), np.uint64(0))
    bucket = (mix64(prefix_hash[prefix] + piece * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
    if hot.any():
        order = np.lexsort((bucket, prefix))
        prefix, following, times, bucket = prefix[order], following[order], times[order], bucket[order]
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (bucket[1:] != bucket[:-1])][: len(prefix)])
    return np.append(first, len(prefix)), prefix[first], bucket[first], following, times


def joined(bounds: np.ndarray, texts: pa.Array, by: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), texts), pa.scalar(by, texts.type))


def stripe_rows(bounds: np.ndarray, lang: np.ndarray, langs: pa.Array, prefix: pa.Array, bucket: np.ndarray, following: np.ndarray, times: np.ndarray, distinct: pa.Array) -> pa.RecordBatch:
    """One row for all stripes of a bucket and language: their prefixes and their words, a line each, and the words' counts."""
    order = np.lexsort((lang, bucket))
    sizes = np.diff(bounds)[order]
    entries = gather(bounds[:-1][order], sizes)
    bounds, lang, bucket, following, times = np.concatenate([[0], np.cumsum(sizes)]), lang[order], bucket[order], following[entries], times[entries]
    rows = np.append(np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1])]), len(order))
    words = pa.chunked_array([distinct, pa.array([""], distinct.type)]).combine_chunks().take(pa.array(np.where(following < 0, len(distinct), following)))
    nexts, prefixes = joined(rows, joined(bounds, words, " "), "\n"), joined(rows, prefix.take(pa.array(order)), "\n")
    counts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer((bounds[rows] * 4).astype(np.int64)), pa.py_buffer(times.astype("<u4"))])
    columns = [pa.array(bucket[rows[:-1]]), langs.take(pa.array(lang[rows[:-1]])), prefixes.cast(pa.string()), nexts.cast(pa.string()), counts.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "prefixes", "nexts", "counts"])


STRIPES = "bucket long, lang string, prefixes string, nexts string, counts binary"
MERGED = "lang string, prefix string, total long, nexts array<string>, counts array<long>"


def stripes(shared, buckets: int, two: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (lang, text): the batch's stripes of one word, or of two. shared holds the bitmaps of the frequent and the hot words or pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = shared.value
        for batch in by_bytes(batches, "text", 8 << 20):
            lang, word, distinct, langs, term, follows = coded(batch)
            if not len(term):
                continue
            by_word = text_hashes(distinct)  # of the word alone: what splits a hot prefix must not depend on the batch's languages
            own = hashes(lang, word, by_word, langs)
            if not two:
                known = holds(frequent, own)
                at = np.flatnonzero(known[term])
                prefix = term[at]
                then = np.minimum(at + 1, len(term) - 1)
                following = np.where(follows[at] & known[term[then]], word[term[then]], -1)
                bounds, key, bucket, following, times = packed_stripes(prefix, following, by_word, own, holds(hot, own), buckets)
                if len(key):
                    yield stripe_rows(bounds, lang[key], langs, distinct.take(pa.array(word[key])), bucket, following, times, distinct)
                continue
            at = np.flatnonzero(follows)
            at = at[holds(frequent, paired(own[term[at]], own[term[at + 1]]))]
            known = np.zeros(len(term) + 1, bool)
            known[at] = True
            keys, prefix = np.unique(term[at] * len(own) + term[at + 1], return_inverse=True)
            if not len(keys):
                continue
            first, second = keys // len(own), keys % len(own)
            following = np.where(known[at + 1], word[term[np.minimum(at + 2, len(term) - 1)]], -1)
            pair = paired(own[first], own[second])
            bounds, key, bucket, following, times = packed_stripes(prefix, following, by_word, pair, holds(hot, pair), buckets)
            names = pc.binary_join_element_wise(distinct.take(pa.array(word[first[key]])), distinct.take(pa.array(word[second[key]])), pa.scalar(" ", distinct.type))
            yield stripe_rows(bounds, lang[first[key]], langs, names, bucket, following, times, distinct)

    return run


def merge(least: int) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow by bucket: stripes of equal prefix summed elementwise; (prefix, sum of this part of its stripe, entries of at least `least`)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        held = pc.split_pattern(group["prefixes"].combine_chunks(), "\n")
        lang = group["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))))
        keys = pc.binary_join_element_wise(lang, held.flatten(), "\n").dictionary_encode()
        lists = pc.split_pattern(pc.split_pattern(group["nexts"].combine_chunks(), "\n").flatten(), " ")
        words = lists.flatten().dictionary_encode()
        own = np.repeat(keys.indices.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()))
        counts = np.frombuffer(b"".join(group["counts"].to_pylist()), "<u4")
        wide = len(words.dictionary)
        entries, which = np.unique(own * wide + words.indices.to_numpy(), return_inverse=True)
        sums = np.zeros(len(entries), np.int64)
        np.add.at(sums, which, counts)
        prefix, word = entries // wide, entries % wide
        total = np.zeros(len(keys.dictionary), np.int64)
        np.add.at(total, prefix, sums)
        keep = (sums >= least) & pc.greater(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)[word]
        bounds = pa.array(np.searchsorted(prefix[keep], np.arange(len(total) + 1)), pa.int32())
        parts = pc.split_pattern(keys.dictionary, "\n", max_splits=1, reverse=True)
        return pa.table({
            "lang": pc.list_element(parts, 0), "prefix": pc.list_element(parts, 1), "total": pa.array(total),
            "nexts": pa.ListArray.from_arrays(bounds, words.dictionary.take(pa.array(word[keep]))), "counts": pa.ListArray.from_arrays(bounds, pa.array(sums[keep])),
        })

    return run


def merged(docs: DataFrame, frequent: DataFrame, hot: DataFrame, names: list[str], buckets: int, least: int) -> DataFrame:
    """The corpus's stripes of the frequent words or pairs (lang, *names)."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap(frequent, names), bitmap(hot, names)))
    return cut(docs.select("lang", "text").mapInArrow(stripes(shared, buckets, len(names) == 2), STRIPES).groupBy("bucket").applyInArrow(merge(least), MERGED))


def cohesion(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (left right)), exactly."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = 50, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of docs (lang, text).

    subsumed: a phrase goes if a longer one that holds it has so many of 100 of its occurrences.
    """
    words = cut(docs.select("lang", "text").mapInArrow(count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")))
    sizes = words.groupBy("lang").agg(F.sum("c").alias("n"))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    buckets = total * 12 // GROUP_BYTES + 1
    key = [F.concat_ws("\n", "lang", "prefix").alias("key")]

    ones = merged(docs, words.where(F.col("c") >= least), words.where(F.col("c") >= hot), ["word"], buckets, least)
    counts1 = cut(ones.groupBy(*key).agg(F.sum("total").alias("f")))
    pairs = ones.select("lang", F.col("prefix").alias("w1"), F.explode(F.arrays_zip("nexts", "counts")).alias("e")).select("lang", "w1", F.col("e.nexts").alias("w2"), F.col("e.counts").alias("a"))
    twos = merged(docs, pairs, pairs.where(F.col("a") >= hot), ["w1", "w2"], buckets, least)
    counts2 = cut(twos.groupBy(*key).agg(F.sum("total").alias("f"), F.max(F.array_max("counts")).alias("right_most")).where(F.col("f") >= least))
    triples = twos.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e")).select("lang", "prefix", F.col("e.nexts").alias("w3"), F.col("e.counts").alias("a"))
    triples = triples.select("lang", F.substring_index("prefix", " ", 1).alias("w1"), F.substring_index("prefix", " ", -1).alias("w2"), "w3", "a")
    left_most = triples.groupBy(F.concat_ws("\n", "lang", F.concat_ws(" ", "w2", "w3")).alias("key")).agg(F.max("a").alias("left_most"))

    def with_count(df: DataFrame, counts: DataFrame, name: str, *parts: str) -> DataFrame:
        keyed = df.withColumn("key", F.concat_ws("\n", "lang", F.concat_ws(" ", *parts)))
        return keyed.join(counts.select("key", F.col("f").alias(name)), "key").drop("key")  # AQE parts a hot word's phrases

    two = counts2.join(left_most, "key", "left").where(F.greatest(F.coalesce("right_most", F.lit(0)), F.coalesce("left_most", F.lit(0))) * 100 < F.col("f") * subsumed)
    name = F.substring_index("key", "\n", -1)
    two = two.select(F.expr("substring(key, 1, char_length(key) - char_length(substring_index(key, '\n', -1)) - 1)").alias("lang"), F.substring_index(name, " ", 1).alias("w1"), F.substring_index(name, " ", -1).alias("w2"), F.col("f").alias("a"))
    two = with_count(with_count(two, counts1, "l", "w1"), counts1, "r", "w2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", cohesion(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = with_count(with_count(triples, counts1, "l1", "w1"), counts2, "r1", "w2", "w3")
    three = with_count(with_count(three, counts2, "l2", "w1", "w2"), counts1, "r2", "w3")
    three = three.withColumn("s1", cohesion(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", cohesion(F.col("a"), F.col("l2"), F.col("r2")))
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = two.union(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)  # what meets below is bounded
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return join_dim(found, sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP11_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM q),
v AS (SELECT lang, x, lead(x) OVER t AS y, lead(x, 2) OVER t AS z FROM u WINDOW t AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS k, x AS phrase FROM v UNION ALL SELECT lang, 2, x || ' ' || y FROM v WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM v WHERE z IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
parts AS (SELECT lang || chr(10) || array_to_string(w[1:cut], ' ') AS lp, lang || chr(10) || array_to_string(w[cut + 1:], ' ') AS rp, * FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)), keyed AS (SELECT lang || chr(10) || phrase AS key, f FROM f),
cuts AS (SELECT parts.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM parts JOIN keyed l ON l.key = lp JOIN keyed r ON r.key = rp),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS f FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY 1, 2)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score FROM s JOIN n ON n.lang = s.lang LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
WHERE coalesce(100 * h.f, 0) < 50 * a QUALIFY rank <= 2000"""
