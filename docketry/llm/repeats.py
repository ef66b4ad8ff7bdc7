"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive.

A run is a stretch of consecutive words with smallest period q, of at least max(LEAST, COPIES * q) words, that no
neighbouring word extends. It holds at least COPIES whole periods, so each of its words occurs COPIES times within it. A
word that occurs less often in a segment can therefore be part of no run there: such words split the segment, the pieces
are counted anew, and pieces shorter than LEAST go. What no longer splits is scanned, all segments of a batch at once: a run of
period q shows at least M = max(LEAST, COPIES * q) - q consecutive words equal to those q further on, so that of the
windows of f = 2^k <= M / 2 words at every (M - f + 1)th place one lies within it. The hashes of these windows and of
those q further on are compared, n log n pairs in all; each hit is then extended word by word. Lags go up, and hits inside a run
of a period that divides theirs are passed over, so that periods are the smallest.

Defined cases: null and wordless texts have no runs and an empty collapsed text. Very long texts are whole, one in a batch of its own.
Rows map one to one, so that repeated rows and null ids stay; only the id and text columns are read, whatever the others are
called. Empty table: empty result. Runs are listed by start, then period; runs that overlap are all listed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import WORD, by_bytes, gather, mix64, split_words, table, word_codes

LEAST, COPIES = 24, 3
#: Pairs of windows compared at once.
PAIRS = 1 << 19


def surviving(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the segments in which every word occurs `copies` times or more; texts are codes[offsets[i]:offsets[i+1]]."""
    done, vocabulary = [], int(codes.max(initial=0)) + 1
    starts, lengths = offsets[:-1], np.diff(offsets)
    while True:
        long = lengths >= least
        starts, lengths = starts[long], lengths[long]
        if not len(starts):
            break
        place, own = gather(starts, lengths), np.repeat(np.arange(len(starts)), lengths)
        _, which, times = np.unique(own * vocabulary + codes[place], return_inverse=True, return_counts=True)
        stays = times[which] >= copies
        whole = np.bincount(own[~stays], minlength=len(starts)) == 0
        done.append((starts[whole], lengths[whole]))
        kept = stays & ~whole[own]
        place, own = place[kept], own[kept]
        if not len(place):
            break
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (own[1:] != own[:-1])])
        starts, lengths = place[first], np.diff(np.r_[first, len(place)])
    found = [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 2
    return found[0], found[1]


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of a and b are equal; looks at more and more of them."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        other = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(other):
            return at + int(other[0])
        at, step = at + step, step * 4
    return n


def lag_scan(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = LEAST, copies: int = COPIES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs inside the segments, starts counted in codes."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    place = gather(starts, lengths)
    words, ends = codes[place], np.cumsum(lengths)
    own = np.repeat(np.arange(len(starts)), lengths)
    end_of = ends[own]
    found: list[tuple[int, int, int]] = []
    known: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by segment, in places of `words`
    longest, width, hashes = int(lengths[0]) if len(lengths) else 0, 1, mix64(words.astype(np.uint64) + np.uint64(1))
    lag = 1
    while max(least, copies * lag) <= longest:
        half = max((max(least, copies * lag) - lag) // 2, 1)
        while 2 * width <= half:
            hashes = mix64(hashes[: max(len(hashes) - width, 0)] * np.uint64(0x9E3779B97F4A7C15) + hashes[width:])
            width *= 2
        lags = np.arange(lag, longest // copies + 1)
        needs = np.maximum(least, copies * lags)
        step = needs - lags - width + 1
        reached = ends[np.searchsorted(-lengths, -needs, "right") - 1]  # segments lie longest first
        counts = -(-reached // step)
        # as many lags as share this window and stay within PAIRS
        n = max(1, min(int(np.searchsorted(np.cumsum(counts), PAIRS, "right")), int(np.searchsorted((needs - lags) // 2, 2 * width, "left"))))
        lags, step, counts = lags[:n], step[:n], counts[:n]
        q = np.repeat(lags, counts)
        c = (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * np.repeat(step, counts)
        inside = c + q + width <= end_of[np.minimum(c, len(end_of) - 1)]
        q, c = q[inside], c[inside]
        same = hashes[c] == hashes[c + q]
        q, c = q[same], c[same]
        if len(c) > 1000:  # leave out at once what long runs explain
            for s, e, p in [r for runs in known.values() for r in runs if r[1] - r[0] > 1000]:
                out = (q % p == 0) & (c >= s) & (c + q + width <= e)
                q, c = q[~out], c[~out]
        seen = (-1, 0)  # lag and end of the stretch looked at last
        for lag_, at in zip(q.tolist(), c.tolist(), strict=True):
            if seen[0] == lag_ and at < seen[1]:
                continue
            segment = int(own[at])
            if any(lag_ % p == 0 and s <= at and at + lag_ + width <= e for s, e, p in known[segment]):
                continue
            low, high = int(ends[segment] - lengths[segment]), int(ends[segment])
            lo = at - reach(words[low:at][::-1], words[low + lag_ : at + lag_][::-1])
            hi = at + reach(words[at : high - lag_], words[at + lag_ : high])
            seen = (lag_, max(hi, at + 1))
            if hi - lo + lag_ >= max(least, copies * lag_):
                known[segment].append((lo, hi + lag_, lag_))
                found.append((int(place[lo]), hi - lo + lag_, lag_))
        lag += n
    return found


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, period) of all runs, by text, start and period."""
    runs = np.array(lag_scan(codes, *surviving(codes, offsets, least, copies), least, copies), np.int64).reshape(-1, 3)
    text = np.searchsorted(offsets, runs[:, 0], "right") - 1
    start = runs[:, 0] - offsets[text]
    order = np.lexsort((runs[:, 2], start, text))
    return text[order], start[order], runs[order, 1], runs[order, 2]


def periodic(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """(ident, n_words, runs array<struct<start, length, period>>, collapsed): collapsed holds the words that no run repeats, a space between two."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            offsets, words = split_words(batch.column("text"))
            own, start, length, period = find_runs(word_codes(words)[0], offsets, least, copies)
            first = offsets[own] + start
            covered = np.cumsum(np.bincount(first + period, minlength=len(words) + 1) - np.bincount(first + length, minlength=len(words) + 1))[: len(words)]
            kept = covered == 0
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[offsets]), words if kept.all() else words.filter(pa.array(kept)))
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            bounds = pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(bounds, runs), pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())], names=[ident, "n_words", "runs", "collapsed"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{ident}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """Of runs by start and period, the first of greatest length / period, compared by cross products; null if there are none."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every document whose crc32(doc_id) ends in 0 repeats a stretch of its words to its end, as the contract says."""
    h, words = F.crc32(F.col("doc_id").cast("string")), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    held = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(WORD), words))
    held = held.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    held = held.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = "array_join(transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')"
    return held.select("doc_id", F.when(F.col("words").isNotNull(), F.expr(repeated)).otherwise(F.col("text")).alias("text"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(with_planted_periods(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
