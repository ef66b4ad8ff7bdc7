"""Packing documents into sequences of CAPACITY tokens: dominance reduction, then best fit.

Every document becomes pieces of at most CAPACITY tokens. Which piece of a length goes where makes no difference, so that the
packing problem is a histogram of CAPACITY rows at most, whatever the corpus; it is solved on the driver, in patterns (so many
pieces of these lengths, so many times), and the pieces then look up their place by their rank among those of their length.

Reduction (after Martello and Toth): a set of pieces that holds a given piece dominates another one if the other's pieces can be dealt into groups
that each fit into one of its pieces; then some best packing has it as a sequence, and it is fixed for good. For each length,
longest first, with space R beside it: the piece alone if nothing fits beside it; with the longest piece j that fits, if j fills R, if no two
others fit together, or if no three fit and no pair holds more than j; with j and the longest piece b that fits
beside both, if no three fit and every pair that fits holds either no piece longer than b besides one up to j, or no more than j.
Sets are fixed as many times at once as the histogram has them, and lengths are gone through until none yields a set. What remains is packed
by best fit, longest first, equal pieces at once. `bound` gives the sum of lengths over CAPACITY, rounded up.

Defined cases: null and empty texts are the end token alone, a piece of length 1. Very long texts become as many pieces as they need. Repeated rows and null ids are pieces
of their own. Ties among equal lengths go by id, piece and row. Columns other than doc_id and text are not read, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import default_path
from docketry.llm.common import by_bytes, cut, gather, global_index, table
from docketry.llm.lm import encoder

CAPACITY, END_ID = 1024, 2
#: Words of Latin letters that all versions of Unicode at hand agree upon, perhaps with a space before and marks after them.
LATIN = r"\A ?[A-Za-zÀ-ÖØ-öø-ɏ]+[!-/:-@\[-`{-~]*\z"
#: The id of a line feed alone.
LINE_FEED = 198

Pattern = tuple[list[tuple[int, int]], int]


class Coder:
    """The tokenizers library, asked once for each unit of a batch; for units of Latin letters tiktoken, which has the same merges and is faster.

    A unit begins where white space follows another character, at a space before a character that is surely no white space, and after a lone line feed:
    byte-level pre-tokenizing begins a piece there whatever lies around it. Other white space, and the special token, stay inside units.
    """

    def __init__(self, path: str | None, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.latin = encoder(ranks) if path is None else None
        #: First bytes of characters that are no white space; C2, E1, E2 and E3 begin some that are.
        self.solid = np.ones(256, bool)
        self.solid[:33] = self.solid[[0xC2, 0xE1, 0xE2, 0xE3]] = False
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True

    def bounds(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where units begin, and the end of the last; ends are the texts' bounds."""
        begins = np.zeros(len(data) + 1, bool)
        begins[ends] = True
        i = np.flatnonzero(self.white[data])
        spaces = i[(data[i] == 32) & (i + 1 < len(data))]
        spaces = spaces[self.solid[data[spaces + 1]] & ~begins[spaces + 1]]
        lead = data.take(i[:, None] - [1, 2, 3], mode="clip")
        after = i[(lead[:, 0] > 32) & (lead[:, 1] != 0xC2) & ~((lead[:, 2] >= 0xE1) & (lead[:, 2] <= 0xE3))]
        alone = after[(data[after] == 10) & (after + 1 < len(data))] + 1
        begins[spaces] = begins[after] = True
        begins[alone[self.solid[data[np.minimum(alone, len(data) - 1)]]]] = True
        return np.flatnonzero(begins)

    def units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each unit has)."""
        latin = pc.match_substring_regex(distinct, LATIN).to_numpy(zero_copy_only=False) if self.latin else np.zeros(len(distinct), bool)
        rest = distinct.filter(pa.array(~latin)).to_pylist()
        coded = [np.array(e.ids, np.uint32) for lo in range(0, len(rest), 4096) for e in self.tokenizer.encode_batch_fast(rest[lo : lo + 4096], add_special_tokens=False)]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, int(latin.sum())], pa.int64()), distinct.filter(pa.array(latin))), pa.scalar("\n", pa.large_string()))
        flat = np.array(self.latin.encode_ordinary(joined[0].as_py() + "\n") if latin.any() else [], np.uint32)
        stops = np.flatnonzero(flat == LINE_FEED)  # a piece of its own after every unit
        lengths = np.empty(len(distinct), np.int64)
        lengths[latin] = np.diff(stops, prepend=-1) - 1
        lengths[~latin] = [len(x) for x in coded]
        order = np.concatenate([np.flatnonzero(latin), np.flatnonzero(~latin)])
        starts = np.empty(len(distinct), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate([flat[flat != LINE_FEED], *coded])[gather(starts, lengths)], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts; null is empty."""
        texts = pa.array(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        _, at, data = texts.buffers()
        begin = np.frombuffer(at, np.int64)[texts.offset]
        data = np.frombuffer(data or b"", np.uint8)[begin : begin + ends[-1]]
        units = self.bounds(data, ends)
        strings = pa.LargeStringArray.from_buffers(len(units) - 1, pa.py_buffer(units), pa.py_buffer(data)).dictionary_encode()
        codes = strings.indices.to_numpy()
        flat, lengths = self.units(strings.dictionary)
        counts = lengths[codes]
        ids = flat[gather((np.cumsum(lengths) - lengths)[codes], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(units, ends)]


@cache
def coder(path: str | None) -> Coder:
    return Coder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids): the tokens of each document and its end, cut so that only the first piece may be short."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in by_bytes(batches, "text", 8 << 20):
            ids, offsets = code.encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            n = np.diff(offsets)
            many = -(-n // capacity)
            own = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            first = n - (many - 1) * capacity
            start = np.where(piece == 0, 0, first[own] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[own], capacity)
            bounds = np.concatenate([offsets[:-1][own] + start, offsets[-1:]])
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


# The histogram: counts[s] pieces of length s.


def bound(counts: np.ndarray) -> int:
    capacity = len(counts) - 1
    return -(-int((counts * np.arange(len(counts))).sum()) // capacity)


def best_pair(have: np.ndarray, room: int, over: int = 0) -> int:
    """The greatest sum up to room of two pieces longer than over, 0 if no two fit."""
    sizes = np.flatnonzero(have[: room + 1])
    sizes = sizes[sizes > over]
    if not len(sizes):
        return 0
    partner = np.searchsorted(sizes, np.minimum(room - sizes, sizes), "right") - 1  # the longest not above itself that fits
    alone = (partner >= 0) & (sizes[partner] == sizes) & (have[sizes] < 2)
    partner = np.where(alone, partner - 1, partner)
    fits = partner >= 0
    return int((sizes + sizes[partner])[fits].max(initial=0))


def dominating(counts: np.ndarray, size: int) -> list[int] | None:
    """The set that holds a piece of this length and dominates all others that do, where a small one is proven to."""
    room = len(counts) - 1 - size
    have = counts.copy()
    have[size] -= 1
    fits = np.flatnonzero(have[: room + 1])
    if not len(fits):
        return [size]
    longest = int(fits[-1])
    if longest == room:
        return [size, longest]
    least = np.repeat(fits[:3], np.minimum(have[fits[:3]], 3))[:3]
    if len(least) < 2 or least[:2].sum() > room:
        return [size, longest]
    if len(least) == 3 and least.sum() <= room:
        return None
    if best_pair(have, room) <= longest:
        return [size, longest]
    have[longest] -= 1
    beside = np.flatnonzero(have[: room - longest + 1])
    have[longest] += 1
    if len(beside) and best_pair(have, room, int(beside[-1])) <= longest:
        return [size, longest, int(beside[-1])]
    return None


def reduced(counts: np.ndarray) -> tuple[list[Pattern], np.ndarray]:
    """(sets fixed for good, what remains)."""
    counts, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for size in range(len(counts) - 1, 0, -1):
            while counts[size] and (chosen := dominating(counts, size)):
                need = [(s, chosen.count(s)) for s in sorted(set(chosen), reverse=True)]
                times = min(int(counts[s]) // m for s, m in need)
                for s, m in need:
                    counts[s] -= m * times
                fixed.append((need, times))
                changed = True
    return fixed, counts


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit, longest first: each piece goes where it leaves the least room. Sequences alike are kept as one pattern and their number."""
    capacity = len(counts) - 1
    open_: dict[int, list[Pattern]] = {}  # by room left
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for room in sorted(r for r in open_ if r >= size):
            if not left:
                break
            held, open_[room] = open_[room], []
            for parts, times in held:
                each = room // size
                full = min(times, left // each)
                more = min(left - full * each, each) if full < times else 0
                for n, k in ((full, each), (1 if more else 0, more), (times - full - (1 if more else 0), 0)):
                    if n:
                        open_.setdefault(room - k * size, []).append((parts + [(size, k)] if k else parts, n))
                left -= full * each + more
            if not open_[room]:
                del open_[room]
        each = capacity // size
        for n, k in ((left // each, each), (1 if left % each else 0, left % each)):
            if n:
                open_.setdefault(capacity - k * size, []).append(([(size, k)], n))
    return [p for group in open_.values() for p in group]


def solved(counts: np.ndarray) -> list[Pattern]:
    fixed, rest = reduced(counts)
    return fixed + best_fit(rest)


def places(counts: np.ndarray, patterns: list[Pattern]) -> np.ndarray:
    """Rows (index, length, pieces of this length a sequence, first sequence, first offset), by index: the pieces from index on, in order of length, go there."""
    base, used, rows, sequence = np.cumsum(counts) - counts, np.zeros(len(counts), np.int64), [], 0
    for parts, times in patterns:
        offset = 0
        for size, each in parts:
            rows.append((base[size] + used[size], size, each, sequence, offset))
            used[size] += each * times
            offset += size * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(parts: DataFrame, capacity: int = CAPACITY, solve: Callable[[np.ndarray], list[Pattern]] = solved) -> DataFrame:
    """parts (length from 1 to capacity, and more columns) with sequence_id and offset. parts should be cheap to read again, as of a written table."""
    spark = parts.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(places(counts, solve(counts)))  # a bounded number of patterns for each length
    names = [c for c in parts.columns]
    laid = global_index(parts, ["length", *[c for c in names if c != "length"]], name="index")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, each, first, offset = shared.value.T
        for batch in batches:
            index = batch.column("index").to_numpy()
            j = np.searchsorted(at, index, "right") - 1
            rank = index - at[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[j] + rank // each[j]), pa.array(offset[j] + rank % each[j] * size[j])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return laid.select(*[f"`{c}`" for c in names], "index").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences themselves, each of `capacity` tokens at most."""
    own = cut(pieces(docs, path, capacity, end_id, keep_ids=True).withColumn("row", F.monotonically_increasing_id()))
    where = packed(own.select("length", "row"), capacity).select("row", "sequence_id", "offset")
    parts = own.join(where, "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cut(pieces(table(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id()))
    return packed(own).drop("row")
