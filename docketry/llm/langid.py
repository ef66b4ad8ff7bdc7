"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of letters (a word boundary counts as one)
is the elementwise product of its letters' vectors, permuted by place; a document is the sum of its
trigrams' vectors; a language's prototype is the sum over all its training documents. The prediction
is the prototype of largest cosine, after the mean prototype, which all languages share, is taken off.

Defined cases: null text and text without a letter: `und`, score 0. Null lang: not learned from. No
training rows: `und` for all. Ties: the first language in code-point order. Repeated rows get equal
results. Long texts are taken whole, in pieces of about PIECE characters that end between words (a run of letters
longer than that is cut). A worker holds the vectors of LIMIT trigrams at a time. Only doc_id, text and lang are
read: other columns, whatever their names, play no part. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import by_bytes, mix64, owner, table

DIM, SYMBOLS, SEED, PIECE, LIMIT = 1024, 128, 5, 1 << 20, 1 << 15
#: Languages whose counts a task holds at once, 17 MB each.
HELD_LANGS = 8
UNKNOWN = "und"


@cache
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 no letter, 1 to 26 a to z in any case, above that the letter's hash."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in letters])
    plain = (lower >= 97) & (lower <= 122)
    out[letters] = np.where(plain, lower - 96, 27 + mix64(lower.astype(np.uint64)) % np.uint64(SYMBOLS - 27))
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram ids, offsets): the trigrams of text i are ids[offsets[i]:offsets[i+1]]."""
    lengths = np.array([len(t) + 2 for t in texts])
    points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = symbol_table()[points]
    own = np.repeat(np.arange(len(texts)), lengths)
    kept = symbols > 0
    kept[1:] |= symbols[:-1] > 0  # the first of a run of other characters stands for the boundary
    kept[:-1] |= symbols[1:] > 0
    kept[1:-1] &= ~((symbols[1:-1] == 0) & (symbols[:-2] == 0) & (own[1:-1] == own[:-2]) & kept[:-2])
    symbols, own = symbols[kept].astype(np.int64), own[kept]
    ids = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    inside = (own[2:] == own[:-2]) & (symbols[1:-1] > 0)
    return ids[inside], np.searchsorted(own[:-2][inside], np.arange(len(texts) + 1))


@cache
def letter_vectors() -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM)) * 2 - 1).astype(np.int8)


def gram_vectors(ids: np.ndarray) -> np.ndarray:
    """One row per trigram id: permuted letters bound together."""
    v = letter_vectors()
    a, b, c = ids // SYMBOLS**2, ids // SYMBOLS % SYMBOLS, ids % SYMBOLS
    return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, between which no trigram lies: text apart from letters gives none."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at + PIECE // 2 and text[end].isalpha():
            end -= 1
        if text[end].isalpha():
            end = at + PIECE
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def pieced(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(pieces, the text of each), in groups of bounded size."""
    held, own, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            held.append(piece)
            own.append(i)
            size += len(piece)
            if size > 2 * PIECE:
                yield held, np.array(own)
                held, own, size = [], [], 0
    if held:
        yield held, np.array(own)


class Grams:
    """Sums of trigrams' vectors; of those that a worker has met it keeps LIMIT at most."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self.row, self.n = limit, np.full(SYMBOLS**3, -1, np.int32), 0
        self.vectors = np.zeros((limit, DIM), np.float32)

    def load(self, ids: np.ndarray) -> None:
        """Of the distinct ids, at most `limit`, the vectors are held."""
        new = ids[self.row[ids] < 0]
        if self.n + len(new) > self.limit:
            self.row[:] = -1
            self.n, new = 0, ids
        self.row[new] = self.n + np.arange(len(new))
        self.vectors[self.n : self.n + len(new)] = gram_vectors(new)
        self.n += len(new)

    def sums(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text: the sum of its trigrams' vectors."""
        out = np.zeros((len(offsets) - 1, DIM), np.float32)
        distinct = np.unique(ids)
        for at in range(0, len(distinct), self.limit):
            part = distinct[at : at + self.limit]
            self.load(part)
            whole = len(part) == len(distinct)
            for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                own = ids[lo:hi]
                rows = self.row[own if whole else own[(own >= part[0]) & (own <= part[-1])]]
                if len(rows):
                    counts = np.bincount(rows)
                    met = np.flatnonzero(counts)
                    out[i] += counts[met].astype(np.float32) @ self.vectors[met]
        return out


def profile_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): trigram counts of each language within a task's batches."""
    total: dict[str, np.ndarray] = {}
    for batch in by_bytes(batches, "text"):
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for texts, place in pieced(batch.column("text").to_pylist()):
            ids, offsets = trigrams(texts)
            own = codes[place][owner(offsets)]
            for k in np.unique(codes[place]).tolist():
                lang = langs.dictionary[k].as_py()
                if lang not in total and len(total) == HELD_LANGS:
                    yield from flush(total)
                counts = np.bincount(ids[own == k], minlength=SYMBOLS**3)
                total[lang] = total[lang] + counts if lang in total else counts
    yield from flush(total)


def flush(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "gram", "n"])
    total.clear()


def partial_prototypes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, v) of (lang, gram, n): sums of whole numbers, exact in doubles, so that their order plays no part."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        grams, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
        for lang in set(langs):
            own = np.flatnonzero(langs == lang)
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                total[lang] = total.get(lang, 0.0) + n[part] @ gram_vectors(grams[part])
    yield vectors_of(total)


def sum_prototypes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, v), one row a language, of partial sums laid by language."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, v in zip(batch.column("lang").to_pylist(), batch.column("v"), strict=True):
            total[lang] = total.get(lang, 0.0) + v.values.to_numpy()
    yield vectors_of(total)


def vectors_of(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["lang", "v"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from docs (text, lang); trigrams are counted and their vectors summed in Spark, one row a language remains."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = known.mapInArrow(profile_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = sorted(counts.mapInArrow(partial_prototypes, "lang string, v array<double>").repartition("lang").mapInArrow(sum_prototypes, "lang string, v array<double>").collect())
    langs, sums = [r["lang"] for r in rows], np.array([r["v"] for r in rows]).reshape(len(rows), DIM)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        unit = unit - unit.mean(axis=0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return langs, unit.astype(np.float32)


def held_out(ident: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % parts == part, F.lit(False))


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in by_bytes(batches, "text"):
            sums, found = np.zeros((batch.num_rows, DIM), np.float32), np.zeros(batch.num_rows, np.int64)
            for texts, place in pieced(batch.column("text").to_pylist()):
                ids, offsets = trigrams(texts)
                np.add.at(sums, place, grams.sums(ids, offsets))
                np.add.at(found, place, np.diff(offsets))
            known = (found > 0) & bool(langs)
            cosines = sums @ prototypes.T / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) if langs else np.zeros((batch.num_rows, 1))
            best = cosines.argmax(axis=1)
            names = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            scores = np.where(known, np.clip((1 + cosines[np.arange(len(best)), best].astype(np.float64)) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    return predict(docs, *learn(docs.where("not held_out")))
