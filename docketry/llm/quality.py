"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every document are computed once. Trees are fitted on a bounded sample of labelled
documents (MAX_LABELLED rows, chosen by a hash of the id), with second-order logistic gradients on
quantile bins, and monotonic constraints: more repetition, more symbols and more repeated lines never
raise the score. The model is flattened into numpy node arrays, over which batches are scored.

Defined cases: null text has no words and fails the base rule. Without labels, or labels of one class
only, the base rule alone decides. A document with several labels counts with each of them. Null
labels are not used. Repeated rows and ties get equal results; an empty table gives none. Very long texts are measured whole, one in a
batch of its own. doc_id keeps its type and meets labels as text; filter_docs keeps all columns, whatever their names, and the others read doc_id and text alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import by_bytes, cut, hash01, mix64, owner, per_text, split_words, table, windows, word_codes

MAX_LABELLED, TREES, DEPTH, RATE, BINS, LAMBDA = 20_000, 40, 3, 0.2, 64, 1.0
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and the sign of their monotonic constraint (-1: more never raises the score).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_part": -1, "repeat_part": -1,
    "upper_part": 0, "digit_part": 0, "stop_part": 0, "words_per_line": 0, "distinct_part": 0, "long_word": 0,
}


def byte_classes() -> np.ndarray:
    """Class of each byte: 1 symbols, 2 upper case, 3 digits, 4 marks that end clauses."""
    out = np.zeros(256, np.uint8)
    for k, chars in enumerate((SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?"), 1):
        out[list(chars.encode())] = k
    return out


def repeated_words(codes: np.ndarray, offsets: np.ndarray, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that stand in a k-word window found at least twice in the text."""
    starts, hashes = windows(mix64(codes.astype(np.uint64) + np.uint64(1)), offsets, k)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    keys = hashes ^ mix64(owner(offsets)[starts].astype(np.uint64) + np.uint64(77))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, starts[twice], 1)
    np.add.at(cover, starts[twice] + k, -1)
    return per_text(np.cumsum(cover)[:-1] > 0, offsets)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and features of a batch of texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets, words = split_words(texts)
    n = np.diff(offsets)
    codes, distinct = word_codes(words)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    kinds = byte_classes()[raw]
    symbols, upper, digits, stops = (per_text(kinds == k, ends) for k in (1, 2, 3, 4))
    lines = pc.split_pattern(texts, "\n")
    own = owner(lines.offsets.to_numpy().astype(np.int64) - lines.offsets[0].as_py())
    flat = lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    own, flat = own[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    line_codes, known = word_codes(flat)
    n_lines = np.bincount(own, minlength=len(n))
    first = np.unique(own * max(1, len(known)) + line_codes) // max(1, len(known))
    dup_lines = n_lines - np.bincount(first, minlength=len(n))
    repeat = repeated_words(codes, offsets)
    pairs = np.unique(owner(offsets) * max(1, len(distinct)) + codes) // max(1, len(distinct))
    n_distinct = np.bincount(pairs, minlength=len(n))
    chars = per_text(lengths, offsets)
    long = per_text(lengths > 20, offsets)
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "log_words": np.log1p(n), "mean_word": chars / w, "symbols_per_word": symbols / w, "dup_line_part": dup_lines / np.maximum(n_lines, 1), "repeat_part": repeat / w,
        "upper_part": upper / c, "digit_part": digits / c, "stop_part": stops / w, "words_per_line": n / np.maximum(n_lines, 1), "distinct_part": n_distinct / w, "long_word": long / w,
    }


def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 2 << 20):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[k], pa.int64()) for k in COUNTS), *(pa.array(x[k], pa.float64()) for k in FEATURES)], names=["doc_id", *COUNTS, *FEATURES])


MEASURED = ", ".join(f"{k} long" for k in COUNTS) + ", " + ", ".join(f"{k} double" for k in FEATURES)


class Trees:
    """Boosted trees as flat arrays: feature (-1: leaf), threshold (left if x <= it), children, value."""

    def __init__(self, base: float = 0.0):
        self.base, self.roots = base, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def node(self) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def flat(self) -> Trees:
        for k in ("feature", "threshold", "left", "right", "value"):
            setattr(self, k, np.array(getattr(self, k)))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                go = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees on features x and labels y (0 or 1) whose margin is monotonic in the features with a sign."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Trees(float(np.log(p / (1 - p))))
    margin = np.full(len(y), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int, low: float, high: float) -> int:
        at = model.node()
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None)
        for f in range(x.shape[1]) if left else ():
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            a, b = np.clip(-gl / (hl + LAMBDA), low, high), np.clip(-gr / (hr + LAMBDA), low, high)
            gain = -(gl * a + (hl + LAMBDA) * a * a / 2) - (gr * b + (hr + LAMBDA) * b * b / 2)
            whole = np.clip(-gs / (hs + LAMBDA), low, high)
            gain += gs * whole + (hs + LAMBDA) * whole * whole / 2
            gain[(hl < 1) | (hr < 1) | (signs[f] * (b - a) < 0)] = -np.inf
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], (f, k, a[k], b[k]))
        if best[1] is None:
            model.value[at] = RATE * float(np.clip(-gs / (hs + LAMBDA), low, high))
            return at
        f, k, a, b = best[1]
        middle = (a + b) / 2
        go = binned[rows, f] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
        model.feature[at], model.threshold[at] = f, float(edges[f][k])
        model.left[at] = grow(rows[go], g, h, left - 1, *bounds[0])
        model.right[at] = grow(rows[~go], g, h, left - 1, *bounds[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        root = grow(np.arange(len(y)), p - y, p * (1 - p), depth, -4.0, 4.0)
        model.roots.append(root)
        one = Trees()
        one.roots = [root]
        for k in ("feature", "threshold", "left", "right", "value"):
            setattr(one, k, np.array(getattr(model, k)))
        margin += one.margin(x)
    return model.flat()


def kind(rows: DataFrame) -> str:
    """The type of doc_id."""
    return rows.schema["doc_id"].dataType.simpleString()


def train(stats: DataFrame, labels: DataFrame) -> Trees | None:
    """Trees for labels (doc_id, quality) on the measured documents, or None if there is nothing to learn."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("labelled"), "quality")
    own = stats.join(known, F.col("doc_id").cast("string") == F.col("labelled").cast("string")).select("labelled", "quality", *FEATURES)
    n = own.count()
    if not n:
        return None
    seen = own.where(hash01(F.lit(11), F.col("labelled")) < MAX_LABELLED / n).drop("labelled").toPandas()
    y = seen["quality"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    order = np.lexsort(seen.to_numpy(np.float64).T)
    return fit(seen[list(FEATURES)].to_numpy(np.float64)[order], y[order], list(FEATURES.values()))


def score(stats: DataFrame, model: Trees | None, keep_from: float = 0.5) -> DataFrame:
    """Adds base_failed, score and kept to the measured documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            p = model.probability(x) if model and len(x) else np.ones(len(x))
            n, repeat = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("n_words", "n_repeat_words"))
            failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", *COUNTS)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_from))], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return stats.mapInArrow(run, f"doc_id {kind(stats)}, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, score double, kept boolean")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of every document."""
    stats = cut(docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {kind(docs)}, {MEASURED}"))
    return score(stats, train(stats, labels))


def filter_docs(docs: DataFrame, model: Trees | None, keep_from: float = 0.5) -> DataFrame:
    """The documents that pass, measured and judged in one scan without a shuffle."""
    schema, names = docs.schema, docs.columns
    text = f"c{names.index('text')}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, 2 << 20):
            x = statistics(batch.column(text))
            p = model.probability(np.stack([x[f] for f in FEATURES], axis=1)) if model else np.ones(batch.num_rows)
            failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
            yield batch.filter(pa.array(~failed & (p >= keep_from))).rename_columns(names)

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)  # by place: Spark takes a dot in a name for a field's


def model_of(docs: DataFrame, labels: DataFrame) -> Trees | None:
    """Trees from labelled documents alone: only a bounded sample of texts is measured."""
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    n = known.count()
    sample = known.where(hash01(F.lit(11), F.col("doc_id")) < MAX_LABELLED / max(n, 1))
    ids = F.broadcast(sample.select(F.col("doc_id").cast("string").alias("labelled")).distinct())  # about MAX_LABELLED at most
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").cast("string") == F.col("labelled"), "left_semi")
    return train(texts.mapInArrow(measured, f"doc_id {kind(docs)}, {MEASURED}"), sample)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
