"""Language-model scoring: a causal self-attention model in numpy over subword ids, and a smoothed word base.

Base: word counts over all training documents. Frequent words (at most FREQUENT, chosen by a
threshold on counts) are broadcast with their subwords; all other words of a document meet their counts in a shuffle join.

Model: one layer of causal self-attention over subword ids, with a bias for each distance. Its state
weighs EXPERTS distributions over subwords; their mixture is mixed with the subword frequencies of the
whole training corpus (FLOOR), which also divide the mass of subwords outside the model's HEAD. A text
is cut into blocks of BLOCK subwords; a window is a block and the one before it. Windows overlap, each
subword is scored once, in its own block, and all blocks of a batch go through masked attention together.

Texts are cut into subwords once, and their ids written; training and scoring read these. Training takes every window of all training documents: each
of their blocks is a target once. A first fit on about WARM windows, on the driver, gives all shards the
same start; then each shard of about SHARD windows, dealt by hash in stretches of at most STRETCH of a document, is a task that trains one epoch by Adam, and the
shards' weights are averaged, by their windows. Neither depends on the order or partitioning of rows.

Defined cases: null or wordless text is the end token alone. Null doc_id: not held out. No training
documents: N = V = 0, every token is unknown and the model is uniform. Equal rows get equal scores.
Long texts are scored whole, in slices of bounded bytes. Only doc_id and text are read: other columns, whatever
their names, play no part. Empty table: empty result.
"""

from __future__ import annotations

import base64
import copy
import itertools
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import by_bytes, cut, gather, mix64, owner, per_text, reused_memory, split_words, table, word_codes

RANKS = "byte_bpe_50k.tiktoken"
FREQUENT, WARM, SHARD, STRETCH = 200_000, 8192, 131_072, 64
BLOCK, DIM, EXPERTS, HEAD, FLOOR = 16, 16, 32, 4096, 0.02
WARM_STEPS, BATCH, WARM_RATE, RATE, PARTS = 500, 256, 0.01, 0.005, 64
END = "\n"  # no word holds white space: the end token's place among words


@cache
def encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_size(path: str | None) -> int:
    """Subword ids and, after them, the end token."""
    return encoder(path).n_vocab + 1


#: Words of ASCII and Latin characters: a line feed after one is a piece of its own, so that many are cut in one call.
PLAIN = r"\A[!-~À-ɏ]+\z"


def subwords(words: pa.Array, path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words, each with the space before it; END is the end token."""
    enc, at = encoder(path), words.cast(pa.string())
    plain = pc.match_substring_regex(at, PLAIN).to_numpy(zero_copy_only=False)
    some = at.filter(pa.array(plain))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n ")[0].as_py()
    flat = enc.encode_to_numpy(f" {joined}\n" if len(some) else "", disallowed_special=()).astype(np.int64)
    feed = enc.encode_ordinary("\n")[0]
    stops = np.flatnonzero(flat == feed)
    end = [vocabulary_size(path) - 1]
    rest = [end if w == END else enc.encode_ordinary(" " + w) for w in at.filter(pa.array(~plain)).to_pylist()]
    lengths = np.empty(len(words), np.int64)
    lengths[plain], lengths[~plain] = np.diff(stops, prepend=-1) - 1, [len(x) for x in rest]
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    starts = np.empty(len(words), np.int64)
    starts[order] = np.cumsum(lengths[order]) - lengths[order]
    ids = np.concatenate([flat[flat != feed], np.fromiter(itertools.chain.from_iterable(rest), np.int64)])
    return ids[gather(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct words) of texts whose last token is END."""
    offsets, words = split_words(texts, lower=True)
    codes, distinct = word_codes(words)
    distinct = pa.concat_arrays([distinct, pa.array([END], distinct.type)])
    at = np.arange(1, len(offsets))
    codes = np.insert(codes, offsets[1:], len(distinct) - 1)
    return offsets + np.concatenate([[0], at]), codes, distinct


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 8 << 20):
        _, codes, distinct = coded(batch.column("text"))
        yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())], names=["word", "c"])


class Known:
    """Words cut into subwords beforehand, with their counts."""

    def __init__(self, counts: dict[str, int], path: str | None):
        self.place, self.counts = {w: i for i, w in enumerate(counts)}, np.array(list(counts.values()), np.int64)
        self.ids, self.bounds = subwords(pa.array(list(counts), pa.string()), path)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where words are among the known ones, or -1."""
        return np.fromiter(map(self.place.get, words.to_numpy(zero_copy_only=False), itertools.repeat(-1)), np.int64, len(words))


def text_ids(texts: pa.Array, path: str | None, known: Known | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(subword ids, their offsets by text, word codes, their offsets by text, distinct words, their places among the known ones)."""
    known = known or Known({}, path)
    offsets, codes, distinct = coded(texts)
    place = known.places(distinct)
    rare = place < 0
    ids, bounds = subwords(distinct.filter(pa.array(rare)), path)
    ids, starts, lengths = np.concatenate([known.ids, ids]), np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    starts[rare], lengths[rare] = bounds[:-1] + len(known.ids), np.diff(bounds)
    starts[~rare], lengths[~rare] = known.bounds[place[~rare]], np.diff(known.bounds)[place[~rare]]
    counts = lengths[codes]
    total = np.concatenate([[0], np.cumsum(counts)])
    return ids[gather(starts[codes], counts)], total[offsets], codes, offsets, distinct, place


def blocks_of(ids: np.ndarray, offsets: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, text of each, whether it is a text's first): rows of BLOCK ids, padded with fill."""
    n = np.diff(offsets)
    per = -(-n // BLOCK)
    first = np.cumsum(per) - per
    out = np.full((int(per.sum()), BLOCK), fill, np.int64)
    own = owner(offsets)
    place = np.arange(len(ids)) - offsets[:-1][own]
    out[first[own] + place // BLOCK, place % BLOCK] = ids
    is_first = np.zeros(len(out), bool)
    is_first[first[per > 0]] = True
    return out, np.repeat(np.arange(len(n)), per), is_first


@cache
def places(size: int, width: int) -> np.ndarray:
    """The places of each row's numbers in a table of `size` rows."""
    return np.arange(size * width).reshape(size, width)


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of `to` at their places; two numbers at a time, as one complex number."""
    pair = np.complex64 if to.dtype == np.float32 else np.complex128
    rows = rows.astype(to.dtype, copy=False).view(pair)
    np.add.at(to.view(pair).reshape(-1), np.take(places(len(to), rows.shape[1]), at, axis=0).ravel(), rows.ravel())


class Attention:
    """The model. Buckets 0 .. HEAD-1 are the most frequent subwords, HEAD is any other, HEAD + 1 begins a text, HEAD + 2 pads."""

    def __init__(self, frequency: np.ndarray, head: int = HEAD, seed: int = 1):
        total = frequency.sum()
        p = (frequency + 0.5) / (total + 0.5 * len(frequency))
        order = np.lexsort((np.arange(len(p)), -frequency))[:head]
        self.bucket = np.full(len(p) + 2, head, np.int32)
        self.bucket[order] = np.arange(len(order))
        self.bucket[-2:] = head + 1, head + 2
        self.head = head
        self.log_unigram = np.log(p)
        rest = np.ones(len(p), bool)
        rest[order] = False
        mass = p[rest].sum()
        log_share = np.where(rest, np.log(p) - np.log(max(mass, 1e-12)), 0.0)
        self.share, self.floor = ((1 - FLOOR) * np.exp(log_share)).astype(np.float32), (FLOOR * p).astype(np.float32)
        r = np.random.default_rng(seed)
        base = np.full(head + 1, -30.0)
        base[: len(order)] = np.log(p[order])
        base[head] = np.log(max(mass, 1e-12))
        self.w = {
            "e": r.normal(0, 0.3, (head + 3, DIM)), "q": r.normal(0, 0.5 * DIM**-0.5, (DIM, DIM)), "k": r.normal(0, DIM**-0.5, (DIM, DIM)), "v": r.normal(0, DIM**-0.5, (DIM, DIM)),
            "g": r.normal(0, 0.3, (DIM, EXPERTS)), "b": np.zeros(EXPERTS), "d": np.zeros(2 * BLOCK), "x": (base + r.normal(0, 0.5, (EXPERTS, head + 1))).T,
        }
        self.w = {k: v.astype(np.float32, order="C") for k, v in self.w.items()}
        i, j = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None]
        self.distance = np.clip(BLOCK + i - j, 0, 2 * BLOCK - 1)
        self.causal = (j <= BLOCK + i).astype(np.float32)

    def experts(self, out: np.ndarray | None = None) -> np.ndarray:
        """Each bucket's probability by each expert. Logits begin as logarithms of probabilities and move by the rate a step at most a few times: they don't overflow."""
        p = np.exp(self.w["x"], out=out)
        p /= np.ones(len(p), p.dtype) @ p
        return p

    def near(self) -> np.ndarray:
        return np.exp(np.clip(self.w["d"], -20, 20))[self.distance] * self.causal

    def tables(self) -> dict[str, np.ndarray]:
        """What each bucket asks of others' vectors; and its probability by each expert."""
        return {"asks": self.w["e"] @ (self.w["q"] @ self.w["k"].T), "near": self.near(), "expert": self.experts()}

    def states(self, own: np.ndarray, asks: np.ndarray, both: np.ndarray, near: np.ndarray, no_before: np.ndarray) -> tuple:
        """A block's own vectors and what they ask, the vectors of it and the block before it -> what step() needs; the experts' weights (not normalised) come last.

        What is offered and said is linear in a vector: asks hold the offers' matrix, and vectors are averaged before they are said.
        """
        s = asks @ both.transpose(0, 2, 1)
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= near
        s[no_before, :, :BLOCK] = 0
        weight = (s.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, s.dtype))[:, None]
        heard = (s @ both).reshape(-1, DIM)
        heard /= weight
        h = heard @ self.w["v"]
        h += own.reshape(-1, DIM)
        z = h @ self.w["g"]
        z += self.w["b"]
        np.clip(z, -30, 30, out=z)
        np.exp(z, out=z)
        return s, weight, heard, h, z

    def log10(self, blocks: np.ndarray, first: np.ndarray, t: dict[str, np.ndarray], rows: int = 256) -> np.ndarray:
        """log10 probability of each id of blocks (rows of a text in order; the id beyond the last is padding)."""
        n = len(self.log_unigram)
        inputs = np.empty((len(blocks) + 1, BLOCK), np.int32)  # after the row before the first, which no row hears
        inputs[0] = self.head + 2
        own, ones = self.bucket[blocks], np.ones(EXPERTS, np.float32)
        inputs[1:, 1:] = own[:, :-1]
        inputs[1:, 0] = inputs[0, 0]
        inputs[2:, 0] = own[:-1, -1]
        inputs[1:][first, 0] = self.head + 1  # begins a text
        out = np.zeros(blocks.shape)
        for lo in range(0, len(blocks), rows):
            hi = min(lo + rows, len(blocks))
            e = np.take(self.w["e"], inputs[lo : hi + 1], axis=0)
            both = np.lib.stride_tricks.as_strided(e, (hi - lo, 2 * BLOCK, DIM), e.strides, writeable=False)  # each row and the one before it
            z = self.states(e[1:], np.take(t["asks"], inputs[lo + 1 : hi + 1], axis=0), both, t["near"], first[lo:hi])[-1]
            target = np.minimum(blocks[lo:hi], n - 1).ravel()
            total = z @ ones
            z *= np.take(t["expert"], own[lo:hi].ravel(), axis=0, mode="clip")  # of padding any
            p = z @ ones / total
            out[lo:hi] = np.log10((p * self.share[target] + self.floor[target]).astype(np.float64)).reshape(-1, BLOCK)
        return np.where(blocks < n, out, 0.0)

    def step(self, windows: np.ndarray, g: dict[str, np.ndarray] | None = None) -> tuple[float, dict]:
        """Mean loss and gradients (into g, where given) on windows: rows of 2 * BLOCK + 1 buckets, the last BLOCK of them targets."""
        g = g or {k: np.empty_like(v) for k, v in self.w.items()}
        w, experts = self.w, self.experts(g["x"])
        inputs, targets = np.ascontiguousarray(windows[:, :-1]), windows[:, BLOCK + 1 :].ravel()
        live = targets <= self.head
        targets = np.where(live, targets, 0)
        both = np.take(w["e"], inputs, axis=0)
        own, joint = both[:, BLOCK:].reshape(-1, DIM), w["q"] @ w["k"].T
        asks = (own @ joint).reshape(-1, BLOCK, DIM)
        s, weight, heard, h, z = self.states(own, asks, both, self.near(), windows[:, BLOCK] == self.head + 1)
        explains = np.take(experts, targets, axis=0)
        explains *= z
        ones, of_all = np.ones(EXPERTS, z.dtype), np.ones(len(z), z.dtype)
        total, found = z @ ones, explains @ ones
        p = found / total + 1e-12
        n = max(int(live.sum()), 1)
        loss = float(-(np.log(p) * live).sum() / n)
        scale = (live / n).astype(z.dtype)
        explains *= (scale / (p * total))[:, None]  # how much each expert explains each target
        z *= (scale / total)[:, None]
        z -= explains
        experts *= of_all @ explains
        np.negative(explains, out=explains)
        add_rows(experts, targets, explains)
        g["b"][:], g["g"][:] = of_all @ z, h.T @ z
        dh = z @ w["g"].T
        d_heard = dh @ w["v"].T
        d_heard /= weight
        d_weight = (d_heard * heard) @ np.ones(DIM, z.dtype)
        ds = d_heard.reshape(-1, BLOCK, DIM) @ both.transpose(0, 2, 1)
        ds -= d_weight.reshape(-1, BLOCK, 1)
        ds *= s
        g["d"][:] = np.bincount(self.distance.ravel(), ds.sum(axis=0).ravel(), 2 * BLOCK)
        d_asks = (ds @ both).reshape(-1, DIM)
        d_joint = own.T @ d_asks
        g["q"][:], g["k"][:], g["v"][:] = d_joint @ w["k"], d_joint.T @ w["q"], heard.T @ dh
        both_s, both_d = np.empty((len(s), 2 * BLOCK, 2 * BLOCK), s.dtype), np.empty((len(s), 2 * BLOCK, DIM), s.dtype)
        both_s[:, :BLOCK], both_s[:, BLOCK:] = s, ds
        both_d[:, :BLOCK], both_d[:, BLOCK:] = d_heard.reshape(-1, BLOCK, DIM), asks
        de = both_s.transpose(0, 2, 1) @ both_d
        dh += d_asks @ joint.T
        de[:, BLOCK:] += dh.reshape(-1, BLOCK, DIM)
        g["e"][:] = 0
        add_rows(g["e"], inputs.ravel(), de.reshape(-1, DIM))
        return loss, g

    def fit(self, windows: np.ndarray, steps: int, rate: float, batch: int = BATCH, seed: int = 2) -> list[float]:
        """Adam on windows of buckets, in epochs of a random order, at a rate that falls to a tenth; returns the losses."""
        r, losses, order = np.random.default_rng(seed), [], np.zeros(0, np.int64)
        flat = self.flat()
        self.w = self.shaped(flat)
        m, s, g = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)  # m and s are sums: 10 and 100 times the means
        grads = self.shaped(g)
        for t in range(1, steps + 1 if len(windows) else 1):
            if len(order) < min(batch, len(windows)):
                order = r.permutation(len(windows))
            loss, _ = self.step(windows[order[:batch]].astype(np.int64), grads)
            order = order[batch:]
            losses.append(loss)
            now, size = rate * (1 - 0.9 * t / steps), (0.01 / (1 - 0.99**t)) ** 0.5
            m *= np.float32(0.9)
            m += g
            g *= g
            s *= np.float32(0.99)
            s += g
            np.sqrt(s, out=g)
            g += np.float32(1e-8 / size)
            np.divide(m, g, out=g)
            g *= np.float32(0.1 * now / (1 - 0.9**t) / size)
            flat -= g
        return losses

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def shaped(self, values: np.ndarray) -> dict[str, np.ndarray]:
        """Weights as views of their values in one row."""
        ends = np.cumsum([v.size for v in self.w.values()])
        return {k: x.reshape(v.shape) for (k, v), x in zip(self.w.items(), np.split(values, ends[:-1]), strict=True)}

    def set_flat(self, values: np.ndarray) -> None:
        self.w = self.shaped(values.astype(np.float32))


def training_windows(model: Attention, every: int):
    """For mapInArrow over (key, ids): (h, window) at one of `every` places of a text, BLOCK subwords apart, and at one of each text at least, as 16-bit buckets. For the start; the shards see all."""
    begins, pads = model.head + 1, model.head + 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "ids", 2 << 20):
            ids, offsets = ids_of(batch.column("ids"))
            places = -(-np.diff(offsets) // BLOCK)  # each text has its end token, and so a place at least
            own = np.repeat(np.arange(batch.num_rows), places)
            place = np.arange(len(own)) - np.repeat(np.cumsum(places) - places, places)
            h = mix64(batch.column("key").to_numpy().view(np.uint64)[own] + mix64(place.astype(np.uint64) + np.uint64(1)))
            least = np.minimum.reduceat(h, np.cumsum(places) - places)
            at = np.flatnonzero((h % np.uint64(every) == 0) | (h == least[own]))
            begin, stop = offsets[:-1][own[at]][:, None], offsets[1:][own[at]][:, None]
            want = begin + (place[at] * BLOCK)[:, None] + np.arange(-BLOCK - 1, BLOCK)
            got = np.where((want >= begin) & (want < stop), model.bucket[ids[np.clip(want, 0, len(ids) - 1)]], pads).astype("<u2")
            got[want == begin - 1] = begins
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * got.shape[1]), len(got), [None, pa.py_buffer(np.ascontiguousarray(got))])
            yield pa.RecordBatch.from_arrays([pa.array((h[at] >> np.uint64(8)).astype(np.int64)), rows.cast(pa.binary())], names=["h", "window"])

    return run


def ids_of(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids, offsets) of texts whose ids are packed."""
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(packed).to_numpy(zero_copy_only=False))]) // 4
    return np.frombuffer(b"".join(packed.to_pylist()), "<u4").astype(np.int64), offsets.astype(np.int64)


def unpacked(windows: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sorted(windows)), "<u2").reshape(-1, 2 * BLOCK + 1)


def stretches(model: Attention, most: int = STRETCH):
    """For mapInArrow over (key, ids): (h, stretch), all of each text as 16-bit buckets, at most `most` blocks each, after the BLOCK + 1 buckets before them."""
    begins, pads, lead, long = model.head + 1, model.head + 2, BLOCK + 1, most * BLOCK

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "ids", 2 << 20):
            ids, offsets = ids_of(batch.column("ids"))
            n = np.diff(offsets)
            laid = np.full(len(ids) + lead * len(n), pads, "<u2")
            at = offsets[:-1] + lead * np.arange(len(n))  # where each text's lead begins
            laid[at + BLOCK] = begins
            laid[gather(at + lead, n)] = model.bucket[ids]
            many = -(-n // long)
            own = np.repeat(np.arange(len(n)), many)
            place = gather(np.zeros(len(n), np.int64), many)
            sizes = np.minimum(long, n[own] - place * long) + lead
            h = mix64(batch.column("key").to_numpy().view(np.uint64)[own] + mix64(place.astype(np.uint64) + np.uint64(1)))
            ends = np.concatenate([[0], np.cumsum(sizes)]) * 2
            data = laid[gather(at[own] + place * long, sizes)]
            rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(8)).astype(np.int64)), rows.cast(pa.binary())], names=["h", "stretch"])

    return run


def windows_of(held: Iterable[bytes], pads: int) -> np.ndarray:
    """Every window of the stretches, whatever their order."""
    held = sorted(held)
    data = np.frombuffer(b"".join(held), "<u2")
    ends = np.cumsum([len(x) // 2 for x in held])
    starts = np.concatenate([[0], ends[:-1]])
    many = -(-(ends - starts - BLOCK - 1) // BLOCK)
    want = gather(np.zeros(len(many), np.int64), many) * BLOCK + np.repeat(starts, many)
    want = (want[:, None] + np.arange(2 * BLOCK + 1)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    return np.where(want < np.repeat(ends, many)[:, None], data[np.minimum(want, len(data) - 1)], np.uint16(pads))


def train_shard(model: Attention):
    """For applyInPandas: one epoch of a shard from the common start; (part, n, values), the weights times the shard's windows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, windows = copy.deepcopy(model), windows_of(pdf["stretch"], model.head + 2)
        with reused_memory():
            own.fit(windows, max(1, len(windows) // BATCH), RATE)
        parts = np.array_split(own.flat().astype(np.float64) * len(windows), PARTS)
        return pd.DataFrame({"part": range(PARTS), "n": len(windows), "values": parts})

    return run


def sum_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (part, n, values) laid by part: one row a part, whatever their number."""
    total: dict[int, list] = {}
    for batch in batches:
        for part, n, values in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("values"), strict=True):
            was = total.setdefault(part, [0, 0.0])
            was[0] += n
            was[1] = was[1] + values.values.to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([v for _, v in total.values()], pa.list_(pa.float64()))], names=["part", "n", "values"])


def train(model: Attention, learned: DataFrame, warm: int = WARM, shard: int = SHARD) -> None:
    """Fits model on learned (key, ids, blocks), on each window of it."""
    texts = learned.select("key", "ids")
    many = learned.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    if not many:
        return
    windows = cut(texts.mapInArrow(training_windows(model, max(1, many // (8 * warm))), "h long, window binary"))
    some = windows.where(F.pmod(F.xxhash64("h", "window"), F.lit(1 << 20)) < F.lit(int(min(1.0, warm / windows.count()) * (1 << 20)))).select("window").collect()
    with reused_memory():
        model.fit(unpacked(r["window"] for r in some), WARM_STEPS, WARM_RATE)
    shards = texts.mapInArrow(stretches(model), "h long, stretch binary").groupBy(F.pmod(F.xxhash64("h"), F.lit(-(-many // shard))).alias("shard"))
    schema = "part long, n long, values array<double>"
    sums = shards.applyInPandas(train_shard(model), schema).repartition("part").mapInArrow(sum_parts, schema).collect()
    n = max(r["n"] for r in sums)
    model.set_flat(np.concatenate([np.array(r["values"]) for r in sorted(sums, key=lambda r: r["part"])]) / n)


def subword_counts(path: str | None):
    """For mapInArrow over (word, c): counts of subwords."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size(path), np.int64)
        for batch in batches:
            ids, offsets = subwords(batch.column("word"), path)
            np.add.at(total, ids, np.repeat(batch.column("c").to_numpy(), np.diff(offsets)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "c"])

    return run


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[int, dict[str, int]]:
    """(least count, words): all words of at least that count, at most `most` of them; short words only."""
    by = counts.where(F.octet_length("word") <= 64).groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.count("*").alias("n")).toPandas().sort_values("b", ascending=False)
    total, least = 0, None
    for b, n in zip(by["b"], by["n"], strict=True):
        total += n
        if total > most:
            break
        least = b
    if least is None:
        return 0, {}
    rows = counts.where((F.floor(F.log2("c") * 4) >= int(least)) & (F.octet_length("word") <= 64)).toPandas()
    return int(least), dict(zip(rows["word"], rows["c"].astype(int), strict=True))


def score(docs: DataFrame, parts: int = 5, part: int = 1, path: str | None = None) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text), learning from those not held out."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))
    own = docs.select("doc_id", "text", held.alias("held_out"))
    learned = own.where(~held)
    counts = cut(learned.select("text").mapInArrow(count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(sums["n"]), int(sums["v"])
    _, frequent = frequent_words(counts)

    found = counts.mapInArrow(subword_counts(path), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    frequency = np.zeros(vocabulary_size(path))
    frequency[found["id"].to_numpy(np.int64)] = found["c"]
    shared = spark.sparkContext.broadcast(Known(frequent, path))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counted = np.append(known.counts, -1)  # a word that is not known has place -1
        values = np.append(np.log10(known.counts + 0.5) - np.log10(n + 0.5 * (v + 1)), 0.0)
        for batch in by_bytes(batches, "text", 4 << 20):
            ids, id_offsets, codes, offsets, distinct, place = text_ids(batch.column("text"), path, known)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(id_offsets * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            c = counted[place][codes]
            sums = np.concatenate([[0.0], np.cumsum(values[place][codes])])
            rare = c < 0
            key = owner(offsets)[rare] * len(distinct) + codes[rare]
            pairs, times = np.unique(key, return_counts=True)
            bounds = np.searchsorted(pairs // len(distinct), np.arange(batch.num_rows + 1)).astype(np.int32)
            words = distinct.take(pa.array(pairs % len(distinct))).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("key"), packed, pa.array(-(-np.diff(id_offsets) // BLOCK)), pa.array(np.diff(offsets)), pa.array(per_text(c > 0, offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]]),
                 pa.ListArray.from_arrays(pa.array(bounds), words), pa.ListArray.from_arrays(pa.array(bounds), pa.array(times, pa.int32()))],
                names=["doc_id", "held_out", "key", "ids", "blocks", "n_tokens", "n_known", "base", "rare", "times"],
            )

    schema = "doc_id long, held_out boolean, key long, ids binary, blocks long, n_tokens long, n_known long, base double, rare array<string>, times array<int>"
    rows = cut(own.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(code, schema).withColumn("row", F.monotonically_increasing_id()))
    model = Attention(frequency)
    train(model, rows.where("not held_out"))
    fitted = spark.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted.value
        tables, end = model.tables(), len(model.log_unigram)
        for batch in by_bytes(batches, "ids", 2 << 20):
            blocks, texts, first = blocks_of(*ids_of(batch.column("ids")), end + 1)
            with reused_memory():
                scores = np.bincount(texts, model.log10(blocks, first, tables).sum(axis=1), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    scored = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(judge, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts.select(F.col("word"), "c"), "word", "left")
    value = F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.log10(F.lit(n + 0.5 * (v + 1))))
    rare = rare.groupBy("row").agg(F.sum(value).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = scored.join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
