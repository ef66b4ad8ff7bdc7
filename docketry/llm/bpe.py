"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text (as the pre-tokenizer's pattern cuts it) starts as single bytes. The leaves of a
segment tree hold rank * 2^32 + place of each adjacent pair; every inner node holds the smaller of
its children, so the root is the leftmost pair of lowest rank. A merge changes three leaves and
their ancestors: O(log n). It ends when the root holds no mergeable pair. Pieces repeat, so that
each worker keeps the ids of the pieces it met last in tables of bounded size; new pieces of a batch
merge in step, a tree a row.

Defined cases: null text is empty; an empty text has no ids. The special token's string in a text is
the special token, as in the tokenizers library. Very long pieces cost n log n. Rows map one to one, so that repeated rows and null ids
stay; doc_id keeps its type, and only doc_id and text are read, whatever the other columns are called. Empty table: empty result.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docketry.llm.common import by_bytes, table

VOCABULARY = "byte_bpe_50k.json"
#: A worker remembers so many pieces at most.
REMEMBERED = 1 << 16
#: The pattern of byte-level pre-tokenizing; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
#: Leaves of the trees that merge in step.
CLASSES = (1, 2, 4, 8, 16, 32)
#: White space beside the space and the line feed.
ODD_SPACE = regex.compile(r"[^\S \n]").search


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 is itself, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.start = [0] * 256
        for i, b in self.pieces.items():
            if len(b) == 1:
                self.start[b[0]] = i
        #: pair of ids (left << 32 | right) -> (rank << 32, merged id)
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            pair = vocab[a] << 32 | vocab[b]
            self.rank[pair], self.made[pair] = r << 32, vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split: Callable[[str], list[str]] = regex.compile(PATTERN).findall
        of = [self.pieces.get(i, b"") for i in range(max(self.pieces) + 1)]
        self.blob = np.frombuffer(b"".join(of), np.uint8)
        self.lengths = np.array([len(x) for x in of], np.int32)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.known: dict[str, bytes] = {}
        self.pieces_known: dict[str, bytes] = {}
        order = sorted(self.rank)
        self.keys = np.array(order, np.int64)
        self.key_rank = np.array([self.rank[p] >> 32 for p in order], np.int64)
        self.made_by_rank = np.zeros(len(order) + 1, np.int64)
        self.made_by_rank[self.key_rank] = [self.made[p] for p in order]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.start[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        rank = self.rank.get
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = self.made

        def put(leaf: int, value: int) -> None:
            at = size + leaf
            if tree[at] == value:
                return
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                low = value if value < other else other
                if tree[at] == low:
                    return
                tree[at] = value = low

        while (low := tree[1]) != NONE:
            i = low & 0xFFFFFFFF
            j = after[i]
            ids[i] = x = made[ids[i] << 32 | ids[j]]
            k = after[i] = after[j]
            ids[j] = -1
            if k < n:
                before[k] = i
                r = rank(x << 32 | ids[k])
                put(i, NONE if r is None else r | i)
            elif i < n - 1:
                put(i, NONE)
            if j < n - 1:
                put(j, NONE)
            h = before[i]
            if h >= 0:
                r = rank(ids[h] << 32 | x)
                put(h, NONE if r is None else r | h)
        return [x for x in ids if x >= 0]

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """Ids of many pieces: one tree a row, all rows of a size class merging in step; long pieces go one by one."""
        out: list[bytes] = [b""] * len(raws)
        lens = np.array([len(r) for r in raws])
        for at in np.flatnonzero(lens > CLASSES[-1] + 1):
            out[at] = np.array(self.merge(raws[at]), "<u4").tobytes()
        least = 0
        for size in CLASSES:
            rows = np.flatnonzero((lens > least) & (lens <= size + 1))
            least = size + 1
            if len(rows):
                flat, n = self.merge_class([raws[i] for i in rows], lens[rows], size)
                ends = np.cumsum(n) * 4
                data = flat.astype("<u4").tobytes()
                for i, end, k in zip(rows.tolist(), ends.tolist(), n.tolist(), strict=True):
                    out[i] = data[end - 4 * k : end]
        return out

    def ranked(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaves of pairs: rank << 32 | place, or NONE."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & (right >= 0), self.key_rank[at] << 32 | place, NONE)

    def merge_class(self, raws: list[bytes], lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        m, width = len(raws), size + 1
        cells = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(m, width)
        places = np.arange(width)
        ids = np.full((m, width + 1), -1, np.int64)
        ids[:, :width] = np.where(places < lens[:, None], np.array(self.start)[cells], -1)
        tree = np.full((m, 2 * size), NONE, np.int64)
        tree[:, size:] = self.ranked(ids[:, :size], ids[:, 1:width], places[:size])
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after = np.tile(np.arange(1, width + 2), (m, 1))
        before = np.tile(np.arange(-1, width), (m, 1))

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            tree[rows, size + leaf] = value

        def lift(rows: np.ndarray, leaf: np.ndarray) -> None:
            at = size + leaf
            for _ in range(size.bit_length() - 1):
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        r = np.flatnonzero(tree[:, 1] < NONE)
        while len(r):
            low = tree[r, 1]
            i = low & 0xFFFFFFFF
            j = after[r, i]
            x = self.made_by_rank[low >> 32]
            k = after[r, j]
            ids[r, i], ids[r, j], after[r, i] = x, -1, k
            k = np.minimum(k, width)
            before[r, k] = np.where(k < width, i, before[r, k])
            last = i >= size  # no leaf: the pair would begin at the last cell
            put(r[~last], i[~last], self.ranked(x, ids[r, k], i)[~last])
            inner = j < size
            put(r[inner], j[inner], NONE)
            h = before[r, i]
            has = h >= 0
            rh, hh = r[has], h[has]
            put(rh, hh, self.ranked(ids[rh, hh], x[has], hh))
            lift(r[~last], i[~last])
            lift(r[inner], j[inner])
            lift(rh, hh)
            r = r[tree[r, 1] < NONE]
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def learn(self, units: set[str], known: dict[str, bytes], prefix: str) -> None:
        """Puts the ids of prefix + unit into known."""
        cut = []
        for u in units:
            if u.isalpha():  # one piece, as the pattern's letters are those of isalpha()
                cut.append((u, (prefix + u,)))
            elif u[:-1].isalpha() and u[-1] in ",.":
                cut.append((u, (prefix + u[:-1], u[-1])))
            else:
                cut.append((u, self.split(prefix + u)))
        new = list({p for _, pieces in cut for p in pieces} - self.pieces_known.keys())
        self.pieces_known.update(zip(new, self.merge_many([p.encode() for p in new]), strict=True))
        ids = self.pieces_known.__getitem__
        for u, pieces in cut:
            known[u] = b"".join(map(ids, pieces))

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens. Where a space surely begins a piece, texts are cut at spaces and pieces looked up."""
        for known in (self.known, self.pieces_known):
            if len(known) > REMEMBERED:
                for old in list(known)[: len(known) - REMEMBERED // 2]:
                    del known[old]
        cut, whole = [], set()
        for t in texts:
            if "  " in t or "\n " in t or t.endswith(" ") or ODD_SPACE(t):
                whole.add(t)
                cut.append(None)
            else:
                cut.append(t.split(" "))
        firsts = {c[0] for c in cut if c} | whole
        begins: dict[str, bytes] = {}
        self.learn(firsts, begins, "")
        units = set()
        for c in cut:
            if c:
                units.update(c[1:])
        self.learn(units - self.known.keys(), self.known, " ")
        ids = self.known.__getitem__
        out = [begins[t] if c is None else begins[c[0]] + b"".join(map(ids, c[1:])) for t, c in zip(texts, cut, strict=True)]
        for long in [u for u in units if len(u) > 64]:
            del self.known[long]
        for long in [p for p in self.pieces_known if len(p) > 64]:
            del self.pieces_known[long]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts, counts = [], []
        for t in texts:
            own = self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t]
            counts.append(len(own))
            parts += own
        ids = iter(self.plain(["" if p in self.special else p for p in parts]))
        texts_ids, at = [], 0
        for n in counts:
            texts_ids.append(b"".join(np.array([self.special[p]], "<u4").tobytes() + next(ids) if p in self.special else next(ids) for p in parts[at : at + n]))
            at += n
        return texts_ids

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode_many(self, ids: list[bytes]) -> list[str]:
        """Texts of id strings; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for text_ids in ids:
            x = np.frombuffer(text_ids, "<u4")
            n = self.lengths[x]
            ends = np.cumsum(n)
            places = np.repeat(self.starts[x] - ends + n, n) + np.arange(ends[-1] if len(x) else 0)
            out.append(self.blob[places].tobytes().decode("utf-8", "replace"))
        return out

    def decode(self, ids: bytes) -> str:
        return self.decode_many([ids])[0]


@cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Without Python's search for reference cycles, which would walk the tables of pieces again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def kind(rows: DataFrame) -> str:
    """The type of doc_id, which is kept."""
    return rows.schema["doc_id"].dataType.simpleString()


def digests(path: str | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text): n_tokens and digests of ids and decoded text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for batch in by_bytes(batches, "text", 1 << 20):
            n, ids_hash, text_hash = [], [], []
            with no_cycles():
                coded = bpe.encode_many([t or "" for t in batch.column("text").to_pylist()])
            for ids, decoded in zip(coded, bpe.decode_many(coded), strict=True):
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the tokens themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for batch in by_bytes(batches, "text", 1 << 20):
            ids = [np.frombuffer(x, "<i4") for x in bpe.encode_many([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind(docs)}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of encode()'s rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind(tokens)}, text string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(digests(path), f"doc_id {kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
