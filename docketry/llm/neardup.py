"""Near-duplicates by a chosen-path set similarity join over minwise sketches.

Texts with equal shingle sets form a class; from here on only one row per class counts.

1. Candidates, from sketches alone. TREES independent trees branch the classes: a node picks minwise coordinates
   (1 / threshold of them on average), and a class goes to the child of its token at each. Nodes of one class
   end. Classes of a node of up to WHOLE classes are compared exhaustively by their 128-bit sketches, which drop
   pairs far below the threshold (5 standard deviations). A larger node gives a star around its medoid, and branches
   again without what is so near the medoid that all it may be linked with is in the star; one that STALLS times
   has not been parted is compared whole, a pair of blocks of MOST classes a task. Each comparison gives edges that
   join its near sketches, as many as classes at most; their components are the families.
2. Links, on full sets. A family's texts go to one task, once. A family of over TILE_BYTES is cut into blocks: each is
   compared in itself and with PIVOTS classes of the whole family; then pairs of blocks compare sketches, and only classes
   with a near one in another component send their texts to meet. Connected classes need no further comparison, so that
   large groups of near copies cost little more than a star.

At similarity 0.8 a pair's sketches, which all trees share, differ too much to be compared with probability 2.4e-6 (64 coordinates
of two bits, 15 % of which differ); beyond that 16 trees miss a pair of a small group with probability under 1e-12, one of a large
group under 1e-4 (of a pair that no other document connects). Joins with texts first drop what a bitmap of
bounded size tells apart, so that only texts of families move.

Every row is a document of its own, also with a null doc_id or one that others share: its text alone says what it links
with. Defined cases: null or wordless text has an empty set and links with nothing; fewer words than K are one
shingle. component_id is the smallest doc_id that is not null of the component, null if there is none, and kept says
whether doc_id equals it; drop_near_duplicates keeps exactly one row of each component. Doc_ids that aren't whole
numbers, repeated and null ones cost one more copy of the table. All other columns are kept, whatever their names.
Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import by_bytes, components, cut, gather, mix64, numbered, screened, split_words, table, windows, word_codes

K, PERCENT, COORDINATES, TREES, LEAF, SAMPLES, PIVOTS = 4, 80, 64, 16, 32, 8, 8
#: Sketches of a block, and of a node that does not branch; a child with over 1 - 1 / PARTED of its parent's classes has not parted it.
MOST, WHOLE, STALLS, PARTED = 4096, 4096, 4, 10
#: Of 64 two-bit coordinates a pair at the threshold differs in 9.6 on average, standard deviation 2.9.
MOST_DIFFERENT = 24
#: Classes that differ from a medoid in so many coordinates at most are its family. Differences are a metric: what
#: differs in FAMILY_DIFFERENT - MOST_DIFFERENT at most has all its near sketches in the family.
FAMILY_DIFFERENT, TILE_BYTES, ROW_BYTES = 32, 4 << 20, 1024


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()], np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The set of hashed k-word shingles of each text, sorted; letters A-Z in lower case."""
    offsets, words = split_words(texts, lower=True)
    codes, distinct = word_codes(words)
    hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    starts, grams = windows(hashes, offsets, k)
    cuts = np.searchsorted(starts, offsets)
    out = []
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if hi > lo:
            out.append(np.unique(grams[lo:hi]))
        elif offsets[i + 1] > offsets[i]:
            n = offsets[i + 1] - offsets[i]
            out.append(windows(hashes[offsets[i] : offsets[i + 1]], np.array([0, n]), int(n), seed=100 + int(n))[1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_random = np.random.default_rng(17)
FACTORS = _random.integers(0, 1 << 63, (COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, (COORDINATES, 1), dtype=np.uint64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima of a set, in blocks of bounded memory."""
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 8192):
        best = np.minimum(best, ((FACTORS * shingles[at : at + 8192] + SHIFTS) >> np.uint64(32)).min(axis=1))
    return best.astype("<u4")


def two_bits(minima: np.ndarray) -> np.ndarray:
    """Two 64-bit words of two bits per coordinate, for each row of minima."""
    bits = (minima & 3).astype(np.uint64).reshape(len(minima), 2, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def sketch(rows: DataFrame, k: int) -> DataFrame:
    """(row, n_shingles, size, fp, s1, s2, minima) of rows (row, text): size is the text's bytes, fp a 128-bit digest of the whole set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column("text"), k)
            minima = np.stack([minwise(s) for s in sets])
            s = two_bits(minima)
            fp = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([len(x) for x in sets], pa.int64()), pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()), pa.array(fp, pa.binary()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array([m.tobytes() for m in minima], pa.binary())],
                names=["row", "n_shingles", "size", "fp", "s1", "s2", "minima"],
            )

    return rows.select("row", "text").mapInArrow(run, "row long, n_shingles long, size long, fp binary, s1 long, s2 long, minima binary")


def children(nodes: np.ndarray, minima: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row places, child nodes): one coordinate of each node, and for 1 / threshold - 1 of the nodes a second."""
    seeds = mix64(nodes)
    for turn in range(2):
        pick = mix64(seeds + np.uint64(turn + 1))
        at = np.arange(len(nodes)) if turn == 0 else np.flatnonzero(pick % np.uint64(PERCENT) < 100 - PERCENT)
        coordinate = (mix64(pick) % np.uint64(COORDINATES)).astype(np.int64)[at]
        yield at, mix64(mix64(seeds[at] + coordinate.astype(np.uint64)) + minima[at, coordinate].astype(np.uint64))


def branch(rows: DataFrame, trees: int | None = None) -> DataFrame:
    """(node, rep, s1, s2) of the children of the trees' roots; of the rows' own nodes also (parent, stalled, stars)."""
    kept = ("rep", "s1", "s2") if trees else ("rep", "s1", "s2", "parent", "stalled", "stars")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), "<u4").reshape(batch.num_rows, COORDINATES)
            if trees:
                starts = [np.full(batch.num_rows, r + 1, np.uint64) for r in range(trees)]
            else:
                starts = [batch.column("node").to_numpy().view(np.uint64)]
            for nodes in starts:
                for at, child in children(nodes, minima):
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(part.column(c) for c in kept)], names=["node", *kept])

    return rows.mapInArrow(run, "node long, " + ", ".join(f"{c} long" for c in kept))


def differing(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Coordinates in which two sketches differ."""

    def count(x: Column) -> Column:
        return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return count(a1.bitwiseXOR(b1)) + count(a2.bitwiseXOR(b2))


def different(*names: str) -> Column:
    return differing(*map(F.col, names))


def medoids(nodes: DataFrame) -> DataFrame:
    """(node, a, p1, p2): of each node the class that is nearest, in sum, to a few random ones of it."""
    some = nodes.groupBy("node", F.pmod(F.xxhash64("rep"), F.lit(SAMPLES)).alias("g")).agg(F.min_by(F.struct("s1", "s2"), F.xxhash64("node", "rep")).alias("x"))
    some = cut(some.groupBy("node").agg(F.collect_list("x").alias("xs")))
    off = F.aggregate("xs", F.lit(0), lambda t, x: t + differing(F.col("s1"), F.col("s2"), x["s1"], x["s2"]))
    return cut(nodes.join(some, "node").withColumn("off", off).groupBy("node").agg(F.min(F.struct("off", "rep", "s1", "s2")).alias("p")).select("node", F.col("p.rep").alias("a"), F.col("p.s1").alias("p1"), F.col("p.s2").alias("p2")))


def off_by(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates in which rows of sketches (two words each) differ."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.uint8)


def roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, after pairs (i, j) have joined components of root."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.arange(len(root))
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
        root = low[root]


def near_sketches(pdf: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: edges (a, b) that join, within each node, all classes with near sketches; in a tile of two blocks, those of pairs across."""
    pdf = pdf.sort_values(["node", "rep"], ignore_index=True)
    node, rep, own = (pdf[c].to_numpy() for c in ("node", "rep", "block"))
    across = (pdf["low"] != pdf["high"]).to_numpy()
    s = pdf[["s1", "s2"]].to_numpy().view(np.uint64)
    root, starts = np.arange(len(pdf)), np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
    sizes = np.diff(starts)
    small = np.repeat(sizes <= LEAF, sizes)
    for lag in range(1, min(LEAF, int(sizes.max()))):  # small nodes, all at once
        i = np.flatnonzero((node[:-lag] == node[lag:]) & small[:-lag])
        i = i[off_by(s[i], s[i + lag]) <= MOST_DIFFERENT]
        i = i[~across[i] | (own[i] != own[i + lag])]
        root = roots(root, i, i + lag)
    for lo, hi in zip(starts[:-1][sizes > LEAF].tolist(), starts[1:][sizes > LEAF].tolist(), strict=True):
        for at in range(lo, hi, 256):
            end = min(at + 256, hi)
            near = (off_by(s[at:end, None], s[None, at:hi]) <= MOST_DIFFERENT) & (root[at:end, None] != root[None, at:hi])
            if across[lo]:
                near &= own[at:end, None] != own[None, at:hi]
            i, j = np.nonzero(near)
            root = roots(root, i + at, j + at)
    joined = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": rep[root[joined]], "b": rep[joined]})


def compare_nodes(rows: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) of near sketches within nodes, from rows (node, n, rep, s1, s2): nodes of up to `most` classes share tasks, of larger ones each pair of blocks is a task's."""
    some = rows.where(F.col("n") <= most).count()
    laid = rows.withColumn("blocks", F.ceil(F.col("n") / most)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    laid = laid.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("node"), F.lit(some // (2 * most) + 1))).otherwise(F.xxhash64("node", low, high))
    return laid.select(tile.alias("tile"), "node", low.alias("low"), high.alias("high"), "block", "rep", "s1", "s2").groupBy("tile").applyInPandas(near_sketches, "a long, b long")


def candidates(classes: DataFrame, trees: int = TREES, most: int = MOST, whole: int = WHOLE) -> DataFrame:
    """Edges (a, b) between classes (rep, s1, s2, minima); classes with near sketches that share a node are joined by edges.

    A pair is in a star, or both its classes branch on; a child gives nothing if one star (a bit of `stars` for each level) holds all of it.
    """
    found, level, many = None, 0, classes.count()
    zeros = [F.lit(0).cast("long").alias(c) for c in ("parent", "stalled", "stars")]
    rows = branch(classes.select("rep", "s1", "s2", "minima"), trees).select("*", *zeros)
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_and("stars").alias("all"), F.max("parent").alias("p"), F.max("stalled").alias("t"))
        same = (F.col("p") > 0) & (F.col("n") * PARTED > F.col("p") * (PARTED - 1))
        sizes = cut(sizes.where("n > 1 and all = 0").select("node", "n", F.when(same, F.col("t") + 1).otherwise(0).alias("t")), 64 * many)
        many = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = cut(rows.join(sizes.hint("merge"), "node").select("node", "n", "t", "rep", "s1", "s2", "stars"), 48 * many)
        ends = (F.col("n") <= whole) | (F.col("t") >= STALLS)
        edges = compare_nodes(rows.where(ends), most)
        large = rows.where(~ends)
        any_large = bool(large.head(1))
        if any_large:
            large = cut(large, 48 * many)
            star = cut(large.join(medoids(large), "node").withColumn("off", different("s1", "s2", "p1", "p2")), 72 * many)
            edges = edges.union(star.where((F.col("off") <= FAMILY_DIFFERENT) & (F.col("rep") != F.col("a"))).select("a", F.col("rep").alias("b")))
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), 16 * many)
        found = edges if found is None else found.union(edges)
        if not any_large:
            return found
        held = F.when(F.col("off") <= FAMILY_DIFFERENT, 1 << level if level < 62 else 0).otherwise(0).cast("long")
        apart = star.where(F.col("off") > FAMILY_DIFFERENT - MOST_DIFFERENT).select("node", "rep", "s1", "s2", F.col("n").alias("parent"), F.col("t").cast("long").alias("stalled"), F.col("stars").bitwiseOR(held).alias("stars"))
        rows = cut(branch(apart.join(classes.select("rep", "minima"), "rep").select("node", "rep", "s1", "s2", "parent", "stalled", "stars", "minima")), 72 * many)
        level += 1


def linked(sets: list[np.ndarray], sketches: np.ndarray, label: np.ndarray, own: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join all components of label (0 .. n - 1 in any order) which links between rows of one family connect.

    A row is compared only with near sketches of other components, and with many at once through the rows of each of its shingles.
    """
    n, links = len(sets), []
    near = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        near[at : at + 256] = off_by(sketches[at : at + 256, None], sketches[None]) <= MOST_DIFFERENT
    near &= label[:, None] != label[None]
    if across:
        near &= own[:, None] != own[None]
    size = np.array([len(x) for x in sets])
    holders = None
    for i in np.argsort(-near.sum(axis=1), kind="stable").tolist():
        rest = np.flatnonzero(near[i] & (label != label[i]))
        if not len(rest):
            continue
        if len(rest) > 4 and holders is None:  # the rows that hold each shingle
            code = np.unique(np.concatenate(sets), return_inverse=True)[1]
            holders = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")]
            counts = np.bincount(code)
            starts, bounds = np.cumsum(counts) - counts, np.cumsum(size) - size
        if len(rest) > 4:
            mine = code[bounds[i] : bounds[i] + size[i]]
            both = np.bincount(holders[gather(starts[mine], counts[mine])], minlength=n)[rest]
        else:
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in rest.tolist()])
        for j in rest[(100 * both >= percent * (size[i] + size[rest] - both)) & (both > 0)].tolist():
            if label[i] != label[j]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def compare_tile(k: int, percent: int):
    """For applyInPandas: links (a, b) that connect the rows of a tile within each family, from their full sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["family", "rep"], ignore_index=True)
        rep, family, own = (pdf[c].to_numpy() for c in ("rep", "family", "block"))
        component = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
        s = pdf[["s1", "s2"]].to_numpy().view(np.uint64)
        across = (pdf["low"] != pdf["high"]).to_numpy()
        starts, links = np.flatnonzero(np.r_[True, family[1:] != family[:-1], True]), []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            sets = shingle_sets(pa.array(pdf["text"].iloc[lo:hi], pa.large_string()), k)
            for i, j in linked(sets, s[lo:hi], component[lo:hi].copy(), own[lo:hi], bool(across[lo]), percent):
                links.append((rep[lo + i], rep[lo + j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def near_across(pdf: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas: the rows of two blocks with a near sketch of another component in the other block."""
    s, component, own = pdf[["s1", "s2"]].to_numpy().view(np.uint64), pdf["component"].to_numpy(), pdf["block"].to_numpy()
    met = np.zeros(len(pdf), bool)
    for at in range(0, len(pdf), 256):
        part = slice(at, at + 256)
        near = (off_by(s[part, None], s[None]) <= MOST_DIFFERENT) & (component[part, None] != component[None]) & (own[part, None] != own[None])
        met[part] = near.any(axis=1)
    return pdf[met]


LAID = "tile long, low long, high long, block long, family long, component long, rep long, s1 long, s2 long"


def compare_texts(laid: DataFrame, keyed: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among the rows of each tile of laid (LAID), whose texts come from keyed (row, text)."""
    texts = screened(keyed, "row", laid.select("rep")).where("may").select(F.col("row").alias("rep"), "text")
    return cut(texts.hint("merge").join(laid, "rep").groupBy("tile").applyInPandas(compare_tile(k, percent), "a long, b long"))


def family_links(edges: DataFrame, classes: DataFrame, keyed: DataFrame, k: int, percent: int, tile_bytes: int) -> DataFrame:
    """Links that connect what links between the classes of each component of edges connect."""
    families = components(edges).withColumnsRenamed({"id": "rep", "component": "family"})
    many = families.count()
    members = cut(families.join(classes.select("rep", "s1", "s2", (F.greatest(F.col("n_shingles") * 8, F.col("size")) + ROW_BYTES).alias("bytes")), "rep"), 40 * many)
    sizes = cut(members.groupBy("family").agg(F.sum("bytes").alias("bytes")).withColumn("blocks", F.ceil(F.col("bytes") / tile_bytes)), 24 * many)
    about = sizes.agg(F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("bytes"))), F.lit(0)).alias("small"), F.coalesce(F.max("blocks"), F.lit(0)).alias("most")).first()
    laid = members.join(sizes.select("family", "blocks"), "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    laid = cut(laid.select("rep", "family", "s1", "s2", "blocks", "block"), 48 * many)
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(int(about["small"]) // tile_bytes + 1))).otherwise(F.xxhash64("family", "block"))
    columns = [x.split()[0] for x in LAID.split(", ")]
    alone = laid.select(tile.alias("tile"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "block", "family", F.col("rep").alias("component"), "rep", "s1", "s2")
    if about["most"] <= 1:
        return compare_texts(alone, keyed, k, percent)
    large = laid.where("blocks > 1")
    spread = large.groupBy("family", "blocks", F.pmod(F.xxhash64("rep", "family"), F.lit(PIVOTS)).alias("g")).agg(F.min_by(F.struct("rep", "s1", "s2", "block"), F.xxhash64("rep")).alias("x"))
    spread = spread.select("family", "x.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).where("other <> block").withColumn("component", F.col("rep"))
    spread = spread.select(F.xxhash64("family", "other").alias("tile"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "block", "family", "component", "rep", "s1", "s2")
    first = compare_texts(alone.union(spread), keyed, k, percent)
    known = components(first.join(large.select(F.col("rep").alias("a")), "a"))
    parts = cut(large.join(known.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), 56 * many)
    several = parts.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("family")
    pairs = parts.join(cut(several, 0), "family").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    pairs = pairs.select(F.xxhash64("family", low, high).alias("tile"), low.alias("low"), high.alias("high"), "block", "family", "component", "rep", "s1", "s2")
    met = cut(pairs.groupBy("tile").applyInPandas(near_across, LAID)).select(*columns)
    return first.union(compare_texts(met, keyed, k, percent))


def grouped(keyed: DataFrame, k: int = K, percent: int = PERCENT, trees: int = TREES, whole: int = WHOLE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(row, n_shingles, root) of keyed (row, text): root is the smallest row of the component."""
    rows = cut(sketch(keyed, k))
    classes = rows.where("n_shingles > 0").groupBy("fp").agg(F.min("row").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "s1", "s2", "minima")), F.max("size").alias("size"))
    classes = cut(classes, 320 * rows.count())
    links = family_links(candidates(classes, trees, min(MOST, whole), whole), classes, keyed, k, percent, tile_bytes)
    merged = components(links)
    reps = classes.select("fp", "rep").join(merged.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = rows.select("row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp")).join(reps, "fp", "left")
    return cut(out.select("row", "n_shingles", F.coalesce("component", "row").alias("root")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    keyed, plain = numbered(docs.select("doc_id", "text"), "doc_id")
    found = grouped(keyed.select("row", F.col("doc.text").alias("text")), **options)
    if plain:
        ident = docs.schema["doc_id"].dataType
        return found.select(F.col("row").cast(ident).alias("doc_id"), "n_shingles", F.col("root").cast(ident).alias("component_id"), (F.col("row") == F.col("root")).alias("kept"))
    ids = keyed.select("row", F.col("doc.doc_id").alias("doc_id"))
    found = found.join(ids, "row").join(ids.select(F.col("row").alias("root"), F.col("doc_id").alias("component_id")), "root")
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, **options) -> DataFrame:
    """The rows of docs but for all except one of each component, the one of smallest doc_id; columns as they were."""
    keyed, _ = numbered(docs, "doc_id")
    gone = cut(grouped(keyed.select("row", F.col("doc.text").alias("text")), k, percent, **options).where("row <> root").select("row"))
    marked = screened(keyed, "row", gone)
    checked = marked.where("may").hint("merge").join(gone, "row", "left_anti")
    return marked.where("not may").select("doc.*").union(checked.select("doc.*"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.both >= 80 * (na.n + nb.n - p.both)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
